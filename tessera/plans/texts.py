"""Text, URL and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text, urls
from ..sources import pages
from .common import SQL_WORDS, table

_RAW = """SELECT client_id AS id, concat(CASE client_id % 5 WHEN 0 THEN 'Công ty TNHH ' WHEN 1 THEN 'CUA HANG ' WHEN 2 THEN 'Quán  Phở, ' ELSE '' END, coalesce(name, '')) AS name,
CASE client_id % 6 WHEN 0 THEN concat('0901', lpad(CAST(client_id AS string), 6, '0')) WHEN 1 THEN concat('+84 901-', lpad(CAST(client_id AS string), 6, '0')) WHEN 2 THEN concat('0084 (28) ', lpad(CAST(client_id AS string), 7, '0')) WHEN 3 THEN concat('12', client_id % 10) WHEN 4 THEN lpad(CAST(client_id AS string), 9, '7') END AS phone,
concat(CASE client_id % 3 WHEN 0 THEN 'HTTPS://www.' WHEN 1 THEN 'http://' ELSE '' END, split_part(coalesce(email, ''), '@', 2), CASE WHEN client_id % 2 = 0 THEN '/a/?x=1' ELSE '#top' END) AS site,
CASE client_id % 5 WHEN 0 THEN 'OPERATIONAL' WHEN 1 THEN 'Đã đóng cửa' WHEN 2 THEN 'temporarily closed - repairs' WHEN 3 THEN segment END AS status FROM clients"""
_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"


def name_forms(rows):
    """rows (id, name, phone, site, status) in their plain forms."""
    n = text.norm_name(F.col("name"))
    return rows.select("id", n.alias("name"), text.name_signature(n).alias("signature"), text.norm_phone(F.col("phone")).alias("phone"), F.nullif(urls.website_domain(F.col("site")), F.lit("")).alias("domain"), text.norm_status(F.col("status")).alias("status"))


@query("name_normalisation", rf"""WITH r AS ({_RAW.replace("AS string)", "AS VARCHAR)")}), f AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(lower(coalesce(name, ''))), 'đ', 'd'), '^(?:(?:cong ty|tnhh|cua hang|quan)(?:[\s.\-,:]+|$))+', ''), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS n, {_DIGITS} AS d FROM r),
p AS (SELECT *, CASE WHEN starts_with(d, '00') THEN substr(d, 3) WHEN starts_with(d, '84') THEN d WHEN starts_with(d, '0') THEN concat('84', substr(d, 2)) WHEN length(d) > 10 THEN d WHEN d <> '' THEN concat('0', d) END AS full_d FROM f)
SELECT id, n AS name, array_to_string(list_sort(list_filter(string_split(n, ' '), lambda t: t <> '')), ' ') AS signature, CASE WHEN length(full_d) BETWEEN 8 AND 13 THEN concat('+', full_d) END AS phone, nullif(regexp_replace(lower(regexp_extract(site, '^(?:[A-Za-z]+://)?([^/?#]*)', 1)), '^www\.', ''), '') AS domain,
CASE lower(status) WHEN 'operational' THEN 'open' WHEN 'đã đóng cửa' THEN 'permanently_closed' WHEN 'temporarily closed - repairs' THEN 'temporarily_closed' END AS status FROM p""")
def name_normalisation(spark, sf_dir):
    """Folding of names, phones, sites and statuses."""
    table(spark, sf_dir, "clients").createOrReplaceTempView("tessera_clients")
    return name_forms(spark.sql(_RAW.replace("FROM clients", "FROM tessera_clients")))


@query("document_text_stats", f"SELECT doc_id, len({SQL_WORDS.format(x='text')}) AS words, len(list_distinct({SQL_WORDS.format(x='text')})) AS distinct_words, substr(sha256(text), 1, 16) AS digest16, concat('doc_', substr(sha256(text), 1, 12)) AS doc_key FROM documents")
def document_text_stats(spark, sf_dir):
    """X23, X44, X62, X65, K26, A09."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.words(t)).cast("long").alias("words"), F.size(F.array_distinct(text.words(t))).cast("long").alias("distinct_words"), text.short_hash(t, 16).alias("digest16"), F.concat(F.lit("doc_"), text.short_hash(t, 12)).alias("doc_key"))


@query("exact_fingerprints", "SELECT sha256(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_fingerprints(spark, sf_dir):
    """Groups of identical content."""
    d = table(spark, sf_dir, "documents").groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return d.where("copies > 1")


@query("query_coverage", f"""WITH q AS (SELECT item_id, list_distinct(list_filter({SQL_WORDS.format(x='text')}, lambda t: length(t) > 1)) AS w FROM benchmark), qw AS (SELECT item_id, len(w) AS n, unnest(w) AS word FROM q),
dw AS (SELECT DISTINCT doc_id, unnest({SQL_WORDS.format(x='text')}) AS word FROM documents)
SELECT item_id, doc_id, round(count(*) / any_value(n), 9) AS coverage FROM qw JOIN dw USING (word) GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.5""")
def query_coverage(spark, sf_dir):
    """Documents that cover half of a query's words, by an equality join on words."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.filter(text.words(F.col("text")), lambda t: F.length(t) > 1)).alias("w"))
    qw = q.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    dw = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("word")).join(qw.select("word").distinct(), "word", "left_semi")
    out = qw.join(dw, "word").groupBy("item_id", "doc_id").agg((F.count("*") / F.first("n")).alias("coverage"))
    return out.where("coverage >= 0.5").select("item_id", "doc_id", F.round("coverage", 9).alias("coverage"))


@query("fixed_chunks", "WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 600)) AS start FROM documents) SELECT doc_id, concat(doc_id, '#p_', printf('%03d', start // 600)) AS passage_id, start, length(substr(text, start + 1, 800)) AS n, md5(substr(text, start + 1, 800)) AS digest FROM s")
def fixed_chunks(spark, sf_dir):
    """X29, K27."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.fixed_chunks(F.col("text"))).alias("i", "c"))
    return d.select("doc_id", F.concat(F.col("doc_id"), F.lit("#p_"), F.format_string("%03d", F.col("i"))).alias("passage_id"), F.col("c.start").alias("start"), F.length("c.text").alias("n"), F.md5(F.encode("c.text", "UTF-8")).alias("digest"))


@query("offset_passages", "WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 800) / 600.0) AS INT), 0) * 600 + 1, 600)) AS start FROM documents WHERE length(text) > 0) SELECT doc_id, start, least(start + 800, length(text)) AS stop, md5(substr(text, start + 1, 800)) AS digest FROM s")
def offset_passages(spark, sf_dir):
    """X30."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.offset_passages(F.col("text"))).alias("c"))
    return d.select("doc_id", F.col("c.start").alias("start"), F.col("c.end").alias("stop"), F.md5(F.encode("c.text", "UTF-8")).alias("digest"))


@query("sentence_counts", r"SELECT doc_id, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')) AS sentences FROM documents")
def sentence_counts(spark, sf_dir):
    """X25, X27."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("number_mentions", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')[1:10], '|') AS numbers FROM documents WHERE regexp_matches(text, '[0-9]')")
def number_mentions(spark, sf_dir):
    """X33."""
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", F.array_join(text.numbers(F.col("text")), "|").alias("numbers"))


@query("phrase_and_title", f"""WITH q AS (SELECT item_id, text AS body, list_filter({SQL_WORDS.format(x='text')}, lambda t: t NOT IN ({', '.join(repr(w) for w in text.STOPWORDS)})) AS w FROM benchmark)
SELECT item_id, round(least(list_sum(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: CASE WHEN contains(lower(body), array_to_string(w[i:i + 2], ' ')) THEN 0.15 ELSE 0 END)) + list_sum(list_transform(range(1, greatest(len(w), 1)), lambda i: CASE WHEN contains(lower(body), array_to_string(w[i:i + 1], ' ')) THEN 0.10 ELSE 0 END)), 0.3), 9) AS bonus FROM q WHERE len(w) >= 3""")
def phrase_and_title(spark, sf_dir):
    """Each query against its own text."""
    b = table(spark, sf_dir, "benchmark").where(F.size(text.tokenize(F.col("text"))) >= 3)
    return b.select("item_id", F.round(text.phrase_bonus(F.col("text"), F.col("text")), 9).alias("bonus"))


@query("url_forms", r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages)
SELECT page_id, regexp_replace(lower(h), '^(?:www\.)+', '') AS domain, regexp_replace(regexp_replace(lower(regexp_replace(url, '#.*$', '')), '^https?://(?:www\.)?', ''), '/+$', '') AS eval_url FROM u""")
def url_forms(spark, sf_dir):
    """X20, X21, J17."""
    p, u = table(spark, sf_dir, "pages"), F.col("url")
    return p.select("page_id", urls.normalize_domain(urls.host(u)).alias("domain"), urls.eval_url(u).alias("eval_url"))


_ADDRESSES = "SELECT page_id AS id, CASE WHEN page_id % 7 = 0 THEN concat('http://10.0.0.', page_id % 250, '/x/', page_id) WHEN page_id % 11 = 0 THEN concat('https://casino-win.xyz/a/b/c/d/e/f/g/', page_id) WHEN page_id % 5 = 0 THEN concat(replace(url, '.example.', '.EXAMPLE.com.vn/'), '?b=2&UTM_source=x&a=', page_id % 9) WHEN page_id % 13 = 0 THEN concat(' not a url ', page_id) ELSE url END AS url FROM pages"


def url_columns(rows):
    """rows (id, url): canonical and identifying forms, the registered domain, whether the host is a private one, tenths of a spam score."""
    u = F.col("url")
    h = urls.host(u)
    return rows.select("id", urls.canonical_url(u).alias("canonical"), urls.identity(u).alias("identity"), urls.registrable_domain(h).alias("registrable"), urls.private_host(h).cast("int").alias("private"), F.round(urls.spam_score(h, urls.path(u)) * 10).cast("int").alias("spam_tenths"))


_TRACKING = ", ".join(f"'{p}'" for p in urls.TRACKING)


@query("url_canonical", rf"""WITH u AS ({_ADDRESSES}), a AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda t: t <> '' AND lower(split_part(t, '=', 1)) NOT IN ({_TRACKING}))) AS q FROM u),
b AS (SELECT *, string_split(regexp_replace(h, '^(?:www\.)+', ''), '.') AS l, concat(regexp_replace(h, '^(?:www\.|m\.)', ''), regexp_replace(p, '/+$', ''), CASE WHEN len(q) > 0 THEN concat('?', array_to_string(q, '&')) ELSE '' END) AS rest FROM a)
SELECT id, CASE WHEN h = '' THEN trim(url) ELSE concat(regexp_extract(url, '^[a-z]+://'), rest) END AS canonical, CASE WHEN h = '' THEN trim(url) ELSE rest END AS identity, array_to_string(l[-(CASE WHEN l[-1] = 'vn' AND l[-2] = 'com' THEN 3 ELSE 2 END):], '.') AS registrable,
CAST(starts_with(h, '10.') AS INT) AS private, CAST(5 * CAST(contains(h, 'casino') AS INT) + greatest(len(string_split(p, '/')) - 6, 0) + 2 * CAST(ends_with(h, '.xyz') AS INT) AS INT) AS spam_tenths FROM b""")
def url_canonical(spark, sf_dir):
    """X17, X18, X22, F19-F21."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("tessera_pages")
    return url_columns(spark.sql(_ADDRESSES.replace("FROM pages", "FROM tessera_pages")))


@query("page_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"'']+)', 1)) AS href FROM pages)
SELECT page_id, count(DISTINCT href) AS links FROM l WHERE regexp_matches(href, '^https?://') GROUP BY 1""")
def page_links(spark, sf_dir):
    """Absolute links, each once."""
    return pages.links(table(spark, sf_dir, "pages")).where(F.col("href").rlike("^https?://")).groupBy("page_id").agg(F.countDistinct("href").alias("links"))


@query("page_titles", r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, lower(regexp_extract(html, '(?i)<html[^>]*\slang\s*=\s*["'']?([A-Za-z]+)', 1)) AS lang FROM pages""")
def page_titles(spark, sf_dir):
    """X46, X47."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", pages.title(h).alias("title"), pages.html_language(h).alias("lang"))


@query("page_images", r"""WITH l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)<img\s[^>]*src\s*=\s*["'']([^"'']+)', 1))) AS src FROM pages)
SELECT page_id, src, md5(concat(url, ':', src)) AS image_id FROM l WHERE NOT regexp_matches(src, '^(?:data|blob):')""")
def page_images(spark, sf_dir):
    """S42."""
    return pages.images(table(spark, sf_dir, "pages")).select("page_id", "src", "image_id")


_HALF = "bit_count(xor(CAST('0x' || substr(h, {0}, 8) AS UBIGINT), CAST('0x' || substr(p, {0}, 8) AS UBIGINT)))"


@query("hamming_pairs", f"WITH d AS (SELECT doc_id, substr(sha256(text), 1, 16) AS h, lag(substr(sha256(text), 1, 16)) OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS p FROM documents) SELECT doc_id, CAST({_HALF.format(1)} + {_HALF.format(9)} AS INT) AS bits FROM d WHERE p IS NOT NULL")
def hamming_pairs(spark, sf_dir):
    """Documents against the one before of their source and block of a thousand ids, bits between their 16-digit digests."""
    from pyspark.sql.window import Window

    d = table(spark, sf_dir, "documents").select("doc_id", "source", text.short_hash(F.col("text"), 16).alias("h"))
    prior = F.lag("h").over(Window.partitionBy("source", F.expr("doc_id div 1000")).orderBy("doc_id"))
    return d.withColumn("p", prior).where("p is not null").select("doc_id", text.hamming(F.col("h"), F.col("p")).alias("bits"))
