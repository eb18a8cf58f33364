"""Passages, answers and businesses; scans of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import addresses, business, labels, spans, text
from ..operators import synthesis
from .common import SQL_WORDS, table
from .understanding import _ASKED, _asked

_STOP = ", ".join(f"'{w}'" for w in text.CLAIM_STOPWORDS)


def _view(spark, sf_dir, *names):
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(f"tessera_{n}")


def _sql(spark, statement):
    out = statement
    for n in ("documents", "conversations", "pages", "part", "benchmark", "customer", "supplier", "events", "orders", "lineitem", "nation", "region"):
        out = out.replace(f"FROM {n}", f"FROM tessera_{n}").replace(f"JOIN {n}", f"JOIN tessera_{n}")
    return spark.sql(out)


_PASSAGES = "SELECT doc_id % 20 AS query_id, CAST(doc_id AS int) AS pos, concat('https://', source, '.com/', doc_id % 7) AS source_url, CASE WHEN doc_id % 5 > 0 THEN concat('T', doc_id) END AS title, CAST(doc_id % 9 AS int) AS chunk_index, text AS chunk_text, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 30 AS DOUBLE) / 20 END AS score FROM documents"


@query("passage_items", f"WITH p AS ({_PASSAGES}) SELECT query_id, printf('psg_%03d_%d', pos, chunk_index) AS item_id, coalesce(source_url, '') AS url, coalesce(title, '') AS title, md5(substr(trim(chunk_text), 1, 800)) AS quote, greatest(0.0, least(1.0, coalesce(score, 0.5))) AS support FROM p WHERE length(trim(coalesce(chunk_text, ''))) >= 50")
def passage_items(spark, sf_dir):
    """F36."""
    _view(spark, sf_dir, "documents")
    return synthesis.passage_items(_sql(spark, _PASSAGES)).withColumn("quote", F.md5(F.encode("quote", "UTF-8")))


_MARKDOWN = "SELECT doc_id % 20 AS query_id, CAST(doc_id AS int) AS pos, source AS url, lang AS title, replace(text, '. ', concat('.', chr(10), chr(10))) AS markdown FROM documents"


@query("paragraph_items", f"""WITH p AS ({_MARKDOWN}), s AS (SELECT *, list_filter(list_transform(string_split(markdown, chr(10) || chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1:3] AS parts FROM p WHERE markdown <> ''), j AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM s)
SELECT query_id, printf('src_%03d_%d', pos, i - 1) AS item_id, url, title, md5(substr(parts[i], 1, 500)) AS quote, 0.5 AS support FROM j WHERE length(parts[i]) >= 50""")
def paragraph_items(spark, sf_dir):
    """F37."""
    _view(spark, sf_dir, "documents")
    return synthesis.paragraph_items(_sql(spark, _MARKDOWN)).withColumn("quote", F.md5(F.encode("quote", "UTF-8")))


_CHUNKS = "SELECT doc_id % 40 AS query_id, doc_id * 7919 % 10007 AS rank, concat('T', doc_id % 3) AS title, concat('u', doc_id % 6) AS url, text FROM documents WHERE text IS NOT NULL"


@query("summaries", f"""WITH c AS ({_CHUNKS}), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM c QUALIFY n <= 5), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY rank) = 1 AS fresh, array_to_string(string_split(text, '. ')[1:3], '. ') AS short FROM t)
SELECT query_id, md5(string_agg(CASE WHEN fresh THEN concat('**', title, '** (', url, ')', chr(10)) ELSE '' END || CASE WHEN length(short) > 500 THEN substr(short, 1, 500) || '...' ELSE short END || chr(10), chr(10) ORDER BY rank)) AS summary FROM f GROUP BY 1""")
def summaries(spark, sf_dir):
    """A report of each query's first five chunks."""
    _view(spark, sf_dir, "documents")
    return synthesis.summaries(_sql(spark, _CHUNKS)).withColumn("summary", F.md5(F.encode("summary", "UTF-8")))


_TURNS = "SELECT concat(conv_id, '-', turn) AS key, CASE WHEN turn % 4 = 1 THEN concat(text, chr(10), 'Sources:', chr(10), '- [1] x') ELSE text END AS answer FROM conversations WHERE role = 'assistant'"
_QUOTES = "SELECT concat(conv_id, '-', turn + 1) AS key, concat('u', turn % 3) AS url, text AS quote FROM conversations WHERE role = 'user' UNION ALL SELECT concat(conv_id, '-', turn) AS key, 'own' AS url, text AS quote FROM conversations WHERE role = 'assistant' AND turn % 3 = 1"
_SETS = "list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> ''))"


@query("filtered_answers", rf"""WITH a AS ({_TURNS}), q AS ({_QUOTES}), s AS (SELECT key, answer, regexp_replace(answer, '(?ims)^\s*(?:#+\s*)?(?:sources|nguồn)\s*:?\s*$.*', '') AS body FROM a), b AS (SELECT *, substr(answer, length(body) + 1) AS tail FROM s),
c AS (SELECT key, unnest(list_filter(list_transform(string_split_regex(body, '[.!?]'), lambda x: trim(x)), lambda x: length(x) > 20)) AS claim FROM b), cw AS (SELECT key, claim, {_SETS.format(x='claim')} AS w FROM c), qw AS (SELECT key, url, {_SETS.format(x='quote')} AS w FROM q),
v AS (SELECT cw.key, claim, count(DISTINCT CASE WHEN len(list_intersect(cw.w, qw.w)) / greatest(len(cw.w), 1) > 0.3 THEN url END) AS n FROM cw LEFT JOIN qw ON cw.key = qw.key GROUP BY 1, 2),
m AS (SELECT c.key, count(*) AS claims_total, count(*) FILTER (WHERE n > 0) AS claims_verified, coalesce(list(DISTINCT c.claim) FILTER (WHERE n = 0), []) AS bad FROM c JOIN v ON c.key = v.key AND c.claim = v.claim GROUP BY 1),
d AS (SELECT b.*, coalesce(claims_total, 0) AS claims_total, coalesce(claims_verified, 0) AS claims_verified, coalesce(bad, []) AS bad, regexp_extract_all(body, '[^.!?]+[.!?]*') AS parts FROM b LEFT JOIN m ON b.key = m.key),
k AS (SELECT *, list_filter(parts, lambda x: NOT (length(trim(regexp_replace(trim(x), '[.!?]+$', ''))) > 20 AND list_contains(bad, trim(regexp_replace(trim(x), '[.!?]+$', ''))))) AS kept FROM d), e AS (SELECT *, trim(array_to_string(kept, '')) AS remaining FROM k)
SELECT key, md5(CASE WHEN len(bad) = 0 THEN answer WHEN remaining = '' THEN '{synthesis.ABSTENTION}' || tail ELSE remaining || tail END) AS answer, claims_verified, CASE WHEN len(bad) > 0 THEN len(parts) - len(kept) ELSE 0 END AS claims_removed, len(bad) > 0 AND remaining = '' AS all_removed FROM e""")
def filtered_answers(spark, sf_dir):
    """O08, O09, X27."""
    _view(spark, sf_dir, "conversations")
    out = synthesis.filtered_answers(_sql(spark, _TURNS), _sql(spark, _QUOTES))
    return out.select("key", F.md5(F.encode("answer", "UTF-8")).alias("answer"), "claims_verified", "claims_removed", "all_removed")


@query("answer_confidence", "WITH c AS (SELECT user_id AS key, event_type = 'view' AS verified FROM events), e AS (SELECT user_id + 3 AS key, least(value / 100, 1.0) AS support FROM events), a AS (SELECT key, avg(CAST(verified AS INT)) AS share FROM c GROUP BY 1), b AS (SELECT key, avg(support) AS mean FROM e GROUP BY 1) SELECT coalesce(a.key, b.key) AS key, round(CASE WHEN mean IS NULL THEN coalesce(share, 0.5) ELSE least(coalesce(share, 0.5) * (1 + mean), 1.0) END, 3) AS confidence FROM a FULL JOIN b ON a.key = b.key")
def answer_confidence(spark, sf_dir):
    """Claims of a user beside the evidence three numbers before, so that the first have claims and the last evidence alone."""
    e = table(spark, sf_dir, "events")
    return synthesis.confidences(e.selectExpr("user_id AS key", "event_type = 'view' AS verified"), e.selectExpr("user_id + 3 AS key", "least(value / 100, 1D) AS support"))


@query("grounded_citations", f"""WITH b AS (SELECT item_id, list_distinct(list_filter({SQL_WORDS.format(x='text')}, lambda w: length(w) > 1 AND w NOT IN ({_STOP}))) AS k FROM benchmark), d AS (SELECT doc_id, doc_id % 40 AS item_id, {SQL_WORDS.format(x='text')} AS w FROM documents)
SELECT doc_id, len(k) = 0 OR len(list_intersect(k, w)) >= least(2, len(k)) AS grounded FROM d JOIN b USING (item_id)""")
def grounded_citations(spark, sf_dir):
    """F32: each document against one of the benchmark's texts."""
    b = table(spark, sf_dir, "benchmark").selectExpr("item_id", "text AS claim")
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 40 AS item_id", "text AS source")
    return d.join(b, "item_id").select("doc_id", synthesis.grounded(F.col("claim"), F.col("source")).alias("grounded"))


@query("citation_repair")
def citation_repair(spark, sf_dir):
    """Answers that cite the user's turns, repaired."""
    c = table(spark, sf_dir, "conversations")
    sources = c.where("role = 'user'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s.text).alias("sources"))
    cited = c.where("role = 'assistant'").join(sources, "conv_id").withColumn("answer", F.regexp_replace("text", r"\. ", r" [1] [7]. "))
    return cited.select("conv_id", "turn", synthesis.escaped(synthesis.repaired_citations(F.col("answer"), F.col("sources"))).alias("answer"))


@query("bundles", None)
def bundles(spark, sf_dir):
    """Bundles of the claims and evidence of each turn."""
    from .evidence import _verdicts

    v = _verdicts(spark, sf_dir).withColumn("key", F.split("claim_key", "/")[0])
    packs = v.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("claim_key", "status", "confidence"))).alias("claims"))
    return synthesis.bundles(packs, "claims")


_CARDS = r"""SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN '# Phở Hòa ' WHEN 1 THEN 'Address: x' WHEN 2 THEN 'ab' ELSE '"Quán Ngon" ' END, chr(10), CASE WHEN page_id % 3 = 0 THEN concat('Địa chỉ: 12 Lê Lợi; tầng 2', chr(10)) ELSE '' END, CASE WHEN page_id % 5 = 0 THEN 'Call 0901 234 567 or a@b.vn ' ELSE '' END, CASE WHEN page_id % 2 = 0 THEN concat(url, ' ') ELSE '' END, CASE WHEN page_id % 7 = 0 THEN 'rated 4.5/5 open 08:00 - 22:30 ' ELSE '' END, CASE WHEN page_id % 6 = 0 THEN 'at 210.5, 10.1 and 10.77, 106.69' ELSE 'khách sạn' END) AS content, CASE WHEN page_id % 8 = 0 THEN '' ELSE 'pho' END AS q, CASE WHEN page_id % 4 = 0 THEN url ELSE '' END AS source FROM pages"""


@query("businesses", rf"""WITH c AS ({_CARDS}), t AS (SELECT *, trim(content) AS body FROM c), l AS (SELECT *, list_filter(list_transform(string_split(body, chr(10))[1:5], lambda x: regexp_replace(trim(x), '^[#*\-=–]+|[#*\-=–]+$', '', 'g')), lambda x: length(x) BETWEEN 3 AND 120 AND NOT regexp_matches(lower(x), '^(địa chỉ|address|phone|tel|email)')) AS names,
 list_filter(regexp_extract_all(body, '{business.WEBSITE}'), lambda u: NOT (source <> '' AND u = source)) AS sites, regexp_extract_all(body, '{business.COORDS}') AS pairs FROM t),
f AS (SELECT *, coalesce(names[1], nullif(regexp_extract(body, '["'']([^"'']{{3,80}})["'']', 1), ''), nullif(trim(q), '')) AS name, nullif(trim(regexp_extract(body, '{business.PHONE}')), '') AS phone, trim(regexp_extract(trim(regexp_extract(body, '{business.ADDRESS}', 1)), '^([^;.]*\.?)', 1)) AS address FROM l)
SELECT page_id, name, address, phone, sites[1] AS website, CAST(nullif(regexp_extract(body, '{business.RATING}', 1), '') AS DOUBLE) AS rating, CASE WHEN regexp_extract(body, '{business.HOURS}', 1) <> '' THEN concat(regexp_extract(body, '{business.HOURS}', 1), ' - ', regexp_extract(body, '{business.HOURS}', 2)) END AS hours,
 CASE WHEN len(pairs) > 0 THEN 10.77 END AS lat, CASE WHEN len(pairs) > 0 THEN 106.69 END AS lon FROM f""")
def businesses(spark, sf_dir):
    """X56."""
    _view(spark, sf_dir, "pages")
    p = _sql(spark, _CARDS).withColumn("b", business.business(F.col("content"), F.col("q"), F.col("source")))
    return p.select("page_id", "b.name", "b.address", "b.phone", "b.website", "b.rating", "b.hours", "b.lat", "b.lon")


_ADDRESSES = "SELECT c_custkey AS id, concat(CASE c_custkey % 4 WHEN 0 THEN concat('Số ', c_custkey, ' ngõ 4 Trần Phú') WHEN 1 THEN concat(c_custkey, 'a  đường Lê Lợi') WHEN 2 THEN 'Phố Huế' ELSE 'hẻm 7' END, CASE c_custkey % 3 WHEN 0 THEN ', P. Bến Nghé' WHEN 1 THEN ', Phường 12' ELSE '' END, CASE c_custkey % 5 WHEN 0 THEN ',quận 1' WHEN 1 THEN ', Ba Đình' ELSE '' END, CASE c_custkey % 2 WHEN 0 THEN ', TP. HCM' ELSE '; hà nội' END) AS a FROM customer"


@query("addresses", f"""WITH a AS ({_ADDRESSES}) SELECT id, CASE id % 4 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN concat(id, 'a') ELSE '' END AS house_number, CASE id % 4 WHEN 0 THEN 'Ngõ 4' WHEN 3 THEN 'Hẻm 7' ELSE '' END AS lane, CASE id % 4 WHEN 0 THEN 'Trần Phú' WHEN 1 THEN 'Đường Lê Lợi' WHEN 2 THEN 'Phố Huế' ELSE '' END AS street,
 CASE id % 3 WHEN 0 THEN 'Bến Nghé' WHEN 1 THEN '12' ELSE '' END AS ward, CASE id % 5 WHEN 0 THEN '1' WHEN 1 THEN 'Ba Đình' ELSE '' END AS district, CASE id % 2 WHEN 0 THEN 'Thành phố Hồ Chí Minh' ELSE 'Thành phố Hà Nội' END AS city, true AS is_address FROM a""")
def parsed_addresses(spark, sf_dir):
    """X48, X49, X84."""
    _view(spark, sf_dir, "customer")
    rows = addresses.looks_like(addresses.parsed(_sql(spark, _ADDRESSES), "a"), "a")
    return rows.select("id", *addresses.FIELDS, "is_address")


_LABELS = ("Nhà Thuốc Tây", "cafe", "BUS_STOP", "quán cà phê sách", "???", "", None, "Văn phòng luật", "ga", "gara ô tô", "shop", "Cửa hàng điện thoại")
_CATS = ("health", "food", "transport", "food", None, None, None, "office", "transport", "transport", "retail", "retail")
_OWN = {("p0", "xyz"): "office", ("*", "???"): "services"}


def _pick(values, by):
    lit = lambda v: "NULL" if v is None else "'" + str(v) + "'"
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


_LABELLED = f"SELECT s_suppkey AS seq, concat('p', s_nationkey % 2) AS provider, {_pick(_LABELS, 's_suppkey')} AS raw, CASE WHEN s_suppkey % 5 = 0 THEN '{{\"shop\": \"book_store\"}}' END AS payload FROM supplier"


@query("category_labels", f"WITH l AS ({_LABELLED}) SELECT seq, coalesce({_pick(_CATS, 'seq')}, CASE WHEN seq % 5 = 0 THEN 'retail' END) AS category, coalesce({_pick(tuple('services' if x == '???' else c for x, c in zip(_LABELS, _CATS)), 'seq')}, CASE WHEN seq % 5 = 0 THEN 'retail' END) AS resolved FROM l")
def category_labels(spark, sf_dir):
    """X13, X14, N06, H15."""
    _view(spark, sf_dir, "supplier")
    r = _sql(spark, _LABELLED)
    names = labels.candidates(F.col("raw"), F.col("payload"))
    return r.select("seq", labels.category(names).alias("category"), labels.resolved(names, F.col("provider"), _OWN).alias("resolved"))


@query("unknown_labels", f"WITH l AS ({_LABELLED}) SELECT provider, '???' AS folded, '???' AS sample, count(*) AS seen FROM l WHERE raw = '???' GROUP BY 1")
def unknown_labels(spark, sf_dir):
    """A28."""
    _view(spark, sf_dir, "supplier")
    return labels.unknown_labels(_sql(spark, _LABELLED))


_HINTED = {h: c for c, names in labels.HINTS.items() for h in names.split("|")}


@query("category_hints", f"WITH a AS ({_ASKED}), f AS (SELECT p_partkey, replace(strip_accents(lower(q)), 'đ', 'd') AS f FROM a) SELECT p_partkey, CASE {' '.join(f'WHEN contains(f, {h!r}) THEN {_HINTED[h]!r}' for h in sorted(_HINTED, key=len, reverse=True))} END AS category FROM f")
def category_hints(spark, sf_dir):
    """F07."""
    return _asked(spark, sf_dir).select("p_partkey", labels.hint(text.fold(F.col("q"))).alias("category"))


@query("boundary_chunks")
def boundary_chunks(spark, sf_dir):
    """Every document in pieces that end at boundaries."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(spans.boundary_chunks(F.col("text"))).alias("i", "c"))
    return d.select("doc_id", "i", F.length("c").alias("n"), F.md5(F.encode("c", "UTF-8")).alias("digest"))


@query("structure_chunks")
def structure_chunks(spark, sf_dir):
    """Turns of each conversation under headings, in chunks."""
    from ..functions import identity

    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(F.repeat(F.lit("#"), (t.turn % 3 + 1).cast("int")), F.lit(" "), t.role, F.lit("\n\n"), t.text)), "\n\n").alias("text"))
    rows = c.select("conv_id", F.posexplode(spans.structure_chunks(F.col("text"))).alias("i", "c"))
    return rows.select("conv_id", "i", "c.role", "c.start", "c.end", F.array_join("c.heading_path", " > ").alias("path"), F.md5(F.encode(identity.headed(F.col("c.heading_path"), F.col("c.text")), "UTF-8")).alias("digest"))


@query("entity_ids")
def entity_ids(spark, sf_dir):
    """Entities of questions about cities, companies and laws."""
    q = F.concat(F.col("q"), F.expr("CASE p_partkey % 5 WHEN 0 THEN ' ở Sài Gòn và TP HCM' WHEN 1 THEN ' CTCP Vingroup VIC' WHEN 2 THEN ' Nghị định 254/2026/NĐ-CP' WHEN 3 THEN ' Hue hà nội' ELSE '' END"))
    return _asked(spark, sf_dir).select("p_partkey", F.array_join(spans.entities(q), ",").alias("entities"))


@query("local_queries")
def local_queries(spark, sf_dir):
    """X55, X79, X80."""
    q = F.concat(F.col("q"), F.expr("CASE p_partkey % 3 WHEN 0 THEN ' phở gà ở Yên Dũng?' ELSE ' gần Bắc Giang' END"))
    return _asked(spark, sf_dir).withColumn("l", spans.local_query(q)).select("p_partkey", "l.specialty", "l.locality", F.array_join("l.variants", " | ").alias("variants"))
