import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, scores, text, urls
from tessera.operators import serving
from tessera.plans import texts
from tessera.sources import files, pages


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_overlaps_and_bonuses(spark):
    a, b = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcde"))
    got = one(spark, text.jaccard(a, b), text.containment(a, b), text.overlap(a, b), text.coverage(F.lit("red fox x"), F.lit("The red FOX")), text.phrase_bonus(F.lit("quick brown fox"), F.lit("a quick brown fox")), text.title_boost(a, F.lit("b z")))
    assert got == pytest.approx((2 / 5, 2 / 3, 2 / math.sqrt(12), 1.0, 0.3, 0.25 / 3))
    assert one(spark, text.hamming(F.lit("0" * 16), F.lit("f" + "0" * 15)), text.hamming(F.lit("0"), F.lit("00"))) == (4, 64)


def test_claims_and_citations(spark):
    src = F.lit("The bridge opened in 1990. It was never closed.")
    assert one(spark, text.supports(F.lit("bridge opened 1990"), src), text.contradicts(F.lit("bridge closed 1990"), src)) == (True, True)
    assert one(spark, text.citation_numbers(F.lit("a [1] b [2,3] c [3-5] d [x]")))[0] == [1, 2, 3, 4, 5]
    assert one(spark, text.sentences(F.lit("One. Two! \n Three? ")))[0] == ["One.", "Two!", "Three?"]
    assert one(spark, text.is_follow_up(F.lit("and what does it cost there in total?")), text.is_follow_up(F.lit("how many people live in the old town")))[0:2] == (True, False)


def test_chunkers(spark):
    got = one(spark, text.fixed_chunks(F.lit("x" * 800)), text.offset_passages(F.lit("x" * 800)), text.offset_passages(F.lit("x" * 801)), text.fixed_chunks(F.lit("")))
    assert [[c.start for c in col] for col in got] == [[0, 600], [0], [0, 600], []]


def test_times_and_scores(spark):
    now = F.expr("TIMESTAMP '2024-01-31 00:00:00'")
    week = F.expr("TIMESTAMP '2024-01-24 00:00:00'")
    got = one(spark, scores.freshness(week, now, F.lit("social")), scores.freshness(F.lit(None).cast("timestamp"), now), scores.recency(week, now, F.lit("hours")), scores.backoff_minutes(F.lit(100)), scores.bayesian_rating(F.lit(5.0), F.lit(10)), scores.popularity(F.lit(5000)), scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))))
    assert got == pytest.approx((0.75, 0.5, math.exp(-7 / 45), 720, 0.85, 1.0, math.sqrt(0.5)))
    assert one(spark, scores.rounded_index(F.array(*map(F.lit, range(1, 7))), 0.5), scores.ema(F.array(F.lit(1), F.lit(0)))) == (3, pytest.approx(0.21))


def test_geography(spark):
    d = geo.haversine_m(F.lit(10.0), F.lit(106.0), F.lit(10.0), F.lit(106.001))
    got = one(spark, d, geo.geo_score(F.lit(115.0)), geo.geo_score(F.lit(500.0)), geo.geo_score(F.lit(None).cast("double")), geo.distance_score(F.lit(750.0)))
    assert got == pytest.approx((109.5, 0.5, -1.0, 0.4, math.exp(-1)), rel=1e-3)
    none = F.lit(None).cast("double")
    assert one(spark, geo.distance_score(none), geo.geo_bonus(none), scores.clamp(none)) == (0.5, 0.0, None)


def test_urls(spark):
    assert one(spark, urls.canonical_url(F.lit("HTTPS://WWW.A.com/x/?b=1&utm_medium=z&a=2#q")), urls.registrable_domain(F.lit("a.b.co.uk")), urls.private_host(F.lit("192.168.0.1")), urls.private_host(F.lit("a.com"))) == ("https://a.com/x?a=2&b=1", "b.co.uk", True, False)


def test_pages(spark):
    html = F.lit('<html lang="vi"><head><title> T </title><style>x</style></head><body><p>a &amp; b</p><script>1</script><a href="/c?d#e">l</a></body></html>')
    assert one(spark, pages.title(html), pages.html_language(html), pages.visible_text(html)) == ("T", "vi", "T\na & b\nl")
    base = F.lit("https://h.org/x/y?q=1")
    assert one(spark, *[pages.absolute(base, F.lit(h)) for h in ("z", "/c#e", "//k.org/p", "mailto:a@b", "http://o/", "#top")]) == ("https://h.org/x/z", "https://h.org/c", "https://k.org/p", None, "http://o/", None)


def test_feeds_and_sitemaps(spark):
    rss = "<rss><channel><item><title><![CDATA[A]]></title><link>http://x/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item></channel></rss>"
    atom = '<feed><entry><title>B</title><link rel="self" href="http://x/s"/><link rel="alternate" href="http://x/2"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>'
    docs = spark.createDataFrame([(1, rss), (2, atom), (3, "<!DOCTYPE x>" + rss)], "id int, xml string")
    rows = files.feed_items(docs).withColumn("t", files.feed_time(F.col("published"))).orderBy("id").collect()
    assert [(r.id, r.title, r.link, str(r.t)) for r in rows] == [(1, "A", "http://x/1", "2024-01-02 03:04:05"), (2, "B", "http://x/2", "2024-01-02 00:00:00")]
    maps = spark.createDataFrame([(1, "<urlset><url><loc>http://x/a</loc><lastmod>2024</lastmod></url><url><loc> </loc></url></urlset>")], "id int, xml string")
    assert [tuple(r) for r in files.sitemap_urls(maps).collect()] == [(1, "url", "http://x/a", "2024")]


def test_scraper_records(spark, tmp_path):
    path = tmp_path / "s.ndjson"
    path.write_text('{"cid":"7","title":"A","longtitude":105.5,"latitude":10,"complete_address":{"street":"1 B","city":"C"},"categories":["x"],"permanently_closed":true}\nnot json\n')
    rows = files.scraper_records(files.scraper_ndjson(spark, str(path))).orderBy("parse_error").collect()
    assert tuple(rows[0]) == ("7", "A", "1 B, C", None, None, "x", 10.0, 105.5, "permanently_closed", False) and rows[1].parse_error


def test_opening_hours(spark):
    hours = "array<struct<opens:int,closes:int>>"
    night = F.array(F.struct(F.lit(1320).alias("opens"), F.lit(120).alias("closes")))
    assert one(spark, serving.open_at(night, F.lit(60)), serving.open_at(night, F.lit(600)), serving.open_at(F.lit(None).cast(hours), F.lit(1)), serving.open_at(F.array().cast(hours), F.lit(1))) == (True, False, None, False)
    assert one(spark, *[serving.minutes(F.lit(x)) for x in ("08:30", "24:00", "8:61", "x")]) == (510, 1440, None, None)
    assert serving.parse_bbox("1,2,3,4") == (1, 2, 3, 4) and serving.parse_bbox("3,2,1,4") is None and serving.parse_bbox("a") is None


def test_passage_ids_of_long_documents_stay_apart(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 602_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = {r.passage_id for r in texts.fixed_chunks(spark, str(tmp_path)).collect()}
    assert len(ids) == 1004 and {"1#p_000", "1#p_100", "1#p_1000", "1#p_1003"} <= ids
