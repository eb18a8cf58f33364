"""Hard cases, by hand, of the forms that the queries over whole tables take to SQL."""

from tessera.operators import crawl
from tessera.plans import more, texts

NAMES = [
    (1, "Công ty TNHH Cửa hàng Điện Máy Xanh", "0901234567", "https://www.dienmayxanh.com/a/?x=1", "OPERATIONAL"),
    (2, "CUA HANG dien may xanh", "+84 901 234 567", "dienmayxanh.com/a", "Đã đóng cửa"),
    (3, "Quán  Phở Bắc - 24", "0084-28-3822-1234", "http://pho24.vn#top", "temporarily closed - covid"),
    (4, "Café Été", "123456789", "", None),
    (5, "Nhà hàng Quán Ngon", "12", "https:///x", "???"),
    (6, "", None, None, "Permanently Closed"),
]
NAME_FORMS = [
    (1, "dien may xanh", "dien may xanh", "+84901234567", "dienmayxanh.com", "open"),
    (2, "dien may xanh", "dien may xanh", "+84901234567", "dienmayxanh.com", "permanently_closed"),
    (3, "pho bac 24", "24 bac pho", "+842838221234", "pho24.vn", "temporarily_closed"),
    (4, "cafe ete", "cafe ete", "+0123456789", None, None),
    (5, "ngon", "ngon", None, None, None),
    (6, "", "", None, None, "permanently_closed"),
]
URLS = [(1, "https://www.Example.com/A/?b=2&utm_source=x&a=1#f"), (2, "http://m.example.co.uk/"), (3, "https://a.b.example.com.vn/p//"), (4, "not a url"), (5, "http://10.0.0.7/x"), (6, "https://casino-win.xyz/a/b/c/d/e/f/g/h")]
URL_FORMS = [
    (1, "https://example.com/A?a=1&b=2", "example.com/A?a=1&b=2", "example.com", 0, 0),
    (2, "http://example.co.uk", "example.co.uk", "example.co.uk", 0, 0),
    (3, "https://a.b.example.com.vn/p", "a.b.example.com.vn/p", "example.com.vn", 0, 0),
    (4, "not a url", "not a url", "", 0, 0),
    (5, "http://10.0.0.7/x", "10.0.0.7/x", "0.7", 1, 0),
    (6, "https://casino-win.xyz/a/b/c/d/e/f/g/h", "casino-win.xyz/a/b/c/d/e/f/g/h", "casino-win.xyz", 0, 10),
]
PAYLOADS = [
    (1, '{"review_rating": 4.5, "review_count": "1,234", "price_range": " $$ ", "images": ["http://a/1", {"u": "http://a/2"}, "http://a/1", "ftp://x"]}'),
    (2, '{"review_rating": "5.0000001", "review_count": 1.5}'),
    (3, '{"review_rating": true, "review_count": "12,34", "price_range": ""}'),
    (4, "not json"),
    (5, '{"review_rating": 0, "review_count": 7, "images": []}'),
]
RICH = [(1, "4.5", 1234, "$$", "http://a/1 http://a/2"), (2, None, None, None, None), (3, None, None, None, None), (4, None, None, None, None), (5, "0.0", 7, None, None)]
ROBOTS = [("a.com", "User-agent: bot\nUser-agent: other\nDisallow: /x\nAllow: /x/ok\nSitemap: s\n\nUser-agent: *\nDisallow: /"), ("b.com", "Disallow: /\nUser-agent: *\nDisallow: /*.pdf$\nAllow: /p\nDisallow: /p\nCrawl-delay: 2")]
PATHS = [(1, "a.com", "/x/1", False), (2, "a.com", "/x/ok", True), (3, "a.com", "/y", True), (4, "b.com", "/f.pdf", False), (5, "b.com", "/f.pdf?q", True), (6, "b.com", "/p", True), (7, "c.com", "/", True), (8, "a.com", "/robots.txt", True)]
ANSWERS = [
    (1, "Đà Nẵng has 1.2 million people", ["da nang", "1.2 million", "x", " "], ["https://www.a.com/p/", "http://b.org/1"], ["http://a.com/p", "https://c.net/z"]),
    (2, "", [], [], ["http://a.com"]),
    (3, None, ["f"], ["http://a.com/other"], []),
]
METRICS = [(1, "0.667", "0.5", "0.5", "0.5"), (2, None, None, "0.0", "0.0"), (3, "0.0", None, None, None)]


def found(rows, key="id"):
    return [tuple(r) for r in rows.orderBy(key).collect()]


def test_names_phones_sites_and_statuses(spark):
    assert found(texts.name_forms(spark.createDataFrame(NAMES, "id int, name string, phone string, site string, status string"))) == NAME_FORMS


def test_addresses(spark):
    assert found(texts.url_columns(spark.createDataFrame(URLS, "id int, url string"))) == URL_FORMS


def test_payloads(spark):
    assert [tuple(v or None if isinstance(v, str) else v for v in r) for r in found(more.payload_fields(spark.createDataFrame(PAYLOADS, "id int, payload string")))] == RICH


def test_robots(spark):
    rules = crawl.robots_rules(spark.createDataFrame(ROBOTS, "host string, body string"))
    got = crawl.robots_verdicts(spark.createDataFrame([p[:3] for p in PATHS], "url_id int, host string, path string"), rules, "Bot")
    assert found(got, "url_id") == [(p[0], p[3]) for p in PATHS]


def test_answers(spark):
    rows = spark.createDataFrame(ANSWERS, "id int, answer string, facts array<string>, cited array<string>, expected array<string>")
    assert found(more.answer_columns(rows)) == METRICS
