"""Queries that SQL doesn't express, held to plain versions over the whole small tables."""

import hashlib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import spans, text
from tessera.operators import local, providers, research, synthesis
from tessera.sources import extract


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return lambda name: catalog.queries()[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def plain_chunks(t, size=800, overlap=200):
    out, at = [], 0
    if len(t) <= size:
        return [t]
    while at < len(t):
        piece = t[at : at + size]
        if at + size < len(t):
            for mark in ("\n\n", "\n", ". ", " "):
                k = piece.rfind(mark)
                if k > size // 2:
                    piece = piece[: k + len(mark)]
                    break
            out.append(piece.strip())
            at += len(piece) - overlap
        else:
            out.append(piece.strip())
            at += size - overlap
    return out


def test_boundary_chunks(rows, table):
    want = {(d.doc_id, i, len(c), md5(c)) for d in table("documents") if d.text is not None for i, c in enumerate(plain_chunks(d.text))}
    assert {tuple(r) for r in rows("boundary_chunks")} == want


def test_structure_chunks(rows, table):
    found = rows("structure_chunks")
    by = {}
    for r in found:
        by.setdefault(r.conv_id, []).append(r)
    assert len(by) == len({c.conv_id for c in table("conversations")})
    for chunks in by.values():
        assert len(chunks) <= 8 and all(c.end - c.start <= 450 or c.role in ("table", "code") for c in chunks)
    one = spans.structured("intro\n\n# A\n\ntext one. text two.\n\n## B\n\n| a | b | c |\n\n# C\n\n```\ncode\n```\n\n- x\n", 450, 60, 8)
    assert [(c["heading_path"], c["role"]) for c in one] == [([], "paragraph"), (["A"], "paragraph"), (["A", "B"], "table"), (["C"], "code")]
    many = spans.structured("word. " * 2000, 450, 60, 8)
    assert len(many) == 8 and many[-1]["end"] == len(("word. " * 2000).strip())
    assert spans.structured("a2024-01-02 and 3.5 on 2024-01-02", 450, 60, 8)[0]["dates"] == ["2024-01-02"]
    assert [spans.role_of(x) for x in ("- a", "why?", "    code", "x\n```", "plain")] == ["list", "faq", "code", "code", "paragraph"]


def folded(s):
    s = unicodedata.normalize("NFKD", s.replace("đ", "d").replace("Đ", "D"))
    return "".join(c for c in s if not unicodedata.combining(c)).lower().strip()


def test_entity_ids(rows):
    names = sorted(((folded(n), i) for i, every in spans.ENTITIES.items() for n in dict.fromkeys(every.split("|"))), key=lambda x: -len(x[0].split()))
    from tessera.plans.understanding import _TEMPLATES

    tails = [" ở Sài Gòn và TP HCM", " CTCP Vingroup VIC", " Nghị định 254/2026/NĐ-CP", " Hue hà nội", ""]
    for r in rows("entity_ids"):
        found = set(filter(None, r.entities.split(",")))
        tail = folded(tails[r.p_partkey % 5])
        # every name that stands in the tail alone is found, and nothing that the text doesn't name
        for name, ident in names:
            if re.search(rf"(?<!\w){re.escape(name)}(?!\w)", tail) and not any(name in other and name != other and re.search(rf"(?<!\w){re.escape(other)}(?!\w)", tail) for other, _ in names):
                assert ident in found
        assert all(i.startswith("legal:") or any(re.search(rf"(?<!\w){re.escape(n)}(?!\w)", tail) or re.search(rf"(?<!\w){re.escape(n)}(?!\w)", folded(" ".join(_TEMPLATES))) for n, j in names if j == i) for i in found)
        assert ("legal:nd-254-2026" in found) == (r.p_partkey % 5 == 2)
    known = spans.compiled()
    assert spans.entity_ids("TP HCM và HCM", known) == ["loc:ho_chi_minh_city"]
    assert spans.entity_ids("Bia Sài Gòn", known) == ["co:sabeco"]  # the longer name takes the words of the shorter
    assert spans.legal_ids("thong tu 12/2020, tt 12-2020, luat 3/2019, nd 5 / 2021") == ["legal:tt-12-2020", "legal:luat-3-2019", "legal:nd-5-2021"]


@pytest.mark.parametrize("q,special,place,variants", [
    ("quán ăn đêm gần Bắc Giang?", None, "Bắc Giang", ["quán ăn đêm gần Bắc Giang", "quán ăn khuya Bắc Giang", "nhà hàng mở muộn Bắc Giang", "quán nhậu Bắc Giang", "quán ăn khuya", "nhà hàng mở muộn", "quán nhậu"]),
    ("giò chả Yên Dũng", "giò chả", "Yên Dũng", ["giò chả Yên Dũng", "giò lụa Yên Dũng", "chả lụa Yên Dũng", "giò chả", "giò lụa", "chả lụa", "chả giò"]),
    ("nha thuoc", None, "", ["nha thuoc", "hiệu thuốc", "tiệm thuốc"]),
    ("python", None, "", ["python"]),
    ("", None, "", [""]),
])
def test_local_parts(q, special, place, variants):
    got = spans.local_parts(q)
    assert (got["specialty"], got["locality"], got["variants"]) == (special, place, variants)


def test_local_queries(rows):
    for r in rows("local_queries"):
        assert r.variants.count(" | ") < 8 and (r.specialty == "phở" if r.p_partkey % 3 == 0 else True)


def test_evidence_clusters(rows, table):
    def words(t):
        return re.findall(r"[^\W]+", (t or "").lower())

    def shingles(t):
        w = words(t)
        return {int(hashlib.sha1(" ".join(w[i : i + 3]).encode()).hexdigest()[:8], 16) for i in range(min(max(len(w) - 2, 0), 600))}

    docs = sorted(table("documents"), key=lambda d: d.doc_id)
    want = {}
    for q in range(50):
        reps = []
        for d in docs:
            if d.doc_id % 50 != q:
                continue
            s = shingles(d.text)
            sims = [round(len(s & r) / min(len(s), len(r)), 12) if s and r else 0.0 for r in reps]
            best = max(sims, default=0.0)
            if best >= 0.25:
                k = sims.index(best)
            else:
                reps.append(s)
                k = len(reps) - 1
            want[q, str(d.doc_id)] = f"clu{k + 1}"
    assert {(r.query_id, r.source_id): r.cluster_id for r in rows("evidence_clusters")} == want


def test_citation_repair(spark, rows):
    sources = ["the red ring is large", "blue bolts cost nine"]
    answers = [("The red ring sells. [1] Nine bolts cost more [2]. Lies [9].", "The red ring sells. Nine bolts cost more [2]. Lies ."), ("Red rings are a large ring [1][2].", "Red rings are a large ring [1]."), ("No marks.", "No marks."), ("[0] zero", "zero"), (None, None)]
    df = spark.createDataFrame([(a, sources) for a, _ in answers], "a string, s array<string>")
    assert [r[0] for r in df.select(synthesis.repaired_citations(F.col("a"), F.col("s"))).collect()] == [w for _, w in answers]
    none = spark.createDataFrame([("x [1].", [])], "a string, s array<string>").select(synthesis.repaired_citations(F.col("a"), F.col("s"))).first()[0]
    assert none == "x ."
    assert all("[7]" not in r.answer for r in rows("citation_repair"))


def test_bundles(rows):
    for r in rows("bundles"):
        body = json.loads(r.bundle)
        assert body["version"] == "2.0" and body["claims"] and hashlib.sha256(r.bundle.encode()).hexdigest() == r.fingerprint


def test_planned_queries(rows, spark, sf_dir):
    variants = {r.p_partkey: r for r in rows("query_rewrites")}
    got = {}
    for r in rows("planned_queries"):
        got.setdefault(r.query_id, {})[r.sub] = r.asked
    for key, v in variants.items():
        every = [x for x in [v.q.strip(), *v.variants.split(" | "), *v.parts.split(" | ")] if x.strip()]
        fresh = [x for i, x in enumerate(every) if x.strip().lower() not in [y.strip().lower() for y in every[:i]]]
        assert [x for _, x in sorted(got.get(key, {}).items())] == fresh[:3]


def test_provider_plans(rows):
    families = {r.p_partkey: r.family for r in rows("query_profile")}
    variants = {r.p_partkey: r.variants.split(" | ") for r in rows("query_rewrites")}
    lanes = {"code": ["code_search", "searxng"], "research": ["searxng", "arxiv", "hn"], "news": ["searxng", "ddgs"], "web": ["searxng", "ddgs"]}
    got = {}
    for r in rows("provider_plans"):
        assert r.family == families[r.query_id]
        got.setdefault(r.query_id, []).append((r.provider, r.variant, r.query))
    for key, family in families.items():
        want = [(p, i, v) for p in lanes[family] for i, v in (list(enumerate(variants[key][:2])) if p == "searxng" else [(0, None)])]
        assert [(p, i) for p, i, _ in got[key]] == [(p, i) for p, i, _ in want]
        assert all(v is None or v == g for (_, _, v), (_, _, g) in zip(want, got[key]))


def candidate(**values):
    names = [f.split()[0] for f in local.SCHEMA.split(", ")]
    return {n: None for n in names} | {"query_id": 1, "name": "Phở Hòa"} | values


def test_merging_of_candidates(spark):
    rows = [
        candidate(pos=1, phone="+84 901 234 567", source_url="a"), candidate(pos=2, name="Khác hẳn", phone="0901234567", address="1 Lê Lợi", source_url="b"),
        candidate(pos=3, name="Bún Chả", lat=10.0, lon=106.0, source_url="c"), candidate(pos=4, name="Bún chả", lat=10.0005, lon=106.0, hours="8", source_url="c"),
        candidate(pos=5, name="Bún chả", lat=10.5, lon=106.0), candidate(pos=6, name="Cơm tấm A", website="https://www.com.vn/x"), candidate(pos=7, name="Cơm tấm B", website="com.vn", lat=1.0, lon=2.0, rating=4.0, description="d"),
    ]
    out = local.merge_rows(rows)
    assert [(r["pos"], r["name"], r["supporting"]) for r in out] == [(1, "Phở Hòa", 2), (3, "Bún Chả", 1), (5, "Bún chả", 1), (6, "Cơm tấm B", 1)]
    assert out[0]["address"] == "1 Lê Lợi" and out[1]["hours"] == "8" and (out[3]["lat"], out[3]["website"]) == (1.0, "com.vn")
    got = local.merged(spark.createDataFrame([tuple(r.values()) for r in rows], local.SCHEMA)).orderBy("pos").collect()
    assert [(r.pos, r.name, r.supporting, r.lat) for r in got] == [(r["pos"], r["name"], r["supporting"], r["lat"]) for r in out]


def test_merged_candidates(rows, spark, sf_dir):
    from tessera.plans.answers import _sql, _view
    from tessera.plans.research import _CANDIDATES

    _view(spark, sf_dir, "supplier")
    groups = {}
    for r in _sql(spark, _CANDIDATES).collect():
        groups.setdefault(r.query_id, []).append(r.asDict())
    want = {(q, r["pos"], r["name"], r["supporting"]) for q, every in groups.items() for r in local.merge_rows(sorted(every, key=lambda x: x["pos"]))}
    assert {(r.query_id, r.pos, r.name, r.supporting) for r in rows("merged_candidates")} == want


def test_research_stops_and_follows_up(spark, rows):
    docs = spark.createDataFrame([(i, f"alpha topic{i % 5} " + "word " * (200 * (i % 3))) for i in range(60)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha topic1"), (2, "nothing here"), (3, "topic2 latest")], "query_id long, query string")
    for name, rounds in (("fast", 1), ("normal", 2)):
        held, packs = research.research(docs, q, name)
        p = {r.query_id: r for r in packs.collect()}
        assert set(p) == {1, 2, 3} and max(r.rounds for r in p.values()) <= rounds and (p[2].n_sources, p[2].stopped) == (0, False)
        keys = [(r.query_id, r.doc) for r in held.collect()]
        assert len(keys) == len(set(keys))
    assert {r.query_id for r in rows("research_packs")} and all(0 <= r.coverage <= 1 for r in rows("research_packs"))


def test_budgets_and_modes():
    b = research.Budget("fast")
    b.use("queries", 2)
    with pytest.raises(RuntimeError):
        b.use("queries")
    with pytest.raises(ValueError):
        b.use("fetches", -1)
    assert (b.left("queries"), b.left("fetches"), research.Budget("?").limits["queries"]) == (0, 3, 5)
    assert research.mode("Quick")["num_queries"] == 3 and research.mode(None)["name"] == "balanced" and research.mode("x", "deep")["max_followups"] == 3


def test_registry_and_lanes(spark):
    r = providers.Registry('{"b": {"priority": 2.0}, "c": {"enabled": false}}')
    make = lambda n: lambda s: s.createDataFrame([(n, 1)], "title string, rank int")
    r.register("a", make("A"), languages=("vi",))
    r.register("b", make("B"))
    r.register("c", make("C"))
    assert [x.provider for x in r.rows(spark, "en").collect()] == ["b"] and sorted(x.provider for x in r.rows(spark, "vi").collect()) == ["a", "b"]
    hn = spark.createDataFrame([('{"title": "T", "objectID": "7", "points": 3}',), ('{"title": "U", "url": "http://u", "points": null}',)], "hit string")
    assert [(x.url, x.score) for x in providers.hacker_news(hn).collect()] == [("https://news.ycombinator.com/item?id=7", 3.0), ("http://u", 0.0)]


def test_extractors(spark):
    html = "<html lang='vi'><head><title>T &amp; x</title><meta name='author' content='Ann'><meta property='og:title' content='OG'></head><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two</b></p><script>x()</script></article><footer>f</footer></body></html>"
    df = spark.createDataFrame([("text/html; charset=utf-8", html), ("text/plain", "# Title\n\nbody text"), ("image/png", "x"), ("text/html", " "), (None, "x")], "mime string, body string")
    got = [r.doc for r in extract.extracted(df).collect()]
    assert (got[0].title, got[0].author, got[0].language, got[0].text) == ("OG", "Ann", "vi", "Head\nOne two")
    assert (got[1].title, got[1].word_count, got[2], got[3], got[4]) == ("Title", 4, None, None, None)
    feed = spark.createDataFrame([("<feed><entry><id>http://arxiv.org/1</id><title>A\n b</title><summary> s </summary><published>2024</published></entry></feed>",), ("<!DOCTYPE x><feed><entry><id>e</id></entry></feed>",)], "xml string")
    assert [(r.url, r.title, r.snippet) for r in extract.arxiv_entries(feed).collect()] == [("http://arxiv.org/1", "A b", "s")]
    maps = spark.createDataFrame([("r", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>r</loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc>p1</loc></url><url><loc>p2</loc></url></urlset>")], "url string, xml string")
    assert [(r.url, r.depth) for r in extract.sitemap_tree(maps, spark.createDataFrame([("r",)], "url string")).orderBy("url").collect()] == [("p1", 1), ("p2", 1)]


def test_golden_set_and_sql_functions(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"queries": [{"query_id": "1", "query": "q", "relevant_urls": ["u"]}]}))
    assert extract.golden_set(spark, str(tmp_path / "g.json")).first().relevant_urls == ["u"]
    extract.register_sql(spark)
    row = spark.sql("SELECT json_float(1.5D), json_float(NULL), identity_canon('p', NULL, ' Nam\"e ', NULL, 1D, NULL), identity_canon('p', 'e1', NULL, NULL, NULL, NULL)").first()
    assert tuple(row) == ("1.5", "null", '{"a": "", "lat": 1.0, "lon": null, "n": "nam\\"e", "p": "p"}', '{"e": "e1", "p": "p"}')


def test_word_vectors(rows):
    assert all(abs(r.self - 1) < 1e-5 and r.score == 1.0 for r in rows("word_vectors"))


def test_reranked_passages_and_results(rows):
    seen = {}
    for r in rows("passage_rerank"):
        seen.setdefault(r.query_id, []).append((r["rank"], r.score, r.source_id))
    for every in seen.values():
        every.sort()
        assert [x[0] for x in every] == list(range(1, len(every) + 1)) and all(a[1] >= b[1] for a, b in zip(every, every[1:]))
    assert rows("result_rerank") and all(r.reranked is not None for r in rows("result_rerank"))


def test_evidence_gaps(rows, table):
    from collections import defaultdict

    quotes = defaultdict(list)
    texts = {d.doc_id: d.text for d in table("documents")}
    best = {}
    for e in table("events"):
        k = (e.user_id % 97, e.event_type, e.event_id % 41)
        best[k] = max(best.get(k, float("-inf")), e.value)
    for (q, _, key), score in best.items():
        if key in texts:
            quotes[q].append((texts[key], min(score / 100, 1.0)))
    asked = {b.item_id: b.text for b in table("benchmark")}
    for r in rows("evidence_gaps"):
        have = {p for t, _ in quotes[r.query_id] for p in re.split(r"[^\w]+", (t or "").lower())}
        words = [w for w in re.split(r"\s+", asked[r.query_id].lower()) if len(w) > 3]
        missing = [w for w in words if not any(w in p for p in have)]
        assert list(r.missing) == missing[:5] and r.need_more == (len(quotes[r.query_id]) < 3)


def test_fields_text_functions(spark):
    df = spark.createDataFrame([("a b c d e f", "The a b c here", ["b", "c"], "c title")], "q string, t string, k array<string>, h string")
    row = df.select(text.phrase_bonus(F.col("q"), F.col("t")), text.title_boost(F.col("k"), F.col("h")), text.word_shingles(F.lit("x y"), 5), text.shingles(F.lit("x y"), 3)).first()
    assert row[0] == 0.1  # of the query's words, b to f, only "b c" stands in the text
    assert row[1] == 0.125 and len(row[2]) == 1 and row[3] == []


def test_token_near_pairs(rows, spark, sf_dir):
    from tessera.operators import resolution
    from tessera.plans.entities import _sides

    src, dst = ({r.id: r for r in t.collect()} for t in _sides(spark, sf_dir))
    every = {(r.s_id, r.p_id) for r in resolution.block_pairs(*_sides(spark, sf_dir), most=10**9).select("s_id", "p_id").collect()}

    def strong(s, p):
        return (s.phone is not None and s.phone == p.phone) or (s.domain is not None and s.domain == p.domain) or any(len(t) >= 3 for t in set(s.name.split()) & set(p.name.split()))

    assert {(r.s_id, r.p_id) for r in rows("token_near_pairs")} == {(a, b) for a, b in every if strong(src[a], dst[b])}


def test_evidence_batch(rows, table):
    want = set()
    for d in table("documents"):
        if d.doc_id % 9 == 0:
            want.add((d.doc_id % 10, "http://10.0.0.1/x", "blocked_host"))
        elif d.doc_id % 4 == 0 or not d.text:
            want.add((d.doc_id % 10, f"http://d{d.doc_id}.com/", "timeout" if d.doc_id % 8 == 0 else "empty"))
    assert {tuple(r) for r in rows("evidence_batch")} == want


def test_answers(rows, table):
    got = {r.query_id: r for r in rows("answers")}
    assert set(got) == {b.item_id for b in table("benchmark")} and all(r.n > 0 for r in got.values()) and any(r.cached for r in got.values())
    texts = {d.doc_id for d in table("documents")}
    assert texts and all(not r.cached or r.n < 20 for r in got.values())
