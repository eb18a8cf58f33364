"""Provider rows, access and routing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, understanding, urls

#: Paths to scopes, for GET and for other methods, and public paths. Fixed values.
GET_SCOPES = {"models": "chat:use", "places/search": "places:read", "places/autocomplete": "places:read", "places/{id}": "places:read"}
SCOPES = {
    "search": "search:read", "answer": "answer:use", "research": "research:use", "research/stream": "research:use", "news": "news:use", "images": "images:use", "read": "read:use", "evidence": "read:use", "verify": "verify:use",
    "business/search": "business:use", "chat/completions": "chat:use", "fetch": "read:use", "code_search": "search:read",
}
PUBLIC = ("health", "capabilities", "auth/check", "")


def required_scope(path: Column, method: Column) -> Column:
    """null is public; an unknown path is admin:debug."""
    rel = F.trim(F.regexp_replace(path, "^.*?/v1", ""), F.lit("/"))
    exact = F.create_map(*[F.lit(x) for k, v in GET_SCOPES.items() if "{" not in k for x in (k, v)])
    templated = F.coalesce(*[F.when(rel.rlike("^" + "/".join("[^/]+" if p.startswith("{") else p for p in k.split("/")) + "$"), v) for k, v in GET_SCOPES.items() if "{" in k])
    other = F.create_map(*[F.lit(x) for kv in SCOPES.items() for x in kv])
    get = F.coalesce(F.try_element_at(exact, rel), templated, F.when(~rel.isin(*PUBLIC), "admin:debug"))
    return F.when(method == "GET", get).otherwise(F.coalesce(F.try_element_at(other, rel), F.lit("admin:debug")))


def key_contexts(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """calls (key) with the context of the key whose hash matches and that isn't revoked; others have nulls."""
    live = keys.where("revoked_at is null").drop("revoked_at")
    return calls.withColumn("key_hash", identity.sha(F.col("key"))).join(live, "key_hash", "left").drop("key_hash")


def supports(languages: Column, countries: Column, language: Column, country: Column) -> Column:
    """an empty list takes all; no asked value fits any."""
    fits = lambda known, asked: (F.size(known) == 0) | asked.isNull() | (asked == "") | F.array_contains(known, asked)
    return fits(languages, language) & fits(countries, country)


def usable(url: Column, title: Column, snippet: Column) -> Column:
    """F39."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return full(url) & (full(title) | full(snippet))


def result_domain(url: Column, publisher_domain: Column) -> Column:
    """the publisher's domain in the metadata, else the URL's host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")
    return F.coalesce(F.nullif(publisher_domain, F.lit("")), host)


#: Keys of a raw item that the common columns take. Fixed values.
CONSUMED = ("url", "title", "description", "body", "snippet", "published_date", "published_at", "score")


def provider_rows(raw: DataFrame, source: str, source_type: str = "general_web", lane: dict | None = None) -> DataFrame:
    """Raw (rank, item: JSON text of any provider) on the common schema: url, title, snippet, source,
    source_type, published_at, score, metadata (map: the lane's, then what the columns don't take), usable, domain."""
    at = lambda *keys: F.coalesce(*[F.nullif(F.get_json_object("item", f"$.{k}"), F.lit("")) for k in keys])
    rest = F.map_filter(F.coalesce(F.from_json("item", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*CONSUMED) & v.isNotNull())
    own = F.map_filter(F.lit(None).cast("map<string,string>") if not lane else F.create_map(*[F.lit(x) for kv in lane.items() for x in kv]), lambda k, v: v.isNotNull())
    meta = rest if not lane else F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(rest, k)), rest)
    rows = raw.select(
        "rank", F.coalesce(at("url"), F.lit("")).alias("url"), F.coalesce(at("title"), F.lit("")).alias("title"), at("description", "body", "snippet").alias("snippet"), F.lit(source).alias("source"), F.lit(source_type).alias("source_type"),
        at("published_date", "published_at").alias("published_at"), F.coalesce(F.get_json_object("item", "$.score").try_cast("double"), F.lit(0.0)).alias("score"), meta.alias("metadata"),
    )
    return rows.withColumn("usable", usable(F.col("url"), F.col("title"), F.col("snippet"))).withColumn("domain", result_domain(F.col("url"), F.try_element_at("metadata", F.lit("publisher_domain"))))


def ranked_lane(rows: DataFrame, most: int, floor: float, step: float, by: str = "query_id") -> DataFrame:
    """The first `most` of each query by rank, scored 1 - step x place, not under floor."""
    place = F.row_number().over(_window(by)) - 1
    return rows.withColumn("place", place).where(F.col("place") < most).withColumn("score", F.round(F.greatest(F.lit(floor), 1 - F.col("place") * step), 3))


def _window(by: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(by).orderBy("rank")


def hacker_news(hits: DataFrame) -> DataFrame:
    """Hits (hit: JSON of a story): a story without url is its item page; the score is its points."""
    at = lambda k: F.get_json_object("hit", f"$.{k}")
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), at("objectID"))
    return hits.select(F.coalesce(F.nullif(at("url"), F.lit("")), page).alias("url"), F.coalesce(at("title"), F.lit("")).alias("title"), F.coalesce(at("points").try_cast("double"), F.lit(0.0)).alias("score"), at("created_at").alias("published_at"))


def plans(queries: DataFrame, most: int = 10, year: int = 2024) -> DataFrame:
    """Queries (query_id, q): one row a provider run: query_id, family, provider, query, categories, max_results,
    time_range, variant. Metasearch takes up to two variants, the others the query itself."""
    q = F.col("q")
    base = queries.select("query_id", "q", understanding.family(q).alias("family"), understanding.rewrites(q, year).alias("variants"))
    run = lambda provider, text, cats, n, window, variant: F.struct(F.lit(provider).alias("provider"), text.alias("query"), F.lit(cats).alias("categories"), F.lit(n).alias("max_results"), F.lit(window).cast("string").alias("time_range"), F.lit(variant).alias("variant"))

    def meta(cats, n, window=None):
        return [run("searxng", F.get("variants", F.lit(i)), cats, n, window, i) for i in (0, 1)]

    runs = {
        "code": [run("code_search", q, "general", most, None, 0), *meta("general", min(most, 8))],
        "research": [*meta("general", most), run("arxiv", q, "general", min(most, 5), None, 0), run("hn", q, "general", min(most, 5), None, 0)],
        "news": [*meta("general,news", most, "month"), run("ddgs", q, "general,news", min(most, 8), None, 0)],
        "web": [*meta("general", most), run("ddgs", q, "general", min(most, 8), None, 0)],
    }
    chosen = F.when(F.col("family") == "code", F.array(*runs["code"])).when(F.col("family") == "research", F.array(*runs["research"])).when(F.col("family") == "news", F.array(*runs["news"])).otherwise(F.array(*runs["web"]))
    return base.select("query_id", "family", F.explode(F.filter(chosen, lambda r: r.query.isNotNull())).alias("r")).select("query_id", "family", "r.*")


class Registry:
    """Named sources of rows with their specs: name -> (rows(spark) -> DataFrame, spec)."""

    def __init__(self, overlay: str | None = None):
        self._specs, self._rows, self._overlay = {}, {}, json.loads(overlay) if overlay else {}

    def register(self, name: str, rows, **spec) -> None:
        """The overlay (JSON by name) wins over the spec given."""
        self._specs[name] = {"priority": 1.0, "enabled": True, "languages": (), "countries": (), "source_types": ("general_web",)} | spec | self._overlay.get(name, {})
        self._rows[name] = rows

    def spec(self, name: str) -> dict:
        return self._specs[name]

    def rows(self, spark, language: str | None = None, country: str | None = None) -> DataFrame:
        """The rows of every enabled source that fits, with its name, by priority."""
        fits = lambda known, asked: not known or not asked or asked in known
        names = [n for n, s in self._specs.items() if s["enabled"] and fits(s["languages"], language) and fits(s["countries"], country)]
        out = None
        for n in sorted(names, key=lambda n: (-self._specs[n]["priority"], n)):
            part = self._rows[n](spark).withColumn("provider", F.lit(n))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise ValueError("no source fits")
        return out


#: What messages show each outcome, in the order tried. Fixed values.
OUTCOMES = (("captcha", r"captcha|solvemedia|are you a robot|unusual traffic"), ("rate_limited", r"rate.?limit|too many requests|429"), ("timeout", r"time.?out|timed out|deadline exceeded"))


def outcome_of(message: Column, status: Column | None = None) -> Column:
    """Captcha, rate_limited, timeout or error by a failure's HTTP status, if there is one, and its message; a 401, 402
    or 403 is a captcha only if its body says so."""
    m = F.lower(F.coalesce(message, F.lit("")))
    by_text = F.lit("error")
    for name, pattern in reversed(OUTCOMES):
        by_text = F.when(m.rlike(pattern), name).otherwise(by_text)
    if status is None:
        return by_text
    wall = F.when(m.rlike(OUTCOMES[0][1]), "captcha").otherwise("error")
    return F.when(status == 429, "rate_limited").when(status.isin(401, 402, 403), wall).when(status.isNotNull(), "error").otherwise(by_text)


#: Signals in a query: whole words, and phrases anywhere. Fixed values.
SIGNALS = {
    "news": ("news|today|latest|breaking|announced?s?|launch(?:ed)?|released?s?|updated?s?|recall|earnings", "hôm nay|mới nhất|tin tức|tin nóng|vừa|ra mắt|công bố|phát hành"),
    "legal": ("decree|circular|resolution|ordinance|statute|legislation|regulation|directive|bylaw|constitution|legal|lawsuit|compliance", r"nghị định|thông tư|bộ luật|luật|nghị quyết|pháp lệnh|quy định|quyết định|chính phủ|chủ trương|công văn|hiến pháp|pháp luật|chính sách|ban hành|gov\.vn|hóa đơn điện tử"),
    "ecommerce": (r"price|cost|buy|bought|shop(?:ping)?|order|deal|discount|coupon|cheap(?:est)?|for sale|pre-?order|specs|vs", "giá|bao nhiêu tiền|mua|bán|đặt hàng|sản phẩm|khuyến mãi|giảm giá|cửa hàng|đại lý|trả góp|sale"),
    "product": ("iphone|samsung|galaxy|xiaomi|oppo|pixel|macbook|laptop|điện thoại|smartphone|tablet|tai nghe|đồng hồ|rtx|gtx|cpu|gpu|máy tính|vinfast|vf-?[0-9]|airblade|vision|sh[- ]?mode|winner|exciter|sirius|xe máy|xe tay ga|ô tô|xe ô tô|xe điện", None),
    "market": ("stock|stocks|forex|bond|commodity|commodities|bullion|exchange rate|interest rate|vn-?index|hsx|hnx|upcom", "giá vàng|vàng|ngoại tệ|tỷ giá|usd|euro|đô la|chứng khoán|cổ phiếu|trái phiếu|hàng hóa|xăng dầu|giá xăng|giá dầu|giá cà phê|giá gạo|giá lúa|giá heo|giá đất|giá nhà|bất động sản|bitcoin|lợi suất"),
    "company": ("company|corporation|enterprise|revenue|profit|shareholder|ipo|listed|holding|conglomerate|tax code|business registration", "doanh thu|lợi nhuận|công ty|tập đoàn|thương hiệu|sếp|ceo|founder|hồ sơ doanh nghiệp|mã số thuế|niêm yết|cổ đông|pháp nhân|đăng ký kinh doanh|doanh nghiệp|trụ sở công ty"),
    "finance": ("bank|banking|loan|mortgage|credit|debit|insurance|tax|budget|investment|investor|fund|deposit|savings|inflation|gdp", "tài chính|ngân hàng|vay|lãi suất|tín dụng|bảo hiểm|thuế|ngân sách|kho bạc|đầu tư|tiết kiệm|lạm phát|tổng sản phẩm quốc nội"),
    "administrative": ("administrative|province|district|ward|commune|boundary|merger|province merger", "tỉnh thành|quận huyện|phường xã|địa giới|sáp nhập|hành chính|đơn vị hành chính|mã đơn vị|thành phố trực thuộc|trung ương"),
    "medical": ("symptom|symptoms|disease|drug|dosage|dose|treatment|diagnosis|vaccine|clinic|hospital|pharmacy|medicine|medical|surgery|cancer", "bệnh|thuốc|triệu chứng|điều trị|viêm|ung thư|vaccine|tiêm|bệnh viện|phẫu thuật|dược|sức khỏe|khám|chẩn đoán|liều dùng"),
    "document": ("template|form|declaration|document|paperwork|procedure|certificate|permit|application form", "biểu mẫu|mẫu đơn|hồ sơ|văn bản|giấy tờ|thủ tục|giấy phép|giấy chứng nhận|khai báo|mẫu cv"),
    "places": ("near me|nearby|restaurant|hotel|cafe|coffee|barber|atm|gas station|directions|map", "nhà hàng|quán|khách sạn|địa chỉ|ở đâu|gần đây|gần tôi|bản đồ|tiệm|phở|bún|cà phê|trà sữa|siêu thị|bệnh viện|nhà thuốc"),
    "academic": ("arxiv|paper|journal|conference|benchmark|thesis|doi|peer.?reviewed|study|survey of|sota|scientific|academic", "nghiên cứu|học thuật|luận văn|tạp chí khoa học"),
    "code": ("function|class|method|endpoint|import|export|require|module|package|pip install|npm install|github|gitlab|stackoverflow|exception|traceback|stack trace|snippet|implementation of|compile|runtime error|debug", "```|cách (?:fix|sửa) lỗi|lỗi code"),
    "forum": ("reddit|forum|stack ?exchange|quora|threads", "diễn đàn|hỏi đáp|kinh nghiệm|mọi người|voz|tinhte|webtretho"),
    "social": ("tiktok|twitter|facebook|instagram|linkedin|youtube|threads|social media", "mạng xã hội|mọi người (?:nói|bàn|chia sẻ)"),
    "image": ("image|images|photo|picture|logo|poster|wallpaper", "ảnh|hình ảnh|hình nền"),
    "video": ("video|videos|clip|trailer|mp4|vlog", "youtube|phim|clip hướng dẫn"),
    "opinion": ("review|reviews|opinion|worth it|should i|any good", "đánh giá|có nên|tốt không|so sánh|nhận xét"),
}
#: Weights of lanes that each signal asks for. Fixed values.
LANES = {
    "news": {"news": 1.0, "social": 0.5}, "legal": {"government": 1.0, "legal": 1.0, "general_web": 0.5, "news": 0.5, "social": 0.25}, "market": {"market": 1.0, "finance": 0.5, "news": 0.5}, "product": {"product": 1.0}, "shopping": {"ecommerce": 1.0, "places": 0.5},
    "offers": {"ecommerce": 0.8, "product": 0.5}, "company": {"company": 1.0, "business": 0.8, "finance": 0.5, "news": 0.5}, "finance": {"finance": 0.8, "market": 0.5, "news": 0.5}, "administrative": {"administrative": 1.0, "places": 0.5, "government": 0.5}, "medical": {"medical": 0.8, "places": 0.25},
    "document": {"document": 0.8, "government": 0.5, "legal": 0.25}, "places": {"places": 0.8, "ecommerce": 0.25}, "academic": {"academic": 0.8, "forum": 0.25}, "code": {"code": 0.8}, "talk": {"forum": 0.8, "social": 0.5}, "opinion": {"ecommerce": 0.5}, "social": {"social": 0.8}, "image": {"image": 0.8},
    "video": {"video": 0.8}, "comparison": {"forum": 0.5, "ecommerce": 0.5}, "co": {"company": 1.0, "business": 0.8, "finance": 0.5}, "loc": {"places": 0.5, "administrative": 0.5}, "law": {"legal": 1.0, "government": 0.8, "document": 0.5}, "goods": {"product": 0.8, "ecommerce": 0.5}, "person": {"news": 0.5}, "event": {"document": 0.5, "news": 0.5},
}
ALL_LANES = "general_web news government legal places ecommerce forum social academic code video image index business company finance market administrative product medical document".split()


def lane_weights(query: Column, entity_ids: Column | None = None) -> Column:
    """Map of lane to weight: 0 off, the web .8 and the own index .5 always, else the greatest that a signal, the profile or
    the kind of a known entity asks for. Prices of markets aren't shopping."""
    q = F.lower(F.coalesce(query, F.lit("")))
    found = {s: q.rlike(understanding.word_pattern([words]) + (f"|(?:{phrases})" if phrases else "")) for s, (words, phrases) in SIGNALS.items()}
    p = understanding.profile(F.coalesce(query, F.lit("")))
    on = {s: c for s, c in found.items() if s not in ("ecommerce", "forum")}
    on |= {"news": found["news"] | p.freshness_required, "shopping": found["product"] & ~found["market"], "offers": found["ecommerce"] & ~found["product"] & ~found["market"], "talk": found["forum"] | found["opinion"], "comparison": p.intent == "comparison"}
    if entity_ids is not None:
        kinds = {"co": "co", "loc": "loc", "law": "legal", "goods": "product", "person": "person", "event": "event"}
        on |= {k: F.exists(entity_ids, lambda e, v=v: e.startswith(v + ":")) for k, v in kinds.items()}
    base = {"general_web": 0.8, "index": 0.5}
    weight = lambda lane: F.greatest(F.lit(base.get(lane, 0.0)), F.lit(0.0), *[F.when(c, LANES[s][lane]).otherwise(0.0) for s, c in on.items() if lane in LANES.get(s, {})])
    return F.create_map(*[x for lane in ALL_LANES for x in (F.lit(lane), weight(lane))])


#: Kinds of directly known sources: type, name, address and facts by their JSON paths ({} is the id asked for). Fixed values.
DIRECT = {
    "huggingface": ("model", "$.id", "https://huggingface.co/{}", {"downloads": "$.downloads", "likes": "$.likes", "tags": "$.tags"}), "github": ("repository", "$.full_name", "$.html_url|https://github.com/{}", {"stars": "$.stargazers_count", "forks": "$.forks_count", "language": "$.language"}),
    "arxiv": ("paper", None, "https://arxiv.org/abs/{}", {}), "npm": ("package", "$.name", "https://www.npmjs.com/package/{}", {"version": "$.version", "description": "$.description"}),
    "pypi": ("package", "$.info.name", "$.info.home_page|https://pypi.org/project/{}/", {"version": "$.info.version", "summary": "$.info.summary"}), "wikipedia": ("article", "$.title", "https://en.wikipedia.org/wiki/{}", {"extract": "$.extract"}),
    "openrouter": ("model", "$.id", "https://openrouter.ai/{}", {"context_length": "$.context_length", "pricing": "$.pricing"}),
}


def direct_rows(fetched: DataFrame) -> DataFrame:
    """Fetched (entity_type, entity_id, body: what the source's interface answered, null if it didn't): entity_id, name, type,
    url and metadata of known kinds of sources; others give no row."""
    out = None
    ident = F.col("entity_id")
    for kind, (type_, name, url, facts) in DIRECT.items():
        at = lambda p: F.nullif(F.get_json_object("body", p), F.lit(""))
        fixed = url.split("|")[-1].split("{}")
        own = F.concat(F.lit(fixed[0]), F.replace(ident, F.lit(" "), F.lit("_")) if kind == "wikipedia" else ident, F.lit(fixed[1]))
        place = F.coalesce(at(url.split("|")[0]), own) if "|" in url else own
        known = F.create_map(*[x for k, p in facts.items() for x in (F.lit(k), F.substring(at(p), 1, 500) if k == "extract" else at(p))]) if facts else F.create_map().cast("map<string,string>")
        rows = fetched.where((F.col("entity_type") == kind) & F.col("body").isNotNull()).select("entity_id", (F.coalesce(at(name), ident) if name else ident).alias("name"), F.lit(type_).alias("type"), place.alias("url"), known.alias("metadata"))
        out = rows if out is None else out.unionByName(rows)
    return out
