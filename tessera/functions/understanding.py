r"""What a query asks.

Word lists are matched as whole words by patterns that Java and RE2 read alike: neighbours are anything but
letters, digits and underscores.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

_EDGE = r"[^\p{L}\p{N}_]"


def java(pattern: str) -> str:
    """A pattern whose (?i) is to hold for all letters: Java takes it for ASCII alone, RE2 for all."""
    return pattern.replace("(?i", "(?iu")


def word_pattern(words) -> str:
    return rf"(?:^|{_EDGE})(?:{'|'.join(words)})(?:$|{_EDGE})"


def phrase_pattern(phrases) -> str:
    return "(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in phrases) + ")"


_W = r"[\p{L}\p{N}_]"
#: Patterns of query types, families, depths and so on. Fixed values.
CODE_TYPE = "|".join([
    word_pattern(["function", "class", "method", "api", "endpoint", "bug", "error", "stack trace", "exception"]),
    word_pattern(["python", "javascript", "typescript", "rust", "golang", "java", "ruby", "php"]), rf"(?:^|{_EDGE})c\+\+{_W}",
    word_pattern(["github", "gitlab", "npm", "pip", "cargo", r"crates?\.io"]), rf"[a-zA-Z_]{_W}*\.[a-zA-Z_]{_W}*\(", "```", word_pattern(["import", "export", "require", "module", "package"]),
])
RESEARCH_TYPE = "|".join([
    word_pattern(["compare", "comparison", "analysis", "deep dive", "comprehensive", "thorough"]), word_pattern(["pros and cons", "advantages", "disadvantages", "trade-?offs?"]),
    word_pattern(["architecture", "design pattern", "best practices?", "guide", "tutorial"]), word_pattern(["history of", "evolution of", "state of"]), word_pattern(["research", "study", "investigate", "analyze"]),
])
CODE_FAMILY = "|".join([
    word_pattern(["function", "class", "method", "api", "endpoint", "import", "export", "require", "pip install", "npm install", "github", "gitlab", "stackoverflow", "exception", "traceback", "snippet", "implementation of"]), rf"(?:^|{_EDGE})docs\.{_W}",
    word_pattern(["python", "javascript", "typescript", "rust", "golang", "go", "java", "kotlin", "swift", "ruby", "php", "sql", "bash", "shell", "powershell", "react", "vue", "django", "fastapi", "flask"]), rf"(?:^|{_EDGE})c\+\+{_W}",
])
RESEARCH_FAMILY = "|".join([
    word_pattern(["research", "paper", "study", "survey", "analysis", "arxiv", "benchmark", "empirical", "academic", "thesis", "literature", "sota", "state of the art", "comparison of"]),
    word_pattern("""research paper study analysis algorithm implementation framework library benchmark performance comparison architecture design pattern arxiv survey review academic scientific model neural network machine
    learning deep transformer llm gpt bert embedding vector database distributed system consensus protocol raft paxos blockchain cryptography evaluation empirical theoretical""".split()),
])
NEWS_FAMILY = "|".join([
    word_pattern(["news", "today", "latest", "breaking", "hôm nay", "mới nhất", "tin nóng", "vừa", "release", "announce", "launch", "update", "ra mắt"]),
    word_pattern(["2025", "2026", "this week", "this month", "last week", "last month", "tuần này", "tháng này"]),
])
QUICK = phrase_pattern(["what is", "who is", "define", "meaning", "là gì", "ai là", "định nghĩa"])
DEEP = phrase_pattern(["so sánh", "phân tích", "nghiên cứu", "compare", "analyze", "research", "review", "đánh giá"])
NEWS = phrase_pattern(["hôm nay", "mới nhất", "tin tức", "today", "latest", "news", "vừa ra", "recent"])
SHOPPING = phrase_pattern(["giá", "price", "mua", "buy", "đáng mua", "best", "tốt nhất", "rẻ", "expensive"])
TECH = phrase_pattern(["version", "release", "update", "api", "library", "framework", "model"])
OFFICIAL = phrase_pattern(["pháp luật", "luật", "legal", "official", "chính thức"])
#: Words that suggest a category. Fixed values.
CATEGORIES = {
    "images": phrase_pattern(["image", "photo", "picture", "logo"]), "news": phrase_pattern(["news", "latest", "recent", "today", "2026", "2025"]), "videos": phrase_pattern(["video", "youtube", "tutorial video"]),
    "science": phrase_pattern(["science", "paper", "research", "academic", "arxiv"]), "it": phrase_pattern(["it", "server", "linux", "docker", "kubernetes", "devops"]),
}
#: Markers of the profile's intents. Fixed values.
TONES = "[áàảãạăắằẳẵặâấầẩẫậđéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵ]"
COMPARISON = word_pattern(["so sánh", "so với", "vs", "versus", "compare", "khác nhau"])
FRESH = word_pattern(["mới", "mới nhất", "hôm nay", "hiện tại", "ngày", "latest", "today", "now", "current", "news", "new"])
DEFINITION = word_pattern(["là gì", "định nghĩa", "what is", "define", "meaning"])
HOWTO = word_pattern(["cách", "làm thế nào", "how to", "how do", "hướng dẫn"])
OPINION = word_pattern(["ý kiến", "đánh giá", "tốt không", "opinion", "review"])
PROFILE_STOPWORDS = tuple("là gì có mới nhất hôm nay của và hay không được như thế nào cách làm the is what how to a an and or of in với so cũng cho về từ đến tại trên dưới".split())
#: Lifetimes of answers, over the folded query. Fixed values.
LOCAL_NOW = word_pattern(["dang mo", "gan day", "gan toi", "gio mo cua", "local", "mo cua", "near me", "open now", "quanh day"])
CURRENT = word_pattern(["bay gio", "breaking", "current", "gio", "hien tai", "hom nay", "latest", "moi nhat", "news", "now", "tin moi", "tin tuc", "today", "tonight", "vua ra mat"])
STATIC = word_pattern(["api reference", "cach su dung", "cach dung", "cu phap", "documentation", "how to", "huong dan", "syntax", "tutorial"])
#: Live, numeric, event and timeless markers. Fixed values.
LIVE = word_pattern(["today", "now", "tonight", "live"]) + "|" + phrase_pattern(["hôm nay", "hom nay", "hôm qua", "hom qua", "hiện tại", "hien tai", "trực tiếp", "truc tiep", "mới nhất", "moi nhat"])
_PRICES = ["giá vàng", "gia vang", "giá heo", "gia heo", "giá xăng", "gia xang", "giá gạo", "gia gao", "giá bạc", "gia bac", "giá bitcoin", "gia bitcoin", "giá bán", "gia ban", "tỷ giá", "ty gia", "ngoại tệ", "ngoai te", "lãi suất", "lai suat", "chỉ số", "chi so", "cổ phiếu", "co phieu", "how much"]
NUMERIC = phrase_pattern(_PRICES) + "|" + word_pattern(["price", "prices", "usd", "vnd", "stock", "stocks", "nasdaq", "dow"])
RATES = word_pattern(["rate", "rates"])  # unless the query is about rate limits
EVENT = word_pattern("result results score scores match fixture fixtures schedule weather forecast epl kqxs".split()) + "|" + phrase_pattern(
    ["xổ số", "xo so", "kết quả", "ket qua", "bóng đá", "bong da", "lịch thi đấu", "lich thi dau", "thời tiết", "thoi tiet", "dự báo thời tiết", "du bao thoi tiet", "vé số", "ve so", "premier league", "world cup", "champions league"]
)
EVERGREEN = word_pattern("what whats history histories define definition definitions meaning meanings explain explains explanation explained tutorial tutorials guide guides overview introduction intro concept concepts".split()) + "|" + phrase_pattern(
    ["là gì", "la gi", "lịch sử", "lich su", "định nghĩa", "dinh nghia", "khái niệm", "khai niem", "hướng dẫn", "huong dan", "giới thiệu", "gioi thieu", "so sánh", "so sanh", "khác nhau", "khac nhau", "rate limit", "rate limiting"]
)
TONELESS = phrase_pattern(["hom nay", "hom qua", "hien tai", "truc tiep", "moi nhat", "gia vang", "gia heo", "gia xang", "gia gao", "gia bac", "gia bitcoin", "gia ban", "ty gia", "ngoai te", "lai suat", "chi so", "co phieu", "xo so", "ket qua", "bong da", "lich thi dau", "thoi tiet", "du bao thoi tiet", "ve so"])
SUFFIXES = {
    "numeric": {"en": ("price", "rate", "quoted"), "vi": ("hôm nay", "mới nhất", "giá", "tỷ giá")},
    "event": {"en": ("today", "latest", "results"), "vi": ("kết quả", "hôm nay", "mới nhất")},
    "live": {"en": ("today", "latest", "now"), "vi": ("hôm nay", "mới nhất", "trực tiếp")},
}
#: Markers of local businesses; markers of the taxonomy in order, and their map tags. Fixed values.
LOCAL_MARKERS = phrase_pattern(["quán", "nhà hàng", "cafe", "cà phê", "khách sạn", "siêu thị", "cửa hàng", "bar", "pub", "spa", "salon", "phòng khám", "bệnh viện", "trường", "học", "gần", "ở đâu", "tại đâu", "địa chỉ", "giờ mở", "giờ đóng", "mở cửa", "số điện thoại", "near me", "address", "phone", "opening hours", "restaurant", "hotel", "store", "shop", "local", "where is"])
TAXONOMY = {
    "cafe": "cafe", "coffee": "cafe", "quán cà phê": "cafe", "cà phê": "cafe", "quán ăn": "restaurant", "nhà hàng": "restaurant", "restaurant": "restaurant", "quán phở": "restaurant", "quán cơm": "restaurant", "quán bún": "restaurant", "quán nhậu": "bar", "bar": "bar",
    "khách sạn": "hotel", "hotel": "hotel", "nhà nghỉ": "guest_house", "siêu thị": "supermarket", "supermarket": "supermarket", "tạp hóa": "convenience", "cửa hàng tiện lợi": "convenience", "cửa hàng": "store", "shop": "store", "store": "store", "chợ": "marketplace",
    "nhà thuốc": "pharmacy", "hiệu thuốc": "pharmacy", "pharmacy": "pharmacy", "phòng khám": "clinic", "trạm y tế": "clinic", "bệnh viện": "hospital", "nha khoa": "dentist", "thú y": "veterinary", "ngân hàng": "bank", "bank": "bank", "atm": "bank", "trạm xăng": "fuel", "cây xăng": "fuel",
    "trường học": "school", "đại học": "university", "salon": "hairdresser", "spa": "spa", "quán": "restaurant",
}
OSM_TAGS = {
    "restaurant": ("amenity", "restaurant"), "cafe": ("amenity", "cafe"), "bar": ("amenity", "bar"), "pharmacy": ("amenity", "pharmacy"), "clinic": ("amenity", "clinic"), "hospital": ("amenity", "hospital"), "dentist": ("amenity", "dentist"), "veterinary": ("amenity", "veterinary"),
    "bank": ("amenity", "bank"), "fuel": ("amenity", "fuel"), "school": ("amenity", "school"), "university": ("amenity", "university"), "marketplace": ("amenity", "marketplace"), "supermarket": ("shop", "supermarket"), "convenience": ("shop", "convenience"), "store": ("shop", None),
    "hotel": ("tourism", "hotel"), "guest_house": ("tourism", "guest_house"), "hairdresser": ("shop", "hairdresser"),
}
#: Fillers before a question, and the patterns of rewriting. Fixed values.
NOISE = r"(?i)^\s*(?:please|could you|can you|tell me|cho tôi hỏi|cho mình hỏi)\s+"
IS_COMPARE = r"(?i)" + word_pattern(["vs", "versus", "so sánh", "so với", "compared?", "khác nhau giữa"])
IS_DEFINITION = r"(?i)" + word_pattern(["là gì", "định nghĩa", "nghĩa là", "what is", "what are", "define", "meaning of", "explain"])
HAS_MEANING = r"(?i)" + word_pattern(["meaning", "definition", "nghĩa là"])
IS_HOWTO = r"(?i)" + word_pattern(["cách", "làm thế nào", "hướng dẫn", "how to", "how do i", "tutorial"])
HAS_EXAMPLE = r"(?i)" + word_pattern(["example", "tutorial", "guide", "ví dụ", "hướng dẫn"])
IS_CODE = r"(?i)" + word_pattern("python javascript typescript rust golang java kotlin swift ruby php sql bash react vue django fastapi flask docker kubernetes api endpoint middleware function async decorator".split()) + rf"|(?:^|{_EDGE})c\+\+{_W}"
HAS_DOCS = r"(?i)" + word_pattern(["docs", "documentation", "example", "tutorial", "tài liệu"])
HAS_YEAR = word_pattern([r"(?:19|20)[0-9]{2}"])
IS_RECENT = r"(?i)" + word_pattern(["hôm nay", "today", "latest", "new", "mới nhất", "tin nóng", "breaking", "năm nay", "this year"])
REWRITE_TONES = "(?i)[àáảãạăắằẳẵặâấầẩẫậđèéẻẽẹêếềểễệìíỉĩịóòỏõọôốồổỗộơớờởỡợùúủũụưứừửữựýỳỷỹỵ]"


def stripped(q: Column) -> Column:
    """Without one leading filler."""
    return F.trim(F.regexp_replace(q, java(NOISE), ""))


def query_type(q: Column) -> Column:
    """X72."""
    low = F.lower(q)
    return F.when(low.rlike(CODE_TYPE), "code").when(low.rlike(RESEARCH_TYPE), "research").otherwise("web")


def family(q: Column) -> Column:
    """X76."""
    low = F.lower(F.coalesce(q, F.lit("")))
    return F.when(low.rlike(CODE_FAMILY), "code").when(low.rlike(RESEARCH_FAMILY), "research").when(low.rlike(NEWS_FAMILY), "news").otherwise("web")


def intent(q: Column) -> Column:
    """Struct of depth, freshness, news and official_first."""
    low = F.lower(q)
    return F.struct(
        F.when(low.rlike(QUICK), "quick").when(low.rlike(DEEP), "deep").otherwise("normal").alias("depth"),
        F.when(low.rlike(NEWS), "day").when(low.rlike(SHOPPING), "week").when(low.rlike(TECH), "month").otherwise("any").alias("freshness"),
        low.rlike(NEWS).alias("news"), low.rlike(OFFICIAL).alias("official_first"),
    )


def categories(q: Column) -> Column:
    """X77."""
    low = F.lower(q)
    return F.array_compact(F.array(F.lit("general"), *[F.when(low.rlike(p), name) for name, p in CATEGORIES.items()]))


def profile(q: Column) -> Column:
    """Struct of intent, language, freshness_required, max_age and entities (words that carry meaning)."""
    low = F.trim(F.lower(q))
    kind = F.when(low.rlike(COMPARISON), "comparison").when(low.rlike(FRESH), "current_fact").when(low.rlike(DEFINITION), "definition").when(low.rlike(HOWTO), "howto").when(low.rlike(OPINION), "opinion").otherwise("current_fact")
    return F.struct(
        kind.alias("intent"), F.when(low.rlike(TONES), "vi").otherwise("en").alias("language"), low.rlike(FRESH).alias("freshness_required"), F.when(low.rlike(FRESH), "24h").alias("max_age"),
        F.filter(text.words(low), lambda t: (F.length(t) > 1) & ~t.isin(*PROFILE_STOPWORDS)).alias("entities"),
    )


def lifetime(q: Column) -> Column:
    """D07."""
    folded = F.trim(F.regexp_replace(text.fold(F.coalesce(q, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(folded.rlike(LOCAL_NOW), "hours").when(folded.rlike(CURRENT), "minutes").when(folded.rlike(STATIC), "static").otherwise("days")


def freshness_signal(q: Column) -> Column:
    """Struct of time_range (day, week or null), live, numeric, event, evergreen and language."""
    low = F.trim(F.lower(F.coalesce(q, F.lit(""))))
    live, event = low.rlike(LIVE), low.rlike(EVENT)
    numeric = low.rlike(NUMERIC) | (low.rlike(RATES) & ~low.contains("rate limit"))
    return F.struct(F.when(live, "day").when(numeric | event, "week").alias("time_range"), live.alias("live"), numeric.alias("numeric"), event.alias("event"), low.rlike(EVERGREEN).alias("evergreen"), F.when(low.rlike(TONES) | low.rlike(TONELESS), "vi").otherwise("en").alias("language"))


def widened(q: Column, signal: Column) -> Column:
    """The query with the first suffix of its family that it lacks; null if it isn't time-sensitive or has all."""
    trimmed = F.trim(q)
    kind = F.when(signal.live, "live").when(signal.event, "event").when(signal.numeric, "numeric")
    table = F.create_map(*[x for k, langs in SUFFIXES.items() for lang, words in langs.items() for x in (F.lit(f"{k}/{lang}"), F.array(*map(F.lit, words)))])
    fitting = F.try_element_at(table, F.concat(kind, F.lit("/"), signal.language))
    first = F.get(F.filter(fitting, lambda s: ~F.lower(trimmed).contains(s)), F.lit(0))
    return F.when(trimmed != "", F.concat(trimmed, F.lit(" "), first))


def is_local(q: Column) -> Column:
    """Plain substrings, so short markers hit inside longer words too."""
    return F.lower(F.coalesce(q, F.lit(""))).rlike(LOCAL_MARKERS)


def taxonomy(q: Column) -> Column:
    """The first marker as written, else the first without marks, else empty."""
    low = F.concat(F.lower(q), F.lit(" "))
    folded = text.fold(low)
    out = F.coalesce(*[F.when(low.contains(m), c) for m, c in TAXONOMY.items()], *[F.when(folded.contains(m), c) for m, c in FOLDED_TAXONOMY], F.lit(""))
    return out


def osm_tag(category: Column) -> Column:
    """Struct of key and value; no value: any under the key."""
    keys = F.create_map(*[F.lit(x) for c, (k, _) in OSM_TAGS.items() for x in (c, k)])
    values = F.create_map(*[F.lit(x) for c, (_, v) in OSM_TAGS.items() if v for x in (c, v)])
    return F.struct(F.coalesce(F.try_element_at(keys, category), F.lit("amenity")).alias("key"), F.try_element_at(values, category).alias("value"))


def _fold(s: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", s.lower()).replace("đ", "d") if not unicodedata.combining(c))


FOLDED_TAXONOMY = tuple((_fold(m), c) for m, c in TAXONOMY.items())


def rewrites(q: Column, year: int, most: int = 3) -> Column:
    """Up to `most` variants, the query without filler first: the sides of a comparison, a qualifier for
    definitions, how-tos and code, the year for what is recent."""
    base = stripped(F.coalesce(q, F.lit("")))

    def of(s: Column) -> Column:
        vi = s.rlike(java(REWRITE_TONES))
        bare = F.regexp_replace(s, r"(?iu)^\s*(?:so sánh|compare)\s+", "")
        joined = F.regexp_replace(bare, rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:so sánh|compare|so với|và|and|between)(?![\p{{L}}\p{{N}}_])", " vs ")
        sides = F.filter(F.transform(F.split(joined, "vs"), lambda p: F.regexp_replace(F.trim(p), r"^[?.]+|[?.]+$", "")), lambda p: p != "")
        pair = text.let(sides, lambda p: F.when(s.rlike(java(IS_COMPARE)) & (F.size(p) == 2) & F.forall(p, lambda x: F.length(x) > 2), p).otherwise(F.array().cast("array<string>")))
        family_code = F.lower(s).rlike(IS_CODE)
        more = F.array_compact(F.array(
            F.when(s.rlike(java(IS_DEFINITION)) & ~s.rlike(java(HAS_MEANING)), F.concat(s, F.when(vi, " nghĩa là").otherwise(" meaning definition"))),
            F.when(s.rlike(java(IS_HOWTO)) & ~s.rlike(java(HAS_EXAMPLE)), F.concat(s, F.when(vi, " ví dụ hướng dẫn").otherwise(" example tutorial"))),
            F.when(family_code & ~s.rlike(java(HAS_DOCS)), F.concat(s, F.when(vi, " tài liệu ví dụ").otherwise(" docs example"))),
            F.when(~s.rlike(HAS_YEAR) & s.rlike(java(IS_RECENT)), F.concat(s, F.lit(f" {year}"))),
        ))
        tidy = lambda v: F.regexp_replace(F.trim(F.regexp_replace(v, r"\s+", " ")), r"^[ ?.]+|[ ?.]+$", "")
        found = F.filter(F.transform(F.concat(pair, more), tidy), lambda v: v != "")
        first = text.first_of_equals(F.concat(F.array(s), found), F.lower)
        return F.when(s == "", F.array(F.coalesce(q, F.lit("")))).otherwise(F.slice(first, 1, most))

    return text.let(base, of)


#: Words that join questions, that name aspects, and that begin comparisons. Fixed values.
CONJUNCTIONS = ("và", "and", "&", "vs", "với", "versus", "hoặc", "hay", "or")
ASPECTS = ("giá", "ngày ra mắt", "ngày", "price", "release date", "specs", "review", "đánh giá", "hiệu năng", "performance", "thiết kế", "design", "pin", "battery", "camera", "màn hình", "display", "tính năng", "features")
COMPARISON_PREFIXES = ("so sánh", "so với", "compare", "versus", "vs")


def decomposed(q: Column, most: int = 2) -> Column:
    """The parts that conjunctions join, `most` of them, the last taking the rest; a part that only names an aspect
    gets the first part's entity in front."""
    alternatives = lambda words: "|".join(re.escape(w).replace(r"\ ", " ") for w in sorted(words, key=len, reverse=True))
    trimmed = F.trim(q)

    def parts_of(s: Column) -> Column:
        raw = F.filter(F.transform(F.split(s, rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{alternatives(CONJUNCTIONS)})(?![\p{{L}}\p{{N}}_])"), lambda p: F.trim(p)), lambda p: p != "")
        few = F.when(F.size(raw) > most, F.concat(F.slice(raw, 1, most - 1), F.array(F.array_join(F.slice(raw, most, F.size(raw)), " ")))).otherwise(raw)
        return F.transform(few, lambda p: F.trim(F.regexp_replace(p, rf"(?iu)^(?:{alternatives(COMPARISON_PREFIXES)})", "")))

    def carried(v: Column) -> Column:
        entity = F.trim(F.regexp_replace(F.trim(F.get(v.parts, F.lit(0))), rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{alternatives(ASPECTS)})\s*$", ""))
        aspect = lambda p: F.lower(p).rlike(rf"^(?:{alternatives(ASPECTS)})")
        rest = F.transform(F.slice(v.parts, 2, most), lambda p: F.when(aspect(p) & (entity != "") & ~F.lower(p).contains(F.lower(entity)), F.concat(entity, F.lit(" "), p)).otherwise(p))
        return F.when((F.size(v.parts) <= 1) | (v.q == "") | F.lit(most <= 1), F.array(v.q)).otherwise(F.concat(F.slice(v.parts, 1, 1), rest))

    return text.let(F.struct(trimmed.alias("q"), parts_of(trimmed).alias("parts")), carried)
