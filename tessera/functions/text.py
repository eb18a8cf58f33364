"""Text scalars. Every function takes and returns a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and their plain forms. Fixed values.
MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđäëïöüñçåîûñ"
#: Business forms that a name may begin with. Fixed values.
NAME_PREFIXES = r"công ty|cong ty|cty|tnhh|cp|jsc|co\.?,?\s*ltd|llc|cửa hàng|cua hang|quán|quan|tiệm|tiem|nhà hàng|nha hang|shop|store|siêu thị|sieu thi|hiệu thuốc|hieu thuoc|nhà thuốc|nha thuoc|phòng khám|phong kham|trạm|tram|bến|ben"
#: Operational statuses by provider wording. Fixed values.
STATUSES = {
    "operational": "open", "open": "open", "open_for_business": "open", "dang hoat dong": "open", "mo cua": "open",
    "closed_temporarily": "temporarily_closed", "temporarily_closed": "temporarily_closed", "tam dong cua": "temporarily_closed", "tam ngung": "temporarily_closed", "ngung tam": "temporarily_closed",
    "closed_permanently": "permanently_closed", "permanently_closed": "permanently_closed", "closed": "permanently_closed", "dong cua": "permanently_closed", "da dong cua": "permanently_closed", "ngung hoat dong": "permanently_closed",
}
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with")
#: Words that claims don't count as keywords, and words that deny. Fixed values.
CLAIM_STOPWORDS = tuple(
    """the a an and or of in on at to for with by from as is are was were be been has have had do does did will would can could may might should this that these those it its he she they we you i not no but
    if than then so also such into about over under between after before during which who whom whose there here their our your his her them us me my
    là gì có mới nhất hôm nay của và hay không được như thế nào cách làm với cho về từ đến tại trên dưới cũng đã sẽ đang theo một hai ba bốn năm sáu bảy tám chín""".split()
)
NEGATIONS = tuple("not no never none without deny denied denies refute refuted refutes false incorrect wrong misleading fake untrue disproven disproved contradicts không chưa chẳng sai".split())


def fold(x: Column) -> Column:
    """Lower case without marks, trimmed."""
    plain = "".join(_plain(c) for c in MARKED)
    return F.trim(F.translate(F.lower(x), MARKED, plain))


def _plain(c: str) -> str:
    import unicodedata

    return "d" if c == "đ" else unicodedata.normalize("NFKD", c)[0]


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def fold_diacritics(x: Column) -> Column:
    """X02."""
    return squeezed(fold(x))


def norm_name(x: Column) -> Column:
    """Folded, leading business forms off until none is left, punctuation to spaces."""
    folded = fold_diacritics(F.coalesce(x, F.lit("")))
    bare = F.regexp_replace(folded, rf"^(?:(?:{NAME_PREFIXES})(?![\p{{L}}\p{{N}}_])[\s.\-,:]*)+", "")
    return squeezed(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " "))


def norm_address(x: Column) -> Column:
    """X11."""
    return squeezed(F.regexp_replace(fold_diacritics(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "))


def name_tokens(norm: Column) -> Column:
    """Distinct tokens of a normalised name."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda t: t != ""))


def name_signature(norm: Column) -> Column:
    """X06."""
    return F.array_join(F.array_sort(F.filter(F.split(norm, " "), lambda t: t != "")), " ")


def norm_phone(x: Column) -> Column:
    """The +84 form; null unless 8 to 13 digits follow."""
    d = F.regexp_replace(F.coalesce(x, F.lit("")), r"\D+", "")
    full = (
        F.when(d.startswith("00"), F.concat(F.lit("+"), F.substring(d, 3, 1000)))
        .when(d.startswith("84"), F.concat(F.lit("+"), d))
        .when(d.startswith("0"), F.concat(F.lit("+84"), F.substring(d, 2, 1000)))
        .when((d != "") & (F.length(d) > 10), F.concat(F.lit("+"), d))
        .when(d != "", F.concat(F.lit("0"), d))
        .otherwise("")
    )
    n = F.length(F.regexp_replace(full, r"^\+", ""))
    return F.when(n.between(8, 13), F.when(full.startswith("+"), full).otherwise(F.concat(F.lit("+"), full)))


def norm_status(x: Column) -> Column:
    """By table, then by a part of the word."""
    s = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    folded = fold_diacritics(s)
    table = F.create_map(*[F.lit(v) for kv in STATUSES.items() for v in kv])
    return F.when(s != "", F.coalesce(F.try_element_at(table, s), F.try_element_at(table, folded), F.when(folded.contains("permanent"), "permanently_closed"), F.when(folded.contains("temporar"), "temporarily_closed")))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once a row: inside lambdas a plain expression runs again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(x: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokenize(x: Column) -> Column:
    """Words that are no stopwords."""
    return F.filter(words(x), lambda t: ~t.isin(*STOPWORDS))


def keywords(x: Column) -> Column:
    """Words of two or more characters that carry a claim."""
    return F.filter(words(x), lambda t: (F.length(t) > 1) & ~t.isin(*CLAIM_STOPWORDS))


def index_terms(x: Column) -> Column:
    """What the lexical lane indexes: words of two or more characters that are no stopwords."""
    return F.filter(words(x), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def sentences(x: Column) -> Column:
    """Split after . ! ? or at line breaks; empty parts go."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def share(part: Column, whole: Column) -> Column:
    return F.when(F.size(whole) == 0, 0.0).otherwise(F.size(part) / F.size(whole))


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's words of two or more characters that the text has."""
    q = F.array_distinct(F.filter(words(query), lambda t: F.length(t) > 1))
    return share(F.array_intersect(q, words(text)), q)


def overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Size of the intersection over the geometric mean of the sizes."""
    q, t = F.array_distinct(query_tokens), F.array_distinct(text_tokens)
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.sqrt(F.size(q) * F.size(t)))


def jaccard(a: Column, b: Column) -> Column:
    """Over sets; two empty ones give 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    """Intersection over the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def _runs(w: Column, n: int, most: int | None = None) -> Column:
    """The n-word windows of an array of words, joined by spaces; of the first `most` positions."""
    last = F.size(w) - n + 1 if most is None else F.least(F.size(w) - n + 1, F.lit(most))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def phrase_bonus(query: Column, text: Column) -> Column:
    """.15 for each three-word run of the query in the text, .10 for each two-word run, .3 at most."""

    def hits(q: Column, low: Column, n: int, gain: float) -> Column:
        return F.size(F.filter(_runs(q, n), lambda r: low.contains(r))) * gain

    return let(F.struct(tokenize(query).alias("q"), F.lower(text).alias("low")), lambda v: F.least(hits(v.q, v.low, 3, 0.15) + hits(v.q, v.low, 2, 0.10), F.lit(0.3)))


def title_boost(query_tokens: Column, title: Column) -> Column:
    """A quarter of the share of query tokens that the title has."""
    found = lambda t: F.size(F.filter(query_tokens, lambda x: F.array_contains(t, x))) / F.size(query_tokens) * 0.25
    return let(tokenize(title), lambda t: F.when((F.size(query_tokens) == 0) | (F.size(t) == 0), 0.0).otherwise(found(t)))


def supports(claim: Column, source: Column, least: float = 0.4) -> Column:
    """Share of the claim's keywords that the source has reaches `least`."""
    k = F.array_distinct(keywords(claim))
    return share(F.array_intersect(k, words(source)), k) >= least


def negated_near(claim: Column, source: Column, reach: int = 5) -> Column:
    """Part of X39: a negation within `reach` words of a keyword of the claim."""
    no = F.array(*map(F.lit, NEGATIONS))

    def near(v: Column) -> Column:
        spots = F.filter(F.when(F.size(v.t) > 0, F.sequence(F.lit(1), F.size(v.t))).otherwise(F.array().cast("array<int>")), lambda i: F.array_contains(v.k, F.element_at(v.t, i)))
        return F.exists(spots, lambda i: F.arrays_overlap(F.slice(v.t, F.greatest(i - reach, F.lit(1)), i - F.greatest(i - reach, F.lit(1)) + reach + 1), no))

    return let(F.struct(F.array_distinct(keywords(claim)).alias("k"), words(source).alias("t")), near)


def contradicts(claim: Column, source: Column, least: float = 0.4) -> Column:
    """X39."""
    return supports(claim, source, least) & negated_near(claim, source)


def language(x: Column) -> Column:
    """Vi by its marks, else en."""
    return F.when(F.lower(x).rlike("[ăắằẳẵặâấầẩẫậđêếềểễệôốồổỗộơớờởỡợưứừửữựạảẹẻẽịỉĩọỏụủũỳỵỷỹ]"), "vi").otherwise("en")


def fixed_chunks(x: Column, size: int = 800, stride: int = 600) -> Column:
    """Structs (start, text) every `stride` characters while a start lies in the text; the last may lie inside the one before."""
    n = F.length(x)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(x, s + 1, F.lit(size)).alias("text")))


def offset_passages(x: Column, size: int = 800, stride: int = 600) -> Column:
    """As fixed_chunks, but ending with the chunk that reaches the end of the text."""
    n = F.length(x)
    last = F.greatest(F.ceil((n - size) / stride), F.lit(0)).cast("int") * stride
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end"), F.substring(x, s + 1, F.lit(size)).alias("text")))


def shingles(x: Column, n: int = 3, most: int = 600) -> Column:
    """Distinct n-word windows of the first `most` positions, as the first 32 bits of their SHA-1."""
    named = lambda r: F.conv(F.substring(F.sha1(F.encode(r, "UTF-8")), 1, 8), 16, 10).cast("long")
    return let(words(x), lambda w: F.array_distinct(F.transform(_runs(w, n, most), named)))


def word_shingles(x: Column, n: int = 5) -> Column:
    """Distinct n-word windows of a whole text as 64-bit hashes; of fewer words, all of them as one."""
    whole = lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(_runs(w, n))
    return let(words(x), lambda w: F.array_distinct(F.transform(whole(w), lambda r: F.xxhash64(r))))


def numbers(x: Column, most: int = 10) -> Column:
    """The first figures of a text."""
    return F.slice(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0)), 1, most)


def short_hash(x: Column, n: int) -> Column:
    """The first n hex digits of the SHA-256."""
    return F.substring(F.sha2(F.encode(x, "UTF-8"), 256), 1, n)


def first_of_equals(every: Column, form: Callable[[Column], Column]) -> Column:
    """The elements of an array without those whose form an earlier one has. The array and its forms are computed once a row, not once an element."""
    both = F.transform(every, lambda v: F.struct(v.alias("v"), form(v).alias("f")))
    return let(both, lambda b: let(F.transform(b, lambda x: x.f), lambda forms: F.transform(F.filter(b, lambda x, i: F.array_position(forms, x.f) == i + 1), lambda x: x.v)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex strings; 64 if their lengths differ or they aren't hex."""

    def half(x: Column, at: int) -> Column:
        return F.conv(F.substring(x, at, 8), 16, 10).cast("long")

    return F.when((F.length(a) != F.length(b)) | (F.length(a) != 16), 64).otherwise(F.coalesce(F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9))), F.lit(64)))


def quote_around(content: Column, first_at: Column) -> Column:
    """From 150 characters before a position to 300 after it."""
    start = F.greatest(first_at - 150, F.lit(1))
    return F.substring(content, start, first_at + 300 - start)


def citation_numbers(answer: Column) -> Column:
    """The distinct numbers cited as [1], [1,2] or [1-3], in order of first use."""
    marks = F.regexp_extract_all(answer, F.lit(r"\[([0-9]+(?:\s*[,-]\s*[0-9]+)*)\]"), F.lit(1))
    parts = F.flatten(F.transform(marks, lambda m: F.split(F.regexp_replace(m, r"\s+", ""), ",")))
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(F.element_at(F.split(p, "-"), 1).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))))


def is_follow_up(x: Column) -> Column:
    """Refers back, or has four words at most."""
    back = F.lower(x).rlike(r"(?:^|\s)(?:it|they|them|that|this|those|these|he|she|nó|họ|cái đó|vậy)(?:\s|[?.!,]|$)")
    return back | (F.size(F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")) <= 4)


def sanitized(x: Column) -> Column:
    """without comments, scripts and styles; a text with an injection phrase becomes a notice and its first 100 characters."""
    bare = F.regexp_replace(x, r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>", "")
    bad = bare.rlike(r"(?i)ignore (?:all |any )?(?:previous|prior|above) instructions|disregard (?:the )?(?:above|previous)|system prompt|you are now")
    return F.when(bad, F.concat(F.lit("[content removed: possible prompt injection] "), F.substring(bare, 1, 100))).otherwise(bare)
