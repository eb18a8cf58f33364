"""Vietnamese addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

#: Cities by their folded names; a parameter of the parser. Fixed values.
CITIES = {
    "ha noi": "Thành phố Hà Nội", "hanoi": "Thành phố Hà Nội", "thanh pho ho chi minh": "Thành phố Hồ Chí Minh", "ho chi minh": "Thành phố Hồ Chí Minh", "tphcm": "Thành phố Hồ Chí Minh", "tp.hcm": "Thành phố Hồ Chí Minh", "tp hcm": "Thành phố Hồ Chí Minh", "hcm": "Thành phố Hồ Chí Minh",
    "sai gon": "Thành phố Hồ Chí Minh", "saigon": "Thành phố Hồ Chí Minh", "sg": "Thành phố Hồ Chí Minh", "can tho": "Thành phố Cần Thơ", "da nang": "Thành phố Đà Nẵng", "hai phong": "Thành phố Hải Phòng", "hue": "Thành phố Huế",
}
#: What marks the parts of an address. Fixed values.
CITY_PREFIX = r"^(?:thành phố|thanh pho|tỉnh|tinh|tp\.?|tp)\s*"
DISTRICT = r"(?iu)^(?:quận|quan|huyện|huyen|thị xã|thi xa|thị trấn|thi tran|q\.)\s*"
WARD = r"(?iu)^(?:phường|phuong|xã|xa|thị trấn|thi tran|p\.)\s*"
HOUSE = r"(?iu)^(?:(?:số|so|nhà|nha|no)\s+)?(?:#\s*)?([0-9]+[a-zA-Z]?(?:\s*[/\-]\s*[0-9]+[a-zA-Z]?)*)"
LANE = r"(?iu)^((?:ngõ|ngo|hẻm|hem|kiệt|kiet|ngách|ngach|đường số|duong so)\s+[0-9]+[a-zA-Z]?)(?:$|[^\p{L}\p{N}_])"
STREET = r"(?iu)^((?:đường|duong|phố|pho|đại lộ|dai lo|quốc lộ|quoc lo|tỉnh lộ|tinh lo|lộ|lo|đê|de)\s+)"
KEYWORD = r"(?iu)(?:^|[^\p{L}\p{N}_])(?:phường|phuong|xã|xa|quận|quan|huyện|huyen|thành phố|thanh pho|tỉnh|tinh|ngõ|ngo|hẻm|hem|kiệt|kiet|đường số|duong so|tp\.?)(?:$|[^\p{L}\p{N}_])|(?iu)(?:^|[^\p{L}\p{N}_])[pq]\.[\p{L}\p{N}_]"
FIELDS = ("house_number", "lane", "street", "ward", "district", "city")


def titled(x: Column) -> Column:
    """Words with a digit in capitals, others with a capital first letter."""
    word = lambda w: F.when(w.rlike("[0-9]"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000))))
    return F.array_join(F.transform(F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != ""), word), " ")


def normalized(x: Column) -> Column:
    """X49."""
    t = text.squeezed(F.coalesce(x, F.lit("")))
    for pattern, put in ((r"\s*,\s*", ", "), (r"\s*/\s*", "/"), (r"\s*-\s*", "-")):
        t = F.regexp_replace(t, pattern, put)
    return titled(t)


def _city(part: Column, cities: dict[str, str]) -> Column:
    """The city that a part names; empty if none. Names of three letters or fewer must stand alone."""
    long = [(k, v) for k, v in cities.items() if len(k) > 3]
    short = [(k, v) for k, v in cities.items() if len(k) <= 3]
    bare = F.trim(F.regexp_replace(F.lower(text.squeezed(part)), CITY_PREFIX, ""))

    def named(folded: Column) -> Column:
        hits = [F.when(folded.contains(k), v) for k, v in long] + [F.when(folded.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){k}(?:$|[^\p{{L}}\p{{N}}_])"), v) for k, v in short]
        return F.coalesce(*hits, F.lit(""))

    return text.let(text.fold_diacritics(bare), named)


def _after(part: Column, pattern: str) -> Column:
    return F.when(part.rlike(pattern), titled(F.regexp_replace(part, pattern, ""))).otherwise("")


def parsed(df: DataFrame, address: str, cities: dict[str, str] | None = None) -> DataFrame:
    """Df with FIELDS and `full`. The rightmost part that names a city, a district and a ward by prefix is taken in
    that order; of what is left, the last parts are district and ward; the first is house, lane and street."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(address), F.lit("")), r"[,\n;]"), lambda p: F.trim(p)), lambda p: p != "")
    df = df.withColumn("__parts", parts).withColumn("full", normalized(F.col(address)))
    for name, value in (("city", lambda p: _city(p, cities or CITIES)), ("district", lambda p: _after(p, DISTRICT)), ("ward", lambda p: _after(p, WARD))):
        df = df.withColumn("__found", F.transform("__parts", value))
        last = F.array_max(F.transform("__found", lambda v, i: F.when(v != "", i)))
        df = df.withColumn("__at", F.coalesce(last, F.lit(-1))).withColumn(name, F.coalesce(F.get("__found", F.col("__at")), F.lit("")))
        df = df.withColumn("__parts", F.filter("__parts", lambda p, i: i != F.col("__at")))
    for name in ("district", "ward"):
        spare = (F.size("__parts") > 1) & (F.col(name) == "")
        df = df.withColumn("__spare", spare).withColumn(name, F.when(F.col("__spare"), titled(F.element_at("__parts", -1))).otherwise(F.col(name)))
        df = df.withColumn("__parts", F.when(F.col("__spare"), F.slice("__parts", 1, F.size("__parts") - 1)).otherwise(F.col("__parts")))
    head = F.trim(F.coalesce(F.get("__parts", F.lit(0)), F.lit("")))
    df = df.withColumn("__head", head).withColumn("house_number", F.regexp_replace(F.regexp_extract("__head", HOUSE, 1), r"\s+", ""))
    df = df.withColumn("__head", F.trim(F.regexp_replace("__head", HOUSE, "")))
    df = df.withColumn("lane", titled(text.squeezed(F.regexp_extract("__head", LANE, 1))))
    df = df.withColumn("__head", F.trim(F.when(F.col("lane") != "", F.substring("__head", F.length(F.regexp_extract("__head", LANE, 1)) + 1, F.lit(10_000))).otherwise(F.col("__head"))))
    prefix = F.regexp_extract("__head", STREET, 1)
    df = df.withColumn("street", F.when(prefix != "", titled(F.concat_ws(" ", F.trim(prefix), F.nullif(F.trim(F.regexp_replace("__head", STREET, "")), F.lit(""))))).otherwise(titled(F.col("__head"))))
    return df.drop("__parts", "__found", "__at", "__spare", "__head")


def looks_like(row: DataFrame, address: str) -> DataFrame:
    """parsed() with is_address: two parts at least, or a word that marks one."""
    count = sum((F.col(f) != "").cast("int") for f in FIELDS)
    blank = F.trim(F.coalesce(F.col(address), F.lit(""))) == ""
    return row.withColumn("is_address", ~blank & ((count >= 2) | F.col(address).rlike(KEYWORD)))
