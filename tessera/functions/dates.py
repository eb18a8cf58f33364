"""Dates in texts and metadata, and scores from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scores

#: Keys of metadata, letters and digits only. Fixed values.
UPDATED = ("articlemodifiedtime", "datemodified", "lastmodified", "modifiedat", "ogupdatedtime", "updatedat", "updatedtime")
PUBLISHED = ("articlepublishedtime", "datepublished", "ogpublishedtime", "publicationdate", "publishedat", "publisheddate", "publishedtime")
FIRST_SEEN = ("firstseen", "firstseenat")
NEW_FLAGS = ("contentchanged", "contenthashisnew", "contenthashnew", "iscontenthashnew", "isnewcontent")
CURRENT_HASH = ("contenthash", "currentcontenthash", "latestcontenthash")
PREVIOUS_HASH = ("lastcontenthash", "oldcontenthash", "previouscontenthash", "priorcontenthash")
#: Scores by age in days, up to and with. Fixed values.
AGES = ((1, 0.95), (7, 0.90), (30, 0.80), (90, 0.65), (180, 0.55), (365, 0.40), (730, 0.25))


def parsed(raw: Column) -> Column:
    """ISO 8601 with or without a zone, with a blank for T, a date alone, or day/month/year; UTC where no zone is given."""
    x = F.trim(raw)
    iso = F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"), F.try_to_timestamp(F.regexp_replace(x, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")))
    day = F.when(x.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_timestamp(x, F.lit("d/M/yyyy")))
    return F.coalesce(iso, day)


def metadata_pairs(metadata: Column) -> Column:
    """Key (letters and digits, lower case) and value of every string, number and flag at any depth of a JSON text, of
    JSON inside its strings, and of meta tags (a property, name or itemprop beside its content)."""
    opened = F.replace(metadata, F.lit('\\"'), F.lit('"'))
    tidy = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    pair = r'"([^"{}\[\],]+)"\s*:\s*(?:"([^"]*)"|(-?[0-9.]+|true|false))'
    found = F.regexp_extract_all(opened, F.lit(pair), F.lit(0))
    plain = F.transform(found, lambda m: F.struct(tidy(F.regexp_extract(m, pair, 1)).alias("key"), F.concat(F.regexp_extract(m, pair, 2), F.regexp_extract(m, pair, 3)).alias("value")))
    tags = F.filter(F.regexp_extract_all(opened, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda o: o.rlike(r'"content"\s*:'))
    name = r'"(?:property|name|itemprop)"\s*:\s*"([^"]+)"'
    content = r'"content"\s*:\s*"([^"]*)"'
    named = F.transform(F.filter(tags, lambda o: o.rlike(name)), lambda o: F.struct(tidy(F.regexp_extract(o, name, 1)).alias("key"), F.regexp_extract(o, content, 1).alias("value")))
    return F.concat(plain, named)


def age_score(days: Column) -> Column:
    out = F.when(days <= AGES[0][0], AGES[0][1])
    for limit, score in AGES[1:]:
        out = out.when(days <= limit, score)
    return out.otherwise(0.10)


def document_freshness(metadata: Column, now: Column) -> Column:
    """By the latest update or publication, else the latest first sight; .5 without any; .1 more for a changed content hash."""

    def scored(pairs: Column) -> Column:
        latest = lambda keys: F.array_max(F.transform(F.filter(pairs, lambda p: p.key.isin(*keys)), lambda p: parsed(p.value)))
        then = F.coalesce(latest((*UPDATED, *PUBLISHED)), latest(FIRST_SEEN))
        last = lambda keys: F.try_element_at(F.filter(pairs, lambda p: p.key.isin(*keys) & (p.value != "")), F.lit(-1)).value
        flagged = F.exists(pairs, lambda p: p.key.isin(*NEW_FLAGS) & F.lower(F.trim(p.value)).isin("1", "true", "new", "changed", "yes"))
        changed = flagged | F.coalesce(last(CURRENT_HASH) != last(PREVIOUS_HASH), F.lit(False))
        base = F.when(then.isNull(), 0.5).otherwise(age_score(scores.age_days(then, now)))
        return F.least(F.lit(1.0), base + F.when(changed, 0.1).otherwise(0.0))

    from .text import let

    return F.when(metadata.isNull(), 0.5).otherwise(let(metadata_pairs(metadata), scored))


def retrieved_share(times: Column) -> Column:
    """The share of results that say when they were retrieved; 0 without results."""
    return F.when(F.size(times) > 0, F.size(F.filter(times, lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")) / F.size(times)).otherwise(0.0)
