"""Fields from provider payloads, as JSON strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_REVIEWS = 2_147_483_647


def field(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def rating(payload: Column) -> Column:
    """0 to 5, compared as an exact decimal; anything else is absent."""
    x = F.trim(field(payload, "review_rating"))
    exact = x.try_cast("decimal(38,18)")
    return F.when(exact.between(0, 5), x.try_cast("double"))


def review_count(payload: Column) -> Column:
    """A whole number, in a string with or without thousands commas; anything else is absent."""
    x = F.trim(field(payload, "review_count"))
    grouped = F.when(x.rlike(r"^[0-9]{1,3}(?:,[0-9]{3})+$"), F.replace(x, F.lit(","), F.lit(""))).when(x.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), x)
    exact = grouped.try_cast("decimal(38,18)")
    return F.when((exact == F.floor(exact)) & exact.between(0, MOST_REVIEWS), exact.cast("long"))


def price_level(payload: Column) -> Column:
    return F.nullif(F.trim(field(payload, "price_range")), F.lit(""))


def image_urls(payload: Column) -> Column:
    """The distinct http(s) addresses under images, at any depth, in order; null if none."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(field(payload, "images"), F.lit("")), F.lit(r'"(https?://[^"\\]+)"'), F.lit(1)))
    return F.when(F.size(found) > 0, found)


def unfenced(raw: Column) -> Column:
    """JSON text without a code fence around it."""
    return F.trim(F.regexp_replace(F.trim(raw), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))


def unwrapped(raw: Column) -> Column:
    """a JSON string that holds JSON is opened, twice at most."""
    once = F.when(F.trim(raw).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")).otherwise(raw)
    return F.when(F.trim(once).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), once, F.lit("}")), "$.v")).otherwise(once)


STATE = "last_query string, last_answer_summary string, resolved_entities array<string>, resolved_locations array<string>, important_constraints array<string>, recent_sources array<struct<url:string,title:string>>, turns array<struct<role:string,text:string>>, updated_at string"


def conversation_state(raw: Column) -> Column:
    """A stored state, tolerantly: what isn't as expected is empty, and every field is bounded again: 500 characters a
    text, the last 20 turns, the first 10 sources with an address."""
    s = F.from_json(raw, STATE, {"mode": "PERMISSIVE"})
    cut = lambda x, n: F.substring(F.coalesce(x, F.lit("")), 1, n)
    some = lambda x, n: F.slice(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")), 1, n)
    turns = F.transform(F.filter(F.coalesce(s.turns, F.array().cast("array<struct<role:string,text:string>>")), lambda t: t.isNotNull()), lambda t: F.struct(cut(F.coalesce(F.nullif(t.role, F.lit("")), F.lit("user")), 32).alias("role"), cut(t.text, 500).alias("text")))
    last = F.slice(turns, F.greatest(F.size(turns) - 19, F.lit(1)), F.lit(20))
    sources = F.slice(F.transform(F.filter(F.coalesce(s.recent_sources, F.array().cast("array<struct<url:string,title:string>>")), lambda x: F.coalesce(x.url, F.lit("")) != ""), lambda x: F.struct(cut(x.url, 2048).alias("url"), cut(x.title, 300).alias("title"))), 1, 10)
    return F.struct(
        cut(s.last_query, 500).alias("last_query"), cut(s.last_answer_summary, 500).alias("last_answer_summary"), some(s.resolved_entities, 10).alias("resolved_entities"), some(s.resolved_locations, 5).alias("resolved_locations"), some(s.important_constraints, 10).alias("important_constraints"),
        sources.alias("recent_sources"), F.when(F.size(turns) > 0, last).otherwise(turns).alias("turns"), cut(s.updated_at, 64).alias("updated_at"),
    )
