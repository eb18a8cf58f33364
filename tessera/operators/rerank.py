"""Reranking formulas over hits and passages."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions import scores, text

#: The idf of a term without corpus statistics: log(1 + 10 / 2). Fixed value.
PLAIN_IDF = 1.791759469228055
#: Upper ages in days and their scores; beyond, .10. Fixed values.
AGE_STEPS = ((1, 0.95), (7, 0.90), (30, 0.80), (90, 0.65), (180, 0.55), (365, 0.40), (730, 0.25))
URGENCY = {"realtime": 2.0, "high": 1.5, "medium": 1.0, "slow": 0.5, "static": 0.1}


def bm25_local(query_terms: Column, doc_terms: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """Over one page of results, each term with the same idf; repeated query terms count again."""
    length = 1 - b + b * F.size(doc_terms) / F.greatest(mean_length, F.lit(1.0))

    def gain(t: Column) -> Column:
        f = (F.size(doc_terms) - F.size(F.array_remove(doc_terms, t))).cast("double")
        return PLAIN_IDF * f * (k1 + 1) / (f + k1 * length)

    return F.aggregate(F.transform(F.filter(query_terms, lambda t: F.array_contains(doc_terms, t)), gain), F.lit(0.0), lambda s, x: s + x)


def reranked_results(hits: DataFrame) -> DataFrame:
    """Hits (query_id, key, query, title, description, authority, engine_score): adds reranked."""
    body = F.concat_ws(" ", "title", "description")
    h = hits.withColumn("__q", text.tokenize(F.col("query"))).withColumn("__d", text.tokenize(body))
    h = h.withColumn("__m", F.avg(F.size("__d")).over(Window.partitionBy("query_id")))
    c = F.col
    score = 0.25 * text.overlap(c("__q"), c("__d")) + 0.20 * c("authority") + 0.15 * F.least(c("engine_score") / 10, F.lit(1.0)) + 0.20 * F.least(bm25_local(c("__q"), c("__d"), c("__m")) / 3, F.lit(1.0)) + 0.10 * text.phrase_bonus(c("query"), body) + 0.10 * text.title_boost(c("__q"), c("title"))
    return h.withColumn("reranked", F.round(score, 9)).drop("__q", "__d", "__m")


@F.pandas_udf(DoubleType())
def _passage_scores(query: pd.Series, tokens: pd.Series, low: pd.Series, mean: pd.Series) -> pd.Series:
    """.5 text.overlap() + .3 bm25_local() / 3 up to 1 + .2 text.phrase_bonus() of a query's words and a passage's words and lower-case text. A query's
    words, pairs and triples are made once a batch and a passage's words counted once a row."""
    k1, b, known, out = 1.5, 0.75, {}, []
    for q, d, t, m in zip(query, tokens, low, mean, strict=True):
        q, count, n = tuple(q), Counter(d), len(d)
        if q not in known:
            known[q] = (set(q), *([" ".join(q[i : i + size]) for i in range(len(q) - size + 1)] for size in (3, 2)))
        own, triples, pairs = known[q]
        both = len(own & count.keys()) / math.sqrt(len(own) * len(count)) if own and count else 0.0
        length = 1 - b + b * n / max(m, 1.0)
        gain = 0.0
        for w in q:
            if f := count.get(w, 0):
                gain += PLAIN_IDF * f * (k1 + 1) / (f + k1 * length)
        bonus = min(sum(r in t for r in triples) * 0.15 + sum(r in t for r in pairs) * 0.10, 0.3) if t is not None else 0.0
        out.append(0.5 * both + 0.3 * min(gain / 3, 1.0) + 0.2 * bonus)
    return pd.Series(out, dtype="float64")


def reranked_passages(passages: DataFrame, top: int, per_source: int) -> DataFrame:
    """Passages (query_id, source_id, pos, query, text; tokens and n_tokens, and asked, the query's words, if they are known): .5 keyword + .3 bm25 + .2 phrase,
    the best per_source of a source and top of a query. The mean length is summed apart, a row a query, so that only scores are sorted, no passages."""
    p = passages if "tokens" in passages.columns else passages.withColumn("tokens", text.tokenize(F.col("text"))).withColumn("n_tokens", F.size("tokens"))
    means = p.groupBy("query_id").agg(F.avg("n_tokens").alias("__m")).withColumnRenamed("query_id", "__id")
    p = p.withColumnRenamed("tokens", "__d").drop("n_tokens")
    p = p.withColumnRenamed("asked", "__q") if "asked" in p.columns else p.withColumn("__q", text.tokenize(F.col("query")))
    p = p.join(F.broadcast(means), F.col("query_id").eqNullSafe(F.col("__id"))).drop("__id")
    p = p.withColumn("score", F.round(_passage_scores("__q", "__d", F.lower("text"), "__m"), 9)).drop("__q", "__d", "__m")
    own = Window.partitionBy("query_id", "source_id").orderBy(F.desc("score"), "pos")
    p = p.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= per_source).drop("__n")
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id", "pos"))).where(F.col("rank") <= top)


def composite(relevance: Column, authority: Column, fresh: Column, engine: Column, fresh_wanted: bool = False) -> Column:
    """Sources of little authority count half."""
    a, b, c, d = (0.35, 0.30, 0.25, 0.10) if fresh_wanted else (0.35, 0.35, 0.15, 0.15)
    mixed = a * relevance + b * authority + c * fresh + d * F.least(engine, F.lit(1.0))
    return mixed * F.when(authority < 0.25, 0.5).otherwise(1.0)


def freshness_bonus(published: Column, now: Column, lane: Column) -> Column:
    """.3 fading to 0 at two half-lives of a known lane, else .3 within a day, .15 within a week; 0 for a
    missing or future date."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 86_400e6
    span = scores.lookup({k: 2 * v for k, v in scores.HALF_LIVES.items()}, F.coalesce(lane, F.lit("")), -1.0)
    graded = F.round(0.3 * F.greatest(F.lit(0.0), 1 - age / span), 4)
    return F.when(age.isNull() | (age < 0), 0.0).when(span > 0, graded).when(age < 1, 0.3).when(age < 7, 0.15).otherwise(0.0)


def age_score(days: Column) -> Column:
    """D05."""
    out = F.when(days.isNull(), F.lit(None).cast("double"))
    for upto, score in AGE_STEPS:
        out = out.when(days <= upto, score)
    return out.otherwise(0.10)


def recrawl_priority(popularity: Column, authority: Column, change: Column, need: Column, feed: Column, since_s: Column) -> Column:
    """D11."""
    return 0.30 * popularity + 0.20 * authority + 0.20 * change + 0.15 * scores.lookup(URGENCY, need, 1.0) + 0.10 * feed + 0.05 * F.least(since_s / 86_400, F.lit(1.0))


def extraction_quality(body: Column, source_length: Column) -> Column:
    """.6 by words, 400 suffice, and .4 by the text's share of the source, .30 suffices."""
    n = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    mixed = 0.6 * F.least(n / 400, F.lit(1.0)) + 0.4 * F.least(F.length(body) / F.greatest(source_length, F.lit(1)) / 0.30, F.lit(1.0))
    return F.when(F.coalesce(body, F.lit("")) == "", 0.0).otherwise(F.round(mixed, 3))


def heuristic_rank(hits: DataFrame) -> DataFrame:
    """Hits (query_id, domain, relevance, authority, fresh, matched): with corroboration by domain, five suffice."""
    same = F.least(F.count("*").over(Window.partitionBy("query_id", "domain")) / 5, F.lit(1.0))
    c = F.col
    return hits.withColumn("heuristic", F.round(0.30 * c("relevance") + 0.25 * c("authority") + 0.20 * c("fresh") + 0.15 * c("matched") + 0.10 * same, 9))


def soft_filter(rows: DataFrame, by: str, matches: Column) -> DataFrame:
    """the matching rows of a group, or all of them when none matches."""
    any_ = F.max(F.coalesce(matches, F.lit(False))).over(Window.partitionBy(by))
    return rows.withColumn("__any", any_).where(F.coalesce(matches, F.lit(False)) | ~F.col("__any")).drop("__any")


def term_rank(items: DataFrame, terms: Column, least: float = 0.5) -> DataFrame:
    """Items (query_id, item_id, title, description, ts): share of the query's terms that the item has as whole words."""
    have = text.words(text.fold(F.concat_ws(" ", "title", "description")))
    share = F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.array_contains(have, t))) / F.size(terms))
    return items.withColumn("score", F.round(share, 3)).where(F.col("score") >= least)
