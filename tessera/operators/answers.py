"""Answer metrics, gaps and merged entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls


def fact_coverage(answer: Column, facts: Column) -> Column:
    """Share of the non-blank facts that the folded answer holds; null without facts."""
    full = F.filter(facts, lambda f: F.trim(f) != "")
    hay = text.fold(F.coalesce(answer, F.lit("")))
    return F.when(F.size(full) > 0, F.size(F.filter(full, lambda f: hay.contains(text.fold(f)))) / F.size(full))


def _sites(addresses: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(addresses, lambda u: urls.normalize_domain(urls.host(u))), lambda d: d != ""))


def citation_precision(cited: Column, expected: Column) -> Column:
    """Share of the cited addresses that match an expected address or its domain; null without either."""
    forms, sites = F.transform(expected, urls.eval_url), _sites(expected)
    full = F.filter(cited, lambda u: u != "")
    hit = F.filter(full, lambda u: F.array_contains(forms, urls.eval_url(u)) | F.array_contains(sites, urls.normalize_domain(urls.host(u))))
    return F.when((F.size(full) > 0) & (F.size(expected) > 0), F.size(hit) / F.size(full))


def citation_recall(cited: Column, expected: Column) -> Column:
    """Share of the expected addresses that a citation covers; null without expectation."""
    forms, sites = F.transform(cited, urls.eval_url), _sites(cited)
    hit = F.filter(expected, lambda u: F.array_contains(forms, urls.eval_url(u)) | F.array_contains(sites, urls.normalize_domain(urls.host(u))))
    return F.when(F.size(expected) > 0, F.size(hit) / F.size(expected))


def cited_source_coverage(cited: Column, sources: Column) -> Column:
    """A40."""
    full = F.filter(sources, lambda u: u != "")
    return F.when(F.size(full) > 0, F.size(F.filter(full, lambda u: F.array_contains(_sites(cited), urls.normalize_domain(urls.host(u))))) / F.size(full))


def unsupported_rate(citations: Column) -> Column:
    """Citations: array of structs with an array `evidence`."""
    return F.when(F.size(citations) > 0, F.size(F.filter(citations, lambda c: F.coalesce(F.size(c.evidence), F.lit(0)) <= 0)) / F.size(citations))


def quote_rate(citations: Column) -> Column:
    """Evidence: array of structs with `quote`."""
    return F.when(F.size(citations) > 0, F.size(F.filter(citations, lambda c: F.coalesce(F.exists(c.evidence, lambda e: F.trim(F.coalesce(e.quote, F.lit(""))) != ""), F.lit(False)))) / F.size(citations))


def gaps(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """Evidence (query_id, quote, support), queries (query_id, query): missing words of over three
    characters (five at most), confidence n/5 x mean support up to 1, need_more under three items."""
    got = evidence.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("support").alias("mean"))
    asked = queries.select("query_id", F.posexplode(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) > 3)).alias("i", "word"))
    have = evidence.select("query_id", F.explode(F.array_distinct(F.split(F.lower("quote"), r"[^\p{L}\p{N}_]+"))).alias("part")).distinct()
    miss = asked.join(have, (asked.query_id == have.query_id) & have.part.contains(asked.word), "left_anti")
    listed = miss.groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda s: s.word), 1, 5).alias("missing"))
    n = F.coalesce("n", F.lit(0))
    return queries.select("query_id").join(got, "query_id", "left").join(listed, "query_id", "left").select(
        "query_id", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.round(F.least(n / 5 * F.coalesce("mean", F.lit(0.0)), F.lit(1.0)), 9).alias("confidence"), (n < 3).alias("need_more")
    )


def same_entity(pairs: DataFrame) -> DataFrame:
    """J20, J21 by strong signals: pairs (a_*, b_*) with the same phone; the same domain and similar names; similar
    names within 100 m; or nearly the same name and address. Similarity is 1 - edit distance / longer length."""
    alike = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    c = F.col
    names = alike(c("a_name"), c("b_name"))
    rule = (c("a_phone") == c("b_phone")) | ((c("a_domain") == c("b_domain")) & (names >= 0.6)) | ((names >= 0.88) & (c("dist_m") <= 100)) | ((names >= 0.9) & (alike(c("a_address"), c("b_address")) >= 0.85))
    return pairs.where(F.coalesce(rule, F.lit(False)))
