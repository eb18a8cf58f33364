"""Crawl rules and outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def robots_groups(body: str) -> Iterator[tuple[str, bool, str, float | None]]:
    """(agent, allow, path pattern, crawl delay) of each rule, by RFC 9309: agent lines that follow each
    other share the rules after them; other records don't end a group."""
    agents, ruled, delay = [], False, None
    rows = []
    for line in body.splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if ruled:
                agents, ruled, delay = [], False, None
            if value:
                agents.append(value.lower())
        elif name in ("allow", "disallow") and agents:
            ruled = True
            if value:
                rows += [(a, name == "allow", value, delay) for a in agents]
        elif name == "crawl-delay" and agents:
            try:
                delay = float(value)
            except ValueError:
                continue
    yield from rows


def robots_rules(files: DataFrame) -> DataFrame:
    """files (host, body): host, agent, allow, pattern, octets, crawl_delay."""

    def run(frames):
        for frame in frames:
            rows = [(h, a, ok, p, len(p.encode()), d) for h, b in zip(frame["host"], frame["body"], strict=True) for a, ok, p, d in robots_groups(b or "")]
            yield pd.DataFrame(rows, columns=["host", "agent", "allow", "pattern", "octets", "crawl_delay"])

    return files.select("host", "body").mapInPandas(run, "host string, agent string, allow boolean, pattern string, octets int, crawl_delay double")


def pattern_regex(pattern: Column) -> Column:
    """A path pattern as a regular expression: * is any run, a last $ is the end."""
    safe = F.regexp_replace(pattern, r"([.\\+?()\[\]{}|^])", r"\\$1")
    safe = F.regexp_replace(safe, r"\*", ".*")
    return F.concat(F.lit("^"), F.when(safe.endswith("$"), safe).otherwise(F.replace(safe, F.lit("$"), F.lit(r"\$"))))


def robots_verdicts(requests: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """requests (url_id, host, path): allowed by the longest matching rule of the agent's own groups, of * if
    there are none; equal lengths allow; no rule allows; /robots.txt always."""
    mine = rules.where(F.col("agent").isin(agent.lower(), "*"))
    own = mine.where(F.col("agent") == agent.lower())
    chosen = own.unionByName(mine.where("agent = '*'").join(own.select("host").distinct(), "host", "left_anti"))
    hit = requests.join(chosen, "host").where(F.regexp("path", pattern_regex(F.col("pattern"))))
    best = hit.groupBy("url_id").agg(F.max(F.struct("octets", "allow")).alias("b"))
    return requests.join(best, "url_id", "left").select("url_id", F.when(F.col("path") == "/robots.txt", True).otherwise(F.coalesce("b.allow", F.lit(True))).alias("allowed"))


def extraction_status(mime: Column, body: Column, quality: Column, error: Column, least_chars: int = 100, least_quality: float = 0.30) -> Column:
    """F13."""
    return F.when(error, "error").when(~mime.rlike(r"^(?:text/|application/(?:xhtml|xml|json))"), "skipped_mime").when(F.trim(F.coalesce(body, F.lit(""))) == "", "empty").when(F.length(body) < least_chars, "low_content").when(quality < least_quality, "low_quality").otherwise("success")


def status_rank(status: Column) -> Column:
    """what is better to keep."""
    order = ["error", "skipped_mime", "empty", "low_content", "low_quality", "success"]
    return F.array_position(F.array(*map(F.lit, order)), status)


def expanded_seeds(sites: DataFrame, sitemaps: DataFrame, feeds: DataFrame, probes: tuple[str, ...] = ("/sitemap.xml", "/feed", "/rss"), cap: int = 500) -> DataFrame:
    """Sites (domain), addresses of sitemaps and feeds (domain, url) and paths to try: site, url and how it was found, inside
    the site's domain alone, `cap` a site, sitemaps before feeds before probes."""
    tried = sites.select("domain", F.explode(F.transform(F.array(*map(F.lit, probes)), lambda p: F.concat(F.lit("https://"), F.col("domain"), p))).alias("url"))
    both = sitemaps.select("domain", "url", F.lit(0).alias("how")).unionByName(feeds.select("domain", "url", F.lit(1).alias("how"))).unionByName(tried.withColumn("how", F.lit(2)))
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)), r"^www\\.", "")
    own = both.join(sites, "domain").where((host == F.col("domain")) | host.endswith(F.concat(F.lit("."), "domain")))
    first = own.groupBy("domain", "url").agg(F.min("how").alias("how"))
    w = Window.partitionBy("domain").orderBy("how", "url")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")


def claimed(frontier: DataFrame, now: Column, n: int, token: str, lease_s: int = 900) -> DataFrame:
    """The frontier after a worker has claimed its n most urgent due rows, pending ones and those whose lease is over: status
    leased, its token and the lease's end."""
    due = frontier.where(((F.col("status") == "pending") & (F.col("next_crawl") <= now)) | ((F.col("status") == "leased") & (F.col("lease_until") < now)))
    mine = due.orderBy(F.desc("priority"), "next_crawl", "url").limit(n).select("url", F.lit(True).alias("__mine"))
    until = F.timestamp_seconds(F.unix_seconds(now.cast("timestamp")) + lease_s)
    rows = frontier.join(mine, "url", "left")
    pick = lambda new, old: F.when(F.col("__mine"), new).otherwise(F.col(old))
    return rows.withColumns({"status": pick(F.lit("leased"), "status"), "claim_token": pick(F.lit(token), "claim_token"), "lease_until": pick(until, "lease_until")}).drop("__mine")


def completed(frontier: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes (url, claim_token, status, next_crawl) take effect only where the token is still the row's."""
    got = outcomes.select("url", F.col("claim_token").alias("__t"), F.col("status").alias("__s"), F.col("next_crawl").alias("__n"))
    rows = frontier.join(got, "url", "left")
    ok = F.col("__s").isNotNull() & F.col("claim_token").eqNullSafe(F.col("__t"))
    return rows.withColumns({"status": F.when(ok, F.col("__s")).otherwise(F.col("status")), "next_crawl": F.when(ok, F.col("__n")).otherwise(F.col("next_crawl")), "claim_token": F.when(ok, F.lit(None)).otherwise(F.col("claim_token"))}).drop("__t", "__s", "__n")


def flushed(frontier: DataFrame, queue: DataFrame) -> DataFrame:
    """Rows held in memory merged into the frontier, as found ones are."""
    from . import ingest

    return ingest.frontier(frontier, queue.withColumn("status", F.lit(None).cast("string")))


def crawl_outcome(fetch: Column, robots: Column, extraction: Column, hash_changed: Column) -> Column:
    """What a crawl of an address came to, by its first step that ends it: robots, the fetch, the extraction, no change."""
    return (
        F.when(~F.coalesce(robots, F.lit(True)), "robots_denied").when(fetch == "not_modified", "unchanged").when(fetch != "ok", fetch).when(extraction.isin("skipped_mime", "empty", "low_content", "low_quality", "error"), extraction)
        .when(~F.coalesce(hash_changed, F.lit(True)), "unchanged").otherwise("indexed")
    )
