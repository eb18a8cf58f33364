"""Names to administrative units."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import addresses, text
from . import graph

#: Prefixes of units' names, folded. Fixed values.
PREFIX = r"^(?:tinh|thanh pho|tp\.?|pho|phuong|xa|thi xa|thi tran|quan|huyen|dac khu)\s+"
TYPE_PREFIX = r"^\s*(?:thanh pho truc thuoc|thanh pho thuoc|thanh pho|tp\.?|thi xa|tx\.?|thi tran|tt\.?|tinh thanh|tinh|quan|q\.?|huyen|h\.?|phuong|p\.?|xa|dac khu)\s+"
#: The level that a prefix implies, in the order tried. Fixed values.
LEVELS = ((2, r"^\s*(?:quan|q\.|huyen|h\.|thi xa|tx\.)\s"), (3, r"^\s*(?:phuong|p\.|xa|dac khu|thi tran|tt\.)\s"), (1, r"^\s*(?:tinh|thanh pho|tp\.)\s"))
#: Moves that lead to a successor. Fixed values.
MOVES = ("merged_into", "split_into", "renamed_to", "replaced_by", "boundary_changed")
MOST_WORDS = 8


def _spaced(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " "))


def forms(units: DataFrame) -> DataFrame:
    """units (key, name, aliases array, is_current): form and key for each folded name and alias, with and without its
    prefix. Of units with one form the current ones, then the smallest key, answer."""
    names = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: text.fold(n))
    every = F.array_distinct(F.filter(F.flatten(F.transform(names, lambda n: F.array(_spaced(n), _spaced(F.regexp_replace(n, PREFIX, ""))))), lambda n: n != ""))
    rows = units.select("key", "is_current", F.explode(every).alias("form"))
    return rows.groupBy("form").agg(F.min(F.struct((~F.col("is_current")).alias("former"), "key")).alias("u")).select("form", F.col("u.key").alias("key"), F.col("u.former").alias("former"))


def lookup(queries: DataFrame, units: DataFrame) -> DataFrame:
    """Queries (query_id, text): the unit whose form is the whole text, with or without a prefix, else the one with
    the longest form that stands in the text as whole words. Equality joins on runs of up to MOST_WORDS words; a form
    of more words is only found whole. query_id, key, found (exact or contained)."""
    f = forms(units)
    folded = queries.select("query_id", text.fold(F.coalesce("text", F.lit(""))).alias("t"))
    whole = folded.select("query_id", F.posexplode(F.array_distinct(F.array(_spaced(F.col("t")), _spaced(F.regexp_replace("t", PREFIX, ""))))).alias("place", "form"))
    exact = whole.join(f, "form").groupBy("query_id").agg(F.min_by("key", "place").alias("exact"))
    words = folded.select("query_id", F.filter(F.split(_spaced(F.col("t")), " "), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    starts = words.select("query_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    runs = starts.select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_WORDS), F.size("w") - F.col("i") + 1)), lambda n: F.array_join(F.slice(F.col("w"), F.col("i"), n), " "))).alias("form")).distinct()
    inside = runs.join(f, "form").groupBy("query_id").agg(F.min_by("key", F.struct(-F.length("form"), "former", "key")).alias("inside"))
    out = queries.select("query_id").join(exact, "query_id", "left").join(inside, "query_id", "left")
    return out.select("query_id", F.coalesce("exact", "inside").alias("key"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("inside").isNotNull(), "contained").alias("found"))


def anchor_phrase(query: Column) -> Column:
    """The text behind a word of nearness, of 2 to 120 characters; null if none."""
    found = F.trim(F.regexp_extract(query, r"(?iu)(?:gần|near|quanh|ở|tại|trong|khu vực|around)\s+(.+?)\s*[?.!]*\s*$", 1))
    return F.when((F.length(found) > 1) & (F.length(found) <= 120), found)


def unit_term(x: Column) -> Column:
    """A segment as units' names are kept: folded, without a prefix."""
    return _spaced(F.regexp_replace(text.fold(x), TYPE_PREFIX, ""))


def forward(units: DataFrame, moves: DataFrame, closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """units (key, parent_key, status), moves (from_key, to_key, relation_type): (key, successor): the current units that a
    unit leads to, and (key, edges): how many moves that takes. A current unit is its own successor; one without moves
    takes those of its nearest ancestor that has any."""
    movers = moves.select(F.col("from_key").alias("start")).distinct()
    up = closure.select("key", "ancestor", "distance").unionByName(units.select("key", F.col("key").alias("ancestor"), F.lit(0).alias("distance")))
    start = up.join(movers, F.col("ancestor") == F.col("start")).groupBy("key").agg(F.min_by("start", "distance").alias("start"))
    start = units.where("status <> 'current'").select("key").join(start, "key")
    real = moves.where(F.col("relation_type").isin(*MOVES)).select("from_key", "to_key")
    orphan = units.where("status <> 'current' and parent_key is not null").join(real.select(F.col("from_key").alias("key")).distinct(), "key", "left_anti")
    steps = real.select("from_key", "to_key", F.lit(1).alias("n")).unionByName(orphan.select(F.col("key").alias("from_key"), F.col("parent_key").alias("to_key"), F.lit(0).alias("n")))
    ends = graph.current_successors(units, steps.select("from_key", "to_key"))
    found = start.join(ends.withColumnRenamed("key", "start"), "start").select("key", "successor")
    found = found.unionByName(units.where("status = 'current'").select("key", F.col("key").alias("successor"))).distinct()
    # edges: the moves of the units on the way that aren't current
    status = units.select(F.col("key").alias("at"), "status")
    open_ = status.where("status <> 'current'").select(F.col("at").alias("from_key"))
    ways = graph.closure(steps.join(open_, "from_key").select(F.col("from_key").alias("key"), F.col("to_key").alias("parent")))
    way = ways.select(F.col("key").alias("start"), F.col("ancestor").alias("at")).unionByName(start.select("start", F.col("start").alias("at")).distinct())
    seen = start.join(way, "start").select("key", "at").distinct()
    edges = seen.join(status.where("status <> 'current'"), "at").join(steps.where("n = 1"), F.col("at") == F.col("from_key")).groupBy("key").agg(F.count("*").alias("edges"))
    return found, edges


def segments(queries: DataFrame) -> DataFrame:
    """queries (query_id, text): place, segment and hint (the level that a prefix implies), then the parsed ward, district
    and city that no segment names."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[,\n;|]+"), lambda p: F.trim(p)), lambda p: p != "")

    def hint(p: Column) -> Column:
        return F.coalesce(*[F.when(F.concat(text.fold(p), F.lit(" ")).rlike(rx), level) for level, rx in LEVELS])

    rows = addresses.parsed(queries.select("query_id", "text"), "text").withColumn("parts", parts)
    own = F.transform("parts", lambda p: F.struct(p.alias("segment"), hint(p).alias("hint"), unit_term(p).alias("term")))
    more = F.filter(F.array(*[F.struct(F.col(c).alias("segment"), F.lit(level).alias("hint"), unit_term(F.col(c)).alias("term")) for c, level in (("ward", 3), ("district", 2), ("city", 1))]), lambda s: s.segment != "")
    every = F.concat(own, F.filter(more, lambda s: ~F.exists(own, lambda o: o.term == s.term)))
    return rows.select("query_id", F.posexplode(every).alias("place", "s")).select("query_id", "place", "s.segment", "s.hint", "s.term")


def resolve(queries: DataFrame, units: DataFrame, aliases: DataFrame, moves: DataFrame) -> DataFrame:
    """Queries (query_id, text), units (key, name, normalized_name, admin_level, parent_key, status), aliases
    (unit_key, normalized_alias), moves: status (resolved, ambiguous, not_found), matched and current (arrays of keys) and
    confidence.

    1. Segments meet units by equal names or aliases; a hint narrows hits of several levels. 2. The province context is
    the first-level hit of the rightmost segment that has one, the one that explains most segments: their units lie
    under it or lead to where it leads. 3. Of each segment's hits that agree with it the best is matched: the province
    itself, a name before an alias, the hinted level, the deepest. 4. Matched units and their ancestors lead to the
    current ones.
    """
    closure = graph.ancestors(units).persist()  # the units' tables are small and met many times
    lead, edges = (t.persist() for t in forward(units, moves, closure))
    under = closure.select("key", "ancestor").unionByName(units.select("key", F.col("key").alias("ancestor")))
    province = under.join(units.where("admin_level = 1").select(F.col("key").alias("ancestor")), "ancestor").select("key", F.col("ancestor").alias("province"))
    goes = lead.join(province.withColumnRenamed("key", "successor"), "successor").select("key", F.col("province").alias("goes")).distinct()
    seg = segments(queries)
    named = units.select("key", "admin_level", "name", F.col("normalized_name").alias("term"), F.lit(2).alias("via"))
    other = aliases.select(F.col("unit_key").alias("key"), F.col("normalized_alias").alias("term")).join(units.select("key", "admin_level", "name"), "key").withColumn("via", F.lit(1))
    hits = seg.where("term <> ''").join(named.unionByName(other), "term").groupBy("query_id", "place", "hint", "key", "admin_level", "name").agg(F.max("via").alias("via"))
    same = Window.partitionBy("query_id", "place")
    hits = hits.withColumn("levels", F.size(F.collect_set("admin_level").over(same))).withColumn("fits", F.max((F.col("admin_level") == F.col("hint")).cast("int")).over(same))
    hits = hits.where((F.col("levels") == 1) | F.col("hint").isNull() | (F.coalesce("fits", F.lit(0)) == 0) | (F.col("admin_level") == F.col("hint"))).drop("levels", "fits").persist()
    # province context
    first = hits.where("admin_level = 1")
    last = first.groupBy("query_id").agg(F.max("place").alias("place"))
    first = first.join(last, ["query_id", "place"]).select("query_id", F.col("key").alias("prov"), F.col("via").alias("pvia"), F.col("place").alias("pplace"))
    pairs = first.select("query_id", "prov").join(hits.select("query_id", "place", "key"), "query_id")
    by_line = pairs.join(under, (pairs.key == under.key) & (pairs.prov == under.ancestor), "left_semi").select("query_id", "prov", "place", "key")
    by_move = pairs.join(goes.withColumnRenamed("goes", "g1"), "key").join(goes.select(F.col("key").alias("prov"), F.col("goes").alias("g2")), "prov").where("g1 = g2").select("query_id", "prov", "place", "key")
    agreed = by_line.unionByName(by_move).distinct().persist()
    explained = agreed.groupBy("query_id", "prov").agg(F.countDistinct("place").alias("n"))
    scored = first.join(explained, ["query_id", "prov"], "left").withColumn("score", F.coalesce("n", F.lit(0)) * 10 + F.col("pvia"))
    context = scored.groupBy("query_id").agg(F.min_by(F.struct("prov", "pplace"), F.struct(-F.col("score"), "prov")).alias("c")).select("query_id", "c.prov", "c.pplace")
    # the best hit of each segment
    rated = hits.join(context, "query_id", "left").join(agreed.withColumn("ok", F.lit(1)), ["query_id", "prov", "place", "key"], "left")
    rated = rated.withColumn("any", F.max(F.coalesce("ok", F.lit(0))).over(same)).where((F.col("any") == 0) | (F.col("ok") == 1))
    order = [F.desc(F.coalesce((F.col("place") == F.col("pplace")) & (F.col("key") == F.col("prov")), F.lit(False))), F.desc("via"), F.desc(F.coalesce(F.col("admin_level") == F.col("hint"), F.lit(False))), F.desc("admin_level"), F.col("key")]
    rated = rated.withColumn("rank", F.row_number().over(same.orderBy(*order)))
    top = rated.where("rank = 1").select("query_id", "place", F.col("key").alias("tkey"), F.col("via").alias("tvia"), F.col("admin_level").alias("tlevel"), "prov")
    ties = rated.where("rank > 1").drop("prov").join(top, ["query_id", "place"]).where("via = tvia and admin_level = tlevel and prov is null").select("query_id").distinct().withColumn("tied", F.lit(True))
    matched = top.select("query_id", F.col("tkey").alias("key")).unionByName(context.select("query_id", F.col("prov").alias("key"))).distinct()
    chain = matched.join(under, "key").select("query_id", "key", F.col("ancestor").alias("at"))
    current = chain.join(lead.withColumnRenamed("key", "at"), "at").join(units.select(F.col("key").alias("successor"), "admin_level", "name"), "successor")
    reached = current.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_set(F.struct((-F.col("admin_level")).alias("l"), F.col("name").alias("n"), F.col("successor").alias("k")))), lambda s: s.k).alias("current"))
    steps = chain.join(edges.withColumnRenamed("key", "at"), "at").groupBy("query_id").agg(F.sum("edges").alias("edges"))
    facts = top.groupBy("query_id").agg(F.min("tvia").alias("worst"), F.array_sort(F.collect_set("tkey")).alias("chosen"))
    out = queries.select("query_id").join(facts, "query_id", "left").join(matched.groupBy("query_id").agg(F.array_sort(F.collect_set("key")).alias("matched")), "query_id", "left").join(reached, "query_id", "left").join(steps, "query_id", "left").join(ties, "query_id", "left")
    status = F.when(F.col("chosen").isNull(), "not_found").when(F.col("tied"), "ambiguous").otherwise("resolved")
    sure = F.least(F.lit(1.0), F.lit(0.9) + 0.1 * (F.col("worst") == 2).cast("int") - F.least(F.lit(0.15), 0.05 * F.coalesce("edges", F.lit(0))))
    none = F.array().cast("array<string>")
    return out.select("query_id", status.alias("status"), F.coalesce("matched", none).alias("matched"), F.coalesce("current", none).alias("current"), F.round(F.when(status == "not_found", 0.0).when(status == "ambiguous", 0.5).otherwise(sure), 6).alias("confidence"))


# Rings


def thinned(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A line without the points that lie within `tolerance` of what is left (Douglas and Peucker)."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        (x0, y0), (x1, y1) = points[a], points[b]
        long = math.hypot(x1 - x0, y1 - y0)
        far, at = tolerance, None
        for i in range(a + 1, b):
            x, y = points[i]
            d = abs((x1 - x0) * (y0 - y) - (x0 - x) * (y1 - y0)) / long if long else math.hypot(x - x0, y - y0)
            if d > far:
                far, at = d, i
        if at is not None:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def thinned_ring(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A closed ring, cut at the point farthest from its first so that both halves keep their ends."""
    if len(ring) < 4:
        return ring
    far = max(range(len(ring)), key=lambda i: math.hypot(ring[i][0] - ring[0][0], ring[i][1] - ring[0][1]))
    return thinned(ring[: far + 1], tolerance)[:-1] + thinned(ring[far:], tolerance)


def simplified(rings: Column, tolerance: float, least: int = 30) -> Column:
    """Rings: array of arrays of structs (x, y), the first one the outline: thinned, with half the tolerance again
    while the outline keeps under `least` points, down to a 64th."""

    @F.pandas_udf("array<array<struct<x:double,y:double>>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(shape):
            if shape is None:
                return None
            lines, t = [[(p["x"], p["y"]) for p in ring] for ring in shape], tolerance
            while True:
                out = [thinned_ring(r, t) for r in lines]
                if not out or len(out[0]) >= least or t <= tolerance / 64:
                    return [[{"x": x, "y": y} for x, y in r] for i, r in enumerate(out) if i or len(r) >= 4]
                t /= 2

        for s in parts:
            yield s.map(one)

    return run(rings)
