"""Recursive walks over administrative units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Rounds, written


def closure(edges: DataFrame) -> DataFrame:
    """edges (key, parent): key, ancestor, distance: every pair that a way leads to, at its least distance from 1, without a key itself.

    Ways double in length each round: those of exactly n steps are continued by all of up to n, so a way of any length takes its
    logarithm in rounds. A cycle adds no pair after it has been walked once, and ends the rounds. Null keys take no part.
    """
    edges = edges.where("key is not null and parent is not null and key <> parent").select("key", F.col("parent").alias("ancestor")).distinct()
    rounds = Rounds(edges.sparkSession, "closure")
    known, n = rounds.next(edges.withColumn("distance", F.lit(1))), 1
    while True:
        far = known.where(F.col("distance") == n).select("key", F.col("ancestor").alias("mid"))
        on = known.select(F.col("key").alias("mid"), "ancestor", F.col("distance").alias("d"))
        more = far.join(on, "mid").where("key <> ancestor").groupBy("key", "ancestor").agg((F.min("d") + n).cast("int").alias("distance"))
        more = written(more.join(known.select("key", "ancestor"), ["key", "ancestor"], "left_anti"), "farther")
        if more.isEmpty():
            return known
        known, n = rounds.next(known.unionByName(more)), 2 * n


def ancestors(units: DataFrame) -> DataFrame:
    """Units (key, parent_key): key, ancestor, distance from 1, however deep; in a cycle each of the others is an ancestor."""
    return closure(units.select("key", F.col("parent_key").alias("parent")))


def cycles(units: DataFrame) -> DataFrame:
    """The keys of units (key, parent_key) that are their own ancestors."""
    edges = units.where("parent_key is not null").select(F.col("key").alias("child"), F.col("parent_key").alias("parent"))
    back = closure(edges.select(F.col("child").alias("key"), "parent")).join(edges, (F.col("key") == F.col("parent")) & (F.col("ancestor") == F.col("child")))
    return edges.where("child = parent").select(F.col("child").alias("key")).union(back.select("child")).distinct()


def walked(units: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """units (key, status), moves (from_key, to_key): (key, successor) for the current units that each unit's moves lead to, a current one itself;
    and the keys whose moves lead into a cycle, in which no way ends.

    A pointer leads from a unit to where it is after n moves, or to the current unit it came to; each round follows the pointers of the pointers,
    so a chain of any length takes its logarithm in rounds. Pointers that still move after as many moves as there are units are in a cycle. A unit that isn't
    current and has no move, or one to a unit that isn't known, leads nowhere.
    """
    now = units.where("key is not null").groupBy("key").agg(F.max(F.coalesce(F.col("status") == "current", F.lit(False))).alias("done"))
    to = now.select(F.col("key").alias("at"), "done")
    steps = now.where("not done").select("key").join(moves.select(F.col("from_key").alias("key"), F.col("to_key").alias("at")), "key").join(to, "at").select("key", "at", "done").distinct()
    rounds, n = Rounds(units.sparkSession, "pointers"), 1
    at = rounds.next(steps.unionByName(now.where("done").select("key", F.col("key").alias("at"), "done")))
    moving = steps.select("key").distinct().count()
    while n <= moving and not at.where("not done").isEmpty():
        onward = at.select(F.col("key").alias("at"), F.col("at").alias("next"), F.col("done").alias("next_done"))
        further = at.where("not done").join(onward, "at").select("key", F.col("next").alias("at"), F.col("next_done").alias("done"))
        at, n = rounds.next(at.where("done").unionByName(further).distinct()), 2 * n
    return at.where("done").select("key", F.col("at").alias("successor")), at.where("not done").select("key").distinct()


def current_successors(units: DataFrame, moves: DataFrame) -> DataFrame:
    """Units (key, status), moves (from_key, to_key): for each unit the current units that its moves lead
    to, over any number of moves; a current unit stays itself."""
    return walked(units, moves)[0]


def with_aliases(units: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each unit with its aliases, sorted; none gives an empty array."""
    named = aliases.groupBy("key").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return units.join(named, "key", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def admin_graph(units: DataFrame, aliases: DataFrame, moves: DataFrame) -> DataFrame:
    """Units (key, name, parent_key) with their aliases, children and moves as arrays: a row a unit."""
    named = with_aliases(units, aliases)
    below = units.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.array_sort(F.collect_set("key")).alias("children"))
    out = moves.groupBy(F.col("from_key").alias("key")).agg(F.array_sort(F.collect_set(F.struct("relation_type", "to_key"))).alias("moves"))
    none = F.array().cast("array<string>")
    return named.join(below, "key", "left").join(out, "key", "left").withColumn("children", F.coalesce("children", none))
