"""A stored index of names for folded, half-typed and mistyped words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.generations import Generations
from ..sources.shared import written
from .retrieval import top_k

#: Folders of the index, and the longest prefix that has an entry; longer ones are found by it and compared in full.
BUCKETS, PREFIX = 16, 8
#: Length from which a word may have one edit, and two. Fixed values.
ONE_EDIT, TWO_EDITS = 3, 6
#: What a word counts that is met in full, by its beginning, by a spelling one or two edits away. Fixed values.
EXACT, BEGINS, EDITED = 1.0, 0.8, 0.5


def edits_allowed(token: Column) -> Column:
    return F.when(F.length(token) < ONE_EDIT, 0).when(F.length(token) < TWO_EDITS, 1).otherwise(2)


def deletions(token: Column, edits: Column) -> Column:
    """The token and what is left of it without any one, or any two, of its characters but the first: two words within so many edits
    (insertions, deletions, replacements) that agree in the first character have one of these in common."""
    drop = lambda words: F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(2), F.greatest(F.length(w), F.lit(2))), lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, F.length(w)))))))
    one = drop(F.array(token))
    return F.when(edits == 0, F.array(token)).when(edits == 1, F.array_union(F.array(token), one)).otherwise(F.array_union(F.array_union(F.array(token), one), drop(one)))


class NameIndex:
    """Entries of the words of names under `root`, a folder that driver and executors share, dealt to folders by a hash.

    A word has its prefixes up to PREFIX characters and its deletions as entries; a distinct word is written once, whatever number of places
    has it, beside the words of each place under each of them. A lookup reads only the folders of its own prefixes or deletions.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._state = Generations(spark, root)

    def _bucket(self, entry: Column) -> Column:
        return F.pmod(F.xxhash64(entry), F.lit(self.buckets)).cast("int")

    def rebuild(self, places: DataFrame) -> dict:
        """places (place_id, name; aliases, an array of names, if there is one). Names without a word have no entry. The pointer moves once all is written."""
        number = self._state.state().get("generation", 0) + 1
        at = f"{self.root}/g{number}"
        names = F.array("name") if "aliases" not in places.columns else F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
        each = places.where("place_id is not null").select("place_id", F.explode(names).alias("name")).where("name is not null")
        words = each.select("place_id", F.explode(text.name_tokens(text.norm_name(F.col("name")))).alias("token"))
        whole = words.groupBy("place_id").agg(F.collect_set("token").alias("words"))  # one place's words
        self._write(whole.select("place_id", F.explode("words").alias("token"), "words").withColumn("bucket", self._bucket(F.col("token"))), f"{at}/words", "token", "place_id")
        tokens = self.spark.read.parquet(f"{at}/words").select("token").distinct()
        prefixes = tokens.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(PREFIX))), lambda i: F.substring("token", 1, i))).alias("entry"), "token")
        self._write(prefixes.withColumn("bucket", self._bucket(F.col("entry"))), f"{at}/prefixes", "entry", "token")
        spelt = tokens.select(F.explode(deletions(F.col("token"), F.lit(2))).alias("entry"), "token")
        self._write(spelt.withColumn("bucket", self._bucket(F.col("entry"))), f"{at}/deletions", "entry", "token")
        return self._state._save(generation=number, concrete=f"g{number}")

    @staticmethod
    def _write(rows: DataFrame, path: str, *order: str) -> None:
        rows.repartition("bucket", F.pmod(F.xxhash64(order[-1]), F.lit(4))).sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _read(self, part: str, keys: DataFrame, key: str, kind: str) -> DataFrame:
        """Rows of a part whose key is asked for, from the keys' folders alone."""
        state = self._state.state()
        if not state:
            return self.spark.createDataFrame([], kind)
        folders = [r[0] for r in keys.select(self._bucket(F.col(key))).distinct().collect()]  # `buckets` numbers at most
        rows = self.spark.read.schema(f"{kind}, bucket int").parquet(f"{self.root}/{state['concrete']}/{part}")
        return rows.where(F.col("bucket").isin(*folders) if folders else F.lit(False)).drop("bucket")

    def meanings(self, queries: DataFrame, half_typed: bool = False) -> DataFrame:
        """queries (query_id, q): query_id, n_asked, asked, token, worth: the known words that each asked word may mean: itself; one within its edits that begins
        with the same letter (one edit from three characters, two from six); and, of a half-typed query, words that begin with the last."""
        asked = queries.select("query_id", text.name_tokens(text.norm_name(F.col("q"))).alias("t"))
        asked = asked.select("query_id", F.size("t").alias("n_asked"), F.posexplode("t").alias("at", "asked"))
        edits = edits_allowed(F.col("asked"))
        # an asked word is spelt once, whatever number of queries has it
        keys = written(asked.select("asked").distinct().select("asked", F.explode(deletions(F.col("asked"), edits)).alias("entry")), "asked_spellings")
        near = keys.join(self._read("deletions", keys, "entry", "entry string, token string"), "entry").select("asked", "token").where((F.substring("asked", 1, 1) == F.substring("token", 1, 1)) & (F.levenshtein("asked", "token") <= edits)).distinct()
        found = asked.join(near, "asked").select("query_id", "n_asked", "asked", "token", F.when(F.col("asked") == F.col("token"), EXACT).otherwise(EDITED).alias("worth"))
        if half_typed:
            last = asked.where("at = n_asked - 1").withColumn("entry", F.substring("asked", 1, PREFIX))
            begun = last.join(self._read("prefixes", last, "entry", "entry string, token string"), "entry").where(F.startswith("token", "asked"))
            found = found.unionByName(begun.select("query_id", "n_asked", "asked", "token", F.lit(BEGINS).alias("worth")))
        return found.groupBy("query_id", "n_asked", "asked", "token").agg(F.max("worth").alias("worth"))

    def candidates(self, means: DataFrame) -> DataFrame:
        """meanings(): query_id, place_id, words (all of the place): the places that have a meaning of the asked word of each query that fewest places may mean."""
        words = self._read("words", means, "token", "place_id long, token string, words array<string>")
        df = words.groupBy("token").agg(F.count("*").alias("df"))
        by = ["query_id", "asked"]
        cost = means.join(df, "token").groupBy(*by).agg(F.sum("df").alias("cost"))
        rarest = top_k(cost, 1, ["query_id"], F.col("cost"), F.col("asked")).select(*by)
        return means.join(rarest, by, "left_semi").select("query_id", "token").join(words, "token").select("query_id", "place_id", "words")

    def lookup(self, queries: DataFrame, k: int = 20, half_typed: bool = False) -> DataFrame:
        """query_id, place_id, relevance, rank: places that have a meaning of every asked word, in any order; relevance is the mean worth of the best ones.
        Equal ones by place_id. A query without a word finds nothing. Queries of equal words are looked up once. Places are met by the asked word that
        fewest places may mean and come with all their words, so a frequent word brings no candidates unless it is asked alone."""
        told = queries.select("query_id", F.array_join(text.name_tokens(text.norm_name(F.col("q"))), " ").alias("q")).distinct()
        told = written(told, "told_queries")
        means = written(self.meanings(told.select(F.col("q").alias("query_id"), "q").distinct(), half_typed), "meanings")
        met = self.candidates(means)
        packs = means.groupBy("query_id").agg(F.first("n_asked").alias("n_asked"), F.collect_list(F.struct("asked", "token", "worth")).alias("m"))  # one query's meanings
        own = F.filter("m", lambda x: F.array_contains("words", x.token))
        hits = met.join(packs, "query_id").select("query_id", "place_id", "n_asked", own.alias("own"))
        each = F.transform(F.array_distinct(F.transform("own", lambda x: x.asked)), lambda a: F.array_max(F.transform(F.filter("own", lambda x: x.asked == a), lambda x: x.worth)))
        whole = hits.select("query_id", "place_id", "n_asked", each.alias("best")).where(F.size("best") == F.col("n_asked"))
        mean = F.round(F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.col("n_asked"), 6)
        scored = whole.select("query_id", "place_id", mean.alias("relevance")).distinct()
        top = top_k(scored, k, ["query_id"], F.desc("relevance"), F.col("place_id")).withColumnRenamed("query_id", "q")
        return told.join(top, "q").select("query_id", "place_id", "relevance", "rank")
