"""A stored inverted index: posting blocks by term with bounds of their scores, and retrieval that skips blocks by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.generations import Generations
from ..sources.shared import written
from . import lexical
from .retrieval import top_k

#: Buckets that terms are hashed to, documents in a span, bands of document lengths, spans that are scored first.
BUCKETS, SPAN_DOCS, BANDS, PROBES = 16, 256, 16, 4
BLOCK = "bucket int, term string, span int, n int, most_tf int, least_length int, postings array<struct<doc: long, tf: int, length: int>>"


class InvertedIndex:
    """Segments under `root`, a folder that driver and executors share, and a manifest that names them.

    A segment holds the documents of one add(). They are dealt to spans: bands of similar length, each cut by a hash of the id into
    parts of about `span_docs`. A block is the postings of a term in a span, with the largest frequency and the smallest length in it, from which
    its best gain follows under any corpus statistics. Blocks stand in folders by a hash of the term, in order of the term: a
    search reads the folders of its terms and no others.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, span_docs: int = SPAN_DOCS):
        self.spark, self.root, self.span_docs = spark, root.rstrip("/"), span_docs
        self._manifest = Generations(spark, root)
        self.buckets = self._manifest.state().get("buckets", buckets)

    def segments(self) -> list[dict]:
        return self._manifest.state().get("segments", [])

    def bucket_of(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> dict:
        """A new segment of docs, whose ids are unique and not yet in the index (else ValueError). What is indexed already isn't read again,
        but for its ids. Null text has no terms but counts as a document; rows without an id take no part."""
        rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), text.index_terms(F.col(body)).alias("terms"))
        return self._write(rows, [*self.segments()])

    def compact(self) -> dict:
        """All segments as one, made of their postings: no text is read."""
        state = self.segments()
        if len(state) < 2:
            return self._manifest.state()
        terms = self._blocks().select(F.explode("postings").alias("p"), "term").select("p.doc", F.explode(F.array_repeat("term", F.col("p.tf"))).alias("term"))
        held = terms.groupBy("doc").agg(F.collect_list("term").alias("terms"))  # one document's terms
        rows = self._docs().select("doc").join(held, "doc", "left").select("doc", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
        return self._write(rows, [])

    def _write(self, rows: DataFrame, before: list[dict]) -> dict:
        number = 1 + max([s["number"] for s in self.segments()], default=0)
        at = f"{self.root}/s{number}"
        rows = written(lexical.counted(rows), "counted")
        rows.select("doc", "length").write.mode("overwrite").parquet(f"{at}/docs")
        docs = self.spark.read.schema("doc long, length int").parquet(f"{at}/docs")
        n, distinct, total = docs.agg(F.count("*"), F.count_distinct("doc"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if n != distinct or before and not docs.join(self._docs(), "doc", "left_semi").isEmpty():
            self._manifest._fs().delete(self._manifest._path(f"s{number}"), True)
            raise ValueError("a document id is repeated, or is in the index already")
        blocks = lexical.span_blocks(rows.withColumn("span", self._span(docs).cast("long"))).withColumn("span", F.col("span").cast("int"))
        blocks.withColumn("bucket", self.bucket_of(F.col("term"))).repartition("bucket").sortWithinPartitions("bucket", "term", "span").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/blocks")
        return self._manifest._save(buckets=self.buckets, segments=[*before, {"number": number, "docs": n, "length": int(total)}])

    def _span(self, docs: DataFrame) -> Column:
        """The span of a document by its length and id: length bands from quantiles (BANDS numbers to the driver), each in as many parts as it needs."""
        cuts = sorted(set(docs.approxQuantile("length", [k / BANDS for k in range(1, BANDS)], 0.01)))
        band = sum(((F.col("length") > c).cast("int") for c in cuts), F.lit(0))
        sizes = dict(docs.groupBy(band.alias("band")).count().collect())
        out, first = F.lit(0), 0
        for k in sorted(sizes):
            parts = -(-sizes[k] // self.span_docs)
            out = F.when(band == k, first + F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int")).otherwise(out)
            first += parts
        return out

    def _all(self, part: str, schema: str) -> DataFrame:
        out = None
        for s in self.segments():
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/s{s['number']}/{part}").withColumn("segment", F.lit(s["number"]))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], f"{schema}, segment int")

    def _docs(self) -> DataFrame:
        return self._all("docs", "doc long, length int")

    def _blocks(self) -> DataFrame:
        return self._all("blocks", BLOCK)

    def of_terms(self, asked: DataFrame) -> DataFrame:
        """The blocks of the terms in asked (term), from their buckets alone; the buckets, `buckets` numbers at most, are known before the read."""
        folders = [r[0] for r in asked.select(self.bucket_of(F.col("term"))).distinct().collect()]
        return self._blocks().where(F.col("bucket").isin(*folders) if folders else F.lit(False)).join(asked.select("term").distinct(), "term", "left_semi")

    def _mean(self) -> float:
        n, total = (sum(s[k] for s in self.segments()) for k in ("docs", "length"))
        return total / n if total else 1.0

    def bounds(self, wanted: DataFrame, blocks: DataFrame, k1: float, b: float) -> DataFrame:
        """(query_id, slice, term, idf, segment, span, bound): the best gain that a term can have in a span."""
        n, mean = sum(s["docs"] for s in self.segments()), self._mean()
        damped = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        idf = df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        rows = blocks.select("term", "segment", "span", damped(F.col("most_tf"), F.col("least_length")).alias("most")).join(wanted.join(idf, "term"), "term")
        return rows.select("query_id", "slice", "term", "idf", "segment", "span", (F.col("idf") * F.col("most")).alias("bound"))

    def search(self, queries: DataFrame, k: int = 60, k1: float = 1.2, b: float = 0.75, probes: int = PROBES) -> DataFrame:
        """queries (query_id, query): query_id, doc, score, rank: the best k by BM25, exactly those of a full scan.

        A span's bound for a query is the sum of its blocks' best gains. The `probes` spans of the highest bounds are scored first; the k-th best score
        there is a floor, and spans whose bound is below it are never opened. A query that finds fewer than k documents in them opens all.
        The blocks of the asked terms are read from the index once; a span is scored as a matrix (lexical.scores).
        """
        chosen, blocks = self.chosen(queries, k, k1, b, probes)
        return top_k(self._scored(chosen.where("kept"), blocks, k, k1, b), k, ["query_id"], F.desc("score"), "doc")

    def chosen(self, queries: DataFrame, k: int = 60, k1: float = 1.2, b: float = 0.75, probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
        """What search() opens: (query_id, slice, term, idf, segment, span, floor, kept), and the blocks of the asked terms."""
        part = lexical.sliced(queries)
        wanted = queries.select("query_id", part("query_id").alias("slice"), F.explode(F.array_distinct(text.index_terms(F.col("query")))).alias("term"))
        wanted = written(wanted, "asked_terms")
        blocks = written(self.of_terms(wanted), "asked_blocks")
        rows = written(self.bounds(wanted, blocks, k1, b), "block_bounds")
        spans = written(rows.groupBy("query_id", "segment", "span").agg(F.sum("bound").alias("bound")), "span_bounds")
        first = top_k(spans, probes, ["query_id"], F.desc("bound"), F.col("segment"), F.col("span")).select("query_id", "segment", "span")
        none = F.lit(None).cast("double")
        probed = top_k(self._scored(rows.join(first, ["query_id", "segment", "span"]).withColumn("floor", none), blocks, k, k1, b), k, ["query_id"], F.desc("score"), "doc")
        floor = written(probed.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")), "floors")
        # scores are rounded to nine digits; a bound may fall short of what it bounds by the rounding of sums
        kept = spans.join(floor, "query_id", "left").select("query_id", "segment", "span", "floor", F.coalesce(F.col("bound") > F.col("floor") - 1e-8, F.lit(True)).alias("kept"))
        return rows.join(kept, ["query_id", "segment", "span"]), blocks

    def _scored(self, rows: DataFrame, blocks: DataFrame, k: int, k1: float, b: float) -> DataFrame:
        """The best k of each span by the given (query_id, slice, term, idf, segment, span, floor); a list holds a slice's queries at most."""
        lists = rows.groupBy("segment", "span", "slice", "term").agg(F.collect_list(F.struct("query_id", "idf", "floor")).alias("asked"))
        hits = blocks.select("term", "segment", "span", "postings").join(lists, ["term", "segment", "span"])
        return lexical.scores(hits, ["segment", "span", "slice"], k, self._mean(), k1, b)
