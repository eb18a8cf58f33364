"""Ranked retrieval: lexical and vector lanes, fusion, normalisation, reranking, caps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores, text
from ..sources.shared import written
from . import lexical

#: Rows of a block, and queries of a block that are scored at once.
BLOCK_ROWS, SCORED_ROWS = 2048, 128


def top_k(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group. Spark limits a group inside each partition before the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def postings(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """term, doc, tf, length: the inverted index as a table."""
    terms = docs.select(F.col(doc_id).alias("doc"), text.index_terms(F.col(body)).alias("terms"))
    return terms.select("doc", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 60, k1: float = 1.2, b: float = 0.75, body: str = "text") -> DataFrame:
    """Queries (query_id, query) against docs (doc_id, text): query_id, doc, score, rank.

    One pass over the texts, no word of which is exchanged: tasks count the words of their documents and write blocks of postings, of words that a query has
    alone. Spans of documents are then scored as matrices (lexical.scores) and give their best k a query. Rows of a repeated id count as one document.
    """
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not again.isEmpty():
        same = lambda how: docs.select("doc_id", body).join(again.withColumnRenamed("doc_id", "again"), F.col("doc_id").eqNullSafe(F.col("again")), how)
        docs = same("left_anti").unionByName(same("left_semi").groupBy("doc_id").agg(F.array_join(F.collect_list(body), " ").alias(body)))
    part = lexical.sliced(queries)
    wanted = queries.select("query_id", part("query_id").alias("slice"), F.explode(F.array_distinct(text.index_terms(F.col("query")))).alias("term"))
    wanted = written(wanted, "asked_terms")
    asked = wanted.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    terms = docs.select(F.col("doc_id").cast("long").alias("doc"), text.index_terms(F.col(body)).alias("terms"))
    blocks = written(lexical.chunk_blocks(terms).join(asked, "term", "left_semi"), "posting_blocks")
    found = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("total"))
    n, total = found.where("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    idf = found.where("term <> ''").select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    one = F.struct("query_id", "idf", F.lit(None).cast("double").alias("floor"))
    # of a slice's queries at most; written, so that Spark knows their size when it joins
    lists = written(wanted.join(idf, "term").groupBy("slice", "term").agg(F.collect_list(one).alias("asked")), "asked_lists")
    scored = lexical.scores(blocks.join(lists, "term"), ["span", "slice"], k, total / n if total else 1.0, k1, b)
    return top_k(scored, k, ["query_id"], F.desc("score"), "doc")


def _blocks(df: DataFrame, key: str, vec: str, names: tuple[str, str]) -> DataFrame:
    """Rows packed into blocks of about BLOCK_ROWS by a hash of their key; their number follows the count."""
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("float")).alias("v"))
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("slot")).agg(F.collect_list("id").alias(names[0]), F.collect_list("v").alias(names[1])).select(*names)


def _matrix(column: pa.ListScalar) -> np.ndarray:
    """A list of vectors of one length as a matrix, from Arrow's buffer."""
    vectors = column.values
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(np.float64)


def knn_topk(vectors: DataFrame, queries: DataFrame, k: int = 60, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Exact cosine neighbours: query_id, doc, score, rank; the query's own row
    is left out. Both sides are packed into blocks of about BLOCK_ROWS, and a pair of blocks is one matrix product
    that gives its best k for each query, SCORED_ROWS queries at once; the winners of all blocks then meet in one ranking."""
    q, d = _blocks(queries, key, vec, ("qid", "qv")), _blocks(vectors, key, vec, ("did", "dv"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = _matrix(batch.column(1)[i]), _matrix(batch.column(3)[i])
                qid, did = (batch.column(c)[i].values.to_numpy() for c in (0, 2))
                size = np.linalg.norm(b, axis=1)[None, :]
                m = min(k, len(did))
                for at in range(0, len(qid), SCORED_ROWS):
                    own, ids = a[at : at + SCORED_ROWS], qid[at : at + SCORED_ROWS]
                    norms = np.linalg.norm(own, axis=1)[:, None] * size
                    score = np.where(norms > 0, (own @ b.T) / np.where(norms > 0, norms, 1), 0.0)
                    score[ids[:, None] == did[None, :]] = -np.inf
                    edge = -np.partition(-score, m - 1, axis=1)[:, m - 1]
                    rows, cols = np.nonzero((score >= edge[:, None]) & np.isfinite(score))  # all that tie with the last
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(did[cols]), pa.array(np.round(score[rows, cols], 6))], ["query_id", "doc", "score"])

    pairs = q.crossJoin(d)  # a stated query set against all rows, in blocks: each pair is a matrix product
    return top_k(pairs.mapInArrow(run, "query_id long, doc long, score double"), k, ["query_id"], F.desc("score"), "doc")


def sparse_topk(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Docs (doc, index, weight) and queries (query_id, index, weight): dot products."""
    hits = docs.join(queries.withColumnRenamed("weight", "q"), "index").groupBy("query_id", "doc").agg(F.round(F.sum(F.col("weight") * F.col("q")), 9).alias("score"))
    return top_k(hits, k, ["query_id"], F.desc("score"), "doc")


def late_interaction(hits: DataFrame, k: int, mode: str = "max") -> DataFrame:
    """Hits (query_id, token, doc, score): the best (or, mode sum, the sum of each token's best) score of a document."""
    if mode == "sum":
        hits = hits.groupBy("query_id", "token", "doc").agg(F.max("score").alias("score"))
    how = F.sum if mode == "sum" else F.max
    return top_k(hits.groupBy("query_id", "doc").agg(how("score").alias("score")), k, ["query_id"], F.desc("score"), "doc")


def ranked(hits: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def rrf(hits: DataFrame, k: int = 60, weights: dict[str, float] | None = None, lane: str = "provider") -> DataFrame:
    """Hits (query_id, <lane>, key, rank): query_id, key, rrf, score (min-max within the query; all
    equal gives 1), lanes (those that have the key, sorted)."""
    w = scores.lookup(weights, F.col(lane), 1.0) if weights else F.lit(1.0)
    fused = hits.groupBy("query_id", "key").agg(F.sum(w / (k + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set(lane)).alias("lanes"))
    q = Window.partitionBy("query_id")
    low, high = F.min("rrf").over(q), F.max("rrf").over(q)
    return fused.withColumn("score", F.when(high == low, (F.col("rrf") > 0).cast("double")).otherwise((F.col("rrf") - low) / (high - low)))


def normalized(hits: DataFrame, method: str = "minmax", by: tuple[str, ...] = ("query_id", "provider"), value: str = "score") -> DataFrame:
    """Adds `normalized`: min-max, or z-scores by the population deviation; all equal gives 1, or 0 for zeros."""
    w, x = Window.partitionBy(*by), F.col(value)
    flat = (x > 0).cast("double") if method == "minmax" else F.lit(0.0)
    if method == "minmax":
        low, high = F.min(x).over(w), F.max(x).over(w)
        return hits.withColumn("normalized", F.when(high == low, flat).otherwise((x - low) / (high - low)))
    mean, sd = F.avg(x).over(w), F.stddev_pop(x).over(w)
    return hits.withColumn("normalized", F.when(sd == 0, flat).otherwise((x - mean) / sd))


def best_per_key(hits: DataFrame, by: list[str], score: str = "score", position: str = "pos") -> DataFrame:
    """Of each key the row of the highest score, at the first position at which the key stands."""
    w = Window.partitionBy(*by)
    first = hits.withColumn("first_pos", F.min(position).over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc(score), position)))
    return first.where("__n = 1").drop("__n")


def first_per_key(hits: DataFrame, by: list[str], position: str = "pos") -> DataFrame:
    """W08, W33, U03, U07."""
    return top_k(hits, 1, by, F.col(position)).drop("rank")


def capped(hits: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """At most n rows of each group."""
    return top_k(hits, n, by, *order).drop("rank")


def preranked(hits: DataFrame, n: int, per_domain: int = 2) -> DataFrame:
    """Hits (query_id, domain, entity, authority, fresh, spam, pos): .30/.25/.15/.10/-.20 with the
    diversity loss .2 for each earlier row of the domain, then per-domain quota and top n."""
    d = Window.partitionBy("query_id", "domain").orderBy("pos")
    loss = F.least(0.2 * (F.row_number().over(d) - 1), F.lit(1.0))
    scored = hits.withColumn("prerank", F.round(0.30 * F.col("entity") + 0.25 * F.col("authority") + 0.15 * F.col("fresh") + 0.10 * (1 - loss) - 0.20 * F.col("spam"), 9))
    some = capped(scored, ["query_id", "domain"], per_domain, F.desc("prerank"), F.col("pos"))
    return top_k(some, n, ["query_id"], F.desc("prerank"), F.col("pos"))


def crowd_penalty(hits: DataFrame, top: int = 10, share: float = 0.5, loss: float = 0.15) -> DataFrame:
    """A domain with over `share` of the first `top` rows loses `loss` in each row but its first; not below 0."""
    d = Window.partitionBy("query_id", "domain")
    crowded = F.count_if(F.col("rank") <= top).over(d) > share * F.least(F.count("*").over(Window.partitionBy("query_id")), F.lit(top))
    later = F.row_number().over(d.orderBy("rank")) > 1
    return hits.withColumn("penalised", F.when(crowded & later, F.greatest(F.col("score") - loss, F.lit(0.0))).otherwise(F.col("score")))


def domain_share_penalty(hits: DataFrame) -> DataFrame:
    """.3 times the domain's share of the query's rows; 0 for a single row."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    same = F.count("*").over(Window.partitionBy("query_id", "domain"))
    return hits.withColumn("penalty", F.when(n <= 1, 0.0).otherwise(F.least(same / n, F.lit(1.0)) * 0.3))


def blended(hits: DataFrame, top: int, semantic: str = "semantic", quality: str = "quality", weight: float = 0.5) -> DataFrame:
    """The first 2 x top rows by quality get weight x semantic + (1 - weight) x quality; then the top."""
    first = top_k(hits, 2 * top, ["query_id"], F.desc(quality), F.col("key")).drop("rank")
    mixed = first.withColumn("blend", F.round(weight * F.col(semantic) + (1 - weight) * F.col(quality), 9))
    return top_k(mixed, top, ["query_id"], F.desc("blend"), F.col("key"))


def lost_in_middle(hits: DataFrame) -> DataFrame:
    """Place of each rank: the best first, the second last, the others alternating inwards."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    r = F.col("rank")
    return hits.withColumn("place", F.when(r % 2 == 1, (r + 1) / 2).otherwise(n - r / 2 + 1).cast("int"))


def token_budget(hits: DataFrame, budget: int, body: str = "text") -> DataFrame:
    """The ranked prefix whose running sum of length/4 stays in the budget, up to the first that doesn't fit."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(F.floor(F.length(body) / 4)).over(w)).where(F.col("used") <= budget)


def head_and_tail(chunks: DataFrame, by: str, pos: str, most: int = 8) -> DataFrame:
    """All chunks of a source if there are `most` or fewer, else the first and the last half of that."""
    w = Window.partitionBy(by)
    n, first = F.count("*").over(w), F.row_number().over(w.orderBy(pos))
    return chunks.withColumn("__n", n).withColumn("__i", first).where((F.col("__n") <= most) | (F.col("__i") <= most // 2) | (F.col("__i") > F.col("__n") - most // 2)).drop("__n", "__i")


def union_lanes(lanes: dict[str, DataFrame], lane: str = "provider") -> DataFrame:
    """The rows of all lanes under their names; columns that a lane lacks are null."""
    out = None
    for name, rows in lanes.items():
        part = rows.withColumn(lane, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def hybrid(lanes: dict[str, DataFrame], k: int, rrf_k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Lanes of (query_id, key, rank) fused by reciprocal rank, the first k of each query: rrf, score (min-max
    over the query), lanes (joined by +) and rank. A lane that gave nothing is simply not there."""
    fused = rrf(union_lanes(lanes), rrf_k, weights)
    fused = fused.select("query_id", "key", F.round("rrf", 9).alias("rrf"), F.round("score", 9).alias("score"), F.array_join("lanes", "+").alias("lanes"))
    return top_k(fused, k, ["query_id"], F.desc("rrf"), "key")


def multi_query(hits: DataFrame, quality: Column, k: int, deep: int = 20) -> DataFrame:
    """Lists of sub-queries (query_id, provider, key, rank, and what `quality` reads) fused without weights; the first
    `deep` are ordered anew by quality, the others follow in their order."""
    facts = hits.groupBy("query_id", "key").agg(F.max(quality).alias("quality"))
    first = top_k(rrf(hits).select("query_id", "key", "rrf"), 10**9, ["query_id"], F.desc("rrf"), "key").withColumnRenamed("rank", "fused_rank").join(facts, ["query_id", "key"])
    order = [F.col("fused_rank") > deep, F.desc(F.when(F.col("fused_rank") <= deep, F.col("quality"))), F.col("fused_rank")]
    return top_k(first, k, ["query_id"], *order).select("query_id", "key", F.round("quality", 9).alias("quality"), "fused_rank", "rank")


def merged_passages(passages: DataFrame, most: int) -> DataFrame:
    """Passages (query_id, url, chunk_index, score) of several rounds: the best score of each chunk, twice `most` in all."""
    best = passages.groupBy("query_id", "url", "chunk_index").agg(F.max("score").alias("score"))
    return top_k(best, 2 * most, ["query_id"], F.desc("score"), "url", "chunk_index")


def url_aliases(rows: DataFrame, url: str = "url", pos: str = "pos") -> DataFrame:
    """Identity (address without scheme), its first address, and all of them, each once, in order."""
    from ..functions import urls

    each = rows.groupBy(urls.identity(F.col(url)).alias("identity"), F.col(url).alias("url")).agg(F.min(pos).alias("pos"))
    listed = each.groupBy("identity").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("a"))
    return listed.select("identity", F.col("a")[0].url.alias("first"), F.transform("a", lambda x: x.url).alias("aliases"))


def recent(log: DataFrame, n: int, by: str = "id") -> DataFrame:
    """The last n rows of a log."""
    return log.orderBy(F.desc(by)).limit(n)
