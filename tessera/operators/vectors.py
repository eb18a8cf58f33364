"""A stored vector index: coarse cells, product codes, exact rescoring of a short list."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.generations import Generations
from ..sources.shared import written
from .retrieval import top_k

#: Rows that cells and codes are fitted on at most, cells at most, dimensions of a code, centroids of each, rows in a block, rows of a cell block of queries.
FIT_ROWS, CELLS, WIDTH, CENTROIDS, BLOCK_ROWS, QUERY_ROWS = 20_000, 1024, 2, 256, 4096, 256
#: Share of the nearest rows of sampled queries that the probed cells have to hold.
AIM = 0.97
SEED = 11
#: Candidates that a task of a search holds before it keeps the best of each query alone.
LISTED = 1 << 18


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Centroids of rows by Lloyd's rounds from seeded rows; an empty one takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        apart = (centres**2).sum(1) - 2 * x @ centres.T
        own = apart.argmin(1)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        for c in np.flatnonzero(count == 0):
            centres[c] = x[(apart.min(1) + (x**2).sum(1)).argmax()]
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class Codes:
    """Cells (a centroid each) and, for each WIDTH dimensions, CENTROIDS values that stand for what is left of a vector beside its cell's centroid."""

    def __init__(self, cells: np.ndarray, books: list[np.ndarray]):
        self.cells, self.books = cells, books

    @classmethod
    def fit(cls, rows: np.ndarray, cells: int) -> Codes:
        centres = _kmeans(rows, cells)
        rest = rows - centres[cls._nearest(rows, centres)]
        return cls(centres, [_kmeans(rest[:, at : at + WIDTH], CENTROIDS, 8) for at in range(0, rows.shape[1], WIDTH)])

    @staticmethod
    def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its code, a byte for each book."""
        cell = self._nearest(rows, self.cells)
        rest = rows - self.cells[cell]
        return cell, np.stack([self._nearest(rest[:, k * WIDTH : (k + 1) * WIDTH], b) for k, b in enumerate(self.books)], 1).astype(np.uint8)

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """The products of queries with what coded rows of a cell stand for: a table look-up for each book."""
        out = np.repeat((queries @ self.cells[cell])[:, None], len(codes), 1)
        for k, book in enumerate(self.books):
            out += (queries[:, k * WIDTH : (k + 1) * WIDTH] @ book.T)[:, codes[:, k]]
        return out

    def ranked_cells(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort(-(queries @ self.cells.T), axis=1, kind="stable")

    def to_json(self) -> dict:
        pack = lambda a: [a.shape, base64.b64encode(np.ascontiguousarray(a, np.float32)).decode()]
        return {"cells": pack(self.cells), "books": [pack(b) for b in self.books]}

    @classmethod
    def from_json(cls, state: dict) -> Codes:
        read = lambda p: np.frombuffer(base64.b64decode(p[1]), np.float32).reshape(p[0]).astype(np.float64)
        return cls(read(state["cells"]), [read(b) for b in state["books"]])


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


class VectorIndex:
    """Cosine neighbours from blocks of coded rows under `root`, a folder that driver and executors share.

    Cells and codes are fitted on a sample of at most FIT_ROWS rows; every row is then put into its nearest cell and coded there. A cell's
    rows stand in blocks of about BLOCK_ROWS, however many it has: ids, codes (a byte for WIDTH dimensions), and the vectors in a
    column of their own. A search probes the cells nearest to a query, as many as sampled queries needed to hold AIM of their neighbours, reads their codes,
    and compares whole vectors of the best by code alone; a task keeps no more than the best by code of each query, LISTED rows at once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._state = Generations(spark, root)

    def rebuild(self, vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", cells: int | None = None, fit_rows: int = FIT_ROWS) -> dict:
        """All rows with a key and a vector that has a direction. Vectors are of one length. The pointer moves once the new blocks are there."""
        rows = vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("float")).alias("v")).where(F.exists("v", lambda x: x != 0))
        rows = written(rows, "vectors")
        n = rows.count()
        if not n:
            raise ValueError("no vectors")
        share = min(1.0, fit_rows / n)
        coin = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
        sample = rows.where(coin).orderBy(F.xxhash64("id", F.lit(SEED))).limit(fit_rows).select("v").toArrow()["v"].combine_chunks()  # fit_rows rows at most
        fitted = _unit(_vectors(sample))
        cells = cells or max(1, min(CELLS, int(n**0.5), len(fitted) // 8))
        codes = Codes.fit(fitted, cells)
        number = self._state.state().get("generation", 0) + 1

        def encoded(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _vectors(batch.column(1))
                    cell, code = codes.encode(_unit(x))
                    packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (code, x.astype(np.float32))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), *packed], ["id", "cell", "code", "vec"])

        coded = written(rows.mapInArrow(encoded, "id long, cell int, code binary, vec binary"), "coded")
        sizes = dict(coded.groupBy("cell").count().collect())  # CELLS numbers at most
        parts = F.element_at(F.create_map(*[F.lit(int(v)) for c, k in sizes.items() for v in (c, -(-k // BLOCK_ROWS))]), F.col("cell"))
        blocks = coded.groupBy("cell", F.pmod(F.xxhash64("id", F.lit(SEED + 1)), parts).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "code", "vec"))).alias("r"))
        blocks = blocks.select("cell", "block", F.col("r.id").alias("ids"), F.col("r.code").alias("codes"), F.col("r.vec").alias("vecs"))
        blocks.repartition("cell", "block").write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/g{number}")
        return self._state._save(generation=number, concrete=f"g{number}", rows=n, probes=self._probes(codes, fitted), sizes={str(k): v for k, v in sizes.items()}, **codes.to_json())

    @staticmethod
    def _probes(codes: Codes, sample: np.ndarray, queries: int = 200, near: int = 10) -> int:
        """How many cells hold AIM of the nearest rows of sampled queries."""
        q = sample[:queries]
        score = q @ sample.T
        np.fill_diagonal(score[:, : len(q)], -np.inf)
        near = min(near, len(sample) - 1)
        if near < 1:
            return 1
        top = np.argpartition(-score, near - 1, axis=1)[:, :near]
        cell = Codes._nearest(sample, codes.cells)
        place = np.argsort(codes.ranked_cells(q), axis=1)
        needed = np.take_along_axis(place, cell[top], axis=1)
        return int(np.quantile(needed, AIM, method="higher")) + 1

    def search(self, queries: DataFrame, k: int = 20, key: str = "vec_id", vec: str = "embedding", probes: int | None = None, refine: int = 8) -> DataFrame:
        """queries (key, vec): query_id, doc, score, rank: the k nearest by cosine among the rows of the probed cells, a row of the query's own key left out.
        Of each query the refine x k best rows by code have their whole vectors compared. Queries are dealt by cell to blocks of QUERY_ROWS, so neither a cell with
        many rows nor one with many queries is one task. probes of all cells and a large refine give the exact answer."""
        state = self._state.state()
        codes, n_cells = Codes.from_json(state), state["cells"][0][0]
        probes = min(probes or state["probes"], n_cells)
        most = refine * k
        asked = queries.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.transform(vec, lambda x: x.cast("float")).alias("q"))

        def dealt(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _unit(_vectors(batch.column(1)))
                    cells = codes.ranked_cells(x)[:, :probes]
                    at = np.repeat(np.arange(len(x)), probes)
                    packed = [x[i].astype(np.float32).tobytes() for i in range(len(x))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cells.ravel().astype(np.int32)), pa.array(packed, pa.binary()).take(pa.array(at))], ["query_id", "cell", "q"])

        probed = asked.mapInArrow(dealt, "query_id long, cell int, q binary")
        groups = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // QUERY_ROWS))))
        packs = written(probed.groupBy("cell", groups.alias("pack")).agg(F.collect_list(F.struct("query_id", "q")).alias("qs")), "query_packs")
        cells = [r[0] for r in packs.select("cell").distinct().collect()]  # CELLS numbers at most
        blocks = self.spark.read.schema("block int, ids array<long>, codes array<binary>, vecs array<binary>, cell int").parquet(f"{self.root}/{state['concrete']}").where(F.col("cell").isin(*cells) if cells else F.lit(False))

        def floats(rows) -> np.ndarray:
            return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64)

        names = ["query_id", "cell", "block", "doc", "near"]

        def best(held):
            """Of the held candidates the `most` nearest of each query."""
            query, cell, block, doc, near = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((doc, -near, query))
            starts = np.flatnonzero(np.append(True, np.diff(query[order]) != 0))
            place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
            return [c[order[place < most]] for c in (query, cell, block, doc, near)]

        def short_lists(batches):
            held, n = [], 0
            for batch in batches:
                for row in batch.to_pylist():
                    q, ids = floats([x["q"] for x in row["qs"]]), np.array(row["ids"], np.int64)
                    mine = np.array([x["query_id"] for x in row["qs"]], np.int64)
                    score = codes.scores(q, row["cell"], np.frombuffer(b"".join(row["codes"]), np.uint8).reshape(len(ids), -1))
                    score[mine[:, None] == ids[None, :]] = -np.inf
                    m = min(most, len(ids))
                    top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                    a = np.repeat(np.arange(len(q)), m)
                    b = top.ravel()
                    ok = np.isfinite(score[a, b])
                    a, b = a[ok], b[ok]
                    held.append([mine[a], np.full(len(a), row["cell"], np.int32), np.full(len(a), row["block"], np.int32), ids[b], score[a, b]])
                    n += len(a)
                    if n > LISTED:
                        held = [best(held)]
                        n = len(held[0][0])
                        if n > LISTED // 2:  # many queries: what is left goes on, a later exchange ranks it
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names)
                            held, n = [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in best(held)], names)

        pairs = packs.join(blocks.select("cell", "block", "ids", "codes"), "cell").select("cell", "block", "ids", "codes", "qs")
        listed = top_k(pairs.mapInArrow(short_lists, "query_id long, cell int, block int, doc long, near double"), most, ["query_id"], F.desc("near"), F.col("doc")).drop("rank", "near")
        listed = written(listed, "short_lists")
        # whole vectors of the listed rows: by block, in which each is looked up by its place
        wanted = listed.groupBy("cell", "block").agg(F.collect_set("doc").alias("docs"))
        chosen = wanted.join(blocks.select("cell", "block", "ids", "vecs"), ["cell", "block"])
        whole = chosen.select(F.explode(F.filter(F.arrays_zip("ids", "vecs"), lambda r: F.array_contains("docs", r.ids))).alias("r")).select(F.col("r.ids").alias("doc"), F.col("r.vecs").alias("vec"))
        both = listed.select("query_id", "doc").join(whole, "doc").join(asked, "query_id").select("query_id", "doc", "q", "vec")

        def compared(batches):
            for batch in batches:
                if batch.num_rows:
                    score = (_unit(_vectors(batch.column(2))) * _unit(floats(batch.column(3).to_pylist()))).sum(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(score, 6))], ["query_id", "doc", "score"])

        return top_k(both.mapInArrow(compared, "query_id long, doc long, score double"), k, ["query_id"], F.desc("score"), F.col("doc"))
