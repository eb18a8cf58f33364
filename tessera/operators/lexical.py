"""Postings and BM25 scores in Arrow batches: a block is the postings of a term in a span of documents, and a span is scored as one matrix product."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a block that a task makes by itself, queries that a span is scored for at once, terms of a product.
CHUNK_DOCS, SLICE_QUERIES, PRODUCT_TERMS = 256, 256, 4096
POSTINGS = "array<struct<doc: long, tf: int, length: int>>"
_POSTING = pa.struct([("doc", pa.int64()), ("tf", pa.int32()), ("length", pa.int32())])


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The list that each value stands in, and the values."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _counts(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of lists of terms: (length of each list; row, term's number and count of each term of a list, by term, then row; the terms)."""
    row, words = _flat(terms)
    coded = words.dictionary_encode()
    key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(terms) + row, return_counts=True)
    code, row_of = np.divmod(key, max(len(terms), 1))
    return np.bincount(row, minlength=len(terms)), row_of, code, tf, coded.dictionary


def _block_rows(span: int, doc: pa.Array, length: np.ndarray, row: np.ndarray, code: np.ndarray, tf: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """The blocks of a span from entries in order of term, then row."""
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    n, own = np.diff(np.append(first, len(code))), length[row]
    listed = pa.StructArray.from_arrays([doc.take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(own.astype(np.int32))], fields=list(_POSTING))
    least = lambda f, x: pa.array((f.reduceat(x, first) if len(first) else first).astype(np.int32))
    columns = [names.take(pa.array(code[first])), pa.array(np.full(len(first), span)), pa.array(n.astype(np.int32)), least(np.maximum, tf), least(np.minimum, own), _lists(n, listed)]
    return pa.RecordBatch.from_arrays(columns, ["term", "span", "n", "most_tf", "least_length", "postings"])


def _counted_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_DOCS):
            part = batch.slice(at, CHUNK_DOCS)
            length, row, code, tf, names = _counts(part.column(1))
            order = np.argsort(row, kind="stable")
            n = np.bincount(row, minlength=part.num_rows)
            columns = [part.column(0), pa.array(length.astype(np.int32)), _lists(n, names.take(pa.array(code[order]))), _lists(n, pa.array(tf[order].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "length", "terms", "tfs"])


def counted(rows: DataFrame) -> DataFrame:
    """rows (doc, terms): doc, length, terms (each once), tfs. A row stays a row: no word is exchanged to be counted."""
    return rows.select("doc", "terms").mapInArrow(_counted_batches, "doc long, length int, terms array<string>, tfs array<int>")


def _span_batches(batches):
    """Rows in order of (span, doc): the blocks of each span, once all of its rows are there."""

    def blocks(span, held):
        doc, length, terms, tfs = (pa.concat_arrays([h.column(c) for h in held]) for c in range(1, 5))
        row, words = _flat(terms)
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((row, code))
        return _block_rows(span, doc, length.to_numpy(), row[order], code[order], tfs.flatten().to_numpy()[order], coded.dictionary)

    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        spans = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.append(True, spans[1:] != spans[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(spans)), strict=True):
            if held and spans[a] != last:
                yield blocks(last, held)
                held = []
            last = int(spans[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield blocks(last, held)


def span_blocks(rows: DataFrame) -> DataFrame:
    """rows (span, doc, length, terms, tfs) as counted() gives them: the blocks of each span, which comes to one task."""
    dealt = rows.select("span", "doc", "length", "terms", "tfs").repartition("span").sortWithinPartitions("span", "doc")
    return dealt.mapInArrow(_span_batches, f"term string, span long, n int, most_tf int, least_length int, postings {POSTINGS}")


def _chunk_batches(batches):
    """Blocks of CHUNK_DOCS rows of a task each; the empty term has no postings, but their number and the sum of lengths."""
    task, number = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_DOCS):
            part = batch.slice(at, CHUNK_DOCS)
            length, row, code, tf, names = _counts(part.column(1))
            found = _block_rows(task + number, part.column(0), length, row, code, tf, names)
            columns = [found.column(c) for c in (0, 1, 2, 5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(found.num_rows, np.int64))], ["term", "span", "n", "postings", "total"])
            whole = [pa.array([""]), pa.array([task + number]), pa.array([part.num_rows], pa.int32()), pa.array([[]], pa.list_(_POSTING)), pa.array([int(length.sum())])]
            yield pa.RecordBatch.from_arrays(whole, ["term", "span", "n", "postings", "total"])
            number += 1


def chunk_blocks(rows: DataFrame) -> DataFrame:
    """rows (doc, terms; a doc once): term, span, n, postings, total: blocks of the documents as they lie, made without an exchange; one of the empty term for each span."""
    return rows.select("doc", "terms").mapInArrow(_chunk_batches, f"term string, span long, n int, postings {POSTINGS}, total long")


def sliced(queries: DataFrame) -> Callable[[str], F.Column]:
    """The slice of a query by its id: SLICE_QUERIES of them in one, about."""
    n = max(1, -(-queries.count() // SLICE_QUERIES))
    return lambda name: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")


def scores(blocks: DataFrame, by: list[str], k: int, mean: float, k1: float, b: float) -> DataFrame:
    """blocks (by: span and slice; term, postings, asked: array of query_id, idf, floor): query_id, doc, score of the k best of each query in each span, with all that may tie
    with the last, and not below the query's floor (null: none). Each group is a matrix of documents by terms times one of terms by queries, PRODUCT_TERMS at once."""
    kind = blocks.schema["asked"].dataType.elementType["query_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        lists, asked = (group.column(c).combine_chunks() for c in ("postings", "asked"))
        lists, asked = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lists, asked))
        (t, p), (u, q) = _flat(lists), _flat(asked)
        docs, who = p.field("doc").dictionary_encode(null_encoding="encode"), q.field("query_id").dictionary_encode(null_encoding="encode")
        d, w = docs.indices.to_numpy(), who.indices.to_numpy()
        tf, length, idf = p.field("tf").to_numpy().astype(float), p.field("length").to_numpy(), q.field("idf").to_numpy()
        gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        floor = np.full(len(who.dictionary), -np.inf)
        np.maximum.at(floor, w, pc.fill_null(q.field("floor"), -np.inf).to_numpy(zero_copy_only=False))
        score = np.zeros((len(floor), len(docs.dictionary)))
        for at in range(0, len(lists), PRODUCT_TERMS):
            m = min(PRODUCT_TERMS, len(lists) - at)
            x, y = slice(*np.searchsorted(t, (at, at + m))), slice(*np.searchsorted(u, (at, at + m)))
            has, wants = np.zeros((m, score.shape[1])), np.zeros((score.shape[0], m))
            has[t[x] - at, d[x]] = gain[x]
            wants[w[y], u[y] - at] = idf[y]
            score += wants @ has
        # scores are compared after rounding to nine digits
        least = np.maximum(floor - 1e-8, -np.partition(-score, k - 1, axis=1)[:, k - 1] - 2e-9 if score.shape[1] > k else -np.inf)
        rows, cols = np.nonzero((score > 0) & (score >= least[:, None]))
        return pa.table({"query_id": who.dictionary.take(pa.array(rows)), "doc": docs.dictionary.take(pa.array(cols)), "score": score[rows, cols]})

    return blocks.select(*by, "postings", "asked").groupBy(*by).applyInArrow(run, f"query_id {kind}, doc long, score double").withColumn("score", F.round("score", 9))
