"""Filter interaction audit: a relational word pipeline and conditional counts by set of failed filters."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import SPACE, text_of, written

#: Thresholds of the five filters. Fixed values.
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 200, 50, 2, "[#$%&*|]"
LETTERS = "ABCDE"


def row_key(docs: DataFrame) -> tuple[Column, Column]:
    """What names a row: doc_id and a hash of the text, so that rows of a repeated doc_id stay apart."""
    return docs.doc_id.cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("text_key")


def word_totals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_distinct of each distinct row: words exploded, counted by (row, word), then by row.

    A row's words all come from one row, so the text moves once, to where its key belongs, and both aggregations
    follow without a further exchange; one row for each distinct word of each text would be several times the bytes. Each row
    adds one null word, so texts without a word keep a row and equal rows, whose words are counted together, can be told.
    """
    doc_id, key = row_key(docs)
    rows = docs.select(doc_id, key, text_of(docs).alias("body")).repartition("doc_id", "text_key")
    words = rows.select("doc_id", "text_key", F.explode(F.array_append(F.split("body", SPACE), F.lit(None))).alias("word")).where("word is null or word != ''")
    each = words.groupBy("doc_id", "text_key", "word").agg(F.count(F.lit(1)).alias("n"))
    sums = each.groupBy("doc_id", "text_key").agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("n"), F.count("word").alias("n_distinct"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("copies"))
    return sums.select("doc_id", "text_key", F.expr("coalesce(n, 0L) div copies").alias("n_words"), "n_distinct")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, part, mask (bit k: fails LETTERS[k]), good, toxic.

    A: fewer than 200 words. B: fewer distinct words than half of the words. C: over 2 % of the code points are A-Z. D: holds a
    mark. E: a smaller doc_id has an identical text (by SHA-256), anywhere in the table. Null text is empty; null source is the part ''.
    A null doc_id never fails E. Of several labels of a doc_id, one that says so is enough; documents without any are neither good nor toxic.
    """
    text = text_of(docs)
    doc_id, key = row_key(docs)
    base = docs.select(
        doc_id, key, F.coalesce(docs.source.cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
        (F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text).cast("long") * UPPER_PERCENT).alias("c"), text.rlike(MARKS).alias("d"),
    )
    base = written(base, "audit_rows")
    # written, so that a join whose left side holds a large group of copies has plain exchanges on both sides, which Spark can split
    firsts = written(base.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "audit_firsts")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    totals = word_totals(docs).withColumnsRenamed({"doc_id": "w_id", "text_key": "w_key"})
    rows = base.join(totals, base.doc_id.eqNullSafe(totals.w_id) & (base.text_key == totals.w_key), "left").join(firsts, "digest", "left").join(known, F.col("doc_id") == F.col("label_id"), "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = [n < LEAST_WORDS, distinct * 100 < n * DISTINCT_PERCENT, F.col("c"), F.col("d"), F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def steps(letters: str = LETTERS) -> str:
    """Every order of the filters and every step in it, as JSON: the order, the step, its filter's bit and the bits before it."""
    out = []
    for order in itertools.permutations(range(len(letters))):
        for k, f in enumerate(order):
            out.append({"filter_order": "".join(letters[x] for x in order), "step": k + 1, "bit": 1 << f, "before": sum(1 << x for x in order[:k])})
    return json.dumps(out)


def interactions(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each filter does at each step of each order, from rows of part, mask, good and toxic: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One aggregation counts the rows of each set of failed filters, 32 conditional counts for five filters, and the same of good and toxic
    rows; everything else is sums over a part's counts. Of the orders of n filters, a document that fails k is removed by each
    of the k in n!/k of them, so shapley needs no pass over the orders. No rows give none.
    """
    sets = 1 << len(letters)
    counts = [F.array(*[F.count_if((F.col("mask") == m) & of) for m in range(sets)]).alias(name) for name, of in (("c", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
    parts = flags.groupBy("part").agg(*counts)
    kind = "array<struct<filter_order: string, step: int, bit: int, before: int>>"
    rows = parts.select("*", F.explode(F.from_json(F.lit(steps(letters)), kind)).alias("s")).select("part", "c", "good", "toxic", "s.*")

    def total(name: str, which: str, of: str = "c", times: str = "1L") -> Column:
        return F.expr(f"aggregate(sequence(0, {sets - 1}), 0L, (t, m) -> t + IF({which}, {of}[m] * {times}, 0L))").alias(name)

    here, orders = "m & before = 0 AND m & bit != 0", len(list(itertools.permutations(letters)))
    return rows.select(
        "part", "filter_order", "step", total("kept", "m & (before | bit) = 0"), total("removed", here), total("redundant", "m & before != 0 AND m & bit != 0"), total("unique_fails", "m = bit"),
        total("good_lost", here, "good"), total("toxic_lost", here, "toxic"), total("shapley", "m & bit != 0", times=f"({orders}L div bit_count(m))"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over docs, by source."""
    return interactions(failures(docs, labels))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, part, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY body) < doc_id AS e FROM d),
f AS (SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
  [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body), regexp_matches(body, '[#$%&*|]'), e.e] AS fails
  FROM w JOIN e USING (doc_id) LEFT JOIN l USING (doc_id)),
n AS (SELECT * FROM (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) t(k, x)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM n a, n b, n c, n d, n e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, step, ks[step] AS k, ks[1:step - 1] AS before FROM o, range(1, 6) r(step)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
j AS (SELECT g.*, filter_order, step, k, fails[k] AS fails_it, len(list_filter(before, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS failed FROM g, s),
a AS (SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT gone AND NOT fails_it), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_it), 0) AS removed,
  coalesce(sum(n) FILTER (gone AND fails_it), 0) AS redundant, coalesce(sum(n) FILTER (fails_it AND failed = 1), 0) AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND fails_it), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_it), 0) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM a
"""
