"""Numeric band join as a sweep line: events sorted over all partitions, running totals, bounded heaps of near lines."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written

#: Of an item's pairs, so many are listed. A heap holds twice as many lines, LISTED of an item at most: without any one item's, LISTED are left.
LISTED = 10
HELD = 2 * LISTED
#: A gap is near if it is at most NEAR cents, or SHARE times the gap is at most the smaller price. Fixed values of the contract.
NEAR, SHARE = 50, 200
#: Ranges of the sweep: so many summaries, with HELD lines on each side, reach the driver at any input size.
RANGES = 200
#: Rows that the combiner sorts at once, and rows in a batch that it emits.
COMBINED, BATCH = 1 << 18, 1 << 14
#: Cents beyond this aren't exact in a double; such amounts and prices count as null.
MOST_CENTS = float(1 << 53)
#: Stands for a null line_no, which comes before all others.
NO_LINE_NO = -(1 << 40)
#: Kinds of events, in the order that they have at one position; and the two summaries of a range.
START, LINE, PRICE, END, FIRST, BEHIND = range(6)


def cents(x: Column) -> Column:
    """floor(100 * x + 0.5) in doubles; null where that isn't finite or exceeds MOST_CENTS."""
    scaled = x.cast("double") * 100.0 + 0.5
    return F.when(F.abs(scaled) < MOST_CENTS, F.floor(scaled))


def priced_lines(lines: DataFrame) -> DataFrame:
    """sale_id, line_no, item_id, u, crc of the lines that can pair. A quantity of 0 has no u, and such lines never pair."""
    rows = lines.select(F.col("sale_id").cast("long"), F.col("line_no").cast("long"), F.col("item_id").cast("long"), cents(F.col("amount")).alias("a"), F.col("quantity").cast("long").alias("q"))
    rows = rows.where("sale_id is not null and item_id is not null and a is not null and q != 0")
    rows = rows.selectExpr("sale_id", "line_no", "item_id", "(2 * a + q) * CAST(signum(q) AS long) AS over", "2 * abs(q) AS under")
    crc = "crc32(concat(sale_id, ',', coalesce(CAST(line_no AS string), ''), ',', item_id))"
    return rows.selectExpr("sale_id", f"coalesce(line_no, {NO_LINE_NO}L) AS line_no", "item_id", "(over - pmod(over, under)) div under AS u", f"{crc} AS crc")


def near(u: str, p: str) -> Column:
    return F.expr(f"abs({u} - {p}) <= {NEAR} OR {SHARE} * abs({u} - {p}) <= least({u}, {p})")


def band(p: str = "p") -> tuple[Column, Column]:
    """The smallest and the largest u that are near p: the rule of near(), solved for u."""
    least = F.expr(f"least({p} - {NEAR}, ({SHARE} * {p} + pmod(-{SHARE} * {p}, {SHARE + 1})) div {SHARE + 1})")
    most = F.expr(f"greatest({p} + {NEAR}, {p} + ({p} - pmod({p}, {SHARE})) div {SHARE})")
    return least, most


EVENTS = "pos long, kind int, p long, n long, crc long, sale_id long, line_no long, item_id long"
_EVENT = pa.schema([("pos", pa.int64()), ("kind", pa.int32()), ("p", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("sale_id", pa.int64()), ("line_no", pa.int64()), ("item_id", pa.int64())])
_LINE = pa.struct([("u", pa.int64()), ("sale_id", pa.int64()), ("line_no", pa.int64()), ("item_id", pa.int64())])
_WHOLE = pa.decimal128(38, 0)
SWEPT = "range int, kind int, p long, n decimal(38,0), s decimal(38,0), x decimal(38,0), lines array<struct<u: long, sale_id: long, line_no: long, item_id: long>>"
_SWEPT = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("p", pa.int64()), ("n", _WHOLE), ("s", _WHOLE), ("x", _WHOLE), ("lines", pa.list_(_LINE))])


def _place_in_group(*keys: np.ndarray) -> np.ndarray:
    """How many rows of the same keys stand before each; rows of the same keys stand together."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(fresh)
    return np.arange(len(fresh)) - np.repeat(first, np.diff(np.append(first, len(fresh))))


def combine(rows: np.ndarray) -> np.ndarray:
    """Columns u, sale_id, line_no, item_id, n, crc of lines, or of lines combined before: of each u the first HELD lines, LISTED of an item at most,
    and n and crc of all of them on the first. Combining parts and then their union gives what combining all at once gives."""
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    first = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
    sums = np.add.reduceat(rows[4:], first, axis=1)
    rows[4:] = 0
    rows[4:, first] = sums
    keep = np.ones(rows.shape[1], bool)
    large = np.flatnonzero(np.repeat(np.diff(np.append(first, len(keep))) > LISTED, np.diff(np.append(first, len(keep)))))
    if len(large):
        by_item = large[np.lexsort((large, rows[3][large], rows[0][large]))]
        keep[by_item[_place_in_group(rows[0][by_item], rows[3][by_item]) >= LISTED]] = False
        rows = rows[:, keep]  # the first line of a u is the first of its item, so the sums stay
        rows = rows[:, _place_in_group(rows[0]) < HELD]
    return rows


def _line_events(batches) -> Iterator[pa.RecordBatch]:
    """Lines of a task as LINE events, combined while they fit."""
    held, size = [], 0

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, rows.shape[1], BATCH):
            u, sale, line, item, n, crc = rows[:, at : at + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.full(len(u), LINE, np.int32)), pa.nulls(len(u), pa.int64()), *map(pa.array, (n, crc, sale, line, item))], schema=_EVENT)

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("u", "sale_id", "line_no", "item_id")]
        held.append(np.stack([*columns, np.ones(batch.num_rows, np.int64), batch.column(batch.schema.get_field_index("crc")).to_numpy()]))
        size += batch.num_rows
        if size >= COMBINED:
            rows = combine(np.concatenate(held, axis=1))
            held, size = [rows], rows.shape[1]
            if size > COMBINED // 2:
                yield from out(rows)
                held, size = [], 0
    if size:
        yield from out(combine(np.concatenate(held, axis=1)))


class Nearest:
    """A heap of the HELD lines nearest to a price by (gap, u, sale_id, line_no, item_id), LISTED of an item at most, in whatever order they are offered."""

    def __init__(self, p: int, lines: Iterable[tuple]):
        self.p, self.heap, self.items = p, [], Counter()
        for line in lines:
            self.offer(line)

    def offer(self, line: tuple) -> bool:
        """False if the line is farther than all of a full heap."""
        u, sale, line_no, item = line
        key = (-abs(u - self.p), -u, -sale, -line_no, -item)
        if len(self.heap) == HELD and key <= self.heap[0]:
            return False
        if self.items[item] == LISTED:
            worst = min(k for k in self.heap if k[4] == -item)
            if key <= worst:
                return True
            self.heap.remove(worst)
            heapq.heapify(self.heap)
            self.items[item] -= 1
        heapq.heappush(self.heap, key)
        self.items[item] += 1
        if len(self.heap) > HELD:
            self.items[-heapq.heappop(self.heap)[4]] -= 1
        return True

    def lines(self) -> list[tuple]:
        return [(-u, -sale, -line_no, -item) for _, u, sale, line_no, item in sorted(self.heap, reverse=True)]


def capped(lines: Iterable[tuple]) -> list[tuple]:
    """The first HELD lines, LISTED of an item at most."""
    out, items = [], Counter()
    for line in lines:
        if items[line[3]] < LISTED:
            items[line[3]] += 1
            out.append(line)
            if len(out) == HELD:
                break
    return out


def sweep(events: Iterator[tuple], number: int) -> Iterator[tuple]:
    """One range of the sweep: rows of SWEPT from its events (pos, kind, p, n, crc, sale_id, line_no, item_id) in order.

    START, PRICE and END of a price report the totals so far within the range: lines, the sum of their u, of their crc. From its PRICE on, a price is
    active: it starts with the nearest lines behind, and takes those ahead until no later one can enter its heap. At last come the range's own
    totals with its first lines and with those nearest to its end. Held: the active prices, and HELD lines each of them, behind and of the current u.
    """
    n = s = x = 0
    first, behind, active = [], [], {}
    begin = u = None
    group: list[tuple] = []
    places: dict[int, tuple] = {}

    def close() -> Iterator[tuple]:
        nonlocal first, behind
        if not group:
            return
        lines = capped(group)
        if len(first) < HELD:
            first = capped(first + lines)
        behind = capped(lines + behind)
        for p in [p for p, nearest in active.items() if not all(map(nearest.offer, lines))]:
            yield ended(p)
        group.clear()

    def ended(p: int) -> tuple:
        return (number, PRICE, p, *places.pop(p), active.pop(p).lines())

    for pos, kind, p, m, crc, sale, line_no, item in events:
        if begin is None:
            begin = pos
        if kind == LINE:
            if pos != u:
                yield from close()
                u = pos
            n, s, x = n + m, s + m * pos, x + crc
            group.append((pos, sale, line_no, item))
            if len(group) > 64 * HELD:
                group[:] = capped(group)
            continue
        yield from close()
        u = None
        if kind == PRICE:
            active[p], places[p] = Nearest(p, behind), (n, s, x)
        else:
            yield number, kind, p, n, s, x, None
            if kind == END and p in active:
                yield ended(p)
    yield from close()
    for p in list(active):
        yield ended(p)
    if begin is not None:
        yield number, FIRST, begin, n, s, x, first
        yield number, BEHIND, begin, n, s, x, behind


def _swept(batches) -> Iterator[pa.RecordBatch]:
    def events() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in _EVENT]
            yield from zip(*(c.fill_null(0).to_numpy().tolist() if c.null_count else c.to_numpy().tolist() for c in columns), strict=True)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        number, kind, p, n, s, x, lines = zip(*rows, strict=True)
        lines = [a if a is None else [dict(zip(("u", "sale_id", "line_no", "item_id"), r, strict=True)) for r in a] for a in lines]
        whole = [pa.array(list(map(Decimal, v)), _WHOLE) for v in (n, s, x)]
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(kind, pa.int32()), pa.array(p, pa.int64()), *whole, pa.array(lines, _SWEPT.field("lines").type)], schema=_SWEPT)

    held: list[tuple] = []
    for row in sweep(events(), TaskContext.get().partitionId()):
        held.append(row)
        if len(held) == 2000:
            yield out(held)
            held = []
    if held:
        yield out(held)


def carried(summaries: list) -> list[tuple]:
    """What each range needs of the others: range, lines, sum and crc before it, and the nearest lines before and after it."""
    of = {kind: sorted((r for r in summaries if r.kind == kind), key=lambda r: r.p) for kind in (FIRST, BEHIND)}
    plain = lambda r: [tuple(line) for line in r.lines]
    out, n, s, x, before = [], 0, 0, 0, []
    for r in of[BEHIND]:
        out.append([r.range, n, s, x, before])
        n, s, x, before = n + int(r.n), s + int(r.s), x + int(r.x), capped(plain(r) + before)
    after: list[tuple] = []
    for row, r in zip(reversed(out), reversed(of[FIRST]), strict=True):
        row.append(after)
        after = capped(plain(r) + after)
    return [(a, Decimal(b), Decimal(c), Decimal(d), e, f) for a, b, c, d, e, f in out]


def by_price(prices: DataFrame, lines: DataFrame, ranges: int = RANGES) -> DataFrame:
    """For each p of prices: n, gaps, crcs over all near lines, and `near`: the lines among which its nearest are, as structs of gap, u, sale_id, line_no,
    item_id in that order, enough to list LISTED without those of any one item.

    Lines are combined in their task and put in order by u together with START, PRICE and END events, over as many ranges as there are shuffle partitions
    (`ranges` at most). Each range is swept by itself; then its totals and the lines nearest to its borders are carried from range to range, which is all that
    reaches the driver, and each price's three reports meet.
    """
    spark = lines.sparkSession
    line_events = written(lines.mapInArrow(_line_events, EVENTS), "line_events")
    least, most = band()
    spots = F.array(*[F.struct(pos.alias("pos"), F.lit(kind).alias("kind")) for pos, kind in ((least, START), (F.col("p"), PRICE), (most, END))])
    others = prices.select("p", F.explode(spots).alias("e")).selectExpr("e.pos", "e.kind", "p", "0L AS n", "0L AS crc", "0L AS sale_id", "0L AS line_no", "0L AS item_id")
    count = min(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = line_events.unionByName(others).repartitionByRange(count, "pos").sortWithinPartitions("pos", "kind", "sale_id", "line_no", "item_id")
    swept = written(ordered.mapInArrow(_swept, SWEPT), "swept")
    kind = SWEPT.rpartition("lines ")[2]
    carry = spark.createDataFrame(carried(swept.where(F.col("kind").isin(FIRST, BEHIND)).collect()), f"range int, n0 decimal(38,0), s0 decimal(38,0), x0 decimal(38,0), before {kind}, after {kind}")
    rows = swept.where(F.col("kind") < FIRST).join(F.broadcast(carry), "range")
    at = lambda column, kind: F.max(F.when(F.col("kind") == kind, F.col(column) + F.col(f"{column}0"))).alias(f"{column}{kind}")
    found = F.when(F.col("kind") == PRICE, F.concat("lines", "before", "after"))
    sums = rows.groupBy("p").agg(*[at(c, k) for c in "nsx" for k in (START, PRICE, END)], F.first(found, ignorenulls=True).alias("found"))
    keyed = F.expr("transform(found, c -> named_struct('gap', abs(c.u - p), 'u', c.u, 'sale_id', c.sale_id, 'line_no', c.line_no, 'item_id', c.item_id))")
    return sums.select(
        "p", F.expr(f"CAST(n{END} - n{START} AS long) AS n"),
        F.expr(f"CAST(p * (n{PRICE} - n{START}) - (s{PRICE} - s{START}) + (s{END} - s{PRICE}) - p * (n{END} - n{PRICE}) AS long) AS gaps"),
        F.expr(f"CAST(x{END} - x{START} AS long) AS crcs"), F.array_sort(F.filter(keyed, lambda c: (c.gap <= NEAR) | (c.gap * SHARE <= F.least(c.u, F.col("p"))))).alias("near"),
    )


def near_prices(items: DataFrame, lines: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Each item's nearest lines of other items, and sums over all its pairs: item_id, rank, gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc.

    p is an item's price in cents, u a line's cents for one piece. An item pairs with every line of another item_id whose u is near p. Its first LISTED pairs by gap, u,
    sale_id, line_no (null first), line_item_id have ranks from 1; an item without pairs has one row of rank 0, nulls and zeros. Lines that are null in sale_id, item_id, quantity
    or amount, or have a quantity of 0, never pair, nor do items that are null in price or item_id; nor prices and amounts that aren't finite or exceed MOST_CENTS.
    Repeated lines each count; a repeated item has its rows as often as it stands there. Empty tables give no pairs. Other columns are ignored.

    Items of one price share one sweep (by_price). An item's own lines are counted by (item, u) beside it and taken off.
    """
    sold = priced_lines(lines)
    priced = items.select(F.col("item_id").cast("long").alias("item_id"), F.when(F.col("item_id").isNotNull(), cents(F.col("price"))).alias("p"))
    wanted = written(priced.groupBy("item_id", "p").agg(F.count(F.lit(1)).alias("copies")), "prices")
    prices = wanted.where("p is not null").select("p").distinct()
    # written, so that items of one frequent price meet their row by a join that Spark can split
    swept = written(by_price(prices, sold, ranges), "by_price")
    groups = sold.groupBy("item_id", "u").agg(F.count(F.lit(1)).alias("n"), F.sum("crc").alias("crc"))
    own = groups.join(wanted.where("p is not null").select("item_id", "p"), "item_id").where(near("u", "p"))
    own = own.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(F.expr("n * abs(u - p)")).alias("own_gaps"), F.sum("crc").alias("own_crcs"))
    rows = wanted.join(own.withColumnsRenamed({"item_id": "own_id", "p": "own_p"}), F.expr("item_id = own_id AND p = own_p"), "left").join(swept, "p", "left")
    rows = rows.withColumn("copy", F.explode(F.expr("array_repeat(0, CAST(copies AS int))")))
    listed = F.slice(F.filter("near", lambda c: c.item_id != F.col("item_id")), 1, LISTED)
    sums = [F.expr(f"coalesce({a}, 0L) - coalesce({b}, 0L) AS {name}") for a, b, name in (("n", "own_n", "n_pairs"), ("gaps", "own_gaps", "gap_sum"), ("crcs", "own_crcs", "lines_crc"))]
    out = rows.select("item_id", *sums, F.posexplode_outer(listed).alias("at", "c"))
    return out.selectExpr("item_id", "coalesce(at + 1, 0) AS rank", "c.gap", "c.u", "c.sale_id", f"nullif(c.line_no, {NO_LINE_NO}L) AS line_no", "c.item_id AS line_item_id", "n_pairs", "gap_sum", "lines_crc")


ORACLE = r"""
WITH i AS (SELECT item_id, row_number() OVER () AS copy, CASE WHEN item_id IS NOT NULL THEN floor(100 * price + 0.5)::BIGINT END AS p FROM items),
b AS (SELECT sale_id, line_no, item_id, 2 * floor(100 * amount + 0.5)::BIGINT + quantity AS over, 2 * quantity::BIGINT AS under FROM sale_lines
  WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity > 0 AND amount IS NOT NULL),
t AS (SELECT list(list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crcs FROM range(0::BIGINT, 256::BIGINT) r(n)),
l AS (SELECT sale_id, line_no, item_id, (over - (over % under + under) % under) // under AS u,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(sale_id || ',' || coalesce(line_no::VARCHAR, '') || ',' || item_id, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, k: xor(c >> 8, t.crcs[(xor(c, k) & 255) + 1]))) AS crc FROM b, t),
j AS (SELECT copy, abs(u - p) AS gap, u, sale_id, line_no, l.item_id AS line_item_id, crc
  FROM i JOIN l ON u >= p - greatest(50, p // 100 + 1) AND u <= p + greatest(50, p // 100 + 1)
  WHERE i.item_id <> l.item_id AND (abs(u - p) <= 50 OR 1000 * abs(u - p) <= 5 * least(u, p))),
s AS (SELECT copy, count(*) AS n_pairs, sum(gap) AS gap_sum, sum(crc) AS lines_crc FROM j GROUP BY copy),
r AS (SELECT *, row_number() OVER (PARTITION BY copy ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS rank FROM j QUALIFY rank <= 10)
SELECT i.item_id, coalesce(r.rank, 0)::INT AS rank, r.gap, r.u, r.sale_id, r.line_no::BIGINT AS line_no, r.line_item_id,
  coalesce(s.n_pairs, 0)::BIGINT AS n_pairs, coalesce(s.gap_sum, 0)::BIGINT AS gap_sum, coalesce(s.lines_crc, 0)::BIGINT AS lines_crc
FROM i LEFT JOIN s ON i.copy = s.copy LEFT JOIN r ON i.copy = r.copy
"""
