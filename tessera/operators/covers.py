"""Covers of polygons by cells of several levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of cells: the first is FIRST degrees wide, each next half as wide; a cover starts where its shape spans few cells, goes at most DEPTH levels down from
#: there, and stops earlier where a cell has FEW edges or fewer beside it.
LEVELS, FIRST, DEPTH, FEW = 24, 64.0, 5, 4
CELL = "level int, cx long, cy long, inner boolean, edges array<struct<ax: double, ay: double, bx: double, by: double>>"
_EDGE = pa.list_(pa.struct([(k, pa.float64()) for k in ("ax", "ay", "bx", "by")]))


def size_of(level: int) -> float:
    return FIRST / (1 << level)


def edges_of(rings) -> np.ndarray:
    """Columns ax, ay, bx, by of the edges of rings of points (x, y), closed or not. An edge runs from a point to the one before it, as rays are cast elsewhere here."""
    out = []
    for ring in rings or []:
        xy = np.array([(p["x"], p["y"]) for p in ring or [] if p and p["x"] is not None and p["y"] is not None], float)
        if len(xy):
            out.append(np.concatenate([xy, np.roll(xy, 1, axis=0)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 4))


def touching(edges: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Which edges have a point in common with a closed rectangle; a few that only come near may be among them."""
    ax, ay, bx, by = edges.T
    box = (np.minimum(ax, bx) <= x1) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y1) & (np.maximum(ay, by) >= y0)
    dx, dy, cx, cy = bx - ax, by - ay, (x0 + x1) / 2, (y0 + y1) / 2
    off = np.abs(dx * (cy - ay) - dy * (cx - ax))
    return box & (off <= (np.abs(dy) * (x1 - x0) + np.abs(dx) * (y1 - y0)) / 2 * (1 + 1e-9) + 1e-12)


def inside(edges: np.ndarray, x: float, y: float) -> bool:
    ax, ay, bx, by = edges.T
    flat = (ay > y) != (by > y)
    ax, ay, bx, by = ax[flat], ay[flat], bx[flat], by[flat]
    return bool((x < (bx - ax) * (y - ay) / (by - ay) + ax).sum() % 2)


def cells_of(edges: np.ndarray) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    """(level, cx, cy, inner, edges) of the cells that hold the inside of a polygon: apart from each other; inner ones are free of edges. A cell on the border has
    the edges that a ray to the right from any of its points can meet."""
    if not len(edges):
        return
    x0, x1 = edges[:, [0, 2]].min(), edges[:, [0, 2]].max()
    y0, y1 = edges[:, [1, 3]].min(), edges[:, [1, 3]].max()
    level = 0
    while level < LEVELS - DEPTH - 1 and max(x1 - x0, y1 - y0) < 2 * size_of(level):
        level += 1
    size, last = size_of(level), min(level + DEPTH, LEVELS - 1)
    stack = [(level, cx, cy) for cx in range(int(np.floor(x0 / size)), int(np.floor(x1 / size)) + 1) for cy in range(int(np.floor(y0 / size)), int(np.floor(y1 / size)) + 1)]
    while stack:
        level, cx, cy = stack.pop()
        size = size_of(level)
        box = (cx * size, cy * size, (cx + 1) * size, (cy + 1) * size)
        if not touching(edges, *box).any():
            if inside(edges, (box[0] + box[2]) / 2, (box[1] + box[3]) / 2):
                yield level, cx, cy, True, edges[:0]
            continue
        beside = (np.minimum(edges[:, 1], edges[:, 3]) <= box[3]) & (np.maximum(edges[:, 1], edges[:, 3]) >= box[1]) & (np.maximum(edges[:, 0], edges[:, 2]) >= box[0])
        if level == last or beside.sum() <= FEW:
            yield level, cx, cy, False, edges[beside]
        else:
            stack += [(level + 1, 2 * cx + i, 2 * cy + j) for i in (0, 1) for j in (0, 1)]


def cover(shapes: DataFrame) -> DataFrame:
    """shapes with a column rings (array of arrays of points x, y; what lies in an even number of them is out, so holes are rings too) or ring (one): a row for each cell of
    each shape's cover, CELL beside its other columns. A shape without points has no cell. Shapes are covered one by one in the tasks; a vertex costs about its cells."""
    one = "rings" not in shapes.columns
    rows = shapes.withColumn("__rings", F.array("ring") if one else F.col("rings")).drop("ring", "rings")
    names = [c for c in rows.columns if c != "__rings"]
    rows = rows.select(*names, "__rings")
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1]) + CELL

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(cells_of(edges_of(batch.column(len(names))[i].as_py())))
                for at in range(0, len(found), 500):
                    level, cx, cy, inner, edges = zip(*found[at : at + 500], strict=True)
                    lists = pa.array([[dict(zip(("ax", "ay", "bx", "by"), e, strict=True)) for e in es.tolist()] for es in edges], _EDGE)
                    own = [batch.column(k).take(pa.array([i] * len(level))) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(level, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(inner), lists], [*names, "level", "cx", "cy", "inner", "edges"])

    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, ddl)
