"""Pairs of vectors that can lie within a reach of one another, by balls around pivots.

Every vector belongs to the nearest of at most PIVOTS pivots, drawn by a hash of the id.  By the triangle inequality a vector of a ball with
centre c and radius r and one of a ball with c' and r' are at least |c - c'| - r - r' apart, so pairs of balls with more than the
reach between them never meet.  Balls lie in blocks of bounded size, near ones together and large ones dealt over several by a hash, so neither
a cluster nor copies of one vector fill a task.  A vector is sent once for each block that it meets, not for each ball: what is
shuffled grows with the number of blocks, whatever the number of balls.  The driver holds a row for each ball and which balls meet, both of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructType

from sievestone.operators.vectors import distances, matrix
from sievestone.session import written

#: Balls at most, vectors for each of them at least, and vectors of a block at most and, where the cores need more blocks, at least.
PIVOTS, LEAST, BLOCK, FEW = 256, 512, 32768, 2048
#: How far rounding may move a distance, as a share of it.
SLACK = 1e-9


@dataclass
class Side:
    """One side's vectors with their ball and distance to its pivot, and by ball how many there are and the radius."""

    rows: DataFrame
    sizes: np.ndarray
    radius: np.ndarray


def pivots(vectors: DataFrame) -> np.ndarray:
    """The centres of the balls: vectors of the ids with the least hashes."""
    n = vectors.count()
    few = vectors.orderBy(F.xxhash64("id"), "id").select("v").limit(min(PIVOTS, max(1, math.ceil(n / LEAST)))).collect()  # PIVOTS vectors
    return np.unique(np.array([r["v"] for r in few], dtype=np.float64), axis=0) if few else np.zeros((0, 0))


def placed(vectors: DataFrame, centres: np.ndarray) -> Side:
    """The vectors with their nearest pivot, written, and what the balls are like."""
    names = vectors.columns
    schema = StructType(list(vectors.schema.fields)).add("ball", IntegerType()).add("off", DoubleType())
    kinds = to_arrow_schema(schema)

    def work(batches):
        for t in batches:
            if t.num_rows:
                d = distances(matrix(t), centres)
                ball = d.argmin(axis=1)
                columns = [t.column(i) for i in range(len(names))] + [pa.array(ball, pa.int32()), pa.array(d[np.arange(len(ball)), ball])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    rows = written(vectors.mapInArrow(work, schema))
    sizes, radius = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
    for r in rows.groupBy("ball").agg(F.count("*").alias("n"), F.max("off").alias("off")).collect():
        sizes[r["ball"]], radius[r["ball"]] = r["n"], r["off"]
    return Side(rows, sizes, radius)


def meeting(left: Side, right: Side, centres: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which balls of the left side (rows) may hold a vector within its reach of one in a ball of the right side (columns)."""
    apart = distances(centres, centres)
    least = apart * (1 - SLACK) - (left.radius[:, None] + right.radius[None]) * (1 + SLACK)
    return (least <= (reach * (1 + SLACK))[:, None]) & (left.sizes > 0)[:, None] & (right.sizes > 0)[None]


def reach_of_k(left: Side, right: Side, centres: np.ndarray, k: int) -> np.ndarray:
    """For each ball of the left side a distance within which each of its vectors has k on the right side besides itself; infinite if there are too few."""
    far = distances(centres, centres) + right.radius[None]
    out = np.full(len(centres), np.inf)
    for g in range(len(centres)):
        order = np.argsort(np.where(right.sizes > 0, far[g], np.inf), kind="stable")
        enough = np.flatnonzero(np.cumsum(right.sizes[order]) >= k + 1)
        if len(enough):
            out[g] = left.radius[g] + far[g, order[enough[0]]]
    return out


def skipped(meets: np.ndarray, left: Side, right: Side) -> float:
    """The share of pairs of vectors whose balls don't meet."""
    every = float(left.sizes.sum()) * float(right.sizes.sum())
    met = float((left.sizes[:, None] * right.sizes[None] * meets).sum())
    return 1 - met / every if every else 0.0


def in_a_row(centres: np.ndarray) -> np.ndarray:
    """The balls in an order in which each is followed by the nearest of those that are left."""
    apart, left, out = distances(centres, centres), np.ones(len(centres), dtype=bool), [0]
    left[0] = False
    while left.any():
        out.append(int(np.where(left, apart[out[-1]], np.inf).argmin()))
        left[out[-1]] = False
    return np.array(out)


def blocks_for(n: int, parallel: int, most: int) -> int:
    """Into how many blocks to deal n vectors of one side: none with more than `most`, and enough to keep all cores busy with pairs of them."""
    return max(1, math.ceil(n / most), min(math.ceil(n / FEW), math.ceil(math.sqrt(6 * parallel))))


def dealt(side: Side, order: np.ndarray, parallel: int, most: int) -> tuple[np.ndarray, int]:
    """(the place at which each ball begins when all lie in a row, how many places a block has): near balls share a block, large ones lie in several."""
    start = np.zeros(len(order), dtype=np.int64)
    start[order] = np.append(0, np.cumsum(side.sizes[order])[:-1])
    n = int(side.sizes.sum())
    return start, max(1, math.ceil(n / blocks_for(n, parallel, most)))


def cells(left: DataFrame, right: DataFrame, work: Callable, schema: str, reach: float | None = None, k: int | None = None, block: int | None = None) -> tuple[DataFrame, float]:
    """(work(left part, right part) -> Arrow table over all parts of cells whose balls meet, the share of pairs that needn't).

    Balls meet within `reach`, or where one may hold one of the k nearest of the other.  A vector is sent once for each block of the other
    side that has a ball which its own meets; within a cell, left balls that meet the same right ones come as one part, so each pair in reach
    meets in exactly one call, and a left vector in one call of each of its cells.
    """
    spark, names = left.sparkSession, (left.columns, right.columns)
    centres = pivots(right)
    if not len(centres):
        return spark.createDataFrame([], schema), 0.0
    one = placed(left, centres)
    two = one if right is left else placed(right, centres)
    meets = meeting(one, two, centres, reach_of_k(one, two, centres, k) if reach is None else np.full(len(centres), float(reach)))
    order, parallel = in_a_row(centres), spark.sparkContext.defaultParallelism
    starts, sizes = zip(*(dealt(s, order, parallel, block or BLOCK) for s in (one, two)), strict=True)

    def table(side: int, met: np.ndarray) -> DataFrame:
        """For each ball of a side where it begins, its size, and the other side's blocks that it meets; PIVOTS rows, for a broadcast."""
        own, other = (one, two)[side], (two, one)[side]
        first, size = starts[1 - side] // sizes[1 - side], sizes[1 - side]
        last = (starts[1 - side] + np.maximum(other.sizes, 1) - 1) // size
        blocks = lambda g: sorted({int(b) for h in np.flatnonzero(met[g]) for b in range(first[h], last[h] + 1)})
        rows = [(g, int(starts[side][g]), int(own.sizes[g]), blocks(g)) for g in range(len(centres)) if own.sizes[g]]
        return F.broadcast(spark.createDataFrame(rows, "ball int, first long, n long, blocks array<long>"))

    def sent(side: int, met: np.ndarray, own: str, other: str) -> DataFrame:
        rows = (one, two)[side].rows
        # New names: where both sides are one frame, pruning takes columns from it otherwise.
        rows = rows.select([F.col(c).alias(c) for c in rows.columns]).join(table(side, met), "ball")
        place = F.floor((F.col("first") + F.pmod(F.xxhash64("id"), F.col("n"))) / sizes[side])
        return rows.select(*names[side], "ball", place.alias(own), F.explode("blocks").alias(other))

    def by_parts(a: pa.Table, b: pa.Table) -> pa.Table:
        of_a, of_b = (t.column("ball").to_numpy() for t in (a, b))
        there, parts = np.unique(of_b), {}
        for g in np.unique(of_a):
            parts.setdefault(meets[g, there].tobytes(), []).append(g)
        out = []
        for mask, own in parts.items():
            met = there[np.frombuffer(mask, dtype=bool)]
            if len(met):
                out.append(work(a if len(parts) == 1 else a.filter(pa.array(np.isin(of_a, own))), b if len(met) == len(there) else b.filter(pa.array(np.isin(of_b, met)))))
        return pa.concat_tables(out) if out else work(a.slice(0, 0), b.slice(0, 0))

    a, b = sent(0, meets, "i", "j"), sent(1, meets.T, "j", "i")
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(by_parts, schema), skipped(meets, one, two)
