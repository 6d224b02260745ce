"""Operators over all pairs of vectors (id, v, and more), in blocks: neighbours, k-th distances, silhouettes.

Vectors are dealt into blocks, pairs of blocks meet in cells, and a cell gives only what is wanted of it: counts and links
within a reach, the k nearest, or sums by cluster.  No pair is emitted that isn't asked for.  Where a reach or k bounds what is
wanted, blocks are parts of balls (balls.py) and only balls that are near enough meet; sums over all points need all pairs.

Rows whose vector is null, empty, not finite or of another length than the others take no part (vectors.py).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievestone.operators import balls
from sievestone.operators.components import connected_components
from sievestone.operators.prefix import at_places
from sievestone.operators.vectors import SIDE, distance_sums, distances, k_nearest, matrix, on_usable, tiles, within
from sievestone.session import HOT, cut, written

#: Scouts, which all points are held against first, and bytes of their vectors, at most.
SCOUTS, SCOUT_BYTES = 8192, 16 << 20


def cells(left: DataFrame, right: DataFrame, work, schema: str, block: int = balls.BLOCK) -> DataFrame:
    """work(left part, right part) -> Arrow table, over all cells of the grid of blocks."""
    n, m = left.count(), right.count()
    down, across = (balls.blocks_for(x, left.sparkSession.sparkContext.defaultParallelism, block) for x in (n, m))
    deal = lambda k: F.pmod(F.xxhash64("id"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
    a = left.withColumn("down", deal(down)).withColumn("across", every(across))
    # New names for the right side: where both sides are one frame, pruning takes columns from it otherwise.
    b = right.select([F.col(c).alias(c) for c in right.columns]).withColumn("across", deal(across)).withColumn("down", every(down))
    return a.groupBy("down", "across").cogroup(b.groupBy("down", "across")).applyInArrow(work, schema)


def halved_cells(rows: DataFrame, work, schema: str, most: int = balls.BLOCK) -> DataFrame:
    """work(one part, another part or the same) -> Arrow table, over half of the grid of blocks: each two blocks meet once, and each meets itself."""
    parts = balls.blocks_for(rows.count(), 2 * rows.sparkSession.sparkContext.defaultParallelism, most)
    whole = F.sequence(F.lit(0), F.lit(parts - 1))
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("__met", F.explode(whole))
    dealt = dealt.withColumn("__cell", F.least("__block", "__met") * parts + F.greatest("__block", "__met")).drop("__met")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        of = t.column("__block").to_numpy()
        low, high = divmod(key[0].as_py(), parts)
        return work(*(t.take(pa.array(np.flatnonzero(of == k))) for k in (low, high)), low == high)

    return dealt.groupBy("__cell").applyInArrow(run, schema)


@on_usable
def neighbour_counts(vectors: DataFrame, eps: float) -> DataFrame:
    """(id, neighbours): how many points lie within eps of each point, itself among them; a cell gives a row a point."""

    rows = vectors.select(F.col("id").cast("bigint").alias("id"), "v")
    return _counts_within(rows, rows, eps).withColumnRenamed("n", "neighbours")


def _counts_within(points: DataFrame, rows: DataFrame, eps: float) -> DataFrame:
    """(id, n): how many of the rows lie within eps of each of the points."""

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        n, x, y = np.zeros(a.num_rows, dtype=np.int64), matrix(a), matrix(b)
        for i, j in tiles(len(x), len(y)):
            n[i] += within(x[i], y[j], eps).sum(axis=1)
        return pa.table({"id": a.column("id"), "n": pa.array(n, pa.int64())})

    return balls.cells(points, rows, work, "id bigint, n bigint", eps)[0].groupBy("id").agg(F.sum("n").alias("n"))


def _scouts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the rows with the least hashes of their ids, a bounded number of them."""
    first = rows.select(F.size("v")).first()
    many = max(1, min(SCOUTS, SCOUT_BYTES // (8 * first[0]))) if first else 1
    found = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(many).toArrow()
    return found.column("id").to_numpy(), matrix(found)


@on_usable
def core_points(vectors: DataFrame, eps: float, least: int) -> DataFrame:
    """(id) of the points with at least so many points, itself among them, within eps.

    Those that have enough among the scouts are known by that; only the others are held against all points.
    """
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), "v")
    ids, x = _scouts(rows)

    def work(batches):
        for t in batches:
            y = matrix(t)
            for i in range(0, len(y), SIDE):
                yield pa.RecordBatch.from_arrays([t.column("id").slice(i, SIDE), pa.array(within(y[i : i + SIDE], x, eps).sum(axis=1), pa.int64())], names=["id", "n"])

    seen = cut(rows.mapInArrow(work, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("rows")))
    sure, unsure = seen.filter(F.col("n") >= least).select("id"), seen.filter(F.col("n") < least).select("id")
    if (seen.agg(F.sum("rows")).first()[0] or 0) <= len(ids) or unsure.isEmpty():
        return sure
    return sure.union(_counts_within(rows.join(unsure, "id", "left_semi"), rows, eps).filter(F.col("n") >= least).select("id"))


def groups_of(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The connected groups of a two-sided graph, as numbers of its left and its right nodes; each node is gone through once."""
    left, right = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    for start in range(near.shape[0]):
        if left[start] >= 0:
            continue
        left[start], front = start, np.array([start])
        while len(front):
            reached = np.flatnonzero(near[front].any(axis=0) & (right < 0))
            right[reached] = start
            front = np.flatnonzero(near[:, reached].any(axis=1) & (left < 0)) if len(reached) else reached
            left[front] = start
    return left, right


def joined_groups(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For n nodes and links between them the least node that each is connected with; below 0: a node without a link."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[u], least[v])
        new = least.copy()
        for x in (least[u], least[v], u, v):
            np.minimum.at(new, x, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == least).all():
            break
        least = new
    out = np.full(n, -1)
    out[u], out[v] = least[u], least[v]
    return out


@on_usable
def links_within(vectors: DataFrame, eps: float) -> DataFrame:
    """(id, other): links that connect the points that lie within eps of one another, each point linked to itself too.

    Not all pairs: in a cell each point is linked to the least one that it is connected with there.
    """

    rows = vectors.select(F.col("id").cast("bigint").alias("id"), "v")
    return balls.cells(rows, rows, _linking(eps), "id bigint, other bigint", eps)[0].distinct()


def _linking(eps: float):
    """What gives the links of a cell.  Where its rows have a root, parts whose rows all have the same one aren't looked at."""

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        none = pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        if not a.num_rows or not b.num_rows:
            return none
        rooted = "root" in a.column_names
        if rooted:
            a, b = a.sort_by("root"), b.sort_by("root")
            of_a, of_b = a.column("root").to_numpy(), b.column("root").to_numpy()
        x, y = matrix(a), matrix(b)
        found = []
        for i, j in tiles(len(x), len(y)):
            if rooted and of_a[i][0] == of_a[i][-1] == of_b[j][0] == of_b[j][-1]:
                continue
            left, right = groups_of(within(x[i], y[j], eps))
            for own, first in ((left, i.start), (right, len(x) + j.start)):
                at = np.flatnonzero(own >= 0)
                found.append(np.stack((at + first, own[at] + i.start)))
        if not found:
            return none
        ids = np.concatenate((a.column("id").to_numpy(), b.column("id").to_numpy()))
        group = joined_groups(len(ids), *np.concatenate(found, axis=1))
        ids, group = ids[group >= 0], group[group >= 0]
        order = np.lexsort((ids, group))
        first = np.append(True, group[order][1:] != group[order][:-1])
        least = ids[order][np.flatnonzero(first)[np.cumsum(first) - 1]]
        found = np.unique(np.stack((ids[order], least), axis=1), axis=0)
        return pa.table({"id": pa.array(found[:, 0], pa.int64()), "other": pa.array(found[:, 1], pa.int64())})

    return work


@on_usable
def groups_within(vectors: DataFrame, eps: float) -> DataFrame:
    """(node, root): for each point the least one that links of at most eps connect it with.

    All points are linked to the scouts first.  Two points of one group needn't meet any more, so only those outside the largest group are then held against
    all points, without parts that are of one group already.
    """
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), "v")
    ids, x = _scouts(rows)

    def work(batches):
        found = [np.zeros((2, 0), dtype=np.int64)]
        for t in batches:
            y, own = matrix(t), t.column("id").to_numpy()
            for i in range(0, len(y), SIDE):
                part = own[i : i + SIDE]
                left, right = groups_of(within(y[i : i + SIDE], x, eps))
                at, least = np.flatnonzero(right >= 0), np.full(len(part), len(ids))
                np.minimum.at(least, right[at], at)
                found.append(np.stack((at, least[right[at]])))
                scout = least[left]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.where(scout < len(ids), ids[np.minimum(scout, len(ids) - 1)], part), pa.int64())], names=["id", "other"])
        group = joined_groups(len(ids), *np.concatenate(found, axis=1))
        at = np.flatnonzero(group >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(ids[group[at]], pa.int64())], names=["id", "other"])

    links = cut(rows.mapInArrow(work, "id bigint, other bigint").distinct())
    roots = cut(connected_components(links, "id", "other"))
    most = roots.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").first()
    if most is None or rows.count() <= len(ids):
        return roots
    rooted = written(rows.join(roots.select(F.col("node").alias("id"), "root"), "id"))
    rest = rooted.filter(F.col("root") != most["root"])
    if rest.isEmpty():
        return roots
    met = balls.cells(rest, rooted, _linking(eps), "id bigint, other bigint", eps)[0]
    return connected_components(roots.select(F.col("node").alias("id"), F.col("root").alias("other")).union(met).distinct(), "id", "other")


@on_usable
def least_within(points: DataFrame, numbered: DataFrame, eps: float) -> DataFrame:
    """(id, cluster): the least cluster number of `numbered` (id, v, cluster) within eps of each of the points that has one there."""

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "cluster": pa.array([], pa.int32())})
        most = np.iinfo(np.int32).max
        x, y, of, least = matrix(a), matrix(b), b.column("cluster").to_numpy(), np.full(a.num_rows, most)
        for i, j in tiles(len(x), len(y)):
            least[i] = np.minimum(least[i], np.where(within(x[i], y[j], eps), of[None, j], most).min(axis=1))
        return pa.table({"id": a.column("id").to_numpy()[least < most], "cluster": pa.array(least[least < most], pa.int32())})

    rows = points.select(F.col("id").cast("bigint").alias("id"), "v")
    return balls.cells(rows, numbered.select(F.col("id").cast("bigint").alias("id"), "v", F.col("cluster").cast("int").alias("cluster")), work, "id bigint, cluster int", eps)[0].groupBy("id").agg(F.min("cluster").alias("cluster"))


@on_usable
def nearest(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(id, rank, other, dist): the k nearest others of each row of `left` in `right`, ties to the smaller id."""

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        ids, others = a.column("id").to_numpy(), b.column("id").to_numpy()
        i, j, d = k_nearest(matrix(a), matrix(b), k, ids, others)
        return pa.table({"id": pa.array(ids[i], pa.int64()), "other": pa.array(others[j], pa.int64()), "dist": pa.array(d, pa.float64())})

    plain = lambda df: df.select(F.col("id").cast("bigint").alias("id"), "v")
    rows = plain(left)
    found = balls.cells(rows, rows if right is left else plain(right), work, "id bigint, other bigint, dist double", k=k)[0]
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "other", "dist")


@on_usable
def kth_distances(vectors: DataFrame, k: int, sample: DataFrame | None = None) -> DataFrame:
    """(id, dist): the distance of each (sampled) point to its k-th nearest other."""
    return nearest(vectors if sample is None else sample, vectors, k).filter(F.col("rank") == k).select("id", "dist")


def nearest_rank(rows: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row of nearest-rank percentiles: the value at int(q * (m - 1) + 0.5) of the m ordered values, nulls left out; null without values."""
    some = rows.filter(F.col(column).isNotNull())
    m = some.count()
    return at_places(some, column, {name: math.floor(q * (m - 1) + 0.5) + 1 for name, q in shares.items()})


@on_usable
def silhouettes(labelled: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """(id, cluster, s): the silhouette of each (sampled) point of `labelled` (id, v, cluster) by Euclidean distance.

    Noise (cluster below 0) takes no part; a cluster of one has 0; with fewer than two clusters there is no row.
    """
    rows = labelled.filter("cluster >= 0").select("id", "v", F.col("cluster").cast("bigint").alias("cluster"))
    left = rows if sample is None else rows.join(sample.select("id"), "id", "left_semi")

    def sums(a: pa.Table, b: pa.Table, both: bool) -> pa.Table:
        """Sums of the points of `a` by clusters of `b` and, if asked for, the other way round."""
        sides = []
        for t in (a, b):
            of = t.column("cluster").to_numpy()
            order = np.argsort(of, kind="stable")
            every, number = np.unique(of[order], return_inverse=True)
            sides.append((t.column("id").to_numpy()[order], matrix(t)[order] if len(of) else np.zeros((0, 0)), every, number))
        (ids, x, own, of_x), (others, y, every, of_y) = sides
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if len(ids) and len(others):
            down, across = distance_sums(x, y, of_x, of_y)
            found = [(np.repeat(i, len(e)), np.tile(e, len(i)), total.ravel()) for i, e, total in ((ids, every, down), (others, own, across))[: 1 + both]]
        i, e, total = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"id": pa.array(i, pa.int64()), "other": pa.array(e, pa.int64()), "total": pa.array(total, pa.float64())})

    schema = "id bigint, other bigint, total double"
    if sample is None:
        met = halved_cells(rows.withColumn("id", F.col("id").cast("bigint")), lambda a, b, same: sums(a, b, not same), schema)
    else:
        met = cells(left, rows, lambda a, b: sums(a, b, False), schema)
    totals = met.groupBy("id", "other").agg(F.sum("total").alias("total"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    joined = _with_cluster(totals, sizes.withColumnRenamed("cluster", "other"), "other").join(left.select("id", "cluster"), "id")
    own = F.col("other") == F.col("cluster")
    each = joined.groupBy("id", "cluster").agg(F.max(F.when(own, F.col("n"))).alias("size"), F.max(F.when(own, F.try_divide("total", F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    return each.filter("b is not null").select("id", "cluster", F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("s"))


def _with_cluster(rows: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """`rows` with what `clusters` tells of their cluster: by broadcast where there are at most HOT clusters, else by a shuffle.

    With more clusters than that the rows are spread over many keys.
    """
    clusters = cut(clusters)
    few = clusters.limit(HOT + 1).count() <= HOT
    return rows.join(F.broadcast(clusters) if few else clusters, key)


@on_usable
def centroids(labelled: DataFrame) -> DataFrame:
    """(cluster, centre, size): means by component; noise takes no part."""
    parts = labelled.filter("cluster >= 0").select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centre"), F.max("n").alias("size"))


def distance(a, b):
    """Euclidean distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


@on_usable
def scatter(labelled: DataFrame) -> DataFrame:
    """(cluster, size, sse, spread): squared and mean distance of a cluster's points to its centre."""
    joined = _with_cluster(labelled.filter("cluster >= 0"), centroids(labelled).select("cluster", "centre"), "cluster").withColumn("d", distance(F.col("v"), F.col("centre")))
    return joined.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.col("d") * F.col("d")).alias("sse"), F.avg("d").alias("spread"))


@on_usable
def davies_bouldin(labelled: DataFrame, block: int = 4096) -> DataFrame:
    """(dbi): null with fewer than two clusters or with centres that coincide.

    Clusters meet in a grid of blocks, and a cell gives one row a cluster: its worst ratio and its least gap.
    """
    c = cut(centroids(labelled).join(scatter(labelled).select("cluster", "spread"), "cluster").select(F.col("cluster").cast("bigint").alias("id"), F.col("centre").alias("v"), "spread"))

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, ratio, gap = a.column("id").to_numpy(), np.zeros(0), np.zeros(0)
        if a.num_rows and b.num_rows:
            d = distances(matrix(a), matrix(b))
            own = ids[:, None] == b.column("id").to_numpy()[None]
            sums = a.column("spread").to_numpy()[:, None] + b.column("spread").to_numpy()[None]
            gap = np.where(own, np.inf, d).min(axis=1)
            ratio = np.where(own | (d == 0), -np.inf, sums / np.where(d == 0, 1, d)).max(axis=1)
        out = np.isfinite(gap)
        return pa.table({"id": pa.array(ids[: len(gap)][out], pa.int64()), "r": pa.array(ratio[out], pa.float64()), "gap": pa.array(gap[out], pa.float64())})

    worst = cells(c, c, work, "id bigint, r double, gap double", block).groupBy("id").agg(F.max("r").alias("r"), F.min("gap").alias("gap"))
    return worst.agg(F.when(F.min("gap") > 0, F.avg("r")).alias("dbi"))
