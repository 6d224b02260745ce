"""K-Means and DBSCAN over vectors (id, v)."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.operators.pairs import core_points, davies_bouldin, distance, groups_within, kth_distances, least_within, nearest_rank, silhouettes
from sievestone.operators.prefix import running_sums
from sievestone.operators.vectors import matrices, matrix, nearest_numbers, on_usable, packed, rough_distances
from sievestone.session import cut, join_keyed, written

#: Rows that a silhouette is sampled on while k is chosen.
SILHOUETTE_ROWS = 800


#: Fixed value: what a seed is multiplied by before the size of the sample is added.
SAMPLE_FACTOR = 7919


def sample_places(n: int, size: int, seed: int) -> list[int]:
    """Which of n ordered rows (from 0) a sample of that size and seed has; all if there are no more."""
    return list(range(n)) if size >= n else sorted(random.Random(seed * SAMPLE_FACTOR + size).sample(range(n), size))


def seeded_sample(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """The rows, in order of their ids (which tell them apart), at `sample_places`.

    Places come from running counts by ranges of ids, so no task orders all rows; the driver draws `size` places, which are
    joined by broadcast.
    """
    counted, upto = running_sums(rows.withColumn("one", F.lit(1).cast("bigint")), F.col("id"), {"place": "one"})
    n = upto["place"] or 0
    if size >= n:
        return rows
    places = rows.sparkSession.createDataFrame([(p + 1,) for p in sample_places(n, size, seed)], "place long")
    return counted.join(F.broadcast(places), "place", "left_semi").select(*rows.columns)


@on_usable
def plus_plus_many(vectors: DataFrame, ks: list[int], seed: int) -> dict[int, np.ndarray]:
    """For each k its centres, each further one drawn with weight of its squared distance to those before, from all rows in order of id.

    Rows lie in ranges of ids.  For each centre every range gives the sum of its weights, then one range gives the row; all
    ks are drawn side by side, in two small jobs a centre.
    """
    rows = cut(vectors.select("id", "v").repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()))
    rngs = {k: random.Random(seed * 100003 + k) for k in ks}

    def weights(x: np.ndarray, centres: list) -> np.ndarray:
        return np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0) if centres else np.ones(len(x))

    def totals(given: dict[int, list]) -> dict[int, list]:
        """For each k (part, sum of weights) of every range, in order."""

        def work(batches):
            for t in batches:
                if t.num_rows:
                    x, part = matrix(t), t.column("part")[0].as_py()
                    yield pa.RecordBatch.from_pydict({"k": pa.array(list(given), pa.int32()), "part": pa.array([part] * len(given), pa.int32()), "total": [float(weights(x, c).sum()) for c in given.values()]})

        out: dict[int, list] = {k: [] for k in given}
        for r in rows.mapInArrow(work, "k int, part int, total double").groupBy("k", "part").agg(F.sum("total").alias("total")).orderBy("k", "part").collect():
            out[r["k"]].append((r["part"], r["total"]))
        return out

    def rows_at(targets: dict[int, float], sums: dict[int, list], given: dict[int, list]) -> dict[int, np.ndarray]:
        """For each k the first row that the running sum of weights reaches the target at, or the last one."""
        wanted = {}
        for k, target in targets.items():
            upto = np.cumsum([t for _, t in sums[k]])
            i = min(int(np.searchsorted(upto, target)), len(upto) - 1)
            wanted[k] = sums[k][i][0], target - (upto[i - 1] if i else 0.0)

        def work(batches):
            before, last = dict.fromkeys(wanted, 0.0), {}
            done = set()
            for t in batches:
                if not t.num_rows:
                    continue
                x, part = matrix(t), t.column("part")[0].as_py()
                for k, (own, rest) in wanted.items():
                    if own == part and k not in done:
                        upto = before[k] + np.cumsum(weights(x, given[k]))
                        at = int(np.searchsorted(upto, rest))
                        before[k], last[k] = upto[-1], x[min(at, len(x) - 1)]
                        if at < len(x):
                            done.add(k)
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(list(last), pa.int32()), pa.array([v.tolist() for v in last.values()], pa.list_(pa.float64()))], names=["k", "v"])

        found = rows.filter(F.col("part").isin(sorted({p for p, _ in wanted.values()}))).mapInArrow(work, "k int, v array<double>").collect()
        return {r["k"]: np.array(r["v"]) for r in found}

    ones = totals({0: []})[0]
    n = int(sum(t for _, t in ones))
    if bad := [k for k in ks if not 1 <= k <= n]:
        raise ValueError(f"k must lie between 1 and {n}, not {bad[0]}")
    centres: dict[int, list] = {k: [] for k in ks}
    while open_ := [k for k in ks if len(centres[k]) < k]:
        given = {k: list(centres[k]) for k in open_}
        sums = totals({k: c for k, c in given.items() if c}) if any(given.values()) else {}
        targets, by, drawn = {}, {}, {}
        for k in open_:
            total = sum(t for _, t in sums.get(k, ()))
            even = not given[k] or not total > 0
            targets[k] = rngs[k].randrange(n) + 1.0 if even else rngs[k].random() * total
            by[k], drawn[k] = (ones, []) if even else (sums[k], given[k])
        for k, v in rows_at(targets, by, drawn).items():
            centres[k].append(v)
    return {k: np.array(c) for k, c in centres.items()}


def plus_plus(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """k centres of `plus_plus_many`."""
    return plus_plus_many(vectors, [k], seed)[k]


@on_usable
def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """`vectors` with cluster and dist of the nearest centre, ties to the lower number."""
    each = [F.struct(distance(F.col("v"), F.array(*[F.lit(float(x)) for x in c])).alias("dist"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]
    return vectors.withColumn("__near", F.array_min(F.array(*each))).select(*vectors.columns, F.col("__near.cluster").alias("cluster"), F.col("__near.dist").alias("dist"))


def placed(x: np.ndarray, centres: tuple | list) -> tuple[list[np.ndarray], np.ndarray]:
    """(each set's nearest centres, a matrix with a one for each row and set at the centre's place among all sets)."""
    near, first = nearest_numbers(x, *centres), 0
    ones = np.zeros((len(x), sum(map(len, centres))))
    for own, c in zip(near, centres, strict=True):
        ones[np.arange(len(x)), first + own] = 1
        first += len(c)
    return near, ones


def cluster_sums(vectors: DataFrame, *centres: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each set of centres the sums and sizes of the rows nearest to each one; the vectors may be `packed`.

    A task gives a row for each set, cluster and component; they are summed with map-side combining.
    """
    d = centres[0].shape[1]
    first = np.cumsum([0, *(len(c) for c in centres)])

    def work(batches):
        total = np.zeros((first[-1], d + 1))
        for x in matrices(batches):
            ones = placed(x, centres)[1]
            total[:, :d] += ones.T @ x
            total[:, d] += ones.sum(axis=0)
        at = np.flatnonzero(np.repeat(total[:, d] > 0, d + 1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at], pa.float64())], names=["cell", "total"])

    out = _summed(vectors.select("n", "x") if "x" in vectors.columns else vectors.select("v"), work, first[-1] * (d + 1)).reshape(-1, d + 1)
    return [(out[a:b, :d], out[a:b, d]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _summed(rows: DataFrame, work, size: int) -> np.ndarray:
    """What the tasks give for each cell, summed with map-side combining."""
    found = rows.mapInArrow(work, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(size)
    out[found.column("cell").to_numpy()] = found.column("total").to_numpy()
    return out


def _sampled(vectors: DataFrame, sample: np.ndarray, centres: list[np.ndarray]) -> list[tuple[float | None, float | None]]:
    """For each set of centres the mean silhouette of the sample's rows among all rows, and the SSE over all rows, from one pass for all sets.

    A task gives its sums of distances by row of the sample and cluster, and each cluster's size, sums and squared distances to its centre.
    """
    d, every = len(centres[0][0]), np.concatenate(centres)
    many = len(every)

    def work(batches):
        apart, own = np.zeros((len(sample), many)), np.zeros((many, d + 2))
        for x in matrices(batches):
            near, ones = placed(x, centres)
            apart += rough_distances(sample, x) @ ones
            gone = np.stack([((x - c[k]) ** 2).sum(axis=1) for k, c in zip(near, centres, strict=True)])
            own[:, :d] += ones.T @ x
            own[:, d] += ones.sum(axis=0)
            first = 0
            for c, k, g in zip(centres, near, gone, strict=True):
                own[first : first + len(c), d + 1] += np.bincount(k, g, len(c))
                first += len(c)
        total = np.concatenate((own.ravel(), apart.ravel()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["cell", "total"])

    total = _summed(vectors, work, many * (d + 2) + len(sample) * many)
    own, apart = total[: many * (d + 2)].reshape(many, d + 2), total[many * (d + 2) :].reshape(len(sample), many)
    out, first = [], 0
    for near, c in zip(nearest_numbers(sample, *centres) if len(sample) else [np.zeros(0, dtype=np.int64)] * len(centres), centres, strict=True):
        part, to = own[first : first + len(c)], apart[:, first : first + len(c)]
        first += len(c)
        size, some = part[:, d], part[:, d] > 0
        # Squared distances to a cluster's mean: those to its centre less those between the two.
        sse = part[some, d + 1] - ((part[some, :d] - size[some, None] * c[some]) ** 2).sum(axis=1) / size[some]
        out.append((_silhouette(to, near, size), float(np.maximum(sse, 0).sum()) if some.any() else None))
    return out


def _silhouette(to: np.ndarray, near: np.ndarray, size: np.ndarray) -> float | None:
    """The mean silhouette of rows with these sums of distances to clusters of these sizes, as `silhouettes` defines it; None with fewer than two clusters."""
    if (size > 0).sum() < 2 or not len(near):
        return None
    rows = np.arange(len(near))
    a = to[rows, near] / np.maximum(size[near] - 1, 1)
    mean = np.where(size > 0, to / np.maximum(size, 1), np.inf)
    mean[rows, near] = np.inf
    b = mean.min(axis=1)
    most = np.maximum(a, b)
    return float(np.where((size[near] == 1) | (most == 0), 0.0, (b - a) / np.where(most == 0, 1, most)).mean())


@on_usable
def kmeans_many(vectors: DataFrame, ks: list[int], seed: int = 42, rounds: int = 100, tolerance: float = 1e-4, start: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """For each k its centres.  The vectors are written once, and one aggregate a round moves the centres of all ks that still move.

    Empty clusters take the farthest points.  `start` gives the first centres of each k, which are drawn otherwise.
    """
    rows = written(vectors.select("id", "v"))
    blocks = written(packed(rows))
    centres = plus_plus_many(rows, ks, seed) if start is None else {k: np.array(start[k], dtype=np.float64) for k in ks}
    moving = list(ks)
    for _ in range(rounds):
        still = []
        for k, (sums, sizes) in zip(moving, cluster_sums(blocks, *(centres[k] for k in moving)), strict=True):
            new = sums / np.maximum(sizes, 1)[:, None]
            if not sizes.all():
                far = assign(rows, centres[k]).orderBy(F.desc("dist"), "id").limit(k).collect()
                for i, c in enumerate(np.flatnonzero(sizes == 0)):
                    new[c] = far[min(i, len(far) - 1)]["v"]
            moved = np.sqrt(((new - centres[k]) ** 2).sum(axis=1)).max()
            centres[k] = new
            if moved >= tolerance:
                still.append(k)
        moving = still
        if not moving:
            break
    return centres


@on_usable
def kmeans(vectors: DataFrame, k: int, seed: int = 42, rounds: int = 100, tolerance: float = 1e-4) -> tuple[DataFrame, np.ndarray]:
    """(vectors with cluster and dist, centres) of `kmeans_many`."""
    centres = kmeans_many(vectors, [k], seed, rounds, tolerance)[k]
    return assign(vectors, centres), centres


@on_usable
def choose_k(vectors: DataFrame, candidates=range(2, 9), seed: int = 42, rounds: int = 100) -> list[dict]:
    """Each candidate, best first; ties to the smaller k.

    k is chosen by a silhouette that is sampled on SILHOUETTE_ROWS rows ("sampled"); then the chosen one's
    "silhouette" and "dbi" are computed over all rows, null for the others.  "sse" is over all rows for each; "centres" and
    "labelled" (id, v, cluster, dist) are each one's own.
    """
    rows = written(vectors.select("id", "v"))
    sample = np.array([r["v"] for r in seeded_sample(rows, SILHOUETTE_ROWS, seed).collect()])
    found = kmeans_many(rows, list(candidates), seed, rounds)
    measured = _sampled(rows.select("v"), sample, list(found.values()))
    out = [
        {"k": k, "sampled": sampled, "silhouette": None, "dbi": None, "sse": sse, "centres": centres, "labelled": assign(rows, centres)}
        for (k, centres), (sampled, sse) in zip(found.items(), measured, strict=True)
    ]
    out.sort(key=lambda r: (-(r["sampled"] if r["sampled"] is not None else -2), r["k"]))
    best = out[0]["labelled"] = cut(out[0]["labelled"])
    out[0] |= {"silhouette": silhouettes(best).agg(F.avg("s")).first()[0], "dbi": davies_bouldin(best).first()["dbi"]}
    return out


@on_usable
def suggested_eps(vectors: DataFrame, min_samples: int, share: float = 0.90) -> float:
    """The nearest-rank percentile of distances to the min_samples-th neighbour, over all points."""
    found = nearest_rank(kth_distances(vectors, min_samples), "dist", {"eps": share}).first()["eps"]
    if found is None:
        raise ValueError("min_samples must be less than the number of points")
    return found


@on_usable
def dbscan(vectors: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster, core): clusters are numbered by their smallest core id; a border point joins the lowest number in reach; noise is -1.

    Points meet in blocks three times: to count neighbours, to link core points, and to find border points' clusters.  A cell
    gives a row or two a point each time, never the pairs themselves.  Only points that a bounded number of scouts leave undecided meet all others.
    """
    rows = cut(vectors.select("id", "v"))
    core = cut(rows.join(core_points(rows, eps, min_samples), "id"))
    roots = cut(groups_within(core, eps))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    numbers = running_sums(sizes, F.col("root"), {"one": "one"})[0].select("root", "n", (F.col("one") - 1).cast("int").alias("cluster"))
    member = join_keyed(roots, cut(numbers), "root", "n", roots.count()).select(F.col("node").alias("id"), "cluster")
    numbered = cut(core.join(member, "id"))
    others = cut(rows.join(core.select("id"), "id", "left_anti"))
    border = (numbered.select("id", "cluster").limit(0) if others.isEmpty() else least_within(others, numbered, eps)).withColumnRenamed("cluster", "near")
    out = rows.select("id").join(numbered.select("id", "cluster"), "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("cluster", "near", F.lit(-1)).alias("cluster"), F.col("cluster").isNotNull().cast("int").alias("core"))
