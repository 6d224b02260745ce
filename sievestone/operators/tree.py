"""An entropy decision tree with exact splits, grown level by level over counts of distinct values.

A feature with at most FEW distinct values (ALL_FEW of all features together) is counted by codes: rows are written once as blocks of codes, and a
level is one pass over them, whose tasks give the counts of (node, feature, code).  The counts of one node and feature, FEW codes at most, meet
in one task, which finds the best split.  Trees of several settings are grown side by side, and nodes that hold the same rows are counted once.

A feature with more distinct values is counted by values.  A level is one aggregate then, by (node, feature, value) with map-side combining, of the rows
that lie in open nodes.  Its ordered counts are dealt into ranges; every range tells its sums and its first key, one row a range on the driver, so running sums and the next
value are known within a range alone, and no task sees all values of a feature however many there are.  As each
feature of a node counts the node's rows once, what lies left of a value within its feature is the running sum less a multiple of the
node's own size.  The driver gets one row a range and one a node.

Every boundary between two distinct values is tried, with no quantile bins.  The gain is compared in ten digits; ties go to the
feature that comes first, then to the smaller value.  A row goes left if its value is at most the threshold, halfway between the two
values; nulls and NaN count as larger than all numbers.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievestone.session import cut, written

DIGITS = 10
#: Distinct values of a feature, and of all features together, that are counted by codes.
FEW, ALL_FEW = 1 << 16, 1 << 20
#: Rows that are counted at once, cells that are counted in one array, and cells that a task holds before it gives them.
CHUNK, DENSE, HELD = 1 << 17, 1 << 19, 1 << 21
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def constants(values: list, kind: str) -> Column:
    """A list as one array literal; None isn't taken."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def entropy(p: Column, n: Column) -> Column:
    """Bits of the share p / n."""
    part = lambda x: F.when(x > 0, -(x / n) * F.log2(x / n)).otherwise(F.lit(0.0))
    return part(p) + part(n - p)


def leaf_of(x: Column, nodes: list[list], depth: int) -> Column:
    """The number of the node that an array of values ends in; nodes: (feature or None, threshold, left, right, ...)."""
    feature, left, right = (constants([-1 if n[i] is None else n[i] for n in nodes], "int") for i in (0, 2, 3))
    threshold = constants([float(n[1] or 0.0) for n in nodes], "double")
    step = lambda at, _: F.when(F.get(feature, at) < 0, at).when(F.get(x, F.get(feature, at)) <= F.get(threshold, at), F.get(left, at)).otherwise(F.get(right, at))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), step)


def _best_splits(rows: DataFrame, nodes: list[list], at: list[int], depth: int, some: list[int], leaf: int) -> list:
    """For each open node that a split by one of some features gains something in: node, and the best one's loss, feature's place in `some`, value, next, and rows and positives to the left."""
    features = len(some)
    spark = rows.sparkSession
    open_ = F.broadcast(spark.createDataFrame([(i, k, nodes[i][4], nodes[i][6]) for k, i in enumerate(at)], "node int, k int, n_all bigint, p_all bigint"))
    placed = rows.withColumn("node", leaf_of(F.col("x"), nodes, depth)).join(open_.select("node", "k"), "node")
    each = placed.select("k", "label", F.posexplode(F.array(*[F.get("x", F.lit(i)) for i in some])).alias("f", "v")).withColumn("v", F.coalesce("v", F.lit(float("nan"))))
    key = F.struct("k", "f", "v")
    counts = each.groupBy("k", "f", "v").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    part = cut(counts.repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    told = part.groupBy("part").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.min(key).alias("first")).orderBy("part").collect()
    ranges, n, p = {}, 0, 0
    for i, r in enumerate(told):
        after = told[i + 1]["first"] if i + 1 < len(told) else None
        ranges[r["part"]] = (r["part"], n, p, *(after or (None, None, None)))
        n, p = n + r["n"], p + r["p"]
    bases, n, p = [], 0, 0
    for k, i in enumerate(at):  # what all features of the nodes before count
        bases.append((k, i, nodes[i][4], nodes[i][6], n, p))
        n, p = n + features * nodes[i][4], p + features * nodes[i][6]
    before = F.broadcast(spark.createDataFrame(list(ranges.values()), "part int, n0 bigint, p0 bigint, k1 int, f1 int, v1 double"))
    base = F.broadcast(spark.createDataFrame(bases, "k int, node int, n_all bigint, p_all bigint, n_base bigint, p_base bigint"))
    window = Window.partitionBy("part").orderBy("k", "f", "v")
    upto = part.select("*", F.sum("n").over(window).alias("ns"), F.sum("p").over(window).alias("ps"), F.lead(F.struct("k", "f", "v")).over(window).alias("later"))
    whole = upto.join(before, "part").join(base, "k").withColumn("later", F.coalesce("later", F.when(F.col("k1").isNotNull(), F.struct(F.col("k1").alias("k"), F.col("f1").alias("f"), F.col("v1").alias("v")))))
    left = whole.filter((F.col("later.k") == F.col("k")) & (F.col("later.f") == F.col("f"))).select(
        "k", "node", "f", "v", F.col("later.v").alias("after"), "n_all", "p_all",
        (F.col("ns") + F.col("n0") - F.col("n_base") - F.col("f") * F.col("n_all")).alias("nl"), (F.col("ps") + F.col("p0") - F.col("p_base") - F.col("f") * F.col("p_all")).alias("pl"),
    )
    nl, pl, n_all, p_all = (F.col(c) for c in ("nl", "pl", "n_all", "p_all"))
    gain = entropy(p_all, n_all) - nl / n_all * entropy(pl, nl) - (n_all - nl) / n_all * entropy(p_all - pl, n_all - nl)
    fine = left.filter((nl >= leaf) & (n_all - nl >= leaf)).withColumn("gain", F.round(gain, DIGITS)).filter("gain > 0")
    return fine.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "f", "v", "after", "nl", "pl")).alias("best")).orderBy("node").collect()


def _doubles(column: pa.Array) -> np.ndarray:
    """Numbers of any kind as doubles; nulls as NaN, and no zero below 0."""
    return column.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0


def _few_values(rows: DataFrame, features: int) -> list[np.ndarray | None]:
    """For each feature its distinct values in order, NaN and nulls as one, the last; None for a feature with too many of them."""
    most = min(FEW, ALL_FEW // features)

    def work(batches):
        seen: list = [np.zeros(0)] * features
        for t in batches:
            for f in range(features):
                if seen[f] is not None and t.num_rows:
                    seen[f] = np.unique(np.concatenate((seen[f], _doubles(pc.unique(t.column(f + 1))))))
                    seen[f] = seen[f] if len(seen[f]) <= most else None
        for f, v in enumerate(seen):
            own = np.zeros(1) if v is None else v
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), f, dtype=np.int32)), pa.array(own, pa.float64()), pa.array(np.full(len(own), v is None))], names=["f", "v", "many"])

    found = cut(rows.mapInArrow(work, "f int, v double, many boolean").distinct())
    fine = [r["f"] for r in found.groupBy("f").agg(F.count("*").alias("n"), F.max("many").alias("many")).collect() if not r["many"] and r["n"] <= most]
    values = found.filter(F.col("f").isin(fine)).select("f", "v").toArrow()
    of, v = values.column("f").to_numpy(), values.column("v").to_numpy()
    return [np.unique(v[of == f]) if f in set(fine) else None for f in range(features)]


def _coded(rows: DataFrame, values: list) -> DataFrame:
    """(n, y, x): blocks of the rows' labels and, feature by feature, their codes, which are numbers of values; of features without codes the values."""
    kind = np.uint16 if all(v is not None for v in values) else np.float64

    def work(batches):
        for t in batches:
            y = t.column(0).to_numpy().astype(np.uint8)
            columns = [_doubles(t.column(f + 1)) for f in range(len(values))]
            x = np.stack([(c if v is None else np.searchsorted(v, c)).astype(kind) for c, v in zip(columns, values, strict=True)])
            for i in range(0, len(y), CHUNK // 16):
                part = y[i : i + CHUNK // 16]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(x[:, i : i + CHUNK // 16]).tobytes()], pa.binary())], names=["n", "y", "x"])

    return rows.mapInArrow(work, "n int, y binary, x binary")


def _in_nodes(x: np.ndarray, feature: np.ndarray, bound: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """The node that each column of `x` ends in."""
    at, rows = np.zeros(x.shape[1], dtype=np.int64), np.arange(x.shape[1])
    for _ in range(depth):
        f = feature[at]
        at = np.where(f < 0, at, np.where(x[np.maximum(f, 0), rows] <= bound[at], left[at], right[at]))
    return at


def _merged(keys: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys in order, each once, with the sums of n and p."""
    if not len(keys):
        return keys, n, p
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(n[order], starts), np.add.reduceat(p[order], starts)


def _bits(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    part = lambda x: np.where(x > 0, -(x / n) * np.log2(np.where(x > 0, x, n) / n), 0.0)
    return part(p) + part(n - p)


def _best_of(keys: np.ndarray, n: np.ndarray, p: np.ndarray, n_all: np.ndarray, p_all: np.ndarray, features: int, leaf: int) -> tuple:
    """(k, gain, feature, code, next code, rows and positives to the left) of the best split of each k, from its counts by ordered keys."""
    group, nl, pl = keys >> 16, np.cumsum(n), np.cumsum(p)
    begins = np.append(True, group[1:] != group[:-1])
    which, starts = np.cumsum(begins) - 1, np.flatnonzero(begins)
    nl, pl = nl - (nl[starts] - n[starts])[which], pl - (pl[starts] - p[starts])[which]
    k = group // features
    at = np.flatnonzero(np.append(group[1:] == group[:-1], False) & (nl >= leaf) & (n_all[k] - nl >= leaf))
    k, a, b, ln, lp = k[at], n_all[k[at]], p_all[k[at]], nl[at], pl[at]
    gain = np.round(_bits(b, a) - ln / a * _bits(lp, ln) - (a - ln) / a * _bits(b - lp, a - ln), DIGITS)
    order = np.lexsort((keys[at], -gain, k))
    order = order[gain[order] > 0]
    first = order[np.flatnonzero(np.append(True, k[order][1:] != k[order][:-1]))] if len(order) else order
    at, gain = at[first], gain[first]
    return k[first], gain, group[at] % features, keys[at] & 0xFFFF, keys[np.minimum(at + 1, len(keys) - 1)] & 0xFFFF, nl[at], pl[at]


def _best_by_codes(coded: DataFrame, values: list, views: list[tuple], n_all: np.ndarray, p_all: np.ndarray, leaves: list[int]) -> dict:
    """For (k, leaf) of the open nodes that a split by a coded feature gains something in: gain, feature, code, next code, and rows and positives to the left.

    A view tells a tree's nodes, and which of them is which k (below 0: none).
    """
    spark, few = coded.sparkSession, [f for f, v in enumerate(values) if v is not None]
    m, kind = len(few), np.uint16 if len(few) == len(values) else np.float64
    # No task merges more than some cells of each row, however many rows there are.
    buckets = max(4 * spark.sparkContext.defaultParallelism, math.ceil(int(n_all.sum()) / CHUNK / 4))
    sizes = [len(n_all) * len(values[f]) * 2 for f in few]
    dense = [s <= DENSE for s in sizes]

    def given(parts: list):
        keys, n, p = _merged(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        own = (keys >> 16) % buckets
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1])) if len(own) else own
        for part in np.split(order, at[1:]) if len(own) else []:
            yield pa.RecordBatch.from_arrays([pa.array([own[part[0]]], pa.int64()), *[pa.array([c[part].astype(np.int64).tobytes()], pa.binary()) for c in (keys, n, p)]], names=["bucket", "keys", "n", "p"])

    def work(batches):
        total = [np.zeros(s if d else 0, dtype=np.int64) for s, d in zip(sizes, dense, strict=True)]
        held, waiting, many = [], [], 0

        def counted(blocks: list):
            y, x = np.concatenate([b[0] for b in blocks]).astype(np.int64), np.concatenate([b[1] for b in blocks], axis=1)
            for *tree, of, depth in views:
                k = of[_in_nodes(x, *tree, depth)]
                own = np.flatnonzero(k >= 0)
                k, label = k[own], y[own]
                for i, f in enumerate(few):
                    code = x[f][own].astype(np.int64)
                    if dense[i]:
                        total[i] += np.bincount((k * len(values[f]) + code) * 2 + label, minlength=sizes[i])
                    elif len(own):
                        key = np.sort((((k * m + i) << 16) + code) * 2 + label)
                        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                        n = np.diff(np.append(starts, len(key)))
                        held.append((key[starts] >> 1, n, n * (key[starts] & 1)))

        for t in batches:
            for size, y, x in zip(t.column("n").to_pylist(), t.column("y"), t.column("x"), strict=True):
                waiting.append((np.frombuffer(y.as_buffer(), dtype=np.uint8), np.frombuffer(x.as_buffer(), dtype=kind).reshape(-1, size)))
                many += size
                if many >= CHUNK:
                    counted(waiting)
                    waiting, many = [], 0
                    if sum(len(h[0]) for h in held) > HELD:
                        held = [_merged(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                        if len(held[0][0]) > HELD // 2:
                            yield from given(held)
                            held = []
        if waiting:
            counted(waiting)
        for i, f in enumerate(few):
            if dense[i]:
                by = total[i].reshape(len(n_all), len(values[f]), 2)
                k, code = np.nonzero(by.any(axis=2))
                held.append((((k * m + i) << 16) + code, by[k, code].sum(axis=1), by[k, code, 1]))
        yield from given(held)

    def best(t: pa.Table) -> pa.Table:
        keys, n, p = (np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in t.column(c)]) for c in ("keys", "n", "p"))
        cells, out = _merged(keys, n, p), []
        for leaf in leaves:
            k, gain, f, code, after, nl, pl = _best_of(*cells, n_all, p_all, m, leaf)
            out.append(pa.table({"k": pa.array(k, pa.int64()), "leaf": pa.array(np.full(len(k), leaf), pa.int64()), "loss": pa.array(-gain), **{c: pa.array(x, pa.int64()) for c, x in (("f", f), ("code", code), ("after", after), ("nl", nl), ("pl", pl))}}))
        return pa.concat_tables(out)

    parts = coded.coalesce(most) if coded.rdd.getNumPartitions() > (most := 4 * spark.sparkContext.defaultParallelism) else coded
    held = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "16")  # a row is a block
    try:
        found = parts.mapInArrow(work, "bucket bigint, keys binary, n binary, p binary").groupBy("bucket").applyInArrow(best, "k bigint, leaf bigint, loss double, f bigint, code bigint, after bigint, nl bigint, pl bigint")
        rows = found.groupBy("k", "leaf").agg(F.min(F.struct("loss", "f", "code", "after", "nl", "pl")).alias("best")).collect()
    finally:
        spark.conf.set(_BATCH, held)
    return {(r["k"], r["leaf"]): (-r["best"]["loss"], few[r["best"]["f"]], *r["best"][2:]) for r in rows}


def halfway(low: float, high: float) -> float:
    """Between two values, and below the higher; the lower one where there is nothing between."""
    mid = low + (high - low) / 2
    return mid if low <= mid < high else low


def grow(rows: DataFrame, columns: list[str], depth: int, leaf: int) -> list[list] | None:
    """The nodes of `grow_many` for one setting."""
    return grow_many(rows, columns, [(depth, leaf)])[0]


def grow_many(rows: DataFrame, columns: list[str], settings: list[tuple[int, int]]) -> list[list[list] | None]:
    """For each (depth, leaf) the nodes (feature, threshold, left, right, rows, share of label 1) of a tree over rows with a label of 0 or 1; null without both labels.

    Rows without a label don't count.  A node stays whole at the given depth, where a side would have fewer than
    `leaf` rows, and where no split gains anything.
    """
    # Numbers that Arrow has become doubles in Python.
    double = lambda c: F.col(f"`{c}`") if dict(rows.dtypes).get(c) in ("int", "bigint", "double") else F.col(f"`{c}`").cast("double")
    own = rows.filter("label is not null").select(F.col("label").cast("bigint").alias("label"), *[double(c).alias(f"c{i}") for i, c in enumerate(columns)])
    n, p = own.agg(F.count("*"), F.sum("label")).first()
    if not p or p == n:
        return [None] * len(settings)
    values = _few_values(own, len(columns))
    many = [f for f, v in enumerate(values) if v is None]
    coded = written(_coded(own, values)) if len(many) < len(columns) else None
    by_value = written(own.select("label", F.array(*[F.col(f"c{i}").cast("double") for i in range(len(columns))]).alias("x"))) if many else None
    # A node's rows are a set, which nodes of several trees may share: its rows and positives, and what splits make of it.
    sets, halves = [(n, p)], {}
    trees = [{"depth": d, "leaf": leaf, "nodes": [[None, None, None, None, n, p / n, p]], "sets": [0], "bounds": [0.0], "level": [0]} for d, leaf in settings]
    for d in range(max(depth for depth, _ in settings)):
        for t in trees:
            t["level"] = [i for i in t["level"] if d < t["depth"] and t["nodes"][i][4] >= 2 * t["leaf"] and 0 < t["nodes"][i][6] < t["nodes"][i][4]]
        going = sorted((t for t in trees if t["level"]), key=lambda t: -t["depth"])
        if not going:
            break
        number, views = {}, []
        for t in going:
            new = {i: t["sets"][i] for i in t["level"] if t["sets"][i] not in number}
            for s in new.values():
                number.setdefault(s, len(number))
            if new:
                column = lambda k, none, kind: np.array([none if x[k] is None else x[k] for x in t["nodes"]], dtype=kind)  # noqa: B023, E731
                of = np.full(len(t["nodes"]), -1)
                of[list(new)] = [number[s] for s in new.values()]
                views.append((column(0, -1, np.int64), np.array(t["bounds"]), column(2, 0, np.int64), column(3, 0, np.int64), of, d))
        counts = np.array([sets[s] for s in number], dtype=np.int64)
        found = _best_by_codes(coded, values, views, counts[:, 0], counts[:, 1], sorted({t["leaf"] for t in going})) if coded is not None else {}
        for t in going:
            others = {r["node"]: r["best"] for r in _best_splits(by_value, t["nodes"], t["level"], d, many, t["leaf"])} if many else {}
            level = []
            for i in t["level"]:
                node, s, choices = t["nodes"][i], t["sets"][i], []
                if (number[s], t["leaf"]) in found:
                    gain, f, code, after, nl, pl = found[number[s], t["leaf"]]
                    choices.append((-gain, f, values[f][code], values[f][after], nl, pl, code))
                if i in others:
                    loss, f, v, after, nl, pl = others[i]
                    choices.append((loss, many[f], v, after, nl, pl, v))
                if not choices:
                    continue
                _, f, v, after, nl, pl, t["bounds"][i] = min(choices, key=lambda c: c[:2])
                node[:4] = [f, float(halfway(v, after) if after == after else v), len(t["nodes"]), len(t["nodes"]) + 1]
                for side, (n_, p_) in enumerate(((nl, pl), (node[4] - nl, node[6] - pl))):
                    half = halves.setdefault((s, f, float(t["bounds"][i]), side), len(sets))
                    if half == len(sets):
                        sets.append((n_, p_))
                    level.append(len(t["nodes"]))
                    t["nodes"].append([None, None, None, None, n_, p_ / n_, p_])
                    t["sets"].append(half)
                    t["bounds"].append(0.0)
            t["level"] = level
    return [[x[:6] for x in t["nodes"]] for t in trees]
