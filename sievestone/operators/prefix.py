"""Running sums over a whole table in one order, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from sievestone.session import cut, written


def running_sums(rows: DataFrame, order: Column, sums: dict[str, str]) -> tuple[DataFrame, dict]:
    """`rows` with, for each name in `sums`, the sum of its column over the rows up to each one, and the sums over all rows.

    `order` must tell rows apart (count equal ones together first).  Rows are dealt into ranges of `order`; each range
    tells its sums, of which the driver gets one row a range, and windows stay within a range.  Nulls count as
    nothing; an empty table has sums of nothing (null).
    """
    part = cut(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    own = part.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).orderBy("__part").collect()
    parts = own[-1]["__part"] + 1 if own else 1
    before, upto = {n: [0] * parts for n in sums}, dict.fromkeys(sums)
    for r in own:
        for n in sums:
            before[n][r["__part"]] = upto[n] or 0
            upto[n] = (upto[n] or 0) + (r[n] or 0)
    window = Window.partitionBy("__part").orderBy(order)
    out = part
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(window) + F.get(F.array(*map(F.lit, before[n])), F.col("__part")))
    return out.drop("__part"), upto


def _filled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which values are null, the values with something in place of nulls)."""
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    return column.is_null().to_numpy(zero_copy_only=False), column.fill_null("" if text else 0).to_numpy(zero_copy_only=False)


def _same(a: tuple, i, b: tuple, j) -> np.ndarray:
    return (a[0][i] == b[0][j]) & (a[1][i] == b[1][j])


def _sums_before(key: str, order: str, names: list[str], sums: dict[str, str], types: dict[str, pa.DataType]):
    """For rows sorted by (key, order), batch by batch, the sums over a key's earlier rows of the same task; equal orders don't see each other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, seen = None, dict.fromkeys(sums, 0), dict.fromkeys(sums, 0)
        for t in batches:
            if not t.num_rows:
                continue
            k, o = _filled(t.column(key)), _filled(t.column(order))
            at, rest, first = np.arange(t.num_rows), slice(1, None), slice(None, -1)
            goes_on = last is not None and bool(_same(k, 0, last[0], -1))
            new_key = np.append(not goes_on, ~_same(k, rest, k, first))
            new_order = new_key | np.append(not (goes_on and bool(_same(o, 0, last[1], -1))), ~_same(o, rest, o, first))
            # Where the key and the group of equal orders began; below 0: in an earlier batch.
            begun, group = (np.maximum.accumulate(np.where(x, at, -1)) for x in (new_key, new_order))
            made = {}
            for n, c in sums.items():
                upto = np.append(np.zeros(1, dtype=types[n].to_pandas_dtype()), np.cumsum(t.column(c).cast(types[n]).fill_null(0).to_numpy(zero_copy_only=False)))
                own = lambda x: np.where(begun < 0, upto[x] + held[n], upto[x] - upto[np.maximum(begun, 0)])  # noqa: B023, E731
                made[n] = np.where(group < 0, seen[n], own(np.maximum(group, 0)))
                held[n], seen[n] = own(at + 1)[-1], made[n][-1]
            last = (k, o)
            yield pa.RecordBatch.from_arrays([*[t.column(c) for c in names], *[pa.array(made[n], types[n]) for n in sums]], names=[*names, *[f"__{n}" for n in sums]])

    return work


def keyed_sums_before(rows: DataFrame, key: str, order: str, sums: dict[str, str]) -> DataFrame:
    """`rows` with, for each name in `sums`, the sum of its column over the rows of the same key that come before in `order`; 0 for a key's first.

    Rows of one (key, order) don't see each other.  Rows are dealt once, into sorted ranges of (key, order), so a key with very many rows
    lies in many ranges, and each range is gone through once, written with its own sums.  Of each
    range the driver gets one row, its first and last key with their sums; all keys between lie in that range whole.  What the first key
    had in earlier ranges is added to the sum within the range.
    """
    dealt = rows.repartitionByRange(key, order).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(key, order)
    totals = rows.agg(*[F.sum(c).alias(n) for n, c in sums.items()]).schema
    schema = StructType([*dealt.schema.fields, *[StructField(f"__{n}", totals[n].dataType) for n in sums]])
    part = written(dealt.mapInArrow(_sums_before(key, order, dealt.columns, sums, {n: to_arrow_type(totals[n].dataType) for n in sums}), schema))
    each = part.groupBy("__part", key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    ends = each.groupBy("__part").agg(F.min(F.struct(key, *sums)).alias("a"), F.max(F.struct(key, *sums)).alias("z")).orderBy("__part").collect()
    carried, last, held = [], None, None
    for r in ends:
        first = r["a"][key]
        begun = held if last is not None and first == last[0] else dict.fromkeys(sums, 0)
        carried.append((r["__part"], first, *begun.values()))
        last = (r["z"][key],)
        held = {n: (r["z"][n] or 0) + (begun[n] if first == r["z"][key] else 0) for n in sums}
    kinds = dict(each.dtypes)
    held_rows = rows.sparkSession.createDataFrame(carried, f"__part int, __first {kinds[key]}, " + ", ".join(f"`__held_{n}` {kinds[n]}" for n in sums))
    out = part.join(F.broadcast(held_rows), "__part")  # a row a range
    new = {n: F.col(f"__{n}") + F.when(F.col(key).eqNullSafe(F.col("__first")), F.coalesce(F.col(f"__held_{n}"), F.lit(0))).otherwise(F.lit(0)) for n in sums}
    return out.withColumns(new).select(*[c for c in rows.columns if c not in sums], *sums)


def at_places(rows: DataFrame, column: str, places: dict[str, int], count: str | None = None) -> DataFrame:
    """One row: for each name the value of `column` at that place (from 1) of the ordered rows, each counted `count` times."""
    values = rows.groupBy(F.col(column).alias("x")).agg((F.count("*") if count is None else F.sum(count)).alias("n"))
    ranked, _ = running_sums(values, F.col("x"), {"upto": "n"})
    return ranked.agg(*[F.min(F.when(F.col("upto") >= place, F.col("x"))).alias(name) for name, place in places.items()])
