import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.llm import codes as C


def brute(rows, parts=8, entries=16, rounds=6):
    """(id, code, error) of each row that can be coded, and the codebooks; plain Lloyd in Python's whole numbers."""
    fine = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) and abs(x) < 40_000 for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])]
    size = len(fine[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v in fine[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v in fine:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, own in groups.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for _, v in fine]
    return sorted(((i, bytes(e for _, e in f).hex(), sum(d for d, _ in f)) for (i, _), f in zip(fine, found, strict=True)), key=repr), books


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def coded(df, **options):
    out, books = C.product_codes(df, **options)
    return sorted(((r["vec_id"], r["code"].hex(), r["error"]) for r in out.collect()), key=repr), books


def vectors(seed, n, d, copies=0):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    if copies:
        x[n - copies :] = x[0]
    return [(i, [float(a) for a in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize(("n", "d", "copies"), [(5, 8, 0), (16, 16, 0), (300, 24, 120), (700, 8, 0)])
def test_matches_plain_lloyd(spark, n, d, copies):
    rows = vectors(n, n, d, copies)
    assert coded(frame(spark, rows)) == brute(rows)


def test_blocks_of_any_size_agree(spark, monkeypatch):
    rows = vectors(3, 200, 16)
    monkeypatch.setattr(C, "BLOCK", 7)
    assert coded(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*vectors(4, 40, 8), (3, None), (4, []), (5, [1.0] * 7), (6, [1.0] * 16), (7, [1.0] * 7 + [nan]), (8, [1.0] * 7 + [inf]), (9, [1.0] * 7 + [None]), (None, [0.5] * 8), (None, [0.25] * 8), (2, [0.0] * 8), (2, [0.0] * 8), (99, [1e30] * 8), (98, [-30_000.0] * 8)]
    df = frame(spark, rows).withColumn("x", F.lit("z")).withColumn("block", F.lit(1)).withColumn("code", F.lit(2))
    assert coded(df) == brute(rows)
    assert coded(frame(spark, [])) == ([], [])
    assert coded(frame(spark, [(1, None)])) == ([], [])
    with_label, _ = C.product_codes(df, keep=("x", "block"))
    assert with_label.columns == ["vec_id", "x", "block", "code", "error"] and {r["x"] for r in with_label.collect()} == {"z"}


def test_deltas_keep_the_running_sums():
    """Contributions of changed parts alone lead from one round's sums to the next one's."""
    rng = np.random.default_rng(5)
    x = rng.integers(-9000, 9000, size=(400, 2, 3))
    books = rng.integers(-9000, 9000, size=(2, 5, 3))
    before, first = C.block_round(x, books, None)
    moved = books + rng.integers(-900, 900, size=books.shape)
    after, delta = C.block_round(x, moved, before)
    _, whole = C.block_round(x, moved, None)
    sums = {}
    for d in first + delta:
        n, s = sums.get((d["part"], d["entry"]), (0, np.zeros(3, dtype=np.int64)))
        sums[d["part"], d["entry"]] = n + d["n"], s + d["sums"]
    assert {k: (n, s.tolist()) for k, (n, s) in sums.items() if n} == {(d["part"], d["entry"]): (d["n"], d["sums"]) for d in whole}
    assert 0 < (before != after).sum() < before.size
    assert C.block_round(x, moved, after)[1] == []


def test_large_numbers_are_exact():
    x = np.array([[2**28, 1], [2**28 - 1, 0], [-(2**28), 5]])
    entry, error = C.assign(x, np.array([[2**28, 0], [-(2**28), 0]]))
    assert entry.tolist() == [0, 0, 1] and error.tolist() == [1, 1, 25]


def test_rounds_join_without_a_shuffle(spark):
    rows = frame(spark, vectors(6, 50, 8)).select(F.col("vec_id").alias("block"), F.lit(b"").alias("x"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    a, name_a = C._bucketed(rows, 4)
    b, name_b = C._bucketed(rows.withColumnRenamed("x", "codes"), 4)
    try:
        plan = a.join(b, "block")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SelectedBucketsCount" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        C._free(spark, name_a)
        C._free(spark, name_b)


def test_query_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        got = C.op12_delta_lloyd(spark, f"/root/testdata/{sf}")
        with duckdb.connect() as c:
            c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
            assert sorted(map(tuple, got.collect())) == sorted(c.execute(C.OP12_SQL).fetchall())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sievestone_")]
