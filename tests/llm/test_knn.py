import numpy as np
from pyspark.sql import functions as F

from sievestone.llm import knn as K


def brute(rows, k, queries):
    out = []
    for q, v in rows:
        if q in queries:
            scored = []
            for c, w in rows:
                if c != q and len(w) == len(v):
                    s = 0.0
                    for a, b in zip(v, w, strict=True):
                        s += a * b
                    scored.append((-s, c))
            out += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:400] = x[100]
    x[500:520] *= 100
    x[520:540] *= 1e-4
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = sorted(map(tuple, K.nearest(frame(spark, rows).withColumn("v", F.lit("x"))).collect()))
    assert got == brute([(i, [float(a) for a in v]) for i, v in enumerate(x)], 20, {i for i in range(700) if i % 20 == 0})


def test_cells_of_any_size_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.integers(-3, 4, size=(300, 5)).astype(np.float32))]
    whole = sorted(map(tuple, K.nearest(frame(spark, rows)).collect()))
    monkeypatch.setattr(K, "BLOCK", 7)
    monkeypatch.setattr(K, "TILE_Q", 3)
    monkeypatch.setattr(K, "TILE_C", 23)
    assert sorted(map(tuple, K.nearest(frame(spark, rows)).collect())) == whole


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (20, [0.0, 1.0], 0), (1, [2.0, 0.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [1.0, nan], 0), (5, [1.0, inf], 0), (6, [1.0, None], 0), (None, [9.0, 9.0], 0), (7, [], 0), (40, [1.0, 2.0, 3.0], 0), (8, [2.0, 0.0], 0)]
    got = sorted(map(tuple, K.nearest(frame(spark, rows)).collect()))
    assert got == [(0, 1, 1, 2.0), (0, 2, 8, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 8, 0.0)]
    assert K.nearest(frame(spark, [])).count() == 0


def test_vectors_of_any_size_take_part(spark):
    """Vectors too small for squares, and so large that bounds overflow, are found as by brute force."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 4))
    x[5:60] *= 1e-200
    x[60:70] *= 5e-320
    x[70:80] *= 1e160
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x) if np.abs(v).max() > 0]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (20, 119):
        got = sorted(map(tuple, K.nearest(df, k).collect()))
        assert got == brute(rows, k, {i for i in range(0, 120, 20)})


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 64)) * rng.lognormal(size=(50, 1)), rng.normal(size=(60, 64))
    a, sa, na, ma = K.code(x)
    b, sb, nb, mb = K.code(y)
    about = (a.astype(float) @ b.T) * sa[:, None] * sb[None]
    assert (np.abs(about - x @ y.T) <= na[:, None] * mb[None] + ma[:, None] * (nb + mb)[None] + 1e-9).all()
