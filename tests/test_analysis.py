import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievestone.operators import balls, classify, clustering, pairs, profile, reduce, temporal
from sievestone.operators.components import connected_components
from sievestone.plans.rules import Rules

RULES = Rules(genres=("Action", "Comedy", "Drama"), t1=200, t2=350)


def ratings(spark, rows):
    return spark.createDataFrame(rows, "user_id long, movie_id long, rating long, ts long")


def test_split_boundaries(spark):
    df = ratings(spark, [(1, 1, 5, 200), (1, 2, 3, 201), (2, 1, 4, 350), (2, 2, 1, 351)])
    got = {r.split: r for r in temporal.split_summary(df, RULES).collect()}
    assert [got[s].records for s in temporal.SPLITS] == [1, 2, 1] and got["validate"].positive_rate == 0.5
    empty = {r.split: r for r in temporal.split_summary(df.filter("ts > 350"), RULES).collect()}
    assert empty["train"].records == 0 and empty["train"].positive_rate is None
    assert temporal.duplicate_pairs(df.union(df)).first().duplicates == 4


def test_no_feature_sees_its_own_second(spark):
    df = ratings(spark, [(1, 10, 1, 100), (1, 10, 5, 300), (1, 11, 5, 300), (2, 10, 4, 300), (3, 11, 2, 150), (3, 10, 5, 400)])
    got = {(r.user_id, r.movie_id, r.ts): r for r in temporal.history(df, RULES).collect()}
    assert got[1, 10, 300].user_mean == 1.0 and got[1, 10, 300].user_count == 1 and got[1, 11, 300].user_count == 1
    assert got[1, 10, 100].user_mean == 1.5 == got[2, 10, 300].user_mean  # the train period's mean
    assert got[2, 10, 300].movie_count == 1 and got[3, 10, 400].movie_mean == pytest.approx(10 / 3)


def test_feature_matrix_tells_missing_attributes(spark):
    df = ratings(spark, [(1, 10, 5, 100), (3, 99, 2, 150)])
    movies = spark.createDataFrame([(10, "Action|Comedy")], "movie_id long, genres string")
    users = spark.createDataFrame([(1, "25", "20")], "user_id long, age string, occup string")
    rows = {r.user_id: r for r in temporal.feature_matrix(df, movies, users, RULES).collect()}
    assert len(temporal.feature_names(Rules())) == 45
    assert (rows[1].genre_action, rows[1].genre_drama, rows[1].occupation_20, rows[1].occupation_unknown, rows[1].age, rows[1].has_attributes) == (1, 0, 1, 0, 2, 1)
    assert (rows[3].genre_action, rows[3].occupation_unknown, rows[3].age, rows[3].has_attributes) == (0, 1, -1, 0)


def test_profile(spark):
    rows = [(1, m, 5, 10 + m) for m in range(4)] + [(1, 0, 4, 90), (2, 0, 1, 20), (99, 0, 3, 30), (4, 0, 3, 300)]
    movies = spark.createDataFrame([(m, "Drama" if m < 2 else "Action") for m in range(3)], "movie_id long, genres string")
    users = spark.createDataFrame([(1,), (2,), (4,), (5,)], "user_id long")
    df = ratings(spark, rows)
    p = profile.profile(df, movies, users, RULES, 5)
    got = {r.user_id: r for r in p.collect()}
    assert {u: got[u].status for u in got} == {1: profile.OK, 2: profile.SPARSE, 4: profile.NONE, 5: profile.NONE}
    assert got[1].avg_rating == 4.8 and got[1].genre_share_drama == 0.5 and got[1].genre_share_action == 0.25 and got[1].std_rating == pytest.approx(0.4) and got[2].std_rating == 0.0 and got[2].avg_gap_days == 0.0
    assert got[5].avg_rating is None and [r.user_id for r in profile.orphans(df, users, RULES).collect()] == [99]
    z = {r.user_id: r for r in profile.zscores(p, ["avg_rating"]).collect()}
    assert z[1].avg_rating == 0.0 and z[5].avg_rating is None


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], c) for i, v, c in rows], "id long, v array<double>, cluster int")


def test_cluster_measures(spark):
    df = vectors(spark, [(0, (0, 0), 0), (1, (2, 0), 0), (2, (10, 0), 1), (3, (100, 100), -1)])
    assert pairs.scatter(df).agg(F.sum("sse")).first()[0] == 2.0
    four = vectors(spark, [(0, (-1, 0), 0), (1, (1, 0), 0), (2, (9, 0), 1), (3, (11, 0), 1)])
    assert pairs.davies_bouldin(four).first().dbi == pytest.approx(0.2)
    assert pairs.davies_bouldin(four.filter("cluster = 0")).first().dbi is None
    assert pairs.davies_bouldin(four.withColumn("v", F.array(F.lit(1.0)))).first().dbi is None
    s = {r.id: r.s for r in pairs.silhouettes(df).collect()}
    assert s[2] == 0.0 and s[0] == pytest.approx(0.8) and 3 not in s
    assert pairs.silhouettes(df.filter("cluster <= 0")).count() == 0


def plain_nearest(x, k):
    out = []
    for i in range(len(x)):
        order = sorted((math.dist(x[i], x[j]), j) for j in range(len(x)) if j != i)
        out += [(i, r, j) for r, (_, j) in enumerate(order[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "block"), [(512, 4096), (5, 7), (2, 3)])
def test_balls_and_blocks_of_any_size_agree(spark, monkeypatch, least, block):
    """Neighbours, links and the k nearest, with ties and copies, as brute force has them."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(30, 3)), rng.normal(size=(20, 3)) + 40, np.full((12, 3), 7.0), rng.integers(0, 3, size=(10, 3)) - 90.0])
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(x)]).select("id", "v")
    monkeypatch.setattr(balls, "LEAST", least)
    monkeypatch.setattr(balls, "BLOCK", block)
    assert sorted((r.id, r.rank, r.other) for r in pairs.nearest(df, df, 4).collect()) == plain_nearest(x, 4)
    near = {i: sum(math.dist(a, b) <= 0.9 for b in x) for i, a in enumerate(x)}
    assert {r.id: r.neighbours for r in pairs.neighbour_counts(df, 0.9).collect()} == near
    roots = {r.node: r.root for r in connected_components(pairs.links_within(df, 0.9), "id", "other").collect()}
    group = list(range(len(x)))
    for _ in x:
        group = [min(group[j] for j in range(len(x)) if math.dist(x[i], x[j]) <= 0.9) for i in range(len(x))]
    assert [roots[i] for i in range(len(x))] == group


def test_far_balls_never_meet(spark, monkeypatch):
    """Twelve clusters far apart: most pairs of vectors are passed over, and nothing is lost."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(50, 4)) + 100 * c for c in range(12)])
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(x)]).select("id", "v")
    monkeypatch.setattr(balls, "LEAST", 10)
    count = lambda a, b: pa.table({"id": a.column("id"), "n": pa.array([b.num_rows] * a.num_rows, pa.int64())})
    for bound in ({"reach": 2.0}, {"k": 5}):
        met, share = balls.cells(df, df, count, "id bigint, n bigint", **bound)
        met = {r.id: r.n for r in met.groupBy("id").agg(F.sum("n").alias("n")).collect()}
        assert len(met) == 600 and share > 0.85
        assert sum(met.values()) / 600**2 == pytest.approx(1 - share)
        assert all(n >= 6 for n in met.values())
    assert sorted((r.id, r.rank, r.other) for r in pairs.nearest(df, df, 3).collect()) == plain_nearest(x, 3)


def test_a_reach_of_k_holds_k_others():
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(80, 2)), rng.normal(size=(9, 2))
    d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2))
    ball = d.argmin(1)
    side = balls.Side(None, np.bincount(ball, minlength=9), np.array([d[ball == g, g].max(initial=0.0) for g in range(9)]))
    for k in (1, 5, 79, 80):
        reach = balls.reach_of_k(side, side, centres, k)
        for i in range(len(x)):
            assert reach[ball[i]] >= (np.inf if k == 80 else np.sort(np.sqrt(((x - x[i]) ** 2).sum(1)))[k])


def test_bad_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 4), float(i % 3)], i % 2) for i in range(12)]
    bad = [(20, None, 0), (21, [], 1), (22, [1.0], 0), (23, [1.0, 2.0, 3.0], 1), (24, [nan, 1.0], 0), (25, [inf, 1.0], 1), (26, [None, 1.0], 0), (None, [1.0, 1.0], 0)]
    schema = "id long, v array<double>, cluster int"
    a, b = spark.createDataFrame(good, schema), spark.createDataFrame(good + bad, schema)
    both = lambda f: sorted(map(repr, f(a).collect())) == sorted(map(repr, f(b).collect()))
    assert both(lambda df: pairs.neighbour_counts(df, 1.1)) and both(lambda df: pairs.nearest(df, df, 3)) and both(pairs.silhouettes) and both(pairs.scatter) and both(pairs.davies_bouldin)
    assert both(lambda df: clustering.dbscan(df, 1.1, 3)) and both(lambda df: clustering.kmeans(df.select("id", "v"), 2)[0].select("id", "cluster"))
    assert np.allclose(reduce.covariance(a)[1], reduce.covariance(b)[1]) and both(lambda df: reduce.knn_agreement(df, df, 3))
    none = spark.createDataFrame(bad[:2], schema)
    assert pairs.neighbour_counts(none, 1.0).count() == 0 == pairs.silhouettes(none).count() and pairs.nearest(none, none, 2).count() == 0


def plain_dbscan(x, eps, least):
    n = len(x)
    near = [[j for j in range(n) if math.dist(x[i], x[j]) <= eps] for i in range(n)]
    label, c = [None] * n, 0
    for i in range(n):
        if label[i] is None and len(near[i]) >= least:
            todo, label[i] = list(near[i]), c
            while todo:
                j = todo.pop(0)
                if label[j] is None:
                    label[j] = c
                    if len(near[j]) >= least:
                        todo += near[j]
            c += 1
    return [-1 if v is None else v for v in label]


def test_dbscan_is_the_plain_one(spark):
    rng = random.Random(2)
    x = [(rng.random() * 6, rng.random() * 6) for _ in range(90)]
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(x)])
    got = {r.id: r.cluster for r in clustering.dbscan(df, 0.7, 4).collect()}
    assert [got[i] for i in range(90)] == plain_dbscan(x, 0.7, 4)


def test_dbscan_by_few_scouts_is_the_plain_one(spark, monkeypatch):
    """Few points are decided by the scouts; chains, clusters and noise without one are met by all."""
    rng = random.Random(5)
    x = [(rng.random() * 6, rng.random() * 6) for _ in range(90)] + [(20 + i / 2, 0.0) for i in range(12)] + [(40.0, 40.0)] * 6
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(x)])
    monkeypatch.setattr(pairs, "SCOUTS", 7)
    got = {r.id: r.cluster for r in clustering.dbscan(df, 0.7, 3).collect()}
    assert [got[i] for i in range(len(x))] == plain_dbscan(x, 0.7, 3)


def test_dbscan_holds_dense_points_against_the_scouts_only(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(rng.normal(size=(400, 3)) * 0.1)])
    monkeypatch.setattr(pairs, "SCOUTS", 50)
    monkeypatch.setattr(pairs.balls, "cells", lambda *_, **__: pytest.fail("all points meet"))
    assert {tuple(r)[1:] for r in clustering.dbscan(df, 1.5, 5).collect()} == {(0, 1)}


def test_kmeans_finds_blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 2)) * 0.1 + c for c in ((0, 0), (5, 5), (0, 5))])
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(x)]).select("id", "v")
    got = {r.id: r.cluster for r in clustering.kmeans(df, 3)[0].collect()}
    assert len({frozenset(got[i] for i in range(a, a + 30)) for a in (0, 30, 60)}) == 3 and len(set(got.values())) == 3
    with pytest.raises(ValueError):
        clustering.kmeans(df, 91)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000 - i, 999 - i) for i in range(50)] + [(5000, 5000), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 950 for i in range(950, 1001)) and got[5000] == 5000 and len(got) == 201 + 51 + 1
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def test_classification_measures(spark):
    df = scored(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 0)])
    assert classify.roc_auc(df).first()[0] == pytest.approx(5.5 / 6)
    assert classify.average_precision(df).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert classify.roc_auc(scored(spark, [(0.5, 1)])).first()[0] is None
    c = classify.confusion(df, 0.8).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.precision) == (2, 1, 0, 2, 0.666667)
    none = classify.confusion(df.filter("label = 0"), 2.0).first()
    assert none.precision == none.recall == none.f1 == 0.0
    assert classify.best_threshold(df, None).first().threshold == 0.8
    assert classify.best_threshold(df, 1.0).first().threshold == 0.9


def test_bayes_separates(spark):
    rng = random.Random(4)
    rows = [(("train", "test")[i % 2], y, rng.gauss(3 * y, 1), 1.0) for i in range(400) for y in (0, 1)]
    df = spark.createDataFrame(rows, "split string, label int, x double, flat double")
    out = classify.gaussian_scores(df, ["x", "flat"])
    assert classify.roc_auc(out.filter("split = 'test'")).first()[0] > 0.95
    assert classify.gaussian_scores(df.filter("label = 1"), ["x"]).filter("score is not null").count() == 0


def test_pca(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(80, 5)) @ np.diag([5, 2, 1, 0.1, 0])
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(x)]).select("id", "v")
    m = reduce.pca(df, 2)
    values, axes = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(m["eigenvalues"], np.clip(values[::-1], 0, None), atol=1e-8) and np.allclose(np.abs(m["components"]), np.abs(axes[:, ::-1].T[:2]), atol=1e-6)
    assert m["without_variance"] == 1 and all(a[np.abs(a).argmax()] > 0 for a in m["components"])
    flat = reduce.project(df, m)
    assert np.allclose([r.v for r in flat.orderBy("id").collect()], (x - x.mean(0)) @ m["components"].T)
    assert reduce.knn_agreement(df, df, 5).first().agreement == 1.0 and reduce.knn_agreement(df.limit(4), df.limit(4), 5).first().agreement is None


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    assert pairs.nearest_rank(df, "x", {"p": 0.9, "m": 0.5}).first().asDict() == {"p": 89.0, "m": 50.0}


def test_k_is_found_up_to_8_and_measured_over_all_rows(spark, monkeypatch):
    from sievestone.plans import analysis

    monkeypatch.setattr(clustering, "SILHOUETTE_ROWS", 30)
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(20, 2)) * 0.1 + (9 * i, 9 * (i % 3)) for i in range(6)])
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(x)]).select("id", "v")
    monkeypatch.setattr(analysis, "_vectors", lambda s, d: df)
    best = analysis.QUERIES["kmeans_choose_k"](spark, "").first()
    labelled = clustering.kmeans(df, best.k)[0]
    assert best.k == 6
    assert best.silhouette == pytest.approx(pairs.silhouettes(labelled).agg(F.avg("s")).first()[0])
    assert best.dbi == pytest.approx(pairs.davies_bouldin(labelled).first().dbi) and best.sse == pytest.approx(pairs.scatter(labelled).agg(F.sum("sse")).first()[0])


def plain_plus_plus(points, k, seed):
    rng = random.Random(seed * 100003 + k)
    centres = [points[rng.randrange(len(points))]]
    while len(centres) < k:
        d = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(points[int(np.searchsorted(np.cumsum(d), rng.random() * d.sum())) if d.sum() > 0 else rng.randrange(len(points))])
    return np.array(centres)


def test_first_centres_are_drawn_from_all_rows(spark, monkeypatch):
    monkeypatch.setattr(clustering, "SEED_ROWS", 10, raising=False)  # the cap that there was
    x = np.random.default_rng(14).normal(size=(50, 2))
    x[::17] += 1000
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(x)]).select("id", "v").repartition(5)
    assert np.array_equal(clustering.plus_plus(df, 4, 42), plain_plus_plus(x, 4, 42))
    same_place = df.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    assert np.array_equal(clustering.plus_plus(same_place, 2, 42), [[1, 2], [1, 2]])
    assert len(clustering.kmeans(df, 11, rounds=1)[1]) == 11


def test_the_tree_sees_the_whole_feature_matrix(spark, monkeypatch):
    from sievestone.plans import analysis

    seen, scores = [], classify.tree_scores
    monkeypatch.setattr(classify, "tree_scores", lambda rows, columns: seen.append(columns) or scores(rows, columns))
    out = {r.split: r.mean_score for r in analysis.QUERIES["cart_predict"](spark, "/root/testdata/sf0.001").collect()}
    assert seen == [temporal.feature_names(analysis.R)] and all(0 <= x <= 1 for x in out.values())


def test_sums_of_a_hot_key_lie_in_many_ranges(spark):
    """A key with half of all rows, nulls, and keys that begin or end at a range's bounds, against plain Python."""
    from sievestone.operators.prefix import keyed_sums_before

    rng = random.Random(3)
    rows = [(7 if rng.random() < 0.5 else rng.randrange(40), t, rng.choice([None, 1, 2, 5])) for t in range(3000)]
    df = spark.createDataFrame(rows, "k long, t long, x long").repartition(3)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = keyed_sums_before(df, "k", "t", {"before": "x"})
        got = {(r.k, r.t): r.before for r in out.collect()}
        want, upto = {}, {}
        for k, t, x in sorted(rows, key=lambda r: r[:2]):
            want[k, t] = upto.get(k, 0)
            upto[k] = upto.get(k, 0) + (x or 0)
        assert got == want
    spread = df.repartitionByRange(13, "k", "t").filter("k = 7").groupBy(F.spark_partition_id()).count().count()
    spark.conf.set("spark.sql.shuffle.partitions", held)
    assert spread >= 4
    assert keyed_sums_before(df.limit(0), "k", "t", {"before": "x"}).count() == 0


def test_a_history_deals_the_ratings_out_once_for_each_key(spark):
    """Ties in time, over bounds of Arrow batches and of ranges, against plain Python; nothing is joined back by a shuffle."""
    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.randrange(9), rng.randrange(1, 6), RULES.t1 - 40 + rng.randrange(60)) for _ in range(900)] + [(None, 1, 5, 3), (1, None, 5, 3), (1, 1, 5, None)]
    df = spark.createDataFrame(rows, "user_id long, movie_id long, rating long, ts long").repartition(3)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    out = temporal.history(df, RULES, seen=True)
    got = sorted((r.user_id, r.movie_id, r.rating, r.ts, r.user_count, round(r.user_mean, 9), r.movie_count, round(r.movie_mean, 9), r.user_seen, r.movie_seen) for r in out.collect())
    spark.conf.set(batch, held)
    mean = sum(x[2] for x in rows if x[3] is not None and x[3] <= RULES.t1) / sum(x[3] is not None and x[3] <= RULES.t1 for x in rows)
    whole = [x for x in rows if None not in x]

    def side(x, i):
        past = [y[2] for y in whole if y[i] == x[i] and y[3] < x[3]]
        return len(past), round(sum(past) / len(past) if past else mean, 9)

    seen = lambda x, i: int(any(y[i] == x[i] and y[3] <= RULES.t1 for y in whole))
    assert got == sorted((*x, *side(x, 0), *side(x, 1), seen(x, 0), seen(x, 1)) for x in whole)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "hashpartitioning" not in plan


def test_seen_flags_come_with_the_history(spark):
    df = spark.createDataFrame([(1, 1, 5, RULES.t1 - 1), (1, 2, 3, RULES.t1), (1, 2, 4, RULES.t1 + 5), (2, 2, 4, RULES.t1 + 5), (2, 3, 4, RULES.t2 + 1), (2, 9, 4, RULES.t2 + 1)], "user_id long, movie_id long, rating long, ts long")
    rows = df.select("*", temporal.split_of(F.col("ts"), RULES).alias("split"))
    want = sorted((r.user_id, r.movie_id, r.ts, r.user_seen, r.movie_seen) for r in classify.with_seen(rows).collect())
    assert sorted((r.user_id, r.movie_id, r.ts, r.user_seen, r.movie_seen) for r in temporal.history(df, RULES, seen=True).collect()) == want


def test_a_seeded_sample_is_the_one_that_its_formula_names(spark):
    rng = random.Random(6)
    ids = rng.sample(range(10_000), 700)
    df = spark.createDataFrame([(i, f"r{i}") for i in ids], "id long, name string").repartition(5)
    for size, seed in ((40, 42), (1, 7), (699, 1)):
        want = [sorted(ids)[p] for p in sorted(random.Random(seed * 7919 + size).sample(range(700), size))]
        assert sorted((r.id, r.name) for r in clustering.seeded_sample(df, size, seed).collect()) == [(i, f"r{i}") for i in want]
    assert clustering.seeded_sample(df, 700).count() == 700 == clustering.seeded_sample(df, 9000).count() and clustering.seeded_sample(df.limit(0), 3).count() == 0


def test_profiles_are_the_same_by_broadcast_and_by_counted_movies(spark, monkeypatch):
    rng = random.Random(8)
    df = ratings(spark, [(u, 1 if rng.random() < 0.5 else rng.randrange(2, 30), rng.randrange(1, 6), rng.randrange(0, 260)) for u in range(40) for _ in range(rng.randrange(1, 12))])
    movies = spark.createDataFrame([(m, "Drama" if m % 2 else "Action|Comedy") for m in range(1, 25)], "movie_id long, genres string")
    rows = lambda: sorted(tuple(round(x, 9) for x in r) for r in profile.features(df, movies, RULES).collect())
    few = rows()
    monkeypatch.setattr(profile, "FEW_MOVIES", 0)
    assert rows() == few and len(few) > 30


def test_distances_take_no_copies_of_the_whole_grid():
    import tracemalloc

    import numpy as np

    from sievestone.operators.vectors import TILE, distances

    draw = np.random.default_rng(5)
    for n, m in ((TILE[0] + 1, TILE[1] + 1), (1, 1), (0, 3), (3, 0)):
        a, b = draw.normal(size=(n, 7)), draw.normal(size=(m, 7))
        assert np.array_equal(distances(a, b), np.sqrt(sum((a[:, j, None] - b[None, :, j]) ** 2 for j in range(7))))
    a = draw.normal(size=(1500, 4))
    tracemalloc.start()
    d = distances(a, a)
    assert tracemalloc.get_traced_memory()[1] < 1.2 * d.nbytes and not d.diagonal().any()
    tracemalloc.stop()


def test_distances_by_a_matrix_product_are_those_by_components():
    import numpy as np

    from sievestone.operators.vectors import distances, rough_distances, within

    draw = np.random.default_rng(6)
    for shift in (0.0, 1e6):
        a, b = draw.normal(size=(300, 16)) + shift, draw.normal(size=(700, 16)) + shift
        b[:40], b[40:80] = a[:40], np.nextafter(a[:40], 9e9)
        d = distances(a, b)
        assert np.allclose(rough_distances(a, b), d, rtol=1e-9, atol=0) and not rough_distances(a, b)[range(40), range(40)].any()
        for eps in (float(d[3, 300]), float(d[250, 1]), float(d[0, 40]), 0.0, -1.0, 4.0):
            assert np.array_equal(within(a, b, eps), d <= eps)
    big = np.full((2, 3), 1e200)
    assert np.array_equal(within(big, -big, 1.0), distances(big, -big) <= 1.0)


def test_a_vector_is_sent_by_blocks_not_by_balls(spark, monkeypatch):
    """Where all balls meet, a vector was sent once for each of them, which filled disks."""
    rng = np.random.default_rng(5)
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(rng.normal(size=(200, 8)))]).select("id", "v")
    monkeypatch.setattr(balls, "LEAST", 5)
    count = lambda a, b: pa.table({"id": a.column("id"), "n": pa.array([b.num_rows] * a.num_rows, pa.int64())})
    for block, most in ((32768, 1), (50, 4)):
        met, share = balls.cells(df, df, count, "id bigint, n bigint", reach=100.0, block=block)
        rows = met.collect()
        assert share == 0 and len(rows) <= 200 * most and sum(r.n for r in rows) == 200**2


def test_k_nearest_over_several_parts(monkeypatch):
    """Parts of the right side one after the other, with ties, copies and lengths that a product can't take."""
    from sievestone.operators import vectors as V

    rng = np.random.default_rng(6)
    monkeypatch.setattr(V, "SIDE", 7)
    for x in (rng.normal(size=(40, 3)), rng.integers(0, 3, size=(40, 3)).astype(float), np.full((40, 3), 0.1), rng.normal(size=(40, 3)) * 1e120, rng.normal(size=(40, 3)) + 1e6):
        ids = rng.permutation(40)
        d = V.distances(x, x)
        i, j, near = V.k_nearest(x, x, 4, ids, ids)
        want = [(a, b, d[a, b]) for a in range(40) for b in sorted((b for b in range(40) if b != a), key=lambda b: (d[a, b], ids[b]))[:4]]
        assert sorted(zip(i.tolist(), near.tolist(), ids[j].tolist())) == sorted((a, t, ids[b]) for a, b, t in want)


def test_point_history_keeps_its_points_compressed(spark, monkeypatch):
    """The points may be as many as the ratings; a checkpoint of them isn't compressed."""
    monkeypatch.setattr(temporal, "cut", lambda df: pytest.fail("points go to a checkpoint"))
    ratings = spark.createDataFrame([(1, 2, 4, 10), (1, 3, 2, 20)], "user_id long, movie_id long, rating long, ts long")
    points = spark.createDataFrame([(1, 2, 15), (1, 2, 15), (None, 2, 15)], "user_id long, movie_id long, asked_at long")
    assert [tuple(r) for r in temporal.point_history(ratings, points, RULES).select("user_mean", "user_count", "movie_mean", "movie_count").collect()] == [(4.0, 1, 4.0, 1)]


def test_silhouettes_find_each_distance_once(spark):
    """Two blocks meet once, not in either order, and what a cell sums for both sides is what all pairs give."""
    import numpy as np
    import pyarrow as pa

    from sievestone.operators.vectors import distance_sums, distances

    draw = np.random.default_rng(21)
    for shift in (0.0, 1e6, 1e150):
        a, b = draw.normal(size=(150, 5)) + shift, draw.normal(size=(2100, 5)) + shift
        b[:9] = a[:9]
        of_a, of_b = np.sort(draw.integers(0, 3, 150)), np.sort(draw.integers(0, 4, 2100))
        down, across = distance_sums(a, b, of_a, of_b)
        d = distances(a, b)
        assert np.allclose(down, np.stack([d[:, of_b == g].sum(axis=1) for g in range(4)], axis=1), rtol=1e-9)
        assert np.allclose(across, np.stack([d[of_a == g].sum(axis=0) for g in range(3)], axis=1), rtol=1e-9)
    df = vectors(spark, [(i, v, i % 3) for i, v in enumerate(draw.normal(size=(90, 2)))])
    met = pairs.halved_cells(df, lambda a, b, same: pa.table({"n": [a.num_rows * (a.num_rows + 1) // 2 if same else a.num_rows * b.num_rows]}), "n bigint", 20)
    assert met.agg(F.sum("n")).first()[0] == 90 * 91 // 2 and met.count() > 1


def test_all_candidates_are_measured_in_one_pass(spark, monkeypatch):
    """What the sampled pass tells of each k is what the operators tell of its labelled rows, whose pairs it never deals out."""
    import numpy as np

    monkeypatch.setattr(clustering, "SILHOUETTE_ROWS", 25)
    x = np.random.default_rng(22).normal(size=(120, 3))
    x[100:] = x[:20]
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(x)]).select("id", "v")
    dealt, real = [], pairs.silhouettes
    monkeypatch.setattr(clustering, "silhouettes", lambda *a: dealt.append(a) or real(*a))
    found = clustering.choose_k(df, range(1, 6))
    assert len(dealt) == 1
    sample = clustering.seeded_sample(df, 25)
    for r in found:
        labelled = r["labelled"]
        wanted = real(labelled, sample).agg(F.avg("s")).first()[0]
        assert r["sampled"] == (None if wanted is None else pytest.approx(wanted)) and r["sse"] == pytest.approx(pairs.scatter(labelled).agg(F.sum("sse")).first()[0])
    centres = [r["centres"] for r in found]
    near = clustering.nearest_numbers(x, *centres, np.repeat(x[:1], 3, axis=0))
    assert near[-1].max() == 0
    for r, k in zip(found, near, strict=False):
        assert dict(r["labelled"].select("id", "cluster").collect()) == dict(enumerate(k.tolist()))
