import hashlib
import json
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.operators import classify, clustering, pairs, prefix, profile, reduce
from sievestone.plans import clusters, learning, tools
from sievestone.plans import service as S
from sievestone.plans.rules import Rules
from sievestone.sources import artefacts

RULES = Rules(genres=("Action", "Comedy", "Drama"), t1=600, t2=800)


def made(spark, n=1200, seed=1):
    """A feature matrix of two columns: the first tells the label, the second doesn't, and one is always 1."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.random() < 0.5
        rows.append((i // 4 % 40, i // 4 % 30 + (i if i % 4 == 3 and i >= 1100 else 0), ("train", "train", "validate", "test")[i % 4], int(y), rng.gauss(2.0 * y, 1.0), rng.gauss(0, 50), 1.0))
    return spark.createDataFrame(rows, "user_id long, movie_id long, split string, label int, a double, b double, flat double")


COLUMNS = ["a", "b", "flat"]


def plain_gaussian(rows, smoothing):
    train = [r for r in rows if r.split == "train"]
    x, y = np.array([[r[c] for c in COLUMNS] for r in train]), np.array([r.label for r in train])
    centre, scale = x.mean(0), np.where(x.std(0) == 0, 1, x.std(0))
    z = (x - centre) / scale
    eps = smoothing * z.var(0).max()
    out = []
    for r in rows:
        v, ll = (np.array([r[c] for c in COLUMNS]) - centre) / scale, []
        for k in (0, 1):
            own = z[y == k]
            var = own.var(0) + eps
            ll.append(math.log(len(own) / len(y)) - 0.5 * (np.log(2 * math.pi * var) + (v - own.mean(0)) ** 2 / var).sum())
        out.append(1 / (1 + math.exp(ll[0] - ll[1])))
    return out


@pytest.mark.parametrize("smoothing", [1e-9, 0.1])
def test_bayes_is_the_plain_one_over_standardised_columns(spark, smoothing):
    df = made(spark)
    rows = df.collect()
    got = [r.score for r in classify.fit_gaussian(df, COLUMNS, smoothing).score(df).collect()]
    assert np.allclose(got, plain_gaussian(rows, smoothing), atol=1e-9)
    assert classify.fit_gaussian(df.filter("label = 1"), COLUMNS) is None


def test_a_trees_score_is_the_leaf_at_the_end_of_its_path(spark):
    df = made(spark)
    model = classify.fit_tree(df, COLUMNS, depth=5, leaf=20)
    assert len(model.nodes) > 5
    train = [r for r in df.collect() if r.split == "train"]
    for r in model.score(df).collect()[::17]:
        path = model.path(r.asDict())
        assert path[-1]["leaf_positive_rate"] == round(r.score, 6)
        for step in path[:-1]:
            assert (r[step["feature"]] <= model.nodes[step["node"]][1]) == (step["direction"] == "left")
    assert classify.fit_tree(df.filter("label = 0"), COLUMNS) is None and classify.tree_scores(df.filter("label = 1"), COLUMNS).filter("score is not null").count() == 0
    with pytest.raises(ValueError):
        classify.train("cart", df.filter("label = 0"), COLUMNS)
    leaves = {}
    for r in train:
        leaves.setdefault(model.path(r.asDict())[-1]["node"], []).append(r.label)
    for at, labels in leaves.items():
        assert model.nodes[at][4] == len(labels) >= 20 and model.nodes[at][5] == pytest.approx(np.mean(labels))


@pytest.mark.parametrize("kind", ["gnb", "cart"])
def test_the_grid_is_tried_on_validation_and_the_threshold_frozen(spark, kind):
    df = made(spark)
    result = classify.train(kind, df, COLUMNS, ({"smoothing": 10.0}, {"smoothing": 1e-9}) if kind == "gnb" else ({"depth": 1, "leaf": 50}, {"depth": 4, "leaf": 20}))
    tried = result["grid"]
    best = max(range(2), key=lambda i: (tried[i]["roc_auc"], tried[i]["pr_auc"], -i))
    assert len(tried) == 2 and result["settings"] == tried[best]["settings"]
    scored = result["model"].score(df).collect()
    part = lambda s: [(r.score, r.label) for r in scored if r.split == s]
    validate, test = part("validate"), part("test")
    base = np.mean([y for _, y in validate])

    def f1_at(t):
        hit = [y for s, y in validate if s >= t]
        tp = sum(hit)
        return (2 * tp / (len(hit) + sum(y for _, y in validate)), t) if len(hit) / len(validate) <= 1.1 * base else (-1, t)

    want = max(f1_at(t) for t in {s for s, _ in validate})
    assert result["threshold"] == pytest.approx(want[1], abs=1e-6) and result["validation"]["f1"] == pytest.approx(want[0], abs=1e-6)
    tn = sum(s < result["threshold"] and y == 0 for s, y in test)
    assert result["test"]["n"] == len(test) == result["test_at_half"]["n"] and result["test"]["confusion"]["tn"] == tn and result["test_at_half"]["threshold"] == 0.5
    pos, neg = [s for s, y in test if y], [s for s, y in test if not y]
    roc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert result["test"]["roc_auc"] == pytest.approx(roc, abs=1e-6)
    strata = result["strata"]
    assert strata["user_unseen_in_train"] == {"n": 0} and strata["movie_unseen_in_train"]["n"] > 0 and strata["user_seen_in_train"]["n"] == len(test)


def test_strata_with_one_label_have_no_areas(spark):
    rows = spark.createDataFrame([(0.9, 1, 1, 1), (0.2, 1, 1, 0), (0.1, 0, 0, 1)], "score double, label int, user_seen int, movie_seen int")
    got = classify.strata_measures(rows, 0.5)
    assert "roc_auc" not in got["user_seen_in_train"] and got["user_seen_in_train"]["recall"] == 0.5 and got["movie_seen_in_train"]["roc_auc"] == 1.0
    assert got["user_unseen_in_train"]["f1"] == 0.0 and got["movie_unseen_in_train"]["n"] == 1


def tables(spark):
    rng = random.Random(5)
    rows = [(u, m, 5 if (u + m) % 2 == 0 else 2 + (u * m) % 2, rng.randrange(1000)) for u in range(1, 25) for m in range(1, 20)]
    ratings = spark.createDataFrame(rows + [(99, 1, 3, 10)], "user_id long, movie_id long, rating long, ts long")
    movies = spark.createDataFrame([(m, f"M{m} (1990)", ("Drama", "Action|Comedy", "Comedy")[m % 3]) for m in range(1, 22)], "movie_id long, title string, genres string")
    users = spark.createDataFrame([(u, "F", "25", str(u % 21), "00000") for u in range(1, 28)], "user_id long, gender string, age string, occup string, zipcode string")
    return {"ratings": ratings, "movies": movies, "users": users}


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    t = tables(spark)
    return tools.workspace(spark, t["ratings"], t["movies"], t["users"], RULES, str(tmp_path_factory.mktemp("models")), "data-v1", min_ratings=8)


def test_models_are_saved_and_loaded_and_classify(spark, space):
    found = learning.run(space.tables["ratings"], space.tables["movies"], space.tables["users"], RULES, grid={"cart": ({"depth": 4, "leaf": 10},)})
    for kind, result in found.items():
        assert learning.save(spark, space.folder, result, RULES, "data-v1") == "v1"
        again, meta = learning.load(spark, space.folder, kind)
        assert again == result["model"] and meta["threshold"] == result["threshold"] and meta["version"] == "v1"
        assert "| roc_auc |" in artefacts.read_text(spark, f"{space.folder}/{kind}/v1/card.md")
    with pytest.raises(artefacts.ArtefactError):
        learning.save(spark, space.folder, found["gnb"], RULES, "data-v1", "v1")
    assert learning.save(spark, space.folder, found["gnb"], RULES, "data-v1") == "v2" and artefacts.versions(spark, space.folder, "gnb") == ["v1", "v2"]
    one = learning.classify_one(spark, space.folder, space.tables, RULES, 3, 5)
    assert [r["algorithm"] for r in one["results"]] == ["gnb", "cart"] and all(r["predicted_class"] == (learning.HIGH if r["score"] >= r["threshold"] else learning.LOW) for r in one["results"])
    past = [r.rating for r in space.tables["ratings"].filter("user_id = 3 and ts <= 600").collect()]
    features = one["results"][0]["features"]
    assert features["user_mean"] == pytest.approx(np.mean(past), abs=1e-4) and features["user_history_count"] == len(past) and "leaf_samples" in one["results"][1]["explanation"][-1]
    early = learning.classify_one(spark, space.folder, space.tables, RULES, 3, 21, at=0, kind="gnb")["results"][0]
    assert early["prediction_time_basis"] == "history_before(prediction_time=0)" and early["features"]["user_mean_source"] == "fallback_global_mean" and learning.FALLBACK in early["limits"]
    for args, code in (((1000, 5), "UNKNOWN_USER"), ((3, 1000), "UNKNOWN_MOVIE"), ((3, 5, None, "forest"), "INVALID_PARAMETER"), ((3, 5, None, "gnb", "v9"), "MODEL_NOT_FOUND")):
        with pytest.raises(S.TaskError) as e:
            learning.classify_one(spark, space.folder, space.tables, RULES, *args)
        assert e.value.code == code
    path = f"{space.folder}/gnb/v2/meta.json"
    artefacts.write_json(spark, path, artefacts.read_json(spark, path) | {"feature_version": "old"})
    with pytest.raises(S.TaskError) as e:
        learning.load(spark, space.folder, "gnb")
    assert e.value.code == "VERSION_MISMATCH" and e.value.as_dict(legacy=True)["code"] == "INVALID_DATA_VERSION"


def test_one_row_is_that_of_the_feature_matrix(spark, space):
    """With the time of a rating the row is the matrix's row of that rating."""
    from sievestone.operators import temporal

    t = space.tables
    matrix = {(r.user_id, r.movie_id): r for r in temporal.feature_matrix(t["ratings"], t["movies"], t["users"], RULES).collect()}
    for key in ((3, 5), (7, 11), (24, 19)):
        row, _ = learning.one_row(t["ratings"], t["movies"], t["users"], RULES, *key, at=matrix[key].ts)
        got = row.first()
        assert all(got[c] == pytest.approx(matrix[key][c]) for c in temporal.feature_names(RULES))


def test_artefacts(spark, tmp_path):
    folder = str(tmp_path / "a")
    assert artefacts.versions(spark, folder, "x") == [] and artefacts.next_version(["v2", "v10", "other"]) == "v11"
    with pytest.raises(artefacts.ArtefactError):
        artefacts.load(spark, folder, "x")
    artefacts.save(spark, folder, "x", "v1", {"n": 1, "text": "é"}, {"t": spark.range(3)})
    meta, path = artefacts.load(spark, folder, "x", n=1)
    assert meta["text"] == "é" and artefacts.tables_of(spark, path, "t").count() == 3
    with pytest.raises(artefacts.ArtefactError) as e:
        artefacts.load(spark, folder, "x", n=2)
    assert e.value.code == "VERSION_MISMATCH"
    for data in (b"", b"a", b"a\nb\n", b"\xe9\r\n\nx"):
        (tmp_path / "f.dat").write_bytes(data)
        assert artefacts.file_facts(spark, str(tmp_path / "f.dat")) == (len(data.splitlines()) if data != b"\xe9\r\n\nx" else 3, hashlib.sha256(data).hexdigest())


def test_running_sums(spark):
    rng = random.Random(3)
    values = sorted({rng.randrange(10_000) for _ in range(500)})
    df = spark.createDataFrame([(v, v % 7) for v in values], "x long, n long").repartition(6)
    out, total = prefix.running_sums(df, F.desc("x"), {"upto": "n"})
    want = dict(zip(values[::-1], np.cumsum([v % 7 for v in values[::-1]]).tolist(), strict=True))
    assert {r.x: r.upto for r in out.collect()} == want and total["upto"] == sum(v % 7 for v in values)
    assert prefix.running_sums(df.filter("x < 0"), F.col("x"), {"upto": "n"})[0].count() == 0
    ordered = sorted(v for v in values for _ in range(v % 7))
    got = prefix.at_places(df, "x", {"a": 1, "b": 100, "c": len(ordered)}, "n").first()
    assert (got.a, got.b, got.c) == (ordered[0], ordered[99], ordered[-1])
    assert pairs.nearest_rank(df.filter("x < 0"), "x", {"p": 0.5}).first().p is None


def test_kmeans_ends_at_a_fixed_point(spark):
    """Each point is nearest its own centre, each centre is the mean of its points, and the sums are those of plain Lloyd."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3)) + rng.integers(0, 4, size=(300, 1)) * 3
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    labelled, centres = clustering.kmeans(df, 4, tolerance=1e-12)
    got = {r.id: (r.cluster, r.dist) for r in labelled.collect()}
    d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2))
    assert all(got[i][0] == d[i].argmin() and got[i][1] == pytest.approx(d[i].min()) for i in range(300))
    own = np.array([got[i][0] for i in range(300)])
    assert np.allclose(centres, [x[own == c].mean(0) for c in range(4)])
    start = clustering.plus_plus(df, 4, 42)
    near = ((x[:, None] - start[None]) ** 2).sum(2).argmin(1)
    (sums, sizes), (more, _) = clustering.cluster_sums(df, start, centres)
    assert np.allclose(more, [x[own == c].sum(0) for c in range(4)])
    many = clustering.kmeans_many(df, [2, 4, 3], tolerance=1e-12)
    assert all(np.allclose(many[k], clustering.kmeans(df, k, tolerance=1e-12)[1]) for k in (2, 3, 4))
    assert np.allclose(sums, [x[near == c].sum(0) for c in range(4)]) and sizes.tolist() == np.bincount(near, minlength=4).tolist()


def test_statuses(spark):
    users = spark.createDataFrame([(1, "OK", 1, [0.0]), (2, "OK", 1, [9.0]), (3, profile.SPARSE, 0, [8.0]), (4, profile.NONE, 0, None)], "id long, status string, fit int, v array<double>")
    got = {r.id: tuple(r)[1:] for r in clusters.kmeans_assignments(users, np.array([[0.0], [10.0]])).collect()}
    assert got == {1: (0, "SUCCESS", 0, 0.0), 2: (1, "SUCCESS", 0, 1.0), 3: (1, "ASSIGNED_FROM_FITTED_CENTROIDS", 1, 2.0), 4: (None, "NO_TRAIN_HISTORY", 1, None)}
    labels = spark.createDataFrame([(1, 0), (2, -1)], "id long, cluster int")
    got = {r.id: tuple(r)[1:] for r in clusters.dbscan_assignments(users, labels).collect()}
    assert got == {1: (0, "SUCCESS", 0), 2: (None, "UNASSIGNED_BY_DENSITY", 1), 3: (None, "INSUFFICIENT_HISTORY", 1), 4: (None, "NO_TRAIN_HISTORY", 1)}
    assert tuple(clusters.noise_summary(labels).first()) == (2, 1, 1, 0.5) and clusters.noise_summary(labels.limit(0)).first().noise_ratio is None
    chosen, missing = clusters.resolve(users, [4, 2, 77, 2])
    assert sorted(r.id for r in chosen.collect()) == [2, 4] and missing == [77]


def test_reduction_results(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate((rng.normal(size=(25, 4)) * 0.2, rng.normal(size=(25, 4)) * 0.2 + 5))
    users = spark.createDataFrame([(i, "OK", int(i < 48), [float(a) for a in v]) for i, v in enumerate(x)], "id long, status string, fit int, v array<double>")
    out = clusters.reduction_run(users, list("abcd"), "pca", asked=[*range(50), 99], k=2, eps=1.5)
    assert out["unknown_users"] == [99] and clusters.reduction_run(users, list("abcd"), k=2)["projected"].count() == 0
    model = reduce.pca(clusters.fitted(users))
    assert out["coordinates"].count() == 48 and out["projected"].count() == 2
    top = out["loadings"][0]["features"]
    assert [f["feature"] for f in top] == [list("abcd")[j] for j in np.argsort(-np.abs(model["components"][0]))]
    c = out["comparison"]
    assert c["kmeans"]["before"]["silhouette"] > 0.8 and c["kmeans"]["delta"]["sse"] == c["kmeans"]["after"]["sse"] - c["kmeans"]["before"]["sse"] and c["dbscan"]["before"]["clusters"] == 2
    flat = clusters.reduction_run(users, list("abcd"), "tsne", perplexity=8.0, rounds=300, k=2)
    assert flat["coordinates"].count() == 48 and flat["metrics"]["kl"] > 0 and 0 <= flat["metrics"]["agreement"] <= 1
    with pytest.raises(S.TaskError):
        clusters.reduction_run(users, list("abcd"), asked=[0, 1])
    with pytest.raises(S.TaskError):
        clusters.compare(clusters.fitted(users), clusters.fitted(users), 1)


def test_eps_probes(spark):
    rows = [(i, [float(i if i < 20 else 1000 * i)]) for i in range(25)]
    got = clusters.eps_probes(spark.createDataFrame(rows, "id long, v array<double>"), 2)
    assert [(p["share"], p["eps"], p["clusters"], p["noise"]) for p in got] == [(0.5, 1.0, 1, 5), (0.75, 2.0, 1, 5)]


def test_groups_within_a_cell():
    rng = np.random.default_rng(2)
    for _ in range(30):
        near = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.2
        left, right = pairs.groups_of(near)
        n, m = near.shape
        reach = np.eye(n + m, dtype=bool)
        reach[:n, n:] |= near
        reach[n:, :n] |= near.T
        for _ in range(n + m):
            reach = (reach.astype(int) @ reach.astype(int)) > 0
        both = np.concatenate((left, right))
        for i in range(n + m):
            for j in range(n + m):
                if i != j:
                    assert reach[i, j] == (both[i] == both[j] and both[i] >= 0)


def test_tools_give_envelopes(spark, space):
    route = lambda c, p: S.route(c, {"data_version": "data-v1", **p}, "data-v1")
    out = tools.run_plan(space, route("clustering", {"user_ids": [1, 2, 26, 500], "parameters": {"k": 2, "eps": 8.0, "min_samples": 3}}))
    k = out["results"]["kmeans"]
    assert [a["user_id"] for a in k["assignments"]] == [1, 2, 26] and k["assignments"][2]["status"] == "NO_TRAIN_HISTORY" and k["unknown_users"] == [500] and k["parameters"]["k"] == 2
    assert sum(c["size"] for c in k["clusters"]) == space.users.filter("fit = 1").count() and "1 raters" in k["limits"][0] and k["result_version"].startswith("res-")
    assert out["results"]["dbscan"]["metrics"]["points"] == space.users.filter("fit = 1").count()
    pca = tools.run_plan(space, {"category": "dimensionality_reduction", "algorithms": ["pca", "umap"], "user_ids": None, "parameters": {}})
    assert len(pca["results"]["pca"]["coordinates"]) > 3 and pca["errors"]["umap"]["code"] == "MODEL_NOT_FOUND"
    with pytest.raises(S.TaskError):
        tools.run_plan(space, {"category": "clustering", "algorithms": ["none"], "user_ids": [1]})
    assert pca["results"]["pca"]["saved"]["version"] == "v1" and pca["execution"]["pca"]["attempt"] == 1
    assert json.loads(json.dumps(artefacts.load(spark, space.folder, "result_pca")[0]["envelope"]["metrics"])) == pca["results"]["pca"]["metrics"]


def test_profiles_are_saved(spark, space):
    version = space.save_profile()
    assert sorted(map(repr, space.load_profile(version).collect())) == sorted(map(repr, space.profile.collect()))
    meta, _ = artefacts.load(spark, space.folder, "profile")
    assert meta["orphans"] == 1 and set(meta["scaler"]) == set(profile.names(RULES))


def test_davies_bouldin_of_many_clusters(spark):
    rng = np.random.default_rng(12)
    x, own = rng.normal(size=(90, 3)), np.arange(90) % 13
    df = spark.createDataFrame([(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, own, strict=True))], "id long, v array<double>, cluster int")
    centre = np.array([x[own == c].mean(0) for c in range(13)])
    spread = np.array([np.linalg.norm(x[own == c] - centre[c], axis=1).mean() for c in range(13)])
    want = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(centre[i] - centre[j]) for j in range(13) if j != i) for i in range(13)])
    assert pairs.davies_bouldin(df).first().dbi == pytest.approx(want) and pairs.davies_bouldin(df, 4).first().dbi == pytest.approx(want)


def test_gaussian_sums_lose_nothing(spark):
    """Means and variances are those of exact arithmetic to the last digits, however rows are dealt, for large numbers of little spread too."""
    rng = random.Random(5)
    given = [("train", i % 2, 1e9 + rng.random(), rng.lognormvariate(0, 3), 7.0, i % 3) for i in range(20000)]
    rows = spark.createDataFrame(given, "split string, label int, a double, b double, c double, d int")
    exact = {y: [[Fraction(r[k]) for r in given if y is None or r[1] == y] for k in range(2, 6)] for y in (0, 1, None)}
    for parts in (1, 7):
        found = classify._moments(rows.repartition(parts), ["a", "b", "c", "d"])
        for y, columns in exact.items():
            for name, x in zip("abcd", columns, strict=True):
                mean = sum(x) / len(x)
                var = sum((v - mean) ** 2 for v in x) / len(x)
                assert found[y]["__n"] == len(x) and found[y][f"m_{name}"] == pytest.approx(float(mean), rel=2e-15, abs=0)
                assert found[y][f"v_{name}"] == pytest.approx(float(var), rel=2e-14, abs=0)
    holes = rows.withColumn("b", F.when(F.col("d") == 0, None).otherwise(F.col("b")))
    assert classify._moments(holes, ["b"])[1]["m_b"] == pytest.approx(holes.filter("label = 1").agg(F.avg("b")).first()[0], rel=1e-12)
    assert set(classify._moments(rows.limit(0), ["a"])) <= {None}
