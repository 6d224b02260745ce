"""Queries of the analysis operators over the driver's tables, with DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.functions import semi
from sievestone.functions import text as T
from sievestone.operators import classify, clustering, pairs, profile, reduce, temporal, tsne
from sievestone.plans import clusters, learning
from sievestone.plans.rules import SAMPLE_RULES
from sievestone.session import cut, drop_at_exit, shared_dir, table, written
from sievestone.sources import artefacts, files, sample
from sievestone.streaming import quality

R = SAMPLE_RULES
GENRES = profile.names(R)[len(profile.BASE) :]
EPS, MIN_SAMPLES, MIN_RATINGS = 1.15, 5, 20
FEATURES = temporal.feature_names(R)
THRESHOLD = 0.4
LLOYD_K, LLOYD_ROUNDS = 6, 5


def _ratings(spark, d: str) -> DataFrame:
    return sample.rows(spark, d, "ratings").select("user_id", "movie_id", "rating", "ts")


def _vectors(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("cluster"))


def _events(spark, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("movie_id"), F.col("value").alias("rating"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ts"))


def _matrix(spark, d: str, seen: bool = False) -> DataFrame:
    return temporal.feature_matrix(_ratings(spark, d), sample.rows(spark, d, "movies"), sample.rows(spark, d, "users"), R, seen)


def _profile(spark, d: str) -> DataFrame:
    return profile.profile(_ratings(spark, d), sample.rows(spark, d, "movies"), sample.rows(spark, d, "users"), R, MIN_RATINGS)


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _history(spark, d):
    return _rounded(temporal.history(_ratings(spark, d), R).select("user_id", "movie_id", "ts", "rating", "user_mean", "movie_mean", "user_count", "movie_count"), ["user_mean", "movie_mean"])


def _event_history(spark, d):
    e = _events(spark, d)
    past = temporal._past(e.withColumn("rating", F.lit(1)), "user_id", "user")
    return past.groupBy("user_id").agg(F.max("user_count").alias("most_before"), F.count("*").alias("seconds"))


def _points(spark, d):
    ratings = written(_ratings(spark, d))
    points = ratings.select("user_id", "movie_id", F.col("ts").alias("asked_at"))
    return _rounded(temporal.point_history(ratings, points, R), ["user_mean", "movie_mean"])


def _top_quartile(spark, d):
    pop = profile.popularity(_ratings(spark, d), R)
    cut_ = profile.top_cut(pop)
    return pop.withColumn("one", F.lit(1)).join(F.broadcast(cut_.withColumn("one", F.lit(1))), "one").filter("pop >= cut").select("movie_id", "pop")


def _labelled_users(spark, d) -> DataFrame:
    """A stand-in clustering of users, the same in both engines."""
    return sample.rows(spark, d, "users").select("user_id", (F.col("user_id") % 5 - 1).alias("cluster"))


def _scored(spark, d, *splits: str) -> DataFrame:
    """split, label, user_seen, movie_seen and the score, to six digits, of naive Bayes over the whole feature matrix, by rows of the splits (none: test)."""
    rows = written(_matrix(spark, d, True))
    model = classify.fit_gaussian(rows, FEATURES)
    return written(_rounded(model.score(rows.filter(F.col("split").isin(*splits or ("test",)))).select("split", "label", "user_seen", "movie_seen", "score"), ["score"]))


def _typed(name: str):
    """Typed rows of the dirty lines, written as files in ISO-8859-1 and read again."""

    def run(spark, d):
        folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        drop_at_exit(spark, folder)
        for t in files.COLUMNS:
            files.write_lines(sample.lines(spark, d, t), f"{folder}/{t}.dat")
        rows = files.typed(files.read_tables(spark, folder)[name], name, R)
        return rows.withColumn("genres", F.array_join("genres", "|")) if name == "movies" else rows

    return run


def _gnb(spark, d):
    return _scored(spark, d, *temporal.SPLITS).groupBy("split").agg(F.round(F.avg("score"), 5).alias("mean_score"), F.round(F.min("score"), 5).alias("min_score"), F.round(F.max("score"), 5).alias("max_score"), F.count("*").alias("records"))


def _strata(spark, d):
    rows, out = _scored(spark, d), []
    for name, m in classify.strata_measures(rows, THRESHOLD).items():
        out.append((name, m["n"], *(m.get(k) for k in ("positive_rate", "precision", "recall", "f1", "roc_auc", "pr_auc"))))
    return spark.createDataFrame(out, "stratum string, n bigint, positive_rate double, precision double, recall double, f1 double, roc_auc double, pr_auc double")


def _frozen(spark, d):
    """The threshold that is best on the validation split, and what it does on the test split."""
    rows = _scored(spark, d, "validate", "test")
    best = classify.best_threshold(rows.filter("split = 'validate'")).first()["threshold"]
    return classify.confusion(rows.filter("split = 'test'"), best).withColumn("threshold", F.lit(best))


def _run(spark, d, kinds=("gnb", "cart")):
    """The measures of a whole classification run, a row for each model and split."""
    found = learning.run(_ratings(spark, d), sample.rows(spark, d, "movies"), sample.rows(spark, d, "users"), R, kinds)
    names = ("n", "positive_rate", "roc_auc", "pr_auc", "threshold", "accuracy", "precision", "recall", "f1", "predicted_rate")
    rows = [(k, part, str(r["settings"]), *(float(r[part][m]) if r[part].get(m) is not None else None for m in names)) for k, r in found.items() for part in ("validation", "test", "test_at_half")]
    return spark.createDataFrame(rows, "model string, part string, settings string, " + ", ".join(f"{m} double" for m in names))


def _users(spark, d) -> DataFrame:
    return clusters.user_vectors(written(_profile(spark, d)), R)


def _cluster_assignments(spark, d):
    """Every user's place under given centres: the vectors of the three users with the smallest ids that fit."""
    import numpy as np

    users = written(_users(spark, d))
    centres = np.array([r["v"] for r in users.filter("fit = 1").orderBy("id").limit(3).collect()])
    return clusters.kmeans_assignments(users, centres).withColumn("dist", F.round("dist", 4))


def _noise(spark, d):
    labels = clustering.dbscan(_vectors(spark, d).select("id", "v"), EPS, MIN_SAMPLES)
    return clusters.noise_summary(labels).withColumn("noise_ratio", F.round("noise_ratio", 6))


def _comparison(spark, d):
    """K-Means before and after PCA to two dimensions."""
    v = cut(_vectors(spark, d).select("id", "v"))
    found = clusters.compare(v, reduce.project(v, reduce.pca(v)))["kmeans"]
    rows = [(side, *(found[side][m] for m in ("silhouette", "dbi", "sse"))) for side in ("before", "after", "delta")]
    return spark.createDataFrame(rows, "side string, silhouette double, dbi double, sse double")


def _eps(spark, d):
    return pairs.neighbour_counts(_vectors(spark, d).select("id", "v"), EPS)


def _cores(spark, d):
    return _eps(spark, d).filter(F.col("neighbours") >= MIN_SAMPLES).select("id")


def _centroid_assign(spark, d):
    v = _vectors(spark, d)
    centres = pairs.centroids(v).orderBy("cluster").collect()
    import numpy as np

    near = clustering.assign(v.select("id", "v"), np.array([c["centre"] for c in centres]))
    return near.select("id", F.get(F.array(*[F.lit(c["cluster"]) for c in centres]), F.col("cluster")).alias("cluster"), F.round("dist", 6).alias("dist"))


def _covariance(spark, d):
    _, cov = reduce.covariance(_vectors(spark, d))
    n = len(cov)
    return spark.createDataFrame([(i, j, float(round(cov[i, j], 8))) for i in range(n) for j in range(i, n)], "i int, j int, cov double")


def _explained(spark, d):
    m = reduce.pca(_vectors(spark, d))
    return spark.createDataFrame([(i, float(round(a, 6)), float(round(b, 6))) for i, (a, b) in enumerate(zip(m["explained"], m["cumulative"], strict=True))], "component int, explained double, cumulative double")


def _pca_coordinates(spark, d):
    v = _vectors(spark, d).select("id", "v")
    return _rounded(reduce.project(v, reduce.pca(v)).select("id", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y")), ["x", "y"])


def _overlap(spark, d):
    """How well the means of every eight components keep neighbours: a reduction that SQL can make too."""
    v = _vectors(spark, d).select("id", "v")
    means = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.aggregate(F.slice("v", i * 8 + 1, F.lit(8)), F.lit(0.0), lambda s, x: s + x) / 8)
    return _rounded(reduce.knn_agreement(v, v.withColumn("v", means)), ["agreement", "baseline"])


def _kmeans(spark, d):
    labelled, _ = clustering.kmeans(_vectors(spark, d).select("id", "v"), 6)
    return labelled.select("id", "cluster", F.round("dist", 6).alias("dist"))


def _lloyd(spark, d):
    """K-Means from the vectors of the smallest ids, moved so many rounds: every vector's cluster and distance."""
    import numpy as np

    v = cut(_vectors(spark, d).select("id", "v"))
    first = np.array([r["v"] for r in v.orderBy("id").limit(LLOYD_K).collect()])
    centres = clustering.kmeans_many(v, [LLOYD_K], rounds=LLOYD_ROUNDS, tolerance=0.0, start={LLOYD_K: first})[LLOYD_K]
    return clustering.assign(v, centres).select("id", "cluster", F.round("dist", 6).alias("dist"))


def _recomposed(spark, d):
    """What all eigenpairs give when put together again, the covariance, and what the axes give among themselves, ones on the diagonal."""
    import numpy as np

    v = _vectors(spark, d)
    m = reduce.pca(v, dims=v.select(F.size("v")).first()[0])
    axes, n = m["components"], len(m["eigenvalues"])
    whole, among = axes.T @ np.diag(m["eigenvalues"]) @ axes, axes @ axes.T
    rows = [(i, j, float(round(whole[i, j], 8)), float(round(among[i, j], 8)) + 0.0) for i in range(n) for j in range(i, n)]
    return spark.createDataFrame(rows, "i int, j int, cov double, dot double")


def _event_values(spark, d):
    """Every event's day, its value as text, and where it lies between the least and the greatest."""
    e = table(spark, d, "events")
    ends = e.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    place = T.placed(F.col("value"), F.lit(ends["low"]), F.lit(ends["high"]))
    return e.select("event_id", T.utc_date(seconds).alias("day"), T.shown(F.col("value"), 2).alias("value_text"), F.round(place, 9).alias("place"), T.finite(F.col("value"), place).alias("fine"))


def _plain_texts(spark, d):
    """Every document's text in ASCII, by its digest, and a slug of its language and source."""
    return table(spark, d, "documents").select("doc_id", F.sha2(T.ascii_only(F.col("text")), 256).alias("ascii_sha256"), T.slug(F.concat("lang", F.lit(" Child's "), "source")).alias("slug"))


def _line_counts(spark, d):
    """Lines of the tables' files in ISO-8859-1, counted by splits."""
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)
    rows = []
    for t in files.COLUMNS:
        files.write_lines(sample.lines(spark, d, t), f"{folder}/{t}.dat")
        rows.append((t, artefacts.line_count(spark, f"{folder}/{t}.dat")))
    return spark.createDataFrame(rows, "name string, lines bigint")


def _saved_profile(spark, d):
    """The users' profile, saved as a version and loaded again."""
    folder = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)
    artefacts.save(spark, folder, "profile", None, {"data_version": d}, {"users": _profile(spark, d)})
    meta, path = artefacts.load(spark, folder, "profile", data_version=d)
    rows = artefacts.tables_of(spark, path, "users").withColumn("version", F.lit(meta["version"]))
    return _rounded(rows.select("user_id", "status", "fit", "version", *profile.BASE), list(profile.BASE))


def _choose_k(spark, d):
    best = clustering.choose_k(cut(_vectors(spark, d).select("id", "v")))[0]
    return spark.createDataFrame([(best["k"], best["silhouette"], best["dbi"], best["sse"])], "k int, silhouette double, dbi double, sse double")


def _event_props(spark, d):
    """Every event's properties by type, where every tenth text has lost its last character and every seventh number is text."""
    i, props = F.col("event_id"), F.col("props")
    odd = F.when(i % 10 == 0, F.expr("left(props, length(props) - 1)")).when(i % 7 == 0, F.regexp_replace(props, ": *([0-9]+)", ': "n$1"')).otherwise(props)
    e = table(spark, d, "events").select("event_type", odd.alias("props"))
    counts = semi.profile(e, "props", {"k": "bigint", "a.b": "string"}, ["event_type"])
    sums = e.groupBy("event_type").agg(F.sum(semi.parsed(F.col("props"), "k bigint")["k"]).alias("k_sum"), F.count_distinct(semi.at(F.col("props"), "k", "string")).alias("k_texts"))
    return counts.join(sums, "event_type")


def _event_windows(spark, d):
    """All events as a stream, counted by hour and type until there are no more."""
    folder = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    drop_at_exit(spark, folder)
    # A stream reads folders, so the table, which is one file, is told from the others by its name.
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    found = quality.run_to_end(quality.event_windows(events), f"{folder}/out", f"{folder}/state")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events", F.round("mean_value", 6).alias("mean_value"))


QUERIES = {
    "event_windows": _event_windows,
    "event_props": _event_props,
    **{f"typed_{t}": _typed(t) for t in files.COLUMNS},
    "time_split_summary": lambda s, d: temporal.split_summary(_ratings(s, d), R),
    "time_quantiles": lambda s, d: temporal.time_quantiles(_ratings(s, d)),
    "duplicate_pairs": lambda s, d: temporal.duplicate_pairs(_ratings(s, d)),
    "history_features": _history,
    "event_history": _event_history,
    "feature_matrix": lambda s, d: _rounded(_matrix(s, d), ["user_mean", "movie_mean", "log1p_movie_count"]),
    "point_history": _points,
    "seen_unseen": lambda s, d: temporal.seen_unseen(_ratings(s, d), R),
    "movie_popularity_top_quartile": _top_quartile,
    "user_profile": lambda s, d: _rounded(_profile(s, d).select("user_id", "status", "fit", *profile.BASE), list(profile.BASE)),
    "genre_shares": lambda s, d: _rounded(_profile(s, d).select("user_id", *GENRES), GENRES),
    "profile_zscore": lambda s, d: _rounded(profile.zscores(_profile(s, d), list(profile.BASE)), list(profile.BASE), 5),
    "profile_status": lambda s, d: profile.status_counts(_profile(s, d)),
    "orphan_anti": lambda s, d: profile.orphans(_typed("ratings")(s, d), _typed("users")(s, d), R),
    "cluster_summary": lambda s, d: _rounded(profile.cluster_summary(_labelled_users(s, d), _profile(s, d), R), [f"{c}_mean" for c in ("avg_rating", "n_ratings", "high_share", "active_span_days")]),
    "cluster_means": lambda s, d: _rounded(profile.cluster_means(_labelled_users(s, d), _profile(s, d), R), profile.names(R)),
    "representative_items": lambda s, d: profile.representative_movies(_labelled_users(s, d), _typed("ratings")(s, d), _typed("movies")(s, d).groupBy("movie_id").agg(F.min("title").alias("title")), R),
    "kdistance_percentiles": lambda s, d: _rounded(pairs.nearest_rank(pairs.kth_distances(_vectors(s, d).select("id", "v"), MIN_SAMPLES), "dist", {"min": 0.0, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "max": 1.0}), ["min", "p50", "p75", "p90", "p95", "max"]),
    "silhouette_by_label": lambda s, d: pairs.silhouettes(_vectors(s, d)).groupBy("cluster").agg(F.round(F.avg("s"), 6).alias("silhouette"), F.count("*").alias("size")),
    "sse_by_label": lambda s, d: _rounded(pairs.scatter(_vectors(s, d)), ["sse", "spread"]),
    "dbi_by_label": lambda s, d: _rounded(pairs.davies_bouldin(_vectors(s, d)), ["dbi"]),
    "nearest_centroid": _centroid_assign,
    "eps_neighbours": _eps,
    "dbscan_core_points": _cores,
    "dbscan_labels": lambda s, d: clustering.dbscan(_vectors(s, d).select("id", "v"), EPS, MIN_SAMPLES),
    "kmeans_fit": _kmeans,
    "kmeans_rounds": _lloyd,
    "pca_recomposed": _recomposed,
    "event_values": _event_values,
    "plain_texts": _plain_texts,
    "line_counts": _line_counts,
    "saved_profile": _saved_profile,
    "kmeans_choose_k": _choose_k,
    "gnb_scores": _gnb,
    "missing_attributes": lambda s, d: temporal.missing_attributes(_matrix(s, d)),
    "frozen_threshold": _frozen,
    "classification_run": _run,
    "cluster_assignments": _cluster_assignments,
    "dbscan_noise": _noise,
    "reduction_comparison": _comparison,
    "cart_predict": lambda s, d: classify.tree_scores(written(_matrix(s, d)), temporal.feature_names(R)).groupBy("split").agg(F.count("*").alias("records"), F.round(F.avg("score"), 6).alias("mean_score")),
    "threshold_scan": lambda s, d: _rounded(classify.threshold_scan(_scored(s, d)), ["precision", "recall", "f1", "rate"]),
    "best_threshold": lambda s, d: _rounded(classify.best_threshold(_scored(s, d)), ["f1"]),
    "confusion": lambda s, d: classify.confusion(_scored(s, d), THRESHOLD),
    "strata_eval": _strata,
    "roc_auc": lambda s, d: _rounded(classify.roc_auc(_scored(s, d)), ["roc_auc"]),
    "average_precision": lambda s, d: _rounded(classify.average_precision(_scored(s, d)), ["average_precision"]),
    "pca_covariance": _covariance,
    "pca_explained": _explained,
    "pca_coordinates": _pca_coordinates,
    "tsne_coords": lambda s, d: tsne.tsne(_vectors(s, d).select("id", "v"), 20.0, 300),
    "knn_overlap": _overlap,
}


def _tree_sql(matrix: str, columns: list[str], depth: int = 12, leaf: int = 100) -> str:
    """An entropy tree grown level by level, and the mean of its leaves' shares by split; node k has 2k to its left and 2k + 1 to its right."""
    part = lambda x, n: f"CASE WHEN {x} > 0 THEN -({x} / {n}) * log2({x} / {n}) ELSE 0 END"
    bits = lambda p, n: f"({part(p, n)} + {part(f'({n} - {p})', n)})"
    steps = []
    for i in range(1, depth + 1):
        steps.append(f"""c{i} AS (SELECT node, f, v, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS p FROM (SELECT node, label, unnest(x) AS v, unnest(range(len(x))) AS f FROM a{i - 1} WHERE split = 'train' AND node >= {2 ** (i - 1)}) GROUP BY ALL),
w{i} AS (SELECT node, f, v, lead(v) OVER o AS after, sum(n) OVER o AS nl, sum(p) OVER o AS pl, sum(n) OVER g AS n, sum(p) OVER g AS p FROM c{i} WINDOW o AS (PARTITION BY node, f ORDER BY v), g AS (PARTITION BY node, f)),
b{i} AS MATERIALIZED (SELECT node, f, v + (after - v) / 2 AS t FROM (SELECT *, round({bits('p', 'n')} - nl / n * {bits('pl', 'nl')} - (n - nl) / n * {bits('(p - pl)', '(n - nl)')}, 10) AS gain FROM w{i} WHERE nl >= {leaf} AND n - nl >= {leaf} AND after IS NOT NULL)
    WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1),
a{i} AS MATERIALIZED (SELECT split, label, x, CASE WHEN f IS NULL THEN node WHEN x[f + 1] <= t THEN 2 * node ELSE 2 * node + 1 END AS node FROM a{i - 1} LEFT JOIN b{i} USING (node))""")
    return f"""WITH m AS MATERIALIZED ({matrix}), a0 AS MATERIALIZED (SELECT split, label, [{', '.join(f'{c}::DOUBLE' for c in columns)}] AS x, 1::BIGINT AS node FROM m), {', '.join(steps)}
SELECT split, count(*) AS records, round(avg(share), 6) AS mean_score FROM a{depth} JOIN (SELECT node, avg(label) AS share FROM a{depth} WHERE split = 'train' GROUP BY node) USING (node) GROUP BY split"""


def _lloyd_sql(vec: str) -> str:
    """Rounds of assigning each vector to the nearest centre, ties to the lower number, and moving the centres to their means."""
    near = lambda t: f"SELECT id, min({{'d': list_distance(v, centre), 'k': k}}) AS n FROM vec CROSS JOIN c{t} GROUP BY id"
    mean = lambda t: f"SELECT k, list(x ORDER BY i) AS centre FROM (SELECT k, i, avg(x) AS x FROM (SELECT n.k AS k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec JOIN n{t} USING (id)) GROUP BY k, i) GROUP BY k"
    steps = ", ".join(f"n{t} AS MATERIALIZED ({near(t)}), c{t + 1} AS MATERIALIZED ({mean(t)})" for t in range(LLOYD_ROUNDS))
    return f"""WITH vec AS MATERIALIZED ({vec}), c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS k, v AS centre FROM vec QUALIFY row_number() OVER (ORDER BY id) <= {LLOYD_K}),
        {steps} SELECT id, n.k AS cluster, round(n.d, 6) AS dist FROM ({near(LLOYD_ROUNDS)})"""


def oracles() -> dict[str, str]:
    r, m, u = (sample.duck(sample.ROWS[t]) for t in ("ratings", "movies", "users"))
    lab, split = "CASE WHEN rating >= 4 THEN 1 ELSE 0 END", f"CASE WHEN ts <= {R.t1} THEN 'train' WHEN ts <= {R.t2} THEN 'validate' ELSE 'test' END"
    gm = f"(SELECT avg(rating) FROM ({r}) WHERE ts <= {R.t1})"
    past = lambda k: f"PARTITION BY {k} ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    hist = f"""SELECT *, coalesce(avg(rating) OVER ({past('user_id')}), {gm}) AS user_mean, coalesce(avg(rating) OVER ({past('movie_id')}), {gm}) AS movie_mean,
        count(*) OVER ({past('user_id')}) AS user_count, count(*) OVER ({past('movie_id')}) AS movie_count FROM ({r})"""
    esc = lambda g: g.replace("'", "''")
    names = temporal.feature_names(R)
    genre_cols = ", ".join(f"CAST(coalesce(list_contains(string_split(genres, '|'), '{esc(g)}'), false) AS INTEGER) AS \"{n}\"" for g, n in zip(R.genres, names[3:], strict=False))
    occ = ", ".join(f"CASE WHEN CAST(occup AS INTEGER) = {i} THEN 1 ELSE 0 END AS occupation_{i}" for i in range(R.max_occupation + 1))
    ages = " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(R.ages))
    matrix = f"""SELECT h.user_id, h.movie_id, h.ts, {split.replace('ts', 'h.ts')} AS split, {lab} AS label, h.user_mean, h.movie_mean, ln(1 + movie_count) AS log1p_movie_count, {genre_cols}, {occ},
        CASE WHEN occup IS NULL OR CAST(occup AS INTEGER) NOT BETWEEN 0 AND {R.max_occupation} THEN 1 ELSE 0 END AS occupation_unknown, coalesce(CASE age {ages} END, -1) AS age, CASE WHEN u.user_id IS NULL THEN 0 ELSE 1 END AS has_attributes
        FROM ({hist}) h LEFT JOIN ({m}) m ON h.movie_id = m.movie_id LEFT JOIN ({u}) u ON h.user_id = u.user_id"""
    train = f"SELECT * FROM ({r}) WHERE ts <= {R.t1}"
    pop = f"SELECT movie_id, count(*) AS pop FROM ({train}) GROUP BY movie_id"
    cut_ = f"(SELECT pop FROM (SELECT pop, row_number() OVER (ORDER BY pop DESC) AS k, count(*) OVER () AS n FROM ({pop})) WHERE k = greatest(1, n // 4))"
    best = f"SELECT user_id, movie_id, max(rating) AS best FROM ({train}) GROUP BY user_id, movie_id"
    base = f"""SELECT user_id, CAST(count(*) AS DOUBLE) AS n_ratings, avg(rating) AS avg_rating, stddev_pop(rating) AS std_rating, avg(rating) - {gm} AS rating_bias, avg({lab}) AS high_share, avg(ln(1 + pop)) AS avg_movie_pop,
        (max(ts) - min(ts)) / 86400.0 AS active_span_days, CASE WHEN count(*) > 1 THEN (max(ts) - min(ts)) / 86400.0 / (count(*) - 1) ELSE 0 END AS avg_gap_days FROM ({train}) JOIN ({pop}) USING (movie_id) GROUP BY user_id"""
    shares = ", ".join(f"avg(CASE WHEN list_contains(string_split(genres, '|'), '{esc(g)}') THEN 1 ELSE 0 END) AS \"{n}\"" for g, n in zip(R.genres, GENRES, strict=True))
    uniq = f"SELECT b.user_id, avg(CASE WHEN pop >= {cut_} THEN 1 ELSE 0 END) AS share_top_pop, {shares} FROM ({best}) b JOIN ({pop}) p USING (movie_id) LEFT JOIN ({m}) m USING (movie_id) GROUP BY b.user_id"
    prof = f"""SELECT u.user_id, CASE WHEN n_ratings IS NULL THEN '{profile.NONE}' WHEN n_ratings < {MIN_RATINGS} THEN '{profile.SPARSE}' ELSE '{profile.OK}' END AS status, CASE WHEN n_ratings >= {MIN_RATINGS} THEN 1 ELSE 0 END AS fit, b.* EXCLUDE (user_id), q.* EXCLUDE (user_id)
        FROM (SELECT DISTINCT user_id FROM ({u})) u LEFT JOIN ({base}) b USING (user_id) LEFT JOIN ({uniq}) q USING (user_id)"""
    z = ", ".join(f"round(CASE WHEN s_{c} > 1e-12 THEN ({c} - m_{c}) / s_{c} WHEN {c} IS NOT NULL THEN 0.0 END, 5) AS {c}" for c in profile.BASE)
    scale = ", ".join(f"avg({c}) FILTER (WHERE fit = 1) AS m_{c}, stddev_pop({c}) FILTER (WHERE fit = 1) AS s_{c}" for c in profile.BASE)
    rounded = lambda cols, k=6: ", ".join(f'round("{c}", {k}) AS "{c}"' for c in cols)
    clusters = f"SELECT user_id, user_id % 5 - 1 AS cluster FROM ({u})"
    means = ("avg_rating", "n_ratings", "high_share", "active_span_days")
    tops = ", ".join(f"{{'v': -coalesce(round(avg(\"{g}\"), 9), 0.0), 'i': {i}, 'g': '{g.removeprefix('genre_share_')}'}}" for i, g in enumerate(GENRES))
    vec = "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label AS cluster FROM embeddings"
    dist = "SELECT a.id, a.cluster, b.id AS other, b.cluster AS other_cluster, list_distance(a.v, b.v) AS d FROM vec a JOIN vec b ON a.id <> b.id"
    centre = "SELECT cluster, list(x ORDER BY i) AS centre FROM (SELECT cluster, i, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY cluster, i) GROUP BY cluster"
    columns = [f'"{c}"' for c in FEATURES]
    fits = ", ".join(f"avg({c}) AS m_{i}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{i}, " + ", ".join(f"avg({c}) FILTER (WHERE label = {y}) AS m{y}_{i}, var_pop({c}) FILTER (WHERE label = {y}) AS v{y}_{i}" for y in (0, 1)) for i, c in enumerate(columns))
    spread = lambda i, y: f"(v{y}_{i} / (s_{i} * s_{i}) + 1e-9)"
    ll = lambda y: f"ln(n{y} / (n0 + n1)) + " + " + ".join(f"(-0.5 * ln(2 * pi() * {spread(i, y)}) - (({c} - m{y}_{i}) / s_{i}) * (({c} - m{y}_{i}) / s_{i}) / (2 * {spread(i, y)}))" for i, c in enumerate(columns))
    gnb = f"""x AS MATERIALIZED ({matrix}), f AS (SELECT {fits}, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM x WHERE split = 'train'),
        tu AS (SELECT DISTINCT user_id FROM x WHERE split = 'train'), tm AS (SELECT DISTINCT movie_id FROM x WHERE split = 'train'),
        sc AS MATERIALIZED (SELECT split, label, CASE WHEN user_id IN (FROM tu) THEN 1 ELSE 0 END AS user_seen, CASE WHEN movie_id IN (FROM tm) THEN 1 ELSE 0 END AS movie_seen, round(1 / (1 + exp(least(greatest(({ll(0)}) - ({ll(1)}), -700), 700))), 6) AS score FROM x, f)"""
    scored = "SELECT * FROM sc WHERE split = 'test'"
    by_score = lambda rows: f"SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM ({rows}) GROUP BY score) WINDOW w AS (ORDER BY score DESC)"
    scan = lambda rows: f"SELECT score AS threshold, tp / (tp + fp) AS precision, tp / p AS recall, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p) ELSE 0.0 END AS f1, (tp + fp) / (p + n) AS rate FROM ({by_score(rows)})"
    best_of = lambda rows: f"SELECT least(greatest(threshold, 1e-6), 1 - 1e-6) AS threshold, f1 FROM ({scan(rows)}) ORDER BY rate <= 1.1 * (SELECT avg(label) FROM ({rows})) DESC, round(f1, 12) DESC, threshold DESC LIMIT 1"
    roc = lambda rows: f"SELECT sum(pos * (n - fp + neg / 2.0)) / (max(p) * max(n)) FROM ({by_score(rows)})"
    pr = lambda rows: f"SELECT sum(pos / p * tp / (tp + fp)) FROM ({by_score(rows)})"
    conf = f"""count(*) FILTER (WHERE score >= {THRESHOLD} AND label = 1) AS tp, count(*) FILTER (WHERE score >= {THRESHOLD} AND label = 0) AS fp, count(*) FILTER (WHERE score < {THRESHOLD} AND label = 1) AS fn, count(*) FILTER (WHERE score < {THRESHOLD} AND label = 0) AS tn"""
    rates = "tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1, round((tp + fp) / (tp + fp + fn + tn), 6) AS predicted_rate"
    stratum = lambda name, cond: f"""SELECT '{name}' AS stratum, n, CASE WHEN n > 0 THEN round((tp + fn) / n, 6) END AS positive_rate, CASE WHEN n > 0 THEN round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) END AS precision, CASE WHEN n > 0 THEN round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) END AS recall,
        CASE WHEN n > 0 THEN round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) END AS f1, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN round(({roc(scored + ' AND ' + cond)}), 6) END AS roc_auc, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN round(({pr(scored + ' AND ' + cond)}), 6) END AS pr_auc
        FROM (SELECT count(*) AS n, {conf} FROM ({scored} AND {cond}))"""  # noqa: E731
    dims = profile.names(R)
    z27 = ", ".join(f'CASE WHEN s_{i} > 1e-12 THEN ("{c}" - m_{i}) / s_{i} ELSE 0.0 END' for i, c in enumerate(dims))
    scale27 = ", ".join(f'avg("{c}") FILTER (WHERE fit = 1) AS m_{i}, stddev_pop("{c}") FILTER (WHERE fit = 1) AS s_{i}' for i, c in enumerate(dims))
    users27 = f"p AS MATERIALIZED ({prof}), sc AS (SELECT {scale27} FROM p), uv AS MATERIALIZED (SELECT user_id AS id, status, fit, CASE WHEN status <> '{profile.NONE}' THEN [{z27}] END AS v FROM p, sc)"
    dbscan = f"""vec AS MATERIALIZED ({vec}), near AS MATERIALIZED (SELECT a.id, b.id AS other FROM vec a JOIN vec b ON list_distance(a.v, b.v) <= {EPS}), core AS MATERIALIZED (SELECT id FROM near GROUP BY id HAVING count(*) >= {MIN_SAMPLES}),
        inner_ AS MATERIALIZED (SELECT near.id, other FROM near JOIN core USING (id) WHERE other IN (FROM core)), reach AS (SELECT id, id AS root FROM core UNION SELECT inner_.other, reach.root FROM reach JOIN inner_ USING (id)),
        member AS MATERIALIZED (SELECT id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS cluster FROM (SELECT id, min(root) AS root FROM reach GROUP BY id)),
        labels AS MATERIALIZED (SELECT vec.id, coalesce(m.cluster, n.cluster, -1) AS cluster, CASE WHEN m.id IS NULL THEN 0 ELSE 1 END AS core FROM vec LEFT JOIN member m USING (id) LEFT JOIN (SELECT near.id, min(k.cluster) AS cluster FROM near JOIN member k ON near.other = k.id GROUP BY near.id) n USING (id))"""
    nearest = lambda v, k: f"SELECT a.id, b.id AS other FROM (SELECT id, {v} AS v FROM vec) a JOIN (SELECT id, {v} AS v FROM vec) b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) <= {k}"
    kd = f"SELECT d FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM dist) WHERE k = {MIN_SAMPLES}"
    cut_up = lambda t, n: f"(SELECT f FROM (SELECT string_split(line, '::') AS f FROM ({sample.duck(sample.LINES[t])}) WHERE line <> '') WHERE len(f) = {n})"
    number = lambda i: f"TRY_CAST(f[{i}] AS BIGINT)"
    typed_r = f"SELECT {number(1)} AS user_id, {number(2)} AS movie_id, {number(3)} AS rating, {number(4)} AS ts FROM {cut_up('ratings', 4)} WHERE {number(1)} + {number(2)} + {number(3)} + {number(4)} IS NOT NULL"
    typed_m = f"SELECT {number(1)} AS movie_id, f[2] AS title, CASE WHEN ends_with(f[2], ')') THEN TRY_CAST(regexp_extract(f[2], '\\(([^(]*)\\)$', 1) AS INTEGER) END AS year, f[3] AS genres FROM {cut_up('movies', 3)} WHERE {number(1)} IS NOT NULL"
    typed_u = f"SELECT {number(1)} AS user_id, f[2] AS gender, {number(3)} AS age, {number(4)} AS occupation, f[5] AS zipcode FROM {cut_up('users', 5)} WHERE {number(1)} IS NOT NULL"
    return {
        "typed_ratings": typed_r,
        "typed_movies": typed_m,
        "typed_users": typed_u,
        "time_split_summary": f"""SELECT s.split, coalesce(records, 0) AS records, coalesce(positives, 0) AS positives, coalesce(users, 0) AS users, coalesce(movies, 0) AS movies, min_ts, max_ts, round(coalesce(records, 0) / sum(coalesce(records, 0)) OVER (), 6) AS ratio, round(positives / nullif(records, 0), 6) AS positive_rate
            FROM (VALUES ('train'), ('validate'), ('test')) s(split) LEFT JOIN (SELECT {split} AS split, count(*) AS records, CAST(sum({lab}) AS BIGINT) AS positives, count(DISTINCT user_id) AS users, count(DISTINCT movie_id) AS movies, min(ts) AS min_ts, max(ts) AS max_ts FROM ({r}) GROUP BY 1) x USING (split)""",
        "time_quantiles": f"SELECT max(CASE WHEN k = CAST(floor(0.70 * (n - 1) + 0.5) AS BIGINT) + 1 THEN ts END) AS t1, max(CASE WHEN k = CAST(floor(0.85 * (n - 1) + 0.5) AS BIGINT) + 1 THEN ts END) AS t2 FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS n FROM ({r}))",
        "duplicate_pairs": f"SELECT count(*) AS records, count(DISTINCT (user_id, movie_id)) AS pairs, count(*) - count(DISTINCT (user_id, movie_id)) AS duplicates FROM ({r})",
        "history_features": f"SELECT user_id, movie_id, ts, rating, round(user_mean, 6) AS user_mean, round(movie_mean, 6) AS movie_mean, user_count, movie_count FROM ({hist})",
        "event_history": f"SELECT user_id, max(c) AS most_before, count(DISTINCT t) AS seconds FROM (SELECT user_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)) GROUP BY user_id",
        "feature_matrix": f"SELECT * REPLACE ({rounded(['user_mean', 'movie_mean', 'log1p_movie_count'])}) FROM ({matrix})",
        "point_history": f"""WITH h AS ({hist}) SELECT DISTINCT user_id, movie_id, ts AS asked_at, round(user_mean, 6) AS user_mean, user_count, round(movie_mean, 6) AS movie_mean, movie_count FROM h""",
        "seen_unseen": f"SELECT CASE WHEN user_id IN (SELECT user_id FROM ({train})) THEN 1 ELSE 0 END AS user_seen, CASE WHEN movie_id IN (SELECT movie_id FROM ({train})) THEN 1 ELSE 0 END AS movie_seen, count(*) AS records, CAST(sum({lab}) AS BIGINT) AS positives FROM ({r}) WHERE ts > {R.t2} GROUP BY 1, 2",
        "movie_popularity_top_quartile": f"SELECT movie_id, pop FROM ({pop}) WHERE pop >= {cut_}",
        "user_profile": f"SELECT user_id, status, fit, {rounded(profile.BASE)} FROM ({prof})",
        "genre_shares": f"SELECT user_id, {rounded(GENRES)} FROM ({prof})",
        "profile_zscore": f"WITH p AS MATERIALIZED ({prof}), s AS (SELECT {scale} FROM p) SELECT user_id, status, fit, {z} FROM p, s",
        "profile_status": f"SELECT status, count(*) AS users FROM ({prof}) GROUP BY status",
        "orphan_anti": f"SELECT DISTINCT user_id FROM ({typed_r}) WHERE ts <= {R.t1} AND user_id NOT IN (SELECT user_id FROM ({typed_u}))",
        "cluster_summary": f"SELECT cluster, count(*) AS size, {', '.join(f'round(avg({c}), 6) AS {c}_mean' for c in means)}, array_to_string(list_transform(list_sort([{tops}])[1:3], lambda x: x.g), ',') AS top_genres FROM ({clusters}) JOIN ({prof}) USING (user_id) WHERE cluster >= 0 GROUP BY cluster",
        "cluster_means": f"SELECT cluster, count(*) AS size, {', '.join(f'round(avg({quoted}), 6) AS {quoted}' for quoted in (chr(34) + n + chr(34) for n in profile.names(R)))} FROM ({clusters}) JOIN ({prof}) USING (user_id) WHERE cluster >= 0 GROUP BY cluster",
        "representative_items": f"""WITH b AS MATERIALIZED (SELECT user_id, movie_id, max(rating) AS best FROM ({typed_r}) WHERE ts <= {R.t1} GROUP BY user_id, movie_id), v AS (SELECT cluster, movie_id, count(*) AS votes FROM b JOIN ({clusters}) USING (user_id) WHERE best >= 4 AND cluster >= 0 GROUP BY 1, 2), k AS (SELECT v.*, raters, row_number() OVER (PARTITION BY cluster ORDER BY votes DESC, raters DESC, movie_id) AS place FROM v JOIN (SELECT movie_id, count(*) AS raters FROM b GROUP BY 1) USING (movie_id)),
            f AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY place) AS INTEGER) AS rank FROM k WHERE place <= 8 AND votes >= 2) SELECT cluster, rank, movie_id, coalesce(title, '#' || movie_id || '(缺失)') AS title, votes FROM f LEFT JOIN (SELECT movie_id, min(title) AS title FROM ({typed_m}) GROUP BY movie_id) USING (movie_id) WHERE rank <= 3""",
        "kdistance_percentiles": f"""WITH vec AS MATERIALIZED ({vec}), dist AS ({dist}), k AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS place, count(*) OVER () AS m FROM ({kd}))
            SELECT {', '.join(f'round(max(CASE WHEN place = CAST(floor({q} * (m - 1) + 0.5) AS BIGINT) THEN d END), 6) AS {n}' for n, q in (('min', 0.0), ('p50', 0.5), ('p75', 0.75), ('p90', 0.9), ('p95', 0.95), ('max', 1.0)))} FROM k""",
        "silhouette_by_label": f"""WITH vec AS MATERIALIZED ({vec}), dist AS ({dist}), t AS (SELECT id, cluster, other_cluster, avg(d) AS d FROM dist GROUP BY 1, 2, 3), e AS (SELECT id, cluster, max(CASE WHEN cluster = other_cluster THEN d END) AS a, min(CASE WHEN cluster <> other_cluster THEN d END) AS b FROM t GROUP BY 1, 2)
            SELECT CAST(cluster AS BIGINT) AS cluster, round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS size FROM e WHERE b IS NOT NULL GROUP BY cluster""",
        "sse_by_label": f"WITH vec AS MATERIALIZED ({vec}), c AS ({centre}) SELECT cluster, count(*) AS size, round(sum(d * d), 6) AS sse, round(avg(d), 6) AS spread FROM (SELECT cluster, list_distance(v, centre) AS d FROM vec JOIN c USING (cluster)) GROUP BY cluster",
        "dbi_by_label": f"""WITH vec AS MATERIALIZED ({vec}), c AS ({centre}), s AS (SELECT cluster, any_value(centre) AS centre, avg(list_distance(v, centre)) AS spread FROM vec JOIN c USING (cluster) GROUP BY cluster)
            SELECT round(avg(r), 6) AS dbi FROM (SELECT a.cluster, max((a.spread + b.spread) / list_distance(a.centre, b.centre)) AS r FROM s a JOIN s b ON a.cluster <> b.cluster GROUP BY a.cluster)""",
        "nearest_centroid": f"WITH vec AS MATERIALIZED ({vec}), c AS ({centre}) SELECT id, n.k AS cluster, round(n.d, 6) AS dist FROM (SELECT vec.id, min({{'d': list_distance(v, centre), 'k': c.cluster}}) AS n FROM vec CROSS JOIN c GROUP BY vec.id)",
        "eps_neighbours": f"WITH vec AS MATERIALIZED ({vec}) SELECT a.id, count(*) AS neighbours FROM vec a JOIN vec b ON list_distance(a.v, b.v) <= {EPS} GROUP BY a.id",
        "dbscan_core_points": f"WITH vec AS MATERIALIZED ({vec}) SELECT a.id FROM vec a JOIN vec b ON list_distance(a.v, b.v) <= {EPS} GROUP BY a.id HAVING count(*) >= {MIN_SAMPLES}",
        "gnb_scores": f"WITH {gnb} SELECT split, round(avg(score), 5) AS mean_score, round(min(score), 5) AS min_score, round(max(score), 5) AS max_score, count(*) AS records FROM sc GROUP BY split",
        "cart_predict": _tree_sql(matrix, columns),
        "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
        "event_props": """WITH e AS (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN left(props, length(props) - 1) WHEN event_id % 7 = 0 THEN regexp_replace(props, ': *([0-9]+)', ': "n\\1"') ELSE props END AS props FROM events),
            v AS (SELECT event_type, props, props IS NOT NULL AND NOT json_valid(props) AS bad, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.a.b') END AS ab FROM e)
            SELECT event_type, count(*) AS records, count(*) FILTER (WHERE props IS NULL) AS nulls, count(*) FILTER (WHERE bad) AS malformed, count(TRY_CAST(k AS BIGINT)) AS k_fits, count(k) - count(TRY_CAST(k AS BIGINT)) AS k_other, count(*) - count(k) AS k_none,
            count(ab) AS a_b_fits, 0::BIGINT AS a_b_other, count(*) - count(ab) AS a_b_none, CAST(sum(TRY_CAST(k AS BIGINT)) AS BIGINT) AS k_sum, count(DISTINCT k) AS k_texts FROM v GROUP BY event_type""",
        "missing_attributes": f"SELECT count(*) AS records, count(*) FILTER (WHERE has_attributes = 0) AS missing FROM ({matrix})",
        "threshold_scan": f"WITH {gnb} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(rate, 6) AS rate FROM ({scan(scored)})",
        "best_threshold": f"WITH {gnb} SELECT threshold, round(f1, 6) AS f1 FROM ({best_of(scored)})",
        "frozen_threshold": f"""WITH {gnb}, b AS MATERIALIZED ({best_of("SELECT * FROM sc WHERE split = 'validate'")}) SELECT {rates}, threshold FROM (SELECT any_value(threshold) AS threshold, {conf.replace(str(THRESHOLD), 'threshold')} FROM ({scored}), b)""",
        "confusion": f"WITH {gnb} SELECT {rates} FROM (SELECT {conf} FROM ({scored}))",
        "strata_eval": f"WITH {gnb} " + " UNION ALL ".join(stratum(n, c) for n, c in (("user_seen_in_train", "user_seen = 1"), ("user_unseen_in_train", "user_seen = 0"), ("movie_seen_in_train", "movie_seen = 1"), ("movie_unseen_in_train", "movie_seen = 0"))),
        "roc_auc": f"WITH {gnb} SELECT round(({roc(scored)}), 6) AS roc_auc",
        "average_precision": f"WITH {gnb} SELECT round(({pr(scored)}), 6) AS average_precision",
        "cluster_assignments": f"""WITH {users27}, c AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS k, v AS centre FROM uv WHERE fit = 1 QUALIFY row_number() OVER (ORDER BY id) <= 3),
            n AS (SELECT uv.id, min({{'d': list_distance(v, centre), 'k': k}}) AS n FROM uv CROSS JOIN c WHERE v IS NOT NULL GROUP BY uv.id)
            SELECT uv.id, n.n.k AS cluster, CASE WHEN v IS NULL THEN 'NO_TRAIN_HISTORY' WHEN fit = 1 THEN 'SUCCESS' ELSE 'ASSIGNED_FROM_FITTED_CENTROIDS' END AS status, CASE WHEN fit = 1 THEN 0 ELSE 1 END AS reliability_low, round(n.n.d, 4) AS dist FROM uv LEFT JOIN n USING (id)""",
        "dbscan_labels": f"WITH RECURSIVE {dbscan} SELECT id, cluster, core FROM labels",
        "dbscan_noise": f"WITH RECURSIVE {dbscan} SELECT count(*) AS points, count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS clusters, count(*) FILTER (WHERE cluster < 0) AS noise, round(count(*) FILTER (WHERE cluster < 0) / count(*), 6) AS noise_ratio FROM labels",
        "pca_covariance": """WITH e AS MATERIALIZED (SELECT vec_id, CAST(i AS INTEGER) - 1 AS i, x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))
            SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 8) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""",
        "pca_recomposed": """WITH e AS MATERIALIZED (SELECT vec_id, CAST(i AS INTEGER) - 1 AS i, x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))
            SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 8) AS cov, CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dot FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""",
        "kmeans_rounds": _lloyd_sql(vec),
        "event_values": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, coalesce(format('{:,.2f}', value), '—') AS value_text, round(CASE WHEN max(value) OVER () > min(value) OVER () THEN (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) ELSE 0.5 END, 9) AS place, coalesce(isfinite(value), false) AS fine FROM events",
        "plain_texts": r"SELECT doc_id, sha256(regexp_replace(text, '[^\x00-\x7F]', '?', 'g')) AS ascii_sha256, replace(replace(lower(lang || ' Child''s ' || source), chr(39), ''), ' ', '_') AS slug FROM documents",
        "line_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS lines FROM ({sample.duck(sample.LINES[t])})" for t in files.COLUMNS),
        "saved_profile": f"SELECT user_id, status, fit, 'v1' AS version, {rounded(profile.BASE)} FROM ({prof})",
        "knn_overlap": f"WITH vec AS MATERIALIZED ({vec}), h AS ({nearest('v', 10)}), l AS ({nearest('list_transform(range(0, 8), lambda i: list_sum(v[i * 8 + 1:i * 8 + 8]) / 8)', 10)}) SELECT round(count(*) / 10.0 / (SELECT count(*) FROM vec), 6) AS agreement, round(10.0 / ((SELECT count(*) FROM vec) - 1), 6) AS baseline FROM h JOIN l USING (id, other)",
    }
