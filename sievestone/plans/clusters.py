"""Clustering and reduction for users: what is fitted, whom it tells something about, and how a reduction changes it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.operators import clustering, pairs, profile, reduce, tsne
from sievestone.plans.rules import Rules
from sievestone.plans.service import TaskError
from sievestone.session import cut

#: What a user's assignment is.
SUCCESS, PROJECTED, NOISE, SPARSE, NONE = "SUCCESS", "ASSIGNED_FROM_FITTED_CENTROIDS", "UNASSIGNED_BY_DENSITY", "INSUFFICIENT_HISTORY", "NO_TRAIN_HISTORY"
#: Users that a reduction needs, K of the comparison, and its tolerance.
LEAST_USERS, COMPARED_K, COMPARED_TOLERANCE = 3, 6, 1e-6


def user_vectors(rows: DataFrame, rules: Rules) -> DataFrame:
    """(id, status, fit, v) of every user of a profile: z-scores of all measures, null without train history."""
    columns = profile.names(rules)
    z = profile.zscores(rows, columns)
    some = F.col("status") != profile.NONE
    return z.select(F.col("user_id").alias("id"), "status", "fit", F.when(some, F.array(*columns)).alias("v"))


def fitted(users: DataFrame) -> DataFrame:
    """(id, v) of the users that models are fitted on."""
    return users.filter("fit = 1").select("id", "v")


def resolve(users: DataFrame, asked: list[int] | None) -> tuple[DataFrame, list[int]]:
    """The users that were asked for, all that fit where none was, and the asked ids that aren't known."""
    if not asked:
        return users.filter("fit = 1"), []
    found = users.join(users.sparkSession.createDataFrame([(i,) for i in sorted(set(asked))], "id long"), "id", "left_semi")
    known = {r["id"] for r in found.select("id").collect()}
    return found, sorted(set(asked) - known)


def kmeans_assignments(users: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cluster, status, reliability_low, dist): who was fitted is assigned, who has a vector is projected, others aren't."""
    some = clustering.assign(users.filter("v is not null"), centres).select("id", F.when(F.col("fit") == 1, SUCCESS).otherwise(PROJECTED).alias("status"), "cluster", "dist")
    rest = users.filter("v is null").select("id", F.lit(NONE).alias("status"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("dist"))
    return some.union(rest).select("id", "cluster", "status", (F.col("status") != SUCCESS).cast("int").alias("reliability_low"), "dist")


def dbscan_assignments(users: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, cluster, status, reliability_low) from labels (id, cluster) of those who were fitted: noise and others have no cluster."""
    rows = users.join(labels.select("id", F.col("cluster").alias("label")), "id", "left")
    status = F.when(F.col("v").isNull(), NONE).when(F.col("label").isNull(), SPARSE).when(F.col("label") < 0, NOISE).otherwise(SUCCESS)
    return rows.select("id", F.when(F.col("label") >= 0, F.col("label")).cast("int").alias("cluster"), status.alias("status"), (status != SUCCESS).cast("int").alias("reliability_low"))


def noise_summary(labels: DataFrame) -> DataFrame:
    """(points, clusters, noise, noise_ratio) of labels (id, cluster); the ratio is null without points."""
    noise = F.count_if(F.col("cluster") < 0)
    return labels.agg(F.count("*").alias("points"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), noise.alias("noise"), F.try_divide(noise, F.count("*")).alias("noise_ratio"))


def sizes(labels: DataFrame) -> DataFrame:
    """(cluster, size), noise left out."""
    return labels.filter("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("size"))


def measured(labelled: DataFrame) -> dict:
    """silhouette, dbi and sse over all rows; null with fewer than two clusters (sse: with none)."""
    return {"silhouette": pairs.silhouettes(labelled).agg(F.avg("s")).first()[0], "dbi": pairs.davies_bouldin(labelled).first()["dbi"], "sse": pairs.scatter(labelled).agg(F.sum("sse")).first()[0]}


def kmeans_run(users: DataFrame, k: int | None = None, asked: list[int] | None = None, seed: int = 42, max_iter: int = 100, candidates: list[int] | None = None) -> dict:
    """Choose k (2 to 8, unless it or others are given), fit it on the users that fit, measure it, and assign those who were asked for."""
    vectors = cut(fitted(users))
    n = vectors.count()
    if n < 2:
        raise TaskError("ALGORITHM_ERROR", "fewer than two users fit")
    if k is not None and not 2 <= k <= n:
        raise TaskError("INVALID_PARAMETER", f"k must lie between 2 and {n}")
    table = clustering.choose_k(vectors, [k] if k else [x for x in candidates or range(2, 9) if x <= n], seed, max_iter)
    best = table[0]
    chosen, missing = resolve(users, asked)
    return {
        "algorithm": "kmeans", "parameters": {"k": best["k"], "seed": seed, "max_iter": max_iter}, "metrics": {m: best[m] for m in ("silhouette", "dbi", "sse")},
        "candidates": [{c: r[c] for c in ("k", "sampled", "sse")} for r in sorted(table, key=lambda r: r["k"])], "centres": best["centres"], "labels": best["labelled"].select("id", "cluster"),
        "assignments": kmeans_assignments(chosen if asked else users, best["centres"]), "unknown_users": missing,
    }


def dbscan_run(users: DataFrame, eps: float | None = None, min_samples: int = 15, asked: list[int] | None = None) -> dict:
    """Cluster the users that fit by density (eps: the 90th percentile of k-distances, unless it is given), and tell about those who were asked for."""
    vectors = cut(fitted(users))
    if vectors.count() < min_samples + 1:
        raise TaskError("ALGORITHM_ERROR", "fewer users fit than min_samples and one more")
    eps = clustering.suggested_eps(vectors, min_samples) if eps is None else eps
    labels = cut(clustering.dbscan(vectors, eps, min_samples).select("id", "cluster"))
    labelled = cut(vectors.join(labels, "id"))
    noise = noise_summary(labels).first().asDict()
    chosen, missing = resolve(users, asked)
    return {
        "algorithm": "dbscan", "parameters": {"eps": eps, "min_samples": min_samples}, "metrics": {**measured(labelled), **noise}, "labels": labels,
        "assignments": dbscan_assignments(chosen if asked else users, labels), "unknown_users": missing,
    }


def eps_probes(vectors: DataFrame, min_samples: int, shares: tuple = (0.50, 0.75)) -> list[dict]:
    """What DBSCAN finds at lesser eps: at these percentiles of the k-distances."""
    rows = cut(vectors.select("id", "v"))
    names = {f"p{round(100 * q)}": q for q in shares}
    found = pairs.nearest_rank(pairs.kth_distances(rows, min_samples), "dist", names).first().asDict()
    return [{"share": q, "eps": found[n], **noise_summary(clustering.dbscan(rows, found[n], min_samples)).first().asDict()} for n, q in names.items() if found[n] is not None]


def compare(before: DataFrame, after: DataFrame, k: int = COMPARED_K, seed: int = 42, eps: float | None = None, min_samples: int = 15) -> dict:
    """The same clustering of the same points (id, v) in two spaces: K-Means always, DBSCAN where eps is given.

    A difference is null where either measure is.  SSE is less in fewer dimensions anyway, and eps means another
    density there, so silhouette and Davies-Bouldin are what to go by.
    """
    n = before.count()
    if not 2 <= k <= n:
        raise TaskError("INVALID_PARAMETER", f"k must lie between 2 and {n}")
    sides = {"before": cut(before.select("id", "v")), "after": cut(after.select("id", "v"))}
    found = {name: measured(cut(clustering.kmeans(df, k, seed, 100, COMPARED_TOLERANCE)[0])) for name, df in sides.items()}
    gap = lambda a, b: None if a is None or b is None else a - b
    out = {"kmeans": {"k": k, **found, "delta": {m: gap(found["after"][m], found["before"][m]) for m in ("silhouette", "dbi", "sse")}}}
    if eps is not None:
        out["dbscan"] = {"eps": eps, "min_samples": min_samples}
        for name, df in sides.items():
            labels = cut(clustering.dbscan(df, eps, min_samples))
            out["dbscan"][name] = noise_summary(labels).first().asDict() | {"silhouette": pairs.silhouettes(df.join(labels.select("id", "cluster"), "id")).agg(F.avg("s")).first()[0]}
    return out


def reduction_run(users: DataFrame, names: list[str], method: str = "pca", asked: list[int] | None = None, dims: int = 2, perplexity: float = 30.0, rounds: int = 500, seed: int = 42, k: int = COMPARED_K, eps: float | None = None, share: float = 0.8, rate: float | None = None, neighbours: int = 10) -> dict:
    """Reduce the users that fit (of those who were asked for) and compare clusterings before and after.

    Users who don't fit but have a vector are projected by PCA; t-SNE has no projection, so it leaves them out.
    """
    chosen, missing = resolve(users, asked)
    fit = cut(chosen.filter("fit = 1").select("id", "v"))
    n = fit.count()
    if n < LEAST_USERS:
        raise TaskError("ALGORITHM_ERROR", f"a reduction needs {LEAST_USERS} users that fit, not {n}")
    out: dict = {"algorithm": method, "unknown_users": missing}
    if method == "pca":
        model = reduce.pca(fit, dims, share)
        after = reduce.project(fit, model)
        others = reduce.project(chosen.filter("fit = 0 and v is not null").select("id", "v"), model)
        top = {m: [float(x) for x in model[m][:10]] for m in ("explained", "cumulative", "eigenvalues")}
        out |= {"metrics": {**top, "dims_for_share": model["dims_for_share"], "without_variance": model["without_variance"]}, "loadings": reduce.loadings(model, names), "projected": others, "model": {m: np.asarray(model[m]).tolist() for m in ("mean", "components")}}
    else:
        after, stats = tsne.tsne_with_stats(fit, perplexity, rounds, seed, rate)
        agreement = reduce.knn_agreement(fit, after.select("id", F.array("x", "y").alias("v")), min(neighbours, n - 2)).first()
        after = after.select("id", F.array("x", "y").alias("v"))
        out |= {"metrics": {**stats, **(agreement.asDict() if agreement else {})}}
    after = cut(after)
    return out | {"coordinates": after, "comparison": compare(fit, after, min(k, n), seed, eps)}
