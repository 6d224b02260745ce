"""Dimensionality reduction: PCA from one distributed Gram matrix, and how well neighbours are kept (t-SNE is in tsne.py)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.operators.pairs import nearest
from sievestone.operators.vectors import matrix, on_usable


@on_usable
def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and sums of products of the components.

    A task gives one row a component and one a pair of components, and those are summed with map-side combining:
    no task gathers the tasks' matrices.
    """
    first = vectors.select(F.size("v")).first()
    d = first[0] if first else 0
    if not d:
        return 0, np.zeros(0), np.zeros((0, 0))
    at = np.triu_indices(d + 1)

    def work(batches):
        g, some = np.zeros((d + 1, d + 1)), False
        for b in batches:
            if b.num_rows:
                x = np.concatenate((np.ones((b.num_rows, 1)), matrix(b)), axis=1)
                g, some = g + x.T @ x, True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at[0])), pa.int32()), pa.array(g[at])], names=["cell", "total"])

    cells = vectors.select("v").mapInArrow(work, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    g = np.zeros((d + 1, d + 1))
    for r in cells:
        g[at[0][r["cell"]], at[1][r["cell"]]] = r["total"]
    g = g + np.triu(g, 1).T
    return int(g[0, 0]), g[0, 1:], g[1:, 1:]


@on_usable
def covariance(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (n - 1)."""
    n, s, g = moments(vectors)
    if n < 2:
        raise ValueError("at least two vectors are needed")
    mean = s / n
    return mean, (g - n * np.outer(mean, mean)) / (n - 1)


@on_usable
def pca(vectors: DataFrame, dims: int = 2, share: float = 0.8) -> dict:
    """mean, components (rows), eigenvalues, explained shares, how many reach `share`, and how many have no variance.

    In each component the largest loading is positive.
    """
    mean, cov = covariance(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = np.clip(values[::-1], 0, None), axes[:, ::-1].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    part = values / values.sum() if values.sum() > 0 else np.zeros_like(values)
    reached = np.flatnonzero(np.cumsum(part) >= share)
    return {"mean": mean, "components": axes[:dims], "eigenvalues": values, "explained": part, "cumulative": np.cumsum(part), "dims_for_share": int(reached[0]) + 1 if len(reached) else len(values), "without_variance": int((values < 1e-12).sum())}


def project(vectors: DataFrame, model: dict) -> DataFrame:
    """`vectors` with v in the components' axes."""
    centred = lambda i: F.get("v", F.lit(i)) - float(model["mean"][i])
    out = [sum((centred(i) * float(w) for i, w in enumerate(axis)), F.lit(0.0)) for axis in model["components"]]
    return vectors.withColumn("v", F.array(*out))


def loadings(model: dict, names: list[str], top: int = 5) -> list[dict]:
    """For each component of a PCA its explained share and the features that weigh most in it, ties in order of the features."""
    out = []
    for i, axis in enumerate(model["components"]):
        order = sorted(range(len(axis)), key=lambda j: (-abs(axis[j]), j))[:top]
        out.append({"component": i + 1, "explained": float(model["explained"][i]), "features": [{"feature": names[j], "loading": float(axis[j])} for j in order]})
    return out


@on_usable
def knn_agreement(high: DataFrame, low: DataFrame, k: int = 10) -> DataFrame:
    """(agreement, baseline): mean share of k nearest neighbours that both spaces have in common, and what chance gives."""
    n = high.count()
    if n <= k + 1:
        return high.sparkSession.createDataFrame([(None, None)], "agreement double, baseline double")
    sets = lambda df, name: nearest(df, df, k).groupBy("id").agg(F.collect_set("other").alias(name))
    both = sets(high, "a").join(sets(low, "b"), "id")
    return both.agg(F.avg(F.size(F.array_intersect("a", "b")) / F.lit(float(k))).alias("agreement")).withColumn("baseline", F.lit(k / (n - 1)))
