"""The tools that the service runs, over one workspace of tables: each gives an envelope with the same keys.

What a tool finds for each user is a table in the envelope's `tables`, with every user that it is about.  Beside it
the envelope lists the rows of the users that were asked for, or the first SHOWN where none was, and how many there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.operators import profile, reduce
from sievestone.plans import clusters, learning
from sievestone.plans.config import Config
from sievestone.plans.limits import attempts
from sievestone.plans.rules import Rules
from sievestone.plans.service import TaskError, accepted, fingerprint, user_ids
from sievestone.session import written
from sievestone.sources import artefacts

#: Users that an envelope lists beside its tables where none was asked for.
SHOWN = 50


@dataclass
class Workspace:
    """Cleaned tables (ratings, movies, users), their rules and version, and the folder that models are kept in."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    rules: Rules
    folder: str
    data_version: str
    min_ratings: int = 20
    notes: list = field(default_factory=list)

    @cached_property
    def profile(self) -> DataFrame:
        """The users' profile, written once."""
        t = self.tables
        return written(profile.profile(t["ratings"], t["movies"], t["users"], self.rules, self.min_ratings))

    @cached_property
    def users(self) -> DataFrame:
        return written(clusters.user_vectors(self.profile, self.rules))

    @cached_property
    def orphans(self) -> int:
        """Raters of the train period that are no users."""
        return profile.orphans(self.tables["ratings"], self.tables["users"], self.rules).count()

    @cached_property
    def scaler(self) -> dict:
        return profile.scaler(self.profile, profile.names(self.rules))

    def save_profile(self, version: str | None = None) -> str:
        """The version under which the profile and its scaler were saved."""
        meta = {"data_version": self.data_version, "features": profile.names(self.rules), "scaler": self.scaler, "min_ratings": self.min_ratings, "t1": self.rules.t1, "orphans": self.orphans}
        return artefacts.save(self.spark, self.folder, "profile", version, meta, {"users": self.profile}).rsplit("/", 1)[-1]

    def load_profile(self, version: str | None = None) -> DataFrame:
        """A saved profile of the same data."""
        _, path = artefacts.load(self.spark, self.folder, "profile", version, data_version=self.data_version)
        return artefacts.tables_of(self.spark, path, "users")


def _rows(df: DataFrame, asked: list[int] | None) -> list[dict]:
    """The rows of the users that were asked for, or the first SHOWN by id."""
    return [r.asDict() for r in df.orderBy("user_id").limit(len(set(asked)) if asked else SHOWN).collect()]


def _listed(name: str, df: DataFrame, asked: list[int] | None) -> dict:
    """A table of users as an envelope has it: its rows that are listed, and how many there are."""
    return {name: _rows(df, asked), f"{name}_total": df.count()}


def _envelope(space: Workspace, result: dict, category: str, **more) -> dict:
    limits = [f"{space.orphans} raters of the train period are no users and take no part."] if space.orphans else []
    limits += [f"Unknown users got nothing: {result['unknown_users']}."] if result.get("unknown_users") else []
    core = {"category": category, "algorithm": result["algorithm"], "parameters": result.get("parameters"), "metrics": result["metrics"], "data_version": space.data_version, "t1": space.rules.t1, "t2": space.rules.t2, **more}
    return {**core, "unknown_users": result.get("unknown_users", []), "limits": limits, "model_version": fingerprint("mdl", [core["algorithm"], core["parameters"], core["data_version"], core["t1"]], 10)}


def _summaries(space: Workspace, labels: DataFrame) -> list[dict]:
    """What the clusters of the users that fit are like, whoever was asked for."""
    own = labels.withColumnRenamed("id", "user_id")
    movies = {}
    for r in profile.representative_movies(own, space.tables["ratings"], space.tables["movies"], space.rules).orderBy("cluster", "rank").collect():
        movies.setdefault(r["cluster"], []).append({"movie_id": r["movie_id"], "title": r["title"], "votes": r["votes"]})
    means = {r["cluster"]: {c: r[c] for c in profile.names(space.rules)} for r in profile.cluster_means(own, space.profile, space.rules).collect()}
    return [{**r.asDict(), "means": means[r["cluster"]], "representative_movies": movies.get(r["cluster"], [])} for r in profile.cluster_summary(own, space.profile, space.rules).orderBy("cluster").collect()]


def _asked(plan: dict) -> list[int] | None:
    return user_ids(plan["user_ids"]) if plan.get("user_ids") else None


def _clustering(space: Workspace, r: dict, asked: list[int] | None, model: dict, **more) -> dict:
    """The envelope of a clustering: every user's assignment, the labels of those that fit, and what assigns others."""
    rows = written(r["assignments"].withColumnRenamed("id", "user_id"))
    labels = written(r["labels"].withColumnRenamed("id", "user_id"))
    tables = {"assignments": rows, "labels": labels}
    return _envelope(space, r, "clustering", **_listed("assignments", rows, asked), clusters=_summaries(space, r["labels"]), model=model, tables=tables, **more)


def kmeans_tool(space: Workspace, plan: dict, given: dict) -> dict:
    asked = _asked(plan)
    r = clusters.kmeans_run(space.users, given.get("k"), asked, given.get("seed", 42), given.get("max_iter", 100), given.get("k_candidates"))
    return _clustering(space, r, asked, {"centres": [[float(x) for x in c] for c in r["centres"]]}, candidates=r["candidates"])


def dbscan_tool(space: Workspace, plan: dict, given: dict) -> dict:
    asked = _asked(plan)
    r = clusters.dbscan_run(space.users, given.get("eps"), given.get("min_samples", 15), asked)
    return _clustering(space, r, asked, {"eps": r["parameters"]["eps"], "min_samples": r["parameters"]["min_samples"]})


def _reduction(space: Workspace, plan: dict, method: str, **given) -> dict:
    asked = _asked(plan)
    r = clusters.reduction_run(space.users, profile.names(space.rules), method, asked, **given)
    plain = lambda df: written(df.select(F.col("id").alias("user_id"), F.col("v").alias("coordinates")))
    tables = {name: plain(r[name]) for name in ("coordinates", "projected") if name in r}
    listed = _listed("coordinates", tables["coordinates"], asked) | (_listed("projected", tables["projected"], asked) if "projected" in tables else {"projected": [], "projected_total": 0})
    return _envelope(space, r, "dimensionality_reduction", **listed, loadings=r.get("loadings"), comparison=r["comparison"], model=r.get("model"), tables=tables)


def pca_tool(space: Workspace, plan: dict, given: dict) -> dict:
    names = {"dims": "target_dimensions", "share": "information_retention_threshold", "k": "clustering_k", "seed": "clustering_seed"}
    return _reduction(space, plan, "pca", **{k: given[v] for k, v in names.items() if v in given})


def tsne_tool(space: Workspace, plan: dict, given: dict) -> dict:
    names = {"perplexity": "perplexity", "rounds": "n_iter", "rate": "learning_rate", "neighbours": "knn_k", "seed": "random_state", "k": "clustering_k"}
    return _reduction(space, plan, "tsne", **{k: given[v] for k, v in names.items() if v in given})


def _classification(space: Workspace, plan: dict, kind: str) -> dict:
    target = plan.get("target") or {}
    if not {"user_id", "movie_id"} <= set(target):
        raise TaskError("INVALID_REQUEST", "classification takes a user and a movie")
    r = learning.classify_one(space.spark, space.folder, space.tables, space.rules, target["user_id"], target["movie_id"], target.get("prediction_time"), kind)["results"][0]
    return _envelope(space, {"algorithm": kind, "parameters": r["settings"], "metrics": r["test"]}, "classification", target=target, prediction=r)


def gnb_tool(space: Workspace, plan: dict, given: dict) -> dict:
    return _classification(space, plan, "gnb")


def cart_tool(space: Workspace, plan: dict, given: dict) -> dict:
    return _classification(space, plan, "cart")


def run_plan(space: Workspace, plan: dict, config: Config | None = None) -> dict:
    """The results of a routed plan's algorithms, ready for JSON; each is saved, with its tables whole, before it is told.

    A tool gets its declared defaults and runs under its declared limit, twice at most.  One that fails leaves its error; the
    task fails where all do.  `execution` tells how each ran.
    """
    config = config or Config()
    results, errors, execution = {}, {}, {}
    for algorithm in plan["algorithms"]:
        try:
            tool = config.tool(plan["category"], algorithm, (plan.get("parameters") or {}).get(algorithm))
            found, execution[algorithm] = attempts(space.spark, lambda t=tool: t.run(space, plan, t.parameters), tool.seconds, tool.name)
            envelope = accepted(tool.name, found, plan["category"])
            version = save_result(space, algorithm, envelope)
            results[algorithm] = {k: v for k, v in envelope.items() if k != "tables"} | {"saved": {"version": version, "folder": f"{space.folder}/result_{algorithm}/{version}", "tables": sorted(envelope.get("tables") or {})}}
        except TaskError as e:
            errors[algorithm] = e.as_dict()
    if not results:
        first = next(iter(errors.values()))
        raise TaskError(first["code"], first["message"], **first.get("detail", {}))
    return {"category": plan["category"], "results": results, "errors": errors or None, "execution": execution, "notes": plan.get("notes", [])}


def save_result(space: Workspace, name: str, envelope: dict, version: str | None = None) -> str:
    """The version under which an envelope was saved: its tables as Parquet, the rest with the scaler as JSON, and a report in Markdown."""

    def report(v: str) -> str:
        lines = [f"# {name} {v}", "", f"Data {space.data_version}, t1 {space.rules.t1}, t2 {space.rules.t2}, model {envelope['model_version']}.", "", "| Measure | Value |", "| --- | --- |"]
        lines += [f"| {k} | {'—' if x is None else x} |" for k, x in (envelope["metrics"] or {}).items()]
        return "\n".join([*lines, "", *(f"* {x}" for x in envelope["limits"]), ""])

    meta = {"envelope": {k: x for k, x in envelope.items() if k not in ("tables", "model")}, "model": envelope.get("model"), "data_version": space.data_version}
    if envelope.get("model"):
        meta |= {"features": profile.names(space.rules), "scaler": space.scaler}
    return artefacts.save(space.spark, space.folder, f"result_{name}", version, meta, envelope.get("tables"), {"report.md": report}).rsplit("/", 1)[-1]


def load_result(space: Workspace, name: str, version: str | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """(description, tables) of a saved result."""
    try:
        meta, path = artefacts.load(space.spark, space.folder, f"result_{name}", version)
    except artefacts.ArtefactError as e:
        raise TaskError(e.code, str(e)) from e
    return meta, {t: artefacts.tables_of(space.spark, path, t) for t in artefacts.names(space.spark, path) if "." not in t and not t.startswith("_")}


def place_users(space: Workspace, name: str, profiles: DataFrame, version: str | None = None) -> DataFrame:
    """What a saved K-Means or PCA makes of users that it wasn't fitted on, by its own scaler: (user_id, cluster, dist) or (user_id, coordinates).

    `profiles` has the rows of a profile; users without measures are left out.
    """
    meta, _ = load_result(space, name, version)
    if not meta["model"] or not {"centres", "components"} & set(meta["model"]):
        raise TaskError("INVALID_PARAMETER", f"{name} places no users")
    if meta["features"] != profile.names(space.rules):
        raise TaskError("VERSION_MISMATCH", "the result is of other measures")
    some = profiles.filter(F.col("status") != profile.NONE)
    rows = profile.scaled(some, meta["features"], {c: tuple(x) for c, x in meta["scaler"].items()}).select(F.col("user_id").alias("id"), F.array(*meta["features"]).alias("v"))
    if "centres" in meta["model"]:
        return clusters.clustering.assign(rows, np.array(meta["model"]["centres"])).select(F.col("id").alias("user_id"), "cluster", "dist")
    return reduce.project(rows, meta["model"]).select(F.col("id").alias("user_id"), F.col("v").alias("coordinates"))


def workspace(spark: SparkSession, ratings: DataFrame, movies: DataFrame, users: DataFrame, rules: Rules, folder: str, data_version: str, **more) -> Workspace:
    """A workspace over tables as sources/files.py types them, or with genres joined by | and text columns age and occup."""
    if dict(movies.dtypes)["genres"].startswith("array"):
        movies = movies.withColumn("genres", F.array_join("genres", "|"))
    if "occupation" in users.columns:
        users = users.select("user_id", "gender", F.col("age").cast("string").alias("age"), F.col("occupation").cast("string").alias("occup"), "zipcode")
    return Workspace(spark, {"ratings": written(ratings), "movies": written(movies), "users": written(users)}, rules, folder, data_version, **more)
