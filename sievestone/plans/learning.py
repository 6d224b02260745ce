"""The classification run: train, choose, freeze, test, save; and what a saved model makes of one user and movie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.operators import classify, temporal
from sievestone.plans.rules import Rules
from sievestone.plans.service import TaskError, fingerprint
from sievestone.session import written
from sievestone.sources import artefacts

FEATURES = "features-v1"
HIGH, LOW = "HIGH_RATING", "LOW_RATING"
#: What every result is told with.
LIMITS = ("The score isn't calibrated; its threshold was chosen on the validation split.", "The model knows nothing after the train period.")
FALLBACK = "Without earlier ratings of the user or the movie its mean is that of the train period."


def run(ratings: DataFrame, movies: DataFrame, users: DataFrame, rules: Rules, kinds: tuple = ("gnb", "cart"), grid: dict | None = None) -> dict[str, dict]:
    """A result of classify.train for each kind, over the whole feature matrix."""
    matrix = written(temporal.feature_matrix(ratings, movies, users, rules, seen=True))
    return {k: classify.train(k, matrix, temporal.feature_names(rules), (grid or {}).get(k)) for k in kinds}


def card(result: dict, meta: dict) -> str:
    """A model card in Markdown."""
    shown = lambda x: "—" if x is None else f"{x:,}" if isinstance(x, int) else f"{x:.6f}"
    rows = lambda names, *parts: [f"| {n} | " + " | ".join(shown(p.get(n)) for p in parts) + " |" for n in names]
    lines = [f"# {meta['kind']} {meta['version']}", "", f"Settings {result['settings']}, features {meta['feature_version']}, data {meta['data_version']}, t1 {meta['t1']}, t2 {meta['t2']}.", ""]
    lines += ["| Measure | Validation | Test | Test at 0.5 |", "| --- | --- | --- | --- |"]
    lines += rows(("n", "positive_rate", "roc_auc", "pr_auc", "threshold", "accuracy", "precision", "recall", "f1", "predicted_rate"), result["validation"], result["test"], result["test_at_half"])
    lines += ["", "| Stratum of the test | n | ROC | PR | F1 |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {name} | {shown(s.get('n'))} | {shown(s.get('roc_auc'))} | {shown(s.get('pr_auc'))} | {shown(s.get('f1'))} |" for name, s in result["strata"].items()]
    return "\n".join([*lines, "", *(f"* {x}" for x in (*LIMITS, FALLBACK)), ""])


def save(spark: SparkSession, folder: str, result: dict, rules: Rules, data_version: str, version: str | None = None) -> str:
    """The version under which a result was saved: its model, measures and card."""
    kind = result["kind"]
    content = {k: v for k, v in result.items() if k != "model"} | {"model": result["model"].as_dict()}
    meta = content | {"feature_version": FEATURES, "data_version": data_version, "t1": rules.t1, "t2": rules.t2, "model_version": fingerprint("mdl", content["model"]), "columns": result["model"].columns}
    path = artefacts.save(spark, folder, kind, version, meta, reports={"card.md": lambda v: card(result, meta | {"version": v})})
    return path.rsplit("/", 1)[-1]


def load(spark: SparkSession, folder: str, kind: str, version: str | None = None) -> tuple[classify.Gaussian | classify.Tree, dict]:
    """(model, description); a model of other features is refused."""
    try:
        meta, _ = artefacts.load(spark, folder, kind, version, feature_version=FEATURES)
    except artefacts.ArtefactError as e:
        raise TaskError(e.code, str(e)) from e
    return classify.model_of(meta["model"]), meta


def one_row(ratings: DataFrame, movies: DataFrame, users: DataFrame, rules: Rules, user_id: int, movie_id: int, at: int | None = None) -> tuple[DataFrame, dict]:
    """The features of one user and movie, and what they come from.

    Without a time they see the train period whole; with one, only ratings strictly before it.  Users and movies that
    the tables don't have are refused.
    """
    known = lambda df, key, value: not df.filter(F.col(key) == value).isEmpty()
    if not known(users, "user_id", user_id) and not known(ratings, "user_id", user_id):
        raise TaskError("UNKNOWN_USER", f"no user {user_id}", user_id=user_id)
    if not known(movies, "movie_id", movie_id):
        raise TaskError("UNKNOWN_MOVIE", f"no movie {movie_id}", movie_id=movie_id)
    seen = F.col("ts") <= rules.t1 if at is None else F.col("ts") < at
    past = ratings.filter(seen & ((F.col("user_id") == user_id) | (F.col("movie_id") == movie_id)))
    of = lambda key, value: F.when(F.col(key) == value, F.col("rating"))
    found = past.agg(*[x for p, k, v in (("user", "user_id", user_id), ("movie", "movie_id", movie_id)) for x in (F.avg(of(k, v)).alias(f"{p}_mean"), F.count(of(k, v)).alias(f"{p}_count"))]).first()
    mean = temporal.train_mean(ratings, rules) or 0.0
    value = {p: mean if found[f"{p}_mean"] is None else found[f"{p}_mean"] for p in ("user", "movie")}
    spark = ratings.sparkSession
    base = spark.createDataFrame([(user_id, movie_id, value["user"], value["movie"], found["movie_count"])], "user_id long, movie_id long, user_mean double, movie_mean double, movie_count long")
    row = temporal.with_attributes(base, movies.filter(F.col("movie_id") == movie_id), users.filter(F.col("user_id") == user_id), rules)
    info = {
        "basis": f"train_snapshot(T1={rules.t1})" if at is None else f"history_before(prediction_time={at})",
        "features": {f"{p}_{k}": v for p in ("user", "movie") for k, v in (("mean", round(value[p], 4)), ("history_count", found[f"{p}_count"]), ("mean_source", "history" if found[f"{p}_count"] else "fallback_global_mean"))},
        "limits": [*LIMITS, *([FALLBACK] if not (found["user_count"] and found["movie_count"]) else [])],
    }
    return row, info


def classify_one(spark: SparkSession, folder: str, tables: dict[str, DataFrame], rules: Rules, user_id: int, movie_id: int, at: int | None = None, kind: str | None = None, version: str | None = None) -> dict:
    """What the saved models of each kind, or of one, make of a user and a movie: class, score, threshold and why."""
    if kind not in (None, *classify.GRID):
        raise TaskError("INVALID_PARAMETER", f"unknown algorithm: {kind}", allowed=list(classify.GRID))
    row, info = one_row(tables["ratings"], tables["movies"], tables["users"], rules, user_id, movie_id, at)
    results = []
    for k in [kind] if kind else list(classify.GRID):
        model, meta = load(spark, folder, k, version)
        values = model.score(row).first().asDict()
        results.append({
            "algorithm": k, "model_version": meta["model_version"], "predicted_class": HIGH if values["score"] >= meta["threshold"] else LOW, "score": round(values["score"], 6), "threshold": meta["threshold"],
            "settings": meta["settings"], "test": {m: meta["test"].get(m) for m in ("roc_auc", "pr_auc")}, "explanation": classify.explain(model, values), "prediction_time_basis": info["basis"], "features": info["features"], "limits": info["limits"],
        })
    return {"target": {"user_id": user_id, "movie_id": movie_id}, "t1": rules.t1, "t2": rules.t2, "results": results}
