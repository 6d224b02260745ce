"""Command line: `python -m sievestone govern|train|classify|cluster|reduce FOLDER ...` over ratings.dat, movies.dat and users.dat."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from sievestone.operators import cleaning
from sievestone.plans import governance, learning, tools
from sievestone.plans.config import Config, ConfigError
from sievestone.plans.rules import RuleError, Rules
from sievestone.plans.service import TaskError, user_ids
from sievestone.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievestone")
    p.add_argument("--rules", help="a JSON file of rules; without it the environment's SIEVESTONE_RULES, then the defaults")
    p.add_argument("--analysis", help="a JSON file that declares the analysis tools; without it the environment's SIEVESTONE_ANALYSIS, then the defaults")
    p.add_argument("--models", default="models", help="the folder of models and of saved results")
    p.add_argument("--data-version", default="unnamed")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("govern", "train", "classify", "cluster", "reduce"):
        one = sub.add_parser(name)
        one.add_argument("folder", help="where the three tables are; any path that Spark can read")
        if name == "govern":
            one.add_argument("--out", help="where to write the cleaned tables")
        if name in ("train", "classify"):
            one.add_argument("--algorithm", choices=("gnb", "cart"))
        if name == "classify":
            one.add_argument("--user", type=int, required=True)
            one.add_argument("--movie", type=int, required=True)
            one.add_argument("--time", type=int)
        if name in ("cluster", "reduce"):
            one.add_argument("--method", choices=("kmeans", "dbscan") if name == "cluster" else ("pca", "tsne"), default="kmeans" if name == "cluster" else "pca")
            one.add_argument("--users", nargs="*", default=[])
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The command's result, ready for JSON."""
    rules = Rules.load(args.rules) if args.rules else Rules()
    lines = files.read_tables(spark, args.folder)
    if args.command == "govern":
        found = governance.govern(lines, rules, args.out)
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a few rows each
        return {k: rows(found[k]) for k in ("before", "after", "improvements", "counts", "problems", "unresolved", "by_action")} | {"observed": found["observed"]}
    ratings, movies, users = (files.typed(lines[t], t, rules) for t in ("ratings", "movies", "users"))
    config = Config.load(args.analysis)
    space = tools.workspace(spark, ratings, movies, users, rules, args.models, args.data_version, min_ratings=config.content.get("min_train_ratings", 10))
    if args.command == "train":
        kinds = (args.algorithm,) if args.algorithm else ("gnb", "cart")
        found = learning.run(*(space.tables[t] for t in ("ratings", "movies", "users")), rules, kinds)
        return {k: {"version": learning.save(spark, args.models, r, rules, args.data_version), "test": r["test"], "threshold": r["threshold"], "settings": r["settings"]} for k, r in found.items()}
    if args.command == "classify":
        return learning.classify_one(spark, args.models, space.tables, rules, args.user, args.movie, args.time, args.algorithm)
    category = "clustering" if args.command == "cluster" else "dimensionality_reduction"
    found = tools.run_plan(space, {"category": category, "algorithms": [args.method], "user_ids": user_ids(args.users) or None, "parameters": {}}, config)
    return found | {"profile": {"version": space.save_profile(), "folder": f"{args.models}/profile"}}


def main(given: list[str] | None = None) -> int:
    args = parser().parse_args(given)
    spark = SparkSession.builder.appName("sievestone").getOrCreate()
    try:
        print(json.dumps(run(spark, args), ensure_ascii=False, indent=1, default=str))
    except (TaskError, RuleError, ConfigError, files.DataNotFound, cleaning.Unreconciled) as e:
        code = "DATA_NOT_FOUND" if isinstance(e, files.DataNotFound) else getattr(e, "code", "INVALID_RULE_VERSION")
        print(json.dumps(e.as_dict() if isinstance(e, TaskError) else {"code": code, "message": str(e)}, ensure_ascii=False), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
