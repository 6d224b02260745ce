"""Quality checks: one aggregate for each table, key and reference checks, and freshness.

Every function gives one row of counters; a table without rows has zeros, never nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievestone.functions import text as T
from sievestone.functions.parse import split_strict, strict
from sievestone.plans.rules import COLUMNS, REQUIRED, Rules
from sievestone.session import written


def _predicates(table: str, rules: Rules) -> dict[str, Column]:
    c = {name: F.col(name) for name in COLUMNS[table]}
    common = {
        "malformed": F.col("arity") != len(COLUMNS[table]),
        "missing": reduce(Column.__or__, [c[x] == "" for x in REQUIRED[table]]),
    }
    if table == "ratings":
        low, high = rules.rating_bounds
        rating, ts = T.to_number(c["rating"]), T.to_number(c["ts"])
        explained = F.coalesce(ts > 0, T.is_digits(c["ts"]) & c["ts"].rlike("[1-9]"))
        inside = explained & F.coalesce(ts.between(*rules.ts_bounds), F.lit(False))
        return common | {
            "lines": F.lit(True), "r_uid_bad": ~T.is_positive_int(c["uid"]), "r_mid_bad": ~T.is_positive_int(c["mid"]),
            "r_rating_bad": ~F.coalesce(rating.between(low, high), F.lit(False)), "d1_ok": explained, "d2_ok": inside, "r_ts_bad": ~inside,
        }
    if table == "movies":
        year = T.title_year(c["title"])
        items = F.transform(F.split(c["genres"], "[|]", -1), lambda g: T.strip(g))
        some = T.strip(c["genres"]) != ""
        return common | {
            "m_mid_bad": ~T.is_positive_int(c["mid"]), "m_title_empty": T.strip(c["title"]) == "", "m_year_missing": year.isNull(),
            "m_year_bad": F.coalesce(~year.between(*rules.year_bounds), F.lit(False)), "m_title_space": T.has_boundary_space(c["title"]), "m_title_nonascii": T.has_non_ascii(c["title"]),
            "m_genres_empty": ~some, "m_genres_emptyitem": some & F.array_contains(items, ""), "m_genres_dup": some & (F.size(F.array_distinct(items)) < F.size(items)),
            "m_genres_unknown": some & F.exists(items, lambda g: ~g.isin(*rules.genres)),
        }
    occupation = T.to_number(c["occup"])
    return common | {
        "u_uid_bad": ~T.is_positive_int(c["uid"]), "u_gender_bad": ~c["gender"].isin(*rules.genders), "u_age_bad": ~c["age"].isin(*rules.ages),
        "u_occ_bad": ~F.coalesce(occupation <= rules.max_occupation, F.lit(False)), "u_zip_bad": ~c["zipcode"].rlike("^[0-9]{5}\\z"), "u_zip_leadingzero": F.startswith(c["zipcode"], F.lit("0")),
        **{f"u_filled_{x}": T.strip(c[x]) != "" for x in COLUMNS["users"][1:]},
    }


def format_check(lines: DataFrame, table: str, rules: Rules) -> DataFrame:
    """The table's counters: rows that fulfil each predicate, in one pass."""
    rows = strict(lines, table, rules)
    return rows.agg(F.count("*").alias(f"{table}_total"), *[F.count_if(p).alias(f"{table}_{name}") for name, p in _predicates(table, rules).items()])


def reference_check(ratings: DataFrame, refs: DataFrame, column: int, prefix: str, rules: Rules) -> DataFrame:
    """Ratings with an id that the reference table has, and those without; ids are compared as text.

    Ratings need the right number of fields, reference rows a positive integer in front.  Ids are
    counted before they are joined, so no id's rows meet in one task.
    """
    f = ratings.filter(F.length("line") > 0).select(split_strict(F.col("line"), rules).alias("f")).filter(F.size("f") == 4)
    ids = f.select(F.get("f", F.lit(column)).alias("id")).filter("id <> ''").groupBy("id").agg(F.count("*").alias("n"))
    known = refs.filter(F.length("line") > 0).select(F.get(split_strict(F.col("line"), rules), F.lit(0)).alias("id")).filter(T.is_positive_int(F.col("id"))).distinct().withColumn("hit", F.lit(True))
    rows = ids.join(known, "id", "left")
    missed = F.col("hit").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.agg(
        total(F.col("n")).alias(f"{prefix}_rating_records"), total(F.when(~missed, F.col("n"))).alias(f"{prefix}_matched_records"), total(F.when(missed, F.col("n"))).alias(f"{prefix}_orphan_records"), F.count_if(missed).alias(f"{prefix}_orphan_ids")
    )


def key_check(lines: DataFrame, keys: tuple, values: tuple, mode: str, prefix: str, rules: Rules) -> DataFrame:
    """Distinct keys, and those with several rows (mode dup) or several distinct values (mode multi).

    Rows need all the fields that are named; more are no fault.  A key whose parts are all empty is none.
    """
    f = lines.filter(F.length("line") > 0).select(split_strict(F.col("line"), rules).alias("f")).filter(F.size("f") > max(*keys, *values, 0))
    part = lambda places: F.concat_ws("::", *[F.get("f", F.lit(i)) for i in places])
    rows = f.select(part(keys).alias("k"), part(values).alias("v")).filter("k <> ''")
    many = F.count("*") if mode == "dup" else F.count_distinct("v")
    return rows.groupBy("k").agg(many.alias("n")).agg(F.count("*").alias(f"{prefix}_keys"), F.count_if(F.col("n") > 1).alias(f"{prefix}_violations"))


#: The key checks: name, table, key fields, value fields, mode.
KEY_CHECKS = (
    ("ratings_pair_dup", "ratings", (0, 1), (), "dup"), ("movies_movie_dup", "movies", (0,), (), "dup"), ("users_user_dup", "users", (0,), (), "dup"),
    ("movies_value_multi", "movies", (0,), (1, 2), "multi"), ("users_attr_multi", "users", (0,), (1, 2, 3, 4), "multi"),
)


def freshness(lines: DataFrame, rules: Rules) -> DataFrame:
    """Sum and number of how far times lie between t1 and t2, and how many rows have none; nothing else is held against a row."""
    f = lines.filter(F.length("line") > 0).select(split_strict(F.col("line"), rules).alias("f"))
    ts = F.get("f", F.lit(3))
    usable = (F.size("f") >= 4) & T.is_digits(ts)
    value = T.clamp((F.coalesce(T.to_number(ts).cast("double"), F.lit(1e38)) - rules.t1) / (rules.t2 - rules.t1))
    return f.agg(F.coalesce(F.sum(F.when(usable, value)), F.lit(0.0)).alias("ratings_freshness_sum"), F.count_if(F.coalesce(usable, F.lit(False))).alias("ratings_freshness_n"), F.count_if(~F.coalesce(usable, F.lit(False))).alias("ratings_freshness_skipped"))


def all_metrics(ratings: DataFrame, movies: DataFrame, users: DataFrame, rules: Rules, write: bool = True) -> DataFrame:
    """(metric, value) of every check, each a partial and a final aggregate.

    Several checks read each table, so the lines are written once, without what lies before them, unless they are a table already (`write` false).
    """
    if write:
        ratings, movies, users = (written(df.select("line")) for df in (ratings, movies, users))
    lines = {"ratings": ratings, "movies": movies, "users": users}
    parts = [format_check(df, name, rules) for name, df in lines.items()]
    parts += [reference_check(ratings, users, 0, "users", rules), reference_check(ratings, movies, 1, "movies", rules)]
    parts += [key_check(lines[table], keys, values, mode, name, rules) for name, table, keys, values, mode in KEY_CHECKS]
    parts.append(freshness(ratings, rules))
    names = [c for p in parts for c in p.columns]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"counters of one name: {sorted(twice)}")
    return reduce(DataFrame.union, [p.select([F.col(c).cast("double") for c in p.columns]).unpivot([], p.columns, "metric", "value") for p in parts])
