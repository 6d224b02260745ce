"""Time splits, labels and strictly-past features of ratings (user_id, movie_id, rating, ts)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievestone.operators.prefix import at_places, keyed_sums_before
from sievestone.plans.rules import Rules
from sievestone.session import cut, written

SPLITS, POSITIVE = ("train", "validate", "test"), 4


def split_of(ts: Column, rules: Rules) -> Column:
    """train up to t1, validate up to t2, test after it."""
    return F.when(ts <= rules.t1, "train").when(ts <= rules.t2, "validate").otherwise("test")


def label(rating: Column) -> Column:
    return (rating >= POSITIVE).cast("int")


def split_summary(ratings: DataFrame, rules: Rules) -> DataFrame:
    """One row for each split, empty ones too: records, ratio, positives, positive rate, users, movies, first and last time."""
    frame = ratings.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    rows = ratings.groupBy(split_of(F.col("ts"), rules).alias("split")).agg(
        F.count("*").alias("records"), F.sum(label(F.col("rating"))).alias("positives"), F.count_distinct("user_id").alias("users"), F.count_distinct("movie_id").alias("movies"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
    )
    out = frame.join(F.broadcast(rows), "split", "left").fillna(0, ["records", "positives", "users", "movies"])
    total = F.sum("records").over(Window.partitionBy(F.lit(1)))  # three rows
    return out.withColumn("ratio", F.round(F.try_divide("records", total), 6)).withColumn("positive_rate", F.round(F.try_divide("positives", "records"), 6))


def duplicate_pairs(ratings: DataFrame) -> DataFrame:
    """Rows, distinct (user, movie) pairs, and by how many rows exceed pairs."""
    return ratings.groupBy("user_id", "movie_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("records"), F.count("*").alias("pairs")).withColumn("duplicates", F.col("records") - F.col("pairs"))


def time_quantiles(ratings: DataFrame, shares: tuple = (0.70, 0.85)) -> DataFrame:
    """The times at nearest-rank quantiles, one row; counted by second first, and no task sees all seconds."""
    seconds = cut(ratings.groupBy("ts").agg(F.count("*").alias("n")))
    total = seconds.agg(F.sum("n")).first()[0] or 0
    return at_places(seconds, "ts", {f"t{i}": math.floor(q * (total - 1) + 0.5) + 1 for i, q in enumerate(shares, 1)}, "n")


def _past(ratings: DataFrame, key: str, prefix: str, rules: Rules | None = None) -> DataFrame:
    """Sum and number of a key's ratings before each of its seconds; with rules also whether it has one in the train period.

    Seconds are summed first, so the running sums see one row a second and key, and equal seconds never see each other; a key with
    very many seconds lies in many tasks.
    """
    old = F.lit(0).cast("bigint") if rules is None else F.count_if(F.col("ts") <= rules.t1)
    seconds = ratings.groupBy(key, "ts").agg(F.sum("rating").alias("s"), F.count("*").alias("n"), old.alias("old"))
    found = keyed_sums_before(seconds, key, "ts", {f"{prefix}_sum": "s", f"{prefix}_count": "n", f"{prefix}_seen": "old"})
    seen = [] if rules is None else [((F.col("ts") <= rules.t1) | (F.col(f"{prefix}_seen") > 0)).cast("int").alias(f"{prefix}_seen")]
    return found.select(key, "ts", f"{prefix}_sum", f"{prefix}_count", *seen)


def train_mean(ratings: DataFrame, rules: Rules) -> float | None:
    return ratings.filter(F.col("ts") <= rules.t1).agg(F.avg("rating")).first()[0]


def history(ratings: DataFrame, rules: Rules, seen: bool = False) -> DataFrame:
    """`ratings` with user_mean, movie_mean and counts of strictly earlier ratings; none: the train period's mean.

    With `seen` also user_seen and movie_seen, whether the train period has them.  The ratings are written once and dealt out once for each key;
    rows without a user, movie or time are left out.
    """
    given = written(ratings)
    mean = F.lit(train_mean(given, rules) or 0.0)
    rows = given.filter("user_id is not null and movie_id is not null and ts is not null").withColumns({"__n": F.lit(1), "__old": (F.col("ts") <= rules.t1).cast("int")})
    for p in ("user", "movie"):
        rows = keyed_sums_before(rows, f"{p}_id", "ts", {f"{p}_sum": "rating", f"{p}_count": "__n", **({f"{p}_seen": "__old"} if seen else {})})
        rows = rows.withColumn(f"{p}_mean", F.coalesce(F.try_divide(f"{p}_sum", f"{p}_count"), mean)).drop(f"{p}_sum")
        if seen:
            rows = rows.withColumn(f"{p}_seen", ((F.col("__old") > 0) | (F.col(f"{p}_seen") > 0)).cast("int"))
    return rows.drop("__n", "__old")


def feature_names(rules: Rules) -> list[str]:
    return ["user_mean", "movie_mean", "log1p_movie_count", *[f"genre_{g.lower().replace(chr(39), '').replace(' ', '_')}" for g in rules.genres], *[f"occupation_{i}" for i in range(rules.max_occupation + 1)], "occupation_unknown", "age", "has_attributes"]


def with_attributes(rows: DataFrame, movies: DataFrame, users: DataFrame, rules: Rules) -> DataFrame:
    """`rows` (user_id, movie_id, user_mean, movie_mean, movie_count, and more) with the features of the feature matrix.

    movies: movie_id, genres (joined by |); users: user_id, age, occup.  Missing attributes are told, not guessed.
    """
    genres = F.split("genres", "[|]", -1)
    tags = movies.select("movie_id", *[F.array_contains(genres, g).cast("int").alias(n) for g, n in zip(rules.genres, feature_names(rules)[3:], strict=False)])
    order = F.create_map(*[F.lit(x) for i, a in enumerate(rules.ages) for x in (a, i)])
    attributes = users.select("user_id", F.coalesce(F.try_element_at(order, F.col("age")), F.lit(-1)).alias("age"), F.col("occup").try_cast("int").alias("occupation"), F.lit(1).alias("has_attributes"))
    joined = rows.join(tags, "movie_id", "left").join(attributes, "user_id", "left")
    occupation = F.when(F.col("occupation").between(0, rules.max_occupation), F.col("occupation")).otherwise(-1)
    out = [F.col("user_mean"), F.col("movie_mean"), F.log1p("movie_count").alias("log1p_movie_count")]
    out += [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in tags.columns[1:]]
    out += [F.coalesce((occupation == i).cast("int"), F.lit(0)).alias(f"occupation_{i}") for i in range(rules.max_occupation + 1)]
    out += [F.coalesce((occupation == -1).cast("int"), F.lit(1)).alias("occupation_unknown"), F.coalesce(F.col("age"), F.lit(-1)).alias("age"), F.coalesce(F.col("has_attributes"), F.lit(0)).alias("has_attributes")]
    own = [c for c in rows.columns if c not in ("user_mean", "movie_mean")]
    return joined.select(*own, *out)


def feature_matrix(ratings: DataFrame, movies: DataFrame, users: DataFrame, rules: Rules, seen: bool = False) -> DataFrame:
    """user_id, movie_id, ts, split, label and the features of each rating; with `seen` also user_seen and movie_seen."""
    rows = with_attributes(history(ratings, rules, seen), movies, users, rules)
    return rows.select("user_id", "movie_id", "ts", split_of(F.col("ts"), rules).alias("split"), label(F.col("rating")).alias("label"), *feature_names(rules), *(("user_seen", "movie_seen") if seen else ()))


def missing_attributes(matrix: DataFrame) -> DataFrame:
    """(records, missing): rows of a feature matrix, and those whose user has no attributes."""
    return matrix.agg(F.count("*").alias("records"), F.count_if(F.col("has_attributes") == 0).alias("missing"))


def point_history(ratings: DataFrame, points: DataFrame, rules: Rules) -> DataFrame:
    """For (user_id, movie_id, asked_at): means and numbers of both sides' ratings before that time.

    Asked times join a key's seconds as seconds without ratings, so a hot key costs its seconds and its points, not
    their product.
    """
    mean = F.lit(train_mean(ratings, rules) or 0.0)
    # A checkpoint isn't compressed, and the points may be as many as the ratings.
    keyed = written(points.select("user_id", "movie_id", "asked_at").filter("user_id is not null and movie_id is not null and asked_at is not null").distinct())

    def side(key: str, p: str) -> DataFrame:
        asked = keyed.select(key, F.col("asked_at").alias("ts"), F.lit(0).cast("bigint").alias("rating"), F.lit(0).alias("real")).distinct()
        both = ratings.select(key, "ts", F.col("rating").cast("bigint").alias("rating"), F.lit(1).alias("real")).union(asked)
        seconds = both.groupBy(key, "ts").agg(F.sum("rating").alias("s"), F.sum("real").alias("n"), F.max(1 - F.col("real")).alias("asked"))
        found = keyed_sums_before(seconds, key, "ts", {"sum": "s", "c": "n"}).filter("asked = 1")
        return found.select(key, F.col("ts").alias("asked_at"), F.coalesce(F.try_divide("sum", "c"), mean).alias(f"{p}_mean"), F.col("c").alias(f"{p}_count"))

    return keyed.join(side("user_id", "user"), ["user_id", "asked_at"]).join(side("movie_id", "movie"), ["movie_id", "asked_at"])


def seen_unseen(ratings: DataFrame, rules: Rules) -> DataFrame:
    """Test rows by whether the train period has their user and their movie."""
    train = ratings.filter(F.col("ts") <= rules.t1)
    flag = lambda key: train.select(key).distinct().withColumn(f"{key}_seen", F.lit(1))
    test = ratings.filter(F.col("ts") > rules.t2).join(flag("user_id"), "user_id", "left").join(flag("movie_id"), "movie_id", "left")
    return test.groupBy(F.coalesce("user_id_seen", F.lit(0)).alias("user_seen"), F.coalesce("movie_id_seen", F.lit(0)).alias("movie_seen")).agg(F.count("*").alias("records"), F.sum(label(F.col("rating"))).alias("positives"))
