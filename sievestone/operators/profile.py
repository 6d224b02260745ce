"""Profiles of users over the train period: 9 measures and a share for each genre, and their z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievestone.operators.prefix import at_places
from sievestone.operators.temporal import label
from sievestone.plans.rules import Rules
from sievestone.session import cut, join_keyed, written

BASE = ("n_ratings", "avg_rating", "std_rating", "rating_bias", "high_share", "avg_movie_pop", "share_top_pop", "active_span_days", "avg_gap_days")
#: Movies up to which what is known of them is broadcast, a few bytes a genre each.
FEW_MOVIES = 50_000
OK, SPARSE, NONE = "OK", "INSUFFICIENT_HISTORY", "NO_TRAIN_HISTORY"


def names(rules: Rules) -> list[str]:
    return [*BASE, *["genre_share_" + g.lower().replace("'", "").replace(" ", "_") for g in rules.genres]]


def popularity(ratings: DataFrame, rules: Rules) -> DataFrame:
    """(movie_id, pop): ratings of each movie in the train period."""
    return ratings.filter(F.col("ts") <= rules.t1).groupBy("movie_id").agg(F.count("*").alias("pop"))


def top_cut(pop: DataFrame) -> DataFrame:
    """(cut): the popularity at the last place of the top quarter, null without movies."""
    pop = pop.select("pop")
    movies = pop.count()
    places = {"cut": movies - max(1, movies // 4) + 1}  # from the least popular
    return at_places(pop, "pop", places)


def best_ratings(ratings: DataFrame, rules: Rules) -> DataFrame:
    """(user_id, movie_id, best) over the train period."""
    return ratings.filter(F.col("ts") <= rules.t1).groupBy("user_id", "movie_id").agg(F.max("rating").alias("best"))


def features(ratings: DataFrame, movies: DataFrame, rules: Rules) -> DataFrame:
    """user_id and the profile's measures of every rater of the train period, whether known as a user or not.

    A rated movie that `movies` lacks counts among the user's movies, in no genre.  Ratings are summed by user and movie once, and
    all measures, the movies' popularity and the mean over all come from those sums: one shuffle of the ratings, and
    one of the sums by user.
    """
    rating, ts = F.col("rating"), F.col("ts")
    pairs = written(
        ratings.filter(ts <= rules.t1).groupBy("user_id", "movie_id").agg(
            F.count("*").alias("n"), F.count(rating).alias("k"), F.sum(rating).alias("s"), F.sum(rating * rating).alias("q"), F.sum(label(rating)).alias("high"), F.min(ts).alias("from"), F.max(ts).alias("to")
        )
    )
    pop = cut(pairs.groupBy("movie_id").agg(F.sum("n").alias("pop"), F.sum("k").alias("k"), F.sum("s").alias("s")))
    whole = pop.agg(F.count("*").alias("movies"), F.sum("pop").alias("total"), F.try_divide(F.sum("s"), F.sum("k")).alias("mean")).first()
    top, mean = top_cut(pop).first()["cut"] or 0, whole["mean"] or 0.0
    genres = F.split("genres", "[|]", -1)
    tagged = movies.select("movie_id", *[F.array_contains(genres, g).cast("int").alias(f"g{i}") for i, g in enumerate(rules.genres)])
    known = pop.select("movie_id", "pop").join(tagged, "movie_id", "left")
    # A movie may hold a large part of all ratings: few movies go by broadcast, of many those that are rated often.
    if whole["movies"] <= FEW_MOVIES:
        joined = pairs.join(F.broadcast(known), "movie_id")
    else:
        joined = join_keyed(pairs, cut(known).withColumn("__n", F.col("pop")), "movie_id", "__n", whole["total"])
    n, k, s, q = (F.sum(c) for c in ("n", "k", "s", "q"))
    span, number = (F.max("to") - F.min("from")) / 86400.0, lambda c: c.cast("double")
    shares = [F.avg(F.coalesce(F.col(f"g{i}"), F.lit(0))).alias(name) for i, name in enumerate(names(rules)[len(BASE) :])]
    return joined.groupBy("user_id").agg(
        number(n).alias("n_ratings"), F.try_divide(s, k).alias("avg_rating"), F.when(k > 0, F.sqrt(F.greatest(number(q) * k - number(s) * s, F.lit(0.0))) / k).alias("std_rating"),
        (F.try_divide(s, k) - mean).alias("rating_bias"), F.try_divide(F.sum("high"), k).alias("high_share"), (F.sum(F.col("n") * F.log1p("pop")) / n).alias("avg_movie_pop"),
        F.avg((F.col("pop") >= top).cast("int")).alias("share_top_pop"), span.alias("active_span_days"), F.coalesce(F.try_divide(span, n - 1), F.lit(0.0)).alias("avg_gap_days"), *shares,
    ).select("user_id", *names(rules))


def profile(ratings: DataFrame, movies: DataFrame, users: DataFrame, rules: Rules, min_ratings: int = 20) -> DataFrame:
    """Every user: user_id, status, fit, and the measures, null without train history."""
    rows = users.select("user_id").distinct().join(features(ratings, movies, rules), "user_id", "left")
    status = F.when(F.col("n_ratings").isNull(), NONE).when(F.col("n_ratings") < min_ratings, SPARSE).otherwise(OK)
    return rows.select("user_id", status.alias("status"), (status == OK).cast("int").alias("fit"), *names(rules))


def scaler(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column over the users that fit."""
    found = rows.filter("fit = 1").agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (found[f"m_{c}"] or 0.0, found[f"s_{c}"] or 0.0) for c in columns}


def zscores(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as z-scores; one without spread is 0, one without a value stays null."""
    return scaled(rows, columns, scaler(rows, columns))


def scaled(rows: DataFrame, columns: list[str], scale: dict[str, tuple[float, float]]) -> DataFrame:
    """As zscores, by means and deviations that are given."""
    z = lambda c: (F.col(c) - scale[c][0]) / scale[c][1] if scale[c][1] > 1e-12 else F.when(F.col(c).isNotNull(), F.lit(0.0))
    return rows.select("user_id", "status", "fit", *[z(c).alias(c) for c in columns])


def vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(id, v) of the users that fit, ready for clustering."""
    return zscores(rows, columns).filter("fit = 1").select(F.col("user_id").alias("id"), F.array(*columns).alias("v"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("users"))


def orphans(ratings: DataFrame, users: DataFrame, rules: Rules) -> DataFrame:
    """Raters of the train period that are no users."""
    return ratings.filter(F.col("ts") <= rules.t1).select("user_id").distinct().join(users, "user_id", "left_anti")


def cluster_summary(labels: DataFrame, rows: DataFrame, rules: Rules) -> DataFrame:
    """For each cluster of `labels` (user_id, cluster >= 0): size, means of four measures, and the three largest genre shares."""
    genre = names(rules)[len(BASE) :]
    found = labels.filter("cluster >= 0").join(rows, "user_id").groupBy("cluster").agg(
        F.count("*").alias("size"), *[F.avg(c).alias(f"{c}_mean") for c in ("avg_rating", "n_ratings", "high_share", "active_span_days")], *[F.avg(c).alias(c) for c in genre]
    )
    top = F.slice(F.array_sort(F.array(*[F.struct((-F.coalesce(F.round(c, 9), F.lit(0.0))).alias("v"), F.lit(i).alias("i"), F.lit(c.removeprefix("genre_share_")).alias("g")) for i, c in enumerate(genre)])), 1, 3)
    return found.select("cluster", "size", *[f"{c}_mean" for c in ("avg_rating", "n_ratings", "high_share", "active_span_days")], F.array_join(F.transform(top, lambda x: x["g"]), ",").alias("top_genres"))


def cluster_means(labels: DataFrame, rows: DataFrame, rules: Rules) -> DataFrame:
    """The mean of every measure over each cluster of `labels` (user_id, cluster >= 0)."""
    return labels.filter("cluster >= 0").join(rows, "user_id").groupBy("cluster").agg(F.count("*").alias("size"), *[F.avg(c).alias(c) for c in names(rules)])


def representative_movies(labels: DataFrame, ratings: DataFrame, movies: DataFrame, rules: Rules, top: int = 3, min_votes: int = 2) -> DataFrame:
    """The movies that most of a cluster's users rate 4 or more, ties to the more widely rated, then to the smaller id."""
    best = best_ratings(ratings, rules)
    votes = labels.filter("cluster >= 0").join(best.filter(f"best >= {4}"), "user_id").groupBy("cluster", "movie_id").agg(F.count("*").alias("votes"))
    known = votes.join(best.groupBy("movie_id").agg(F.count("*").alias("raters")), "movie_id")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("votes"), F.desc("raters"), "movie_id"))
    first = known.withColumn("place", place).filter((F.col("place") <= top + 5) & (F.col("votes") >= min_votes))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("place"))
    title = F.coalesce("title", F.concat(F.lit("#"), F.col("movie_id").cast("string"), F.lit("(缺失)")))
    return first.withColumn("rank", rank).filter(F.col("rank") <= top).join(movies.select("movie_id", "title"), "movie_id", "left").select("cluster", "rank", "movie_id", title.alias("title"), "votes")
