"""Scores of the five quality dimensions from the counters, and what follows from them.

A score that doesn't apply is null, never zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.functions.text import rounded, sign_class
from sievestone.plans.rules import DIMENSIONS, Rules

#: What counts against accuracy: counters and the table whose rows they are held against.
ACCURACY = (
    (("ratings_r_uid_bad",), "ratings"), (("ratings_r_mid_bad",), "ratings"), (("ratings_r_rating_bad",), "ratings"), (("ratings_r_ts_bad",), "ratings"),
    (("movies_m_mid_bad",), "movies"), (("movies_m_title_empty",), "movies"), (("movies_m_year_missing", "movies_m_year_bad"), "movies"),
    (("users_u_uid_bad",), "users"), (("users_u_gender_bad",), "users"), (("users_u_age_bad",), "users"), (("users_u_occ_bad",), "users"), (("users_u_zip_bad",), "users"),
)
REFERENCES = ((("users_orphan_records",), "ratings"), (("movies_orphan_records",), "ratings"))
FORMATS = (
    (("movies_value_multi_violations",), "movies"), (("users_attr_multi_violations",), "users"), (("movies_m_genres_dup", "movies_m_genres_emptyitem", "movies_m_genres_unknown", "movies_m_genres_empty"), "movies"),
    (("movies_m_title_space",), "movies"), (("users_u_zip_bad",), "users"),
)

#: Problems as counter, dimension, action, severity; then, in words, what is wrong and why it is dealt with so.
PROBLEMS = (
    ("users_u_zip_bad", "accurate", "fix", "low", "zip code isn't five digits", "a ZIP+4 code is cut to its first five digits, any other form can't be told right"),
    ("ratings_r_uid_bad", "accurate", "isolate", "high", "user id of a rating is no positive integer", "nothing tells the right id"),
    ("ratings_r_mid_bad", "accurate", "isolate", "high", "movie id of a rating is no positive integer", "nothing tells the right id"),
    ("ratings_r_rating_bad", "accurate", "isolate", "high", "rating isn't an integer in its range", "nothing tells what the user meant"),
    ("ratings_r_ts_bad", "accurate", "isolate", "medium", "time can't be read or lies outside the data's period", "nothing tells the right time"),
    ("movies_m_mid_bad", "accurate", "isolate", "high", "movie id is no positive integer", "nothing tells the right id"),
    ("movies_m_title_empty", "accurate", "isolate", "high", "movie without a title", "a needed field can't be made up"),
    ("movies_m_year_missing", "accurate", "keep", "low", "title doesn't end in a year", "the record is told apart all the same"),
    ("movies_m_year_bad", "accurate", "keep", "low", "year of a title is out of range", "only other sources could tell"),
    ("users_u_uid_bad", "accurate", "isolate", "high", "user id is no positive integer", "nothing tells the right id"),
    ("users_u_gender_bad", "accurate", "isolate", "low", "gender isn't one of the codes", "nothing tells the right code"),
    ("users_u_age_bad", "accurate", "isolate", "low", "age isn't one of the codes", "nothing tells the right code"),
    ("users_u_occ_bad", "accurate", "isolate", "low", "occupation isn't one of the codes", "nothing tells the right code"),
    ("ratings_missing", "complete", "isolate", "high", "rating without a needed field", "it can't be analysed"),
    ("movies_missing", "complete", "isolate", "high", "movie without a needed field", "it can't be found"),
    ("users_missing", "complete", "isolate", "high", "user without an id", "it can't be joined"),
    ("ratings_pair_dup_violations", "unique", "dedupe", "high", "several ratings of one movie by one user", "user and movie are the key"),
    ("movies_movie_dup_violations", "unique", "dedupe", "high", "movie id found again", "it is the key"),
    ("users_user_dup_violations", "unique", "dedupe", "high", "user id found again", "it is the key"),
    ("users_orphan_records", "consistent", "isolate", "high", "rating of a user that isn't there", "it can't be joined to the user"),
    ("movies_orphan_records", "consistent", "isolate", "high", "rating of a movie that isn't there", "it can't be joined to the movie"),
    ("movies_value_multi_violations", "consistent", "dedupe", "high", "one movie id, several titles or genres", "one is kept by rule; which is right stays open"),
    ("users_attr_multi_violations", "consistent", "dedupe", "medium", "one user id, several attributes", "one is kept by rule; which is right stays open"),
    ("movies_m_genres_dup", "consistent", "fix", "low", "a genre is named twice", "once is enough"),
    ("movies_m_genres_emptyitem", "consistent", "fix", "low", "an empty genre among others", "it can be left out"),
    ("movies_m_genres_unknown", "consistent", "isolate", "low", "genre that isn't one of the known", "nothing tells which was meant"),
    ("movies_m_genres_empty", "consistent", "isolate", "low", "movie without genres", "no other field tells them"),
    ("movies_m_title_space", "consistent", "fix", "low", "title with blanks at its ends", "they can be taken off"),
    ("movies_m_title_nonascii", "consistent", "keep", "info", "title with letters beyond ASCII", "it is right if read and written as ISO-8859-1"),
    ("ratings_r_ts_bad", "up_to_date", "isolate", "medium", "time can't be placed in any period", "nothing tells the right time"),
)
#: The problem that only cleaning shows: keys with several valid records.
CONFLICT = ("clean_conflict_keys", "consistent", "dedupe", "medium", "several valid records of one key, of which one was kept", "which is right stays open")
COLUMNS = ("code", "dimension", "action", "severity", "subject", "reason")


class QualityError(RuntimeError):
    """Counters that scores can't be made of."""


def _mean_rate(m: dict, items: tuple) -> float | None:
    """Mean of counters over their tables' rows, of the tables that have rows; null if none has."""
    rates = [sum(m.get(n) or 0.0 for n in names) / m[f"{table}_total"] for names, table in items if m.get(f"{table}_total")]
    return sum(rates) / len(rates) if rates else None


def _score(rate: float | None) -> float | None:
    return None if rate is None else round(100.0 * (1.0 - max(rate, 0.0)), 4)


def score_values(m: dict[str, float], rules: Rules) -> dict[str, float | None]:
    """The five dimensions and their weighted sum of counters by name, null where they don't apply."""
    total = lambda *names: sum(m.get(n) or 0.0 for n in names)
    rows, ratings = total("ratings_total", "movies_total", "users_total"), m.get("ratings_total") or 0.0
    share = lambda part, whole: part / whole if whole else None
    both = [r for r in (_mean_rate(m, REFERENCES), _mean_rate(m, FORMATS)) if r is not None]
    reliable = _score(share(ratings - total("ratings_d2_ok"), ratings))
    fresh = share(total("ratings_freshness_sum"), m.get("ratings_freshness_n"))
    out = {
        "accurate": _score(_mean_rate(m, ACCURACY)), "complete": _score(share(total("ratings_missing", "movies_missing", "users_missing"), rows)),
        "unique": _score(share(total("ratings_pair_dup_violations", "movies_movie_dup_violations", "users_user_dup_violations"), rows)),
        "up_to_date": reliable if fresh is None or reliable is None else round(reliable * fresh, 4), "consistent": _score(sum(both) / len(both) if both else None),
    }
    whole = None if None in out.values() else round(sum(rules.weights[d] * out[d] for d in DIMENSIONS), 4)
    return out | {"overall": whole}


def scores(metrics: DataFrame, rules: Rules) -> DataFrame:
    """One row: the five dimensions and their weighted sum, null where a dimension is.

    The counters, some eighty rows whatever the tables' size, come to the driver for it.
    """
    values = score_values({r["metric"]: r["value"] for r in metrics.collect()}, rules)
    return metrics.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"`{d}` double" for d in values))


def score_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dimension, before, after, change, trend) of the five dimensions; a change is null where a score is."""
    long = lambda df, name: df.unpivot([], list(DIMENSIONS), "dimension", name)
    rows = long(before, "before").join(long(after, "after"), "dimension")
    change = rounded(F.col("after") - F.col("before"))
    return rows.withColumn("change", change).withColumn("trend", sign_class(F.col("change")))


def improvements(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dimension, before, after, change, trend, description) of the dimensions that both have; a loss is told as one."""
    rows = score_delta(before, after).filter(F.col("change").isNotNull())
    number = lambda c: F.format_string("%.4f", c)
    moved = F.concat("dimension", F.when(F.col("trend") == "up", " rose from ").otherwise(" fell from "), number(F.col("before")), F.lit(" to "), number(F.col("after")), F.lit(", by "), number(F.col("change")))
    return rows.withColumn("description", F.when(F.col("trend") == "same", F.concat("dimension", F.lit(" stayed at "), number(F.col("before")))).otherwise(moved))


def checked(metrics: DataFrame) -> dict[str, float]:
    """The counters by name, if each table has rows and no name is there twice; else QualityError.

    There are some eighty of them, whatever the tables' size.
    """
    rows = metrics.collect()
    found = {r["metric"]: r["value"] for r in rows}
    if len(found) < len(rows):
        raise QualityError("a counter has several values")
    if empty := [t for t in ("ratings", "movies", "users") if not found.get(f"{t}_total")]:
        raise QualityError(f"no rows were read of {', '.join(empty)}")
    return found


def problems(metrics: DataFrame, cleaned: dict | None = None) -> DataFrame:
    """code, dimension, action, severity, subject, reason, count, unresolved: the counters that are not zero and what they mean.

    What is kept counts as resolved.  With counts of a cleaning (conflict_key_count, conflict_record_count, conflict_count) its
    conflicts are a problem of their own, as the cleaned rows show none.
    """
    spark = metrics.sparkSession
    rules = spark.createDataFrame(PROBLEMS, ", ".join(f"{c} string" for c in COLUMNS))
    found = metrics.join(F.broadcast(rules), metrics["metric"] == rules["code"]).filter("value > 0")
    out = found.select(*COLUMNS, F.col("value").cast("bigint").alias("count"), (F.col("action") != "keep").cast("int").alias("unresolved"))
    if cleaned and cleaned.get("conflict_key_count"):
        reason = f"{CONFLICT[-1]}; {cleaned.get('conflict_record_count') or 0} records, of which {cleaned.get('conflict_count') or 0} were kept"
        one = spark.createDataFrame([(*CONFLICT[:-1], reason, int(cleaned["conflict_key_count"]), 1)], out.schema)
        out = out.union(one)
    return out


def by_action(found: DataFrame) -> DataFrame:
    return found.groupBy("action").agg(F.sum("count").alias("count"))
