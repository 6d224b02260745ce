"""Cleaning: each row is kept, repaired or isolated; then one row for each key is kept by policy.

The first rule that a row breaks is its reason; repairs add up.  Duplicates collapse by a map-side
aggregate over (key, record), so a key with very many copies is no large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sievestone.functions import text as T
from sievestone.functions.parse import tolerant
from sievestone.plans.rules import COLUMNS, Rules
from sievestone.session import written


TAGS = ("clean", "fixed", "conflict", "isolated")


def _cascade(*rules: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds; one that can't be told doesn't hold."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(rules):
        out = F.when(condition, reason).otherwise(out)
    return out


def _with_repair(condition: Column, name: str) -> Column:
    return F.when(condition, F.array_union(F.array_distinct("repairs"), F.array(F.lit(name)))).otherwise(F.col("repairs"))


def _ratings(rows: DataFrame, rules: Rules) -> tuple[DataFrame, Column]:
    # Numbers and times are read once a row; conditions look at them several times.
    numbers = {f"__{c}": T.to_number(F.col(c)) for c in ("rating", "ts")}
    rating, ts, late = F.col("__rating"), F.col("__ts"), F.col("__late")
    rows = rows.withColumns(numbers).withColumn("__late", F.coalesce(ts > rules.ms_above, F.lit(False)))
    rows = rows.withColumn("__seconds", F.when(late, F.floor(ts / 1000).cast("decimal(38,0)")).otherwise(ts))
    reason = _cascade(
        (~T.in_domain(F.col("uid"), rules.user_domain), "uid_out_of_domain"),
        (~T.in_domain(F.col("mid"), rules.movie_domain), "mid_out_of_domain"),
        (~T.is_digits(F.col("rating")), "rating_not_integer"),
        (~F.coalesce(rating.between(*rules.rating_bounds), F.lit(False)), "rating_out_of_range"),
        (~T.is_digits(F.col("ts")), "timestamp_not_numeric"),
        (~F.col("ts").rlike("[1-9]"), "timestamp_not_positive"),
        (~F.coalesce(F.col("__seconds").between(*rules.ts_bounds), F.lit(False)), "timestamp_out_of_range"),
    )
    repaired = rows.withColumn("reason", reason).withColumn("repairs", _with_repair(late, "timestamp_ms"))
    return repaired.withColumn("ts", F.when(late, F.col("__seconds").cast("string")).otherwise(F.col("ts"))), F.col("uid")


def _movies(rows: DataFrame, rules: Rules) -> tuple[DataFrame, Column]:
    items = F.split("genres", "[|]", -1)
    reason = _cascade(
        (~T.in_domain(F.col("mid"), rules.movie_domain), "mid_out_of_domain"),
        (T.strip(F.col("title")) == "", "title_empty"),
        (T.strip(F.col("genres")) == "", "genres_empty"),
        (F.exists(items, lambda g: ~T.strip(g, T.TEXT_BLANKS).isin(*rules.genres)), "genres_invalid"),
    )
    spaced, twice = T.has_boundary_space(F.col("title")), F.size(F.array_distinct(items)) < F.size(items)
    out = rows.withColumn("reason", reason).withColumn("repairs", _with_repair(spaced, "title_space")).withColumn("repairs", _with_repair(twice, "genres_deduped"))
    return out.withColumn("title", F.when(spaced, T.strip(F.col("title"))).otherwise(F.col("title"))).withColumn("genres", F.array_join(F.array_distinct(items), "|")), F.col("mid")


def _users(rows: DataFrame, rules: Rules) -> tuple[DataFrame, Column]:
    occupation = T.to_number(F.col("occup"))
    short = F.regexp_extract(T.strip(F.col("zipcode"), T.TEXT_BLANKS), "^([0-9]{5})-[0-9]{4}\\z", 1)
    reason = _cascade(
        (~T.in_domain(F.col("uid"), rules.user_domain), "uid_out_of_domain"),
        (~T.strip(F.col("gender"), T.TEXT_BLANKS).isin(*rules.genders), "gender_invalid"),
        (~T.strip(F.col("age"), T.TEXT_BLANKS).isin(*rules.ages), "age_invalid"),
        (~F.coalesce(occupation <= rules.max_occupation, F.lit(False)), "occupation_invalid"),
        ((short == "") & ~F.col("zipcode").rlike("^[0-9]{5}\\z"), "zipcode_invalid"),
    )
    return rows.withColumn("reason", reason).withColumn("repairs", _with_repair(short != "", "zip4_truncated")).withColumn("zipcode", F.when(short != "", short).otherwise(F.col("zipcode"))), F.col("uid")


def dispositions(lines: DataFrame, table: str, rules: Rules) -> DataFrame:
    """(tag, reason, key, record) of each line: clean, fixed or isolated; isolated records are the lines as they were."""
    rows = tolerant(lines, table, rules)
    judged, key = {"ratings": _ratings, "movies": _movies, "users": _users}[table](rows, rules)
    reason = F.when(~F.col("fits"), "field_count_mismatch").otherwise(F.col("reason"))
    tag = F.when(reason.isNotNull(), "isolated").when(F.size("repairs") > 0, "fixed").otherwise("clean")
    why = F.coalesce(reason, F.when(F.size("repairs") > 0, F.array_join("repairs", "+")).otherwise("ok"))
    whole = F.concat_ws(rules.separator, *COLUMNS[table])
    key = F.concat_ws(rules.separator, "uid", "mid") if table == "ratings" else key
    return judged.select(tag.alias("tag"), why.alias("reason"), F.when(reason.isNull(), key).alias("key"), F.when(reason.isNull(), whole).otherwise(F.col("line")).alias("record"))


def resolve(rows: DataFrame, table: str, rules: Rules) -> DataFrame:
    """(tag, reason, key, record, copies): equal records of a key as one, and conflicts by the table's policy.

    A record is clean if one of its copies was.  Under `isolate` all records of a key with several go; under
    `keep_best` the best stays, tagged conflict: clean before fixed, then most fields filled, then the
    least text.  The copies of a kept record count all rows of its key.
    """
    kept = rows.filter("tag <> 'isolated'").groupBy("key", "record").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.when(F.col("tag") == "clean", 0).otherwise(1).alias("fixed"), F.col("reason"))).alias("best")
    )
    kept = kept.select("key", "record", "copies", F.when(F.col("best.fixed") == 0, "clean").otherwise("fixed").alias("tag"), "best.fixed", "best.reason")
    many = kept.groupBy("key").agg(F.count("*").alias("variants"), F.sum("copies").alias("all_copies"), F.min(F.struct("fixed", (-T.filled(F.split("record", rules.separator, -1))).alias("empty"), "record")).alias("first"))
    joined = kept.join(many, "key")
    single = F.col("variants") == 1
    if rules.conflict_policy[table] == "isolate":
        out = joined.select(F.when(single, F.col("tag")).otherwise("isolated").alias("tag"), F.when(single, F.col("reason")).otherwise("conflict_isolated").alias("reason"), "key", "record", "copies")
    else:
        out = joined.filter(F.col("record") == F.col("first.record")).select(F.when(single, F.col("tag")).otherwise("conflict").alias("tag"), F.when(single, F.col("reason")).otherwise("conflict_resolved").alias("reason"), "key", "record", F.col("all_copies").alias("copies"))
    return out.union(rows.filter("tag = 'isolated'").select("tag", "reason", "key", "record", F.lit(1).cast("bigint").alias("copies")))


def clean(lines: DataFrame, table: str, rules: Rules) -> DataFrame:
    """Dispositions are written once: kept and isolated rows, records and keys are all drawn from them."""
    return resolve(written(dispositions(lines, table, rules)), table, rules)


def counts(cleaned: DataFrame) -> DataFrame:
    """One row: rows by tag, duplicates that went, conflicts, and input and output rows; input = output + deduped."""
    tag = lambda t: F.count_if(F.col("tag") == t).alias(f"{t}_count")
    unknown = F.count_if(~F.coalesce(F.col("tag").isin(*TAGS), F.lit(False))).alias("unknown_count")
    conflict = F.col("reason").isin("conflict_isolated", "conflict_resolved")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return cleaned.agg(
        *map(tag, TAGS), unknown, zero(F.sum("copies") - F.count("*")).alias("deduped_count"), F.count_distinct(F.when(conflict, F.col("key"))).alias("conflict_key_count"),
        zero(F.sum(F.when(conflict, F.col("copies")))).alias("conflict_record_count"), zero(F.sum("copies")).alias("total_input_count"), F.count("*").alias("total_count"),
    )


def reasons(rows: DataFrame) -> DataFrame:
    """(reason, count) over input rows, before duplicates and conflicts are resolved."""
    return rows.groupBy("reason").agg(F.count("*").alias("count"))


def all_reasons(rows: dict[str, DataFrame]) -> DataFrame:
    """(tbl, reason, count) of each table's dispositions, and of all together as 'total'."""
    each = None
    for t, df in rows.items():
        one = reasons(df).select(F.lit(t).alias("tbl"), "reason", "count")
        each = one if each is None else each.union(one)
    return each.union(each.groupBy("reason").agg(F.sum("count").cast("bigint").alias("count")).select(F.lit("total").alias("tbl"), "reason", "count"))


#: What is counted beside a pass over cleaned rows.
OBSERVED = tuple(f"{t}_count" for t in (*TAGS, "unknown")) + ("deduped_count", "total_input_count", "total_count")


def observed(cleaned: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and what tells the counts OBSERVED once something has gone through all of them; no pass of its own."""
    seen = Observation()
    tag = lambda t: F.count_if(F.col("tag") == t).alias(f"{t}_count")
    unknown = F.count_if(~F.coalesce(F.col("tag").isin(*TAGS), F.lit(False))).alias("unknown_count")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return cleaned.observe(seen, *map(tag, TAGS), unknown, zero(F.sum("copies") - F.count(F.lit(1))).alias("deduped_count"), zero(F.sum("copies")).alias("total_input_count"), F.count(F.lit(1)).alias("total_count")), seen


class Unreconciled(RuntimeError):
    """Counts of a cleaning run that don't add up; `found` tells where."""

    code = "HADOOP_EXECUTION_ERROR"

    def __init__(self, table: str, found: list[str]):
        super().__init__(f"{table}: {'; '.join(found)}")
        self.table, self.found = table, found


def settle(table: str, row: dict, lines: int, again: dict | None = None) -> dict:
    """The counts of a table if they add up to its lines, and agree with those of a second pass where there was one; else Unreconciled."""
    found = reconcile(row, lines) + [f"{k} is {row[k]} in one pass and {again[k]} in the other" for k in OBSERVED if again is not None and row[k] != again[k]]
    if found:
        raise Unreconciled(table, found)
    return row


def reconcile(row, lines: int) -> list[str]:
    """What doesn't add up in a row of counts against the number of non-blank lines; empty if all does."""
    found = []
    if row["total_input_count"] != row["total_count"] + row["deduped_count"]:
        found.append("input is not output and duplicates")
    if row["total_input_count"] != lines:
        found.append(f"{lines} lines, {row['total_input_count']} rows")
    if sum(row[f"{t}_count"] for t in TAGS) != row["total_count"]:
        found.append("tags don't add up")
    if row["unknown_count"]:
        found.append("rows with an unknown tag")
    if not row["clean_count"] + row["fixed_count"] + row["conflict_count"]:
        found.append("nothing is left")
    return found
