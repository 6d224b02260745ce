"""From lines to fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievestone.plans.rules import COLUMNS, Rules

#: What stands for a separator of several characters while a line is split; lines that have it are split by a pattern.
MARK = "\x01"


def _pattern(separator: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in separator)


def split_strict(line: Column, rules: Rules) -> Column:
    """All fields between separators, empty ones too.

    A pattern of more than one character is compiled anew for each line, so such a separator gives way to a character that
    the line doesn't have, which Java splits at without a pattern.
    """
    by_pattern = F.split(line, _pattern(rules.separator), -1)
    if len(rules.separator) < 2:
        return by_pattern
    return F.when(F.contains(line, F.lit(MARK)), by_pattern).otherwise(F.split(F.replace(line, F.lit(rules.separator), F.lit(MARK)), MARK, -1))


def strict(lines: DataFrame, table: str, rules: Rules, line: str = "line") -> DataFrame:
    """The table's columns (empty where a line has too few fields) and `arity`; blank lines are left out."""
    parts = lines.filter(F.length(line) > 0).select(split_strict(F.col(line), rules).alias("f"))
    return parts.select(*[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(COLUMNS[table])], F.size("f").alias("arity"))


def split_tolerant(line: Column, rules: Rules) -> Column:
    """Fields by the separator, or else by the first of the others that the line has, even if their number is wrong then."""
    parts = F.when(F.contains(line, F.lit(rules.separator)), split_strict(line, rules))
    for other in rules.other_separators:
        parts = parts.when(F.contains(line, F.lit(other)), F.split(line, _pattern(other), -1))
    return parts.otherwise(F.array(line))


def tolerant(lines: DataFrame, table: str, rules: Rules, line: str = "line") -> DataFrame:
    """line, the table's columns or nulls, `fits` (whether their number is right) and the array `repairs`.

    Fields beyond the table's number go if they are the known needless one, and then one empty field.
    """
    n = len(COLUMNS[table])
    own = F.col(line)
    rows = lines.filter(F.length(line) > 0).select(own.alias("line"), split_tolerant(own, rules).alias("f"))
    extra = F.slice("f", F.lit(n + 1), F.greatest(F.size("f"), F.lit(1)))
    # Of the fields beyond, those after the last that isn't the needless one.
    needless = F.aggregate(extra, F.lit(0), lambda run, x: F.when(x == rules.extra_field, run + 1).otherwise(0))
    rows = rows.withColumn("extras", F.when(F.size("f") > n, needless).otherwise(0))
    rows = rows.withColumn("left", F.size("f") - F.col("extras"))
    empty = (F.col("left") > n) & (F.get("f", F.col("left") - 1) == "")
    rows = rows.withColumn("empties", F.when(empty, 1).otherwise(0))
    replaced = ~F.contains("line", F.lit(rules.separator)) & (F.size("f") > 1)
    repairs = F.concat(F.when(replaced, F.array(F.lit("sep_replaced"))).otherwise(F.array().cast("array<string>")), F.array_repeat(F.lit("extra_field"), F.col("extras") + F.col("empties")))
    fits = (F.col("left") - F.col("empties") == n) & (F.contains("line", F.lit(rules.separator)) | replaced)
    return rows.select("line", *[F.when(fits, F.get("f", F.lit(i))).alias(c) for i, c in enumerate(COLUMNS[table])], fits.alias("fits"), repairs.alias("repairs"))
