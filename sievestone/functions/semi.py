"""Semi-structured columns: JSON text as typed fields, with what can't be read counted rather than lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MALFORMED = "_malformed"


def parsed(text: Column, schema: str) -> Column:
    """A struct of the schema's fields and MALFORMED, which holds the text where it isn't such an object; fields that it lacks are null."""
    return F.from_json(text, f"{schema}, {MALFORMED} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED})


def malformed(text: Column) -> Column:
    """Whether a text that isn't null is no JSON value."""
    return text.isNotNull() & F.try_parse_json(text).isNull()


def at(text: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path, as `a.b[0].c`; null where the text is malformed, nothing is there, or it isn't of that kind."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{path}", kind)


def profile(rows: DataFrame, column: str, paths: dict[str, str], by: list[str] = ()) -> DataFrame:
    """By group: rows, nulls, malformed texts, and for each path (path to its kind) how many rows have a value of that kind, one of another, and none.

    The text is parsed once a row; the counts are one aggregate with map-side combining.
    """
    name = lambda p: "".join(c if c.isalnum() else "_" for c in p)
    value = F.try_parse_json(F.col(column))
    read = rows.select(*by, F.col(column).alias("text"), value.alias("value"))
    out = [F.count("*").alias("records"), F.count_if(F.col("text").isNull()).alias("nulls"), F.count_if(F.col("text").isNotNull() & F.col("value").isNull()).alias("malformed")]
    for p, kind in paths.items():
        there = F.try_variant_get("value", f"$.{p}", "variant").isNotNull() & ~F.coalesce(F.is_variant_null(F.try_variant_get("value", f"$.{p}", "variant")), F.lit(False))
        fits = F.try_variant_get("value", f"$.{p}", kind).isNotNull()
        out += [F.count_if(fits).alias(f"{name(p)}_fits"), F.count_if(there & ~fits).alias(f"{name(p)}_other"), F.count_if(~F.coalesce(there, F.lit(False))).alias(f"{name(p)}_none")]
    return read.groupBy(*by).agg(*out)
