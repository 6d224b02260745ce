"""Files in and out: delimited text in ISO-8859-1, JSON lines, and the three-way result of cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.functions import text as T
from sievestone.functions.parse import split_strict
from sievestone.operators import cleaning
from sievestone.plans.rules import COLUMNS, Rules
from sievestone.session import dropped


class DataNotFound(FileNotFoundError):
    """An input file is missing."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a text file in ISO-8859-1, without line ends and blank lines."""
    raw = spark.read.text(path)
    # The text source takes bytes for UTF-8 only when they are turned into characters; as bytes they are untouched.
    return raw.select(F.regexp_replace(T.from_latin1(F.col("value")), "[\\r\\n]+$", "").alias("line")).filter(F.length("line") > 0)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The lines of ratings.dat, movies.dat and users.dat under a folder of any file system that Spark knows."""
    paths = {name: f"{folder}/{name}.dat" for name in COLUMNS}
    if missing := [p for p in paths.values() if not exists(spark, p)]:
        raise DataNotFound(", ".join(missing))
    return {name: read_lines(spark, p) for name, p in paths.items()}


def typed(lines: DataFrame, table: str, rules: Rules, strict: bool = False) -> DataFrame:
    """Typed rows of clean lines.  Lenient: rows with a wrong number of fields or no numbers go; strict: they raise."""
    f = lines.select("line", split_strict(F.col("line"), rules).alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    number = lambda i: at(i).try_cast("bigint")
    if table == "ratings":
        out, need = [number(0).alias("user_id"), number(1).alias("movie_id"), number(2).alias("rating"), number(3).alias("ts")], range(4)
    elif table == "movies":
        out, need = [number(0).alias("movie_id"), at(1).alias("title"), T.last_parenthesis_year(at(1)).alias("year"), F.split(at(2), "[|]", -1).alias("genres")], (0,)
    else:
        out, need = [number(0).alias("user_id"), at(1).alias("gender"), number(2).alias("age"), number(3).alias("occupation"), at(4).alias("zipcode")], (0,)
    fine = F.size("f") == len(COLUMNS[table])
    for i in need:
        fine = fine & number(i).isNotNull()
    if strict:
        f = f.filter(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"no {table} row: "), "line")).cast("boolean")))
    return f.filter(fine).select(*out)


def latin1(text: Column) -> Column:
    """The bytes of a text in ISO-8859-1, as a string that holds them as they are; characters beyond it become question marks."""
    return F.encode(F.regexp_replace(text, r"[^\x00-\xFF]", "?"), "ISO-8859-1").cast("string")


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """A text file in ISO-8859-1."""
    lines.select(latin1(F.col(column)).alias("value")).write.mode("overwrite").text(path)


#: Where cleaned rows go: the folder of each part, and the end of its names.
PARTS = {"clean": "dat", "isolated": "dat", "audit": "tsv"}


def write_cleaned(cleaned: DataFrame, folder: str, table: str, lines: int | None = None, again: dict | None = None) -> dict:
    """The clean records and the isolated ones as text, and the audit as tab-separated text, from one pass; the counts seen in it.

    A row goes to its data file, and to the audit unless it is clean.  The pass writes beside the places of the
    files and is held against the lines of the input, and against counts taken `again`, where they are given.  Only if all adds
    up do the parts take their places; else what was written goes, what was there stays, and Unreconciled tells why.
    """
    rows, seen = cleaning.observed(cleaned)
    audit = F.when(F.col("tag") != "clean", F.struct(F.lit("audit").alias("part"), F.concat_ws("\t", "tag", "reason", "record").alias("line")))
    data = F.struct(F.when(F.col("tag") == "isolated", "isolated").otherwise("clean").alias("part"), F.col("record").alias("line"))
    spark, beside = cleaned.sparkSession, f"{folder}/_writing-{table}-{uuid.uuid4().hex}"
    try:
        # The text sink writes a string's bytes as they are.
        rows.select(F.explode(F.array_compact(F.array(data, audit))).alias("x")).select(latin1(F.col("x.line")).alias("value"), "x.part").write.partitionBy("part").text(beside)
        counts = seen.get
        if lines is not None:
            cleaning.settle(table, counts, lines, again)
        for part, end in PARTS.items():
            replaced(spark, f"{beside}/part={part}", f"{folder}/{part}/{table}.{end}")
    finally:
        dropped(spark, beside)
    return counts


def replaced(spark: SparkSession, source: str, target: str) -> None:
    """A folder in the place of another one, by renames; no source: an empty folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    new, at, old = path(source), path(target), path(f"{target}.{uuid.uuid4().hex}.old")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(new):
        fs.mkdirs(new)
    fs.mkdirs(at.getParent())
    was = fs.exists(at) and fs.rename(at, old)
    if not fs.rename(new, at):
        raise OSError(f"{target} can't be put in place")
    if was:
        fs.delete(old, True)


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows, and a fingerprint of them that doesn't depend on their order."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")).first()
    return row["n"], f"{row['h'] or 0}/{row['x'] or 0}"
