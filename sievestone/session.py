"""Session helpers shared by every layer: a local test session, and places to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sievestone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under a folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than one in so many rows is joined by broadcast: there are at most so many of them.
HOT = 1000


class NoSharedFolder(RuntimeError):
    """A cluster without spark.checkpoint.dir: executors couldn't read what others wrote."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in a local session only, one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("sievestone.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sievestone-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("sievestone.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


_CLEANED: set = set()


def _place(spark: SparkSession, path: str) -> tuple:
    """The file system that a path is on, by any scheme that Spark knows, and the path there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def dropped(spark: SparkSession, path: str) -> bool:
    """Deletes a folder; whether there was one."""
    files, at = _place(spark, path)
    return files.delete(at, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver's Python ends, with its session stopped or not."""
    files, at = _place(spark, path)

    def drop() -> None:
        with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone already
            files.delete(at, True)

    atexit.register(drop)


def written(df: DataFrame, **options: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read again: lineage ends here and lost executors lose nothing.

    The files go when the driver's Python ends.  `options` are those of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievestone-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    drop_at_exit(spark, path)
    return spark.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint; for small frames inside loops.

    The checkpoints' folder goes when the driver's Python ends.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if spark.sparkContext not in _CLEANED:
        _CLEANED.add(spark.sparkContext)
        drop_at_exit(spark, spark.sparkContext.getCheckpointDir())
    return df.checkpoint(eager=True)


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """`rows` joined to the one row of `keyed` for their key, whose column `count` tells how many of the `total` rows have it.

    Keys that more than one in HOT rows have are joined by broadcast (HOT of them at most); the others
    by a shuffle, in which no key is large.
    """
    cutoff, keys = max(total // HOT, 1), [key] if isinstance(key, str) else key
    often = F.broadcast(keyed.filter(F.col(count) > cutoff).drop(count))
    seldom = keyed.filter(F.col(count) <= cutoff).drop(count)
    return rows.join(often, key).unionByName(rows.join(often.select(*keys), key, "left_anti").join(seldom, key))
