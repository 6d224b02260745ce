"""Quality counters and event windows over streams, in Structured Streaming.

The batch checks are aggregates of predicates, so they run on a stream of lines as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievestone.functions import text as T
from sievestone.operators.checks import format_check
from sievestone.plans.rules import Rules


def line_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """(line) of the text files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder).select(T.from_latin1(F.col("value")).alias("line"))


def running_check(lines: DataFrame, table: str, rules: Rules) -> DataFrame:
    """The table's counters over all lines so far; write it in complete mode."""
    return format_check(lines, table, rules)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their mean value by window of event time and type; rows later than `late` are left out, state is dropped then."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "events", "mean_value")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """What a streaming aggregate comes to once all that has arrived is read: each batch's result takes the last one's place as Parquet.

    The checkpoint holds offsets and state, so a run that is stopped goes on where it was.
    """

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
