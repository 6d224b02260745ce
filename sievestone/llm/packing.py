"""Packing: length buckets that pad least, and batches within a token budget inside each bucket.

A document's length is its number of tokens (llm/token_counts.py).  The global histogram of lengths is counted with
map-side combining.  Lengths of 1024 or more are rounded up to 512 steps an octave, so it has at most about
1024 + 512 cells an octave, whatever the corpus.  Dynamic programming over it finds the bucket ends that make the
sum of padded lengths least.  Within a bucket every document is padded to the bucket's end, so a batch holds
budget // end documents; a document longer than the budget makes a batch of its own.

Buckets are dealt into shards of about SHARD_ROWS documents by a hash of the id, and
batches are numbered within a shard: no task ever orders a whole bucket.  A shard that is far too large all the same, as
many rows have one id or none, is dealt again by rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievestone.llm.common import free_name
from sievestone.llm.token_counts import token_counts
from sievestone.session import table, written

BUCKETS, BUDGET, SHARD_ROWS = 8, 16_384, 4096
#: A shard of more than one in so many rows, and of more than CROWD times its share, is dealt again; so there are at most HOT.
HOT, CROWD = 1000, 4


def cell(n: Column) -> Column:
    """The length, rounded up to the histogram's cell."""
    step = F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin(n)) - 10)).cast("bigint")
    return (F.floor((n + step - 1) / step) * step).cast("bigint")


def bucket_ends(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The ends of at most `buckets` buckets over ascending lengths for which the padded lengths sum to the least.

    Of equal sums, each end, from the last to the first, is as small as it can be.
    """
    d = len(lengths)
    if not d:
        return []
    b, upto = np.array(lengths, dtype=np.int64), np.append(0, np.cumsum(np.array(counts, dtype=np.int64)))
    best, back = b * upto[1:], []
    for _ in range(min(buckets, d) - 1):
        new, at = np.full(d, np.iinfo(np.int64).max), np.zeros(d, dtype=np.int64)
        for j in range(1, d):
            if (k := len(back)) <= j - 1:
                costs = best[k:j] + b[j] * (upto[j + 1] - upto[k + 1 : j + 1])
                i = int(costs.argmin())
                new[j], at[j] = costs[i], k + i
        back.append(at)
        best = new
    ends, j = [d - 1], d - 1
    for at in reversed(back):
        j = int(at[j])
        ends.append(j)
    return [lengths[j] for j in reversed(ends)]


def pack(lengths: DataFrame, doc_id: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_tokens, shard, batch, slot for every row of `lengths` (doc_id, n_tokens).

    A batch is named by bucket, shard and batch.  Null ids are hashed as the text 'null'
    and come first; repeated rows take a slot each; where shards are dealt again, equal rows may change places
    from run to run.  An empty table gives no rows.  Further columns are left out.
    """
    row = free_name(lengths, "__row")
    rows = written(lengths.select(doc_id, F.col("n_tokens").cast("bigint").alias("n_tokens"), cell(F.col("n_tokens")).alias("cell"), F.monotonically_increasing_id().alias(row)))
    histogram = rows.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect()
    ends = bucket_ends([r["cell"] for r in histogram], [r["n"] for r in histogram], buckets)
    sizes = [0] * max(1, len(ends))
    for r in histogram:
        sizes[sum(e < r["cell"] for e in ends)] += r["n"]
    bucket = sum((F.when(F.col("cell") > e, 1).otherwise(0) for e in ends), F.lit(0))
    pick = lambda values, c: F.get(F.array(*[F.lit(v).cast("bigint") for v in values or [0]]), c)
    spread = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    placed = rows.select(doc_id, "n_tokens", row, bucket.alias("bucket")).withColumn("padded_tokens", pick(ends, F.col("bucket")))
    shards = pick([-(-n // shard_rows) for n in sizes], F.col("bucket"))
    placed = placed.withColumn("shard", spread % shards)
    crowded = placed.groupBy(F.col("bucket").alias("in_bucket"), F.col("shard").alias("in_shard")).agg(F.count("*").alias("crowd")).filter(F.col("crowd") > max(CROWD * shard_rows, sum(sizes) // HOT))
    placed = placed.join(F.broadcast(crowded), (F.col("bucket") == F.col("in_bucket")) & (F.col("shard") == F.col("in_shard")), "left")
    again = F.pmod(F.xxhash64(row), F.ceil(F.col("crowd") / F.lit(shard_rows)).cast("bigint"))
    placed = placed.withColumn("shard", F.when(F.col("crowd").isNull(), F.col("shard")).otherwise(F.col("shard") + shards * (1 + again)))
    order = Window.partitionBy("bucket", "shard").orderBy(F.col(doc_id).asc_nulls_first(), "n_tokens")
    at = (F.row_number().over(order) - 1).cast("bigint")
    room = F.greatest(F.floor(F.lit(budget) / F.greatest("padded_tokens", F.lit(1))), F.lit(1)).cast("bigint")
    return placed.withColumn("at", at).select(doc_id, "n_tokens", "bucket", "padded_tokens", "shard", F.floor(F.col("at") / room).cast("bigint").alias("batch"), (F.col("at") % room).alias("slot"))


def token_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens): the number of tokens of each whole text, a row for each row; null counts as none."""
    return token_counts(docs, text, (doc_id,)).select(doc_id, "n_tokens")


def op7_length_buckets(spark, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of every row of `documents`, by its tokens."""
    return pack(token_lengths(table(spark, sf_dir, "documents")))
