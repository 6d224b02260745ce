"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Two texts can only be equal if their lengths are, and then if their prefixes are.  A first pass over the
texts keeps 16 bytes a row, the length and a hash of the first PREFIX characters.  Of these, rows whose length no other row
has go at once; the others are grouped by length and prefix.  A second pass hashes the whole text of
only those rows whose (length, prefix) more than one row has; the others are known to be alone.

What a pass has found reaches the rows of the next as a bitmap, not as a join that would shuffle texts: each key
that more than one row has sets a bit.  The bitmap has BITS_PER_KEY bits for each of its keys, at
least LEAST_BITS and at most MOST_BITS (32 MB), which bounds what is broadcast at any size of the table.  A key that shares a
bit with another by chance only makes a row be hashed once more, as groups are told by length and whole hash in
the end, so results are exact however full the bitmap is.

Texts are never shuffled, and built-in expressions do all of the work.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievestone.llm.common import free_name
from sievestone.session import join_keyed, table, written

PREFIX = 64
#: Bits of a bitmap: for each key, at least, at most.  A row of the bitmap's table holds BLOCK of them.
BITS_PER_KEY, LEAST_BITS, MOST_BITS, BLOCK = 16, 1 << 20, 1 << 28, 32_768


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case, and nothing else changed; null as empty."""
    own = F.coalesce(text, F.lit(""))
    # A text of ASCII alone is left to lower(), which is much faster than going through its characters.
    return F.when(F.octet_length(own) == F.char_length(own), F.lower(own)).otherwise(F.translate(own, string.ascii_uppercase, string.ascii_lowercase))


def bits_for(keys: int) -> int:
    """A power of two: the bits of a bitmap of so many keys."""
    return 1 << (min(max(keys * BITS_PER_KEY, LEAST_BITS), MOST_BITS) - 1).bit_length()


def bitmap(keys: DataFrame, hashed: Column, bits: int) -> DataFrame:
    """(block, map): the bits at `hashed` modulo `bits` of all rows, BLOCK of them a row, in bits / BLOCK rows at most."""
    bit = F.pmod(hashed, F.lit(bits).cast("bigint"))
    return keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))


def marked(rows: DataFrame, hashed: Column, bitmap_: DataFrame, bits: int, name: str) -> DataFrame:
    """`rows` with a boolean column that tells whether the bit at `hashed` is set."""
    block, map_ = free_name(rows, "__block"), free_name(rows, "__map")
    bit = F.pmod(hashed, F.lit(bits).cast("bigint"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col(map_), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.broadcast(bitmap_.select(F.col("block").alias(block), F.col("map").alias(map_)))
    joined = rows.join(held, F.bitmap_bucket_number(bit) == F.col(block), "left")
    return joined.withColumn(name, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop(block, map_)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple = (), prefix: int = PREFIX) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the columns `keep` for every row of `docs`.

    Texts are equal that are identical with A-Z in lower case; null counts as empty.  Of a group of
    equal texts the row with the largest id stays; a null id counts as smaller than any, so a group of null ids only has a null
    keep_id.  Of repeated rows with that id exactly one stays.  An empty table gives no
    rows, and extra columns may have any name.
    """
    spark = docs.sparkSession
    own = docs.select(*[docs[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)], docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    raw = F.coalesce(F.col("text"), F.lit(""))
    length = F.octet_length(raw)
    start = F.xxhash64(F.octet_length(raw), lowered(F.substring(raw, 1, prefix)))

    sizes = written(own.select(length.alias("length"), start.alias("start")))
    lengths = sizes.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1")
    length_bits = bits_for(1 << 18)  # a length below 4 MB has a bit of its own
    of_length = marked(sizes, F.col("length").cast("bigint"), bitmap(lengths, F.col("length").cast("bigint"), length_bits), length_bits, "met").filter("met")
    shared = written(of_length.groupBy("start").agg(F.count("*").alias("n")).filter("n > 1").select("start"))
    bits = bits_for(shared.count())

    met = marked(own, start, bitmap(shared, F.col("start"), bits), bits, "met")
    whole = F.when(F.col("met"), F.sha2(lowered(F.col("text")).cast("binary"), 256))
    # The texts end here; one written row for each document tells rows apart from now on.
    rows = written(met.select(*[f"k{i}" for i in range(len(keep))], "doc_id", length.alias("length"), whole.alias("whole"), F.monotonically_increasing_id().alias("row")))
    alone = rows.filter("whole is null").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)})
    met_rows = rows.filter("whole is not null")
    # A null id is least of all: structs put nulls first.
    last = F.max(F.struct("doc_id", "row"))
    groups = written(met_rows.groupBy("length", "whole").agg(F.count("*").alias("group_size"), last.alias("last")).withColumn("often", F.col("group_size")))
    found = join_keyed(met_rows, groups, ["length", "whole"], "often", rows.count()).withColumns({"keep_id": F.col("last")["doc_id"], "kept": F.col("row") == F.col("last")["row"]})
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    columns = [F.col("doc_id").alias(doc_id), "keep_id", "group_size", "kept", *names]
    return found.select(*columns).unionByName(alone.select(*columns))


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that exact_duplicates keeps, with all their columns; its rules for odd rows hold.

    The rows are written once, so that each has a number that stays.
    """
    row = free_name(docs, "__row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = exact_duplicates(rows, doc_id, text, (row,)).filter("not kept").select(row)
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op13_progressive_exact(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of `documents`.

    The digest column is of every text, as the contract asks for it; groups come from the refinement.
    """
    docs = table(spark, sf_dir, "documents")
    return exact_duplicates(docs.select("doc_id", "text", F.sha2(lowered(F.col("text")).cast("binary"), 256).alias("text_sha256")), keep=("text_sha256",))


OP13_SQL = """
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
"""
