"""Near-duplicates: 64-bit SimHash fingerprints, linked exactly within a Hamming radius.

Candidates come from covering locality-sensitive hashing (Pagh, 2016).  For radius r
every bit position gets a non-zero vector of r+1 bits; each non-zero vector v gives a
table whose mask holds the positions with an odd inner product with v.  The
positions where two fingerprints within the radius differ number at most r, so
some v is orthogonal to all their vectors: the two agree on that whole mask and
meet in that table.  Nothing is left to chance, whatever the data.

With r = 2 there are 7 tables, each over 36 or 37 of 64 bits.  A bucket of more than
SMALL fingerprints is dealt again by 7 masks over the bits that its own mask
leaves free (28 at most), then once more over the 12 that are free then; after that at
most 6 bits are free, so a bucket has at most 64 members by construction.  No group
is compared all with all, none is capped.

Shingles and votes are over distinct fingerprints after a map-side aggregate, so
copies never enter the candidate search.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.llm.common import free_name, map_rows
from sievestone.operators.components import connected_components
from sievestone.session import cut, join_keyed, table, written

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Fingerprints in a bucket that are compared with one another; six free bits give no more.
SMALL = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer; no words (or null): zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _make(shingle: int, name: str):
    return lambda: lambda texts: {name: [fingerprint(t, shingle) for t in texts]}


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """The columns `keep` and the fingerprint of each text."""
    return map_rows(docs, text, f"`{name}` bigint", _make(shingle, name), list(keep))


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """The masks over the given bit positions, one for each table, as signed 64-bit integers."""
    size = (1 << (radius + 1)) - 1
    vector = {b: i % size + 1 for i, b in enumerate(bits)}
    masks = []
    for v in range(1, size + 1):
        mask = sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return masks


def mask_tree(radius: int = RADIUS) -> list[list[list[int]]]:
    """Levels of masks: level k lists, for each mask of level k-1 in order, the wider masks that refine it."""
    levels, parents = [], [0]
    for _ in range(3):
        level = []
        for p in parents:
            free = [b for b in range(64) if not (p >> b) & 1]
            masks = [m | p for m in covering_masks(free, radius)]
            level.append([m - (1 << 64) if m >= 1 << 63 else m for m in masks])
        levels.append(level)
        parents = [m for group in level for m in group]
    return levels


def _keyed(rows: DataFrame, level: list[list[int]]) -> DataFrame:
    """Each (fp, node) once for each mask that refines its node, under the key of its bucket there."""
    wide = len(level[0])
    masks = F.array(*[F.lit(m).cast("bigint") for group in level for m in group])
    return rows.select("fp", F.explode(F.sequence(F.col("node") * wide, F.col("node") * wide + wide - 1)).alias("node")).select(
        "fp", "node", F.xxhash64("node", F.col("fp").bitwiseAND(F.get(masks, F.col("node")))).alias("key")
    )


def links(distinct: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """All pairs (src < dst) of distinct fingerprints `fp` within the radius, each once or more."""
    found, rows = [], distinct.select("fp", F.lit(0).alias("node"))
    for depth, level in enumerate(mask_tree(radius)):
        keyed = _keyed(rows, level)
        sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        shared = cut(keyed.join(sizes, "key"))
        here = shared if depth == 2 else shared.filter(F.col("n") <= small)
        a, b = here.select("key", F.col("fp").alias("src")), here.select("key", F.col("fp").alias("dst"))
        near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius
        found.append(a.join(b, (a["key"] == b["key"]) & (F.col("src") < F.col("dst")) & near).select("src", "dst").distinct())
        if depth == 2:
            break
        rows = shared.filter(F.col("n") > small).select("fp", "node")
        if rows.isEmpty():
            break
    return reduce(DataFrame.union, found)


def components(prints: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id, n) of each distinct fingerprint of `prints`.

    root names the component, component_id is its smallest doc_id, n counts the fingerprint's rows.

    Null ids count as larger than any; a component of null ids only has a null id.
    """
    groups = cut(prints.groupBy("fp").agg(F.min(doc_id).alias("least"), F.count("*").alias("n")))
    roots = cut(connected_components(links(groups, radius)))
    members = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", "n", "root")
    linked = cut(members.filter("root is not null"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    return members.filter("root is null").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"), "n").union(
        join_keyed(linked, least, "root", "size", linked.count()).select("fp", "root", "component_id", "n")
    )


def with_components(prints: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Every row of `prints` (with a column fp), its root and component_id.

    A fingerprint that more than a thousandth of all rows have is joined by broadcast (a
    thousand of them at most); the others by a shuffle, in which no key is large.
    """
    groups = cut(components(prints, doc_id, radius))
    total = groups.agg(F.sum("n")).first()[0] or 0
    return join_keyed(prints, groups, "fp", "n", total)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of `docs`.

    Null and empty texts and texts of blanks have fingerprint zero and are linked like any
    other.  Repeated rows stay, each with the same result.  An empty table gives no rows, and extra columns may have any name.
    """
    prints = written(fingerprints(docs, text, (doc_id,)))
    return with_components(prints, doc_id).select(
        doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without those that another row of their group replaces; the smallest doc_id stays.

    Of repeated rows with that id one stays; a null id is kept only where the group has no other.  Null and empty texts are one
    group.  An empty table gives no rows, and extra columns may have any name.
    """
    fp, row = free_name(docs, "__fp"), free_name(docs, "__row")
    marked = written(fingerprints(docs, text, tuple(docs.columns), name=fp).withColumn(row, F.monotonically_increasing_id()))
    groups = with_components(marked.select(F.col(doc_id).alias("doc_id"), F.col(row).alias("row"), F.col(fp).alias("fp")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row"))
    first = groups.groupBy("root").agg(F.min(order)["row"].alias(row))
    return marked.join(first.select(row), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash_covering(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of `documents`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
