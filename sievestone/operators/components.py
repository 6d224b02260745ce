"""Connected components over an edge list, by alternating large-star and small-star steps.

Both steps are a groupBy and a join on the star's centre.  A centre with more than a thousandth of all edges is
joined by broadcast, so no node's neighbours meet in one task however large its component; a
chain of n nodes needs O(log n) rounds.  Each round ends in a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.session import cut, join_keyed


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour greater than u is linked to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return join_keyed(both.filter("v > u"), least, "u", "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """u and its lesser neighbours are linked to the least of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    others = join_keyed(edges, least, "u", "n", total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge, root the smallest node reachable.

    Self links only declare a node.  Edges with a null end are left out.  An
    empty edge list gives no rows.
    """
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    links = cut(given.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        links = cut(_small_star(cut(_large_star(links, before[0])), before[0]))
        after = _mark(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).union(
        given.filter("u = v").join(links.select("u"), "u", "left_anti").select(F.col("u").alias("node"), F.col("u").alias("root"))
    ).distinct()
