"""Nearest neighbours by inner product: a block matrix join over int8 codes with error bounds.

Queries and rows are dealt into blocks, and each pair of blocks meets once, in one cell of a
grid.  A cell codes every vector as int8 steps of its own scale and multiplies tiles of codes.
By Cauchy-Schwarz, <x, y> differs from the coded product by at most
|x'| |y - y'| + |x - x'| |y'| + |x - x'| |y - y'|, where x' and y' are the decoded vectors.  Only pairs
whose upper bound reaches the k-th best lower bound are recomputed, in double precision on
the original vectors, and go through a heap of k for each query; the cells' results are merged
by heaps too.  The bounds hold always, so the result is that of brute force.

The number of cells grows with queries times rows, as the work of a stated query set does; a
cell holds at most about BLOCK of either, dealt by a hash of the id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.session import table, written

K, EVERY = 20, 20
#: Vectors of each kind in a cell at most (as the hash deals them), and at least where there are many tasks.
BLOCK, LEAST = 32_768, 2048
TILE_Q, TILE_C = 256, 8192


def code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the decoded vectors, and (at least the) norms of what the codes miss.

    A vector too small for a scale has codes of 0 and misses all it holds; that norm is told from its greatest part, as
    squares would vanish.
    """
    most = np.abs(x).max(axis=1)
    tiny = most < 1e-150
    scale = np.where(tiny, 1.0, most / 127)
    codes = np.where(tiny[:, None], 0.0, np.rint(x / scale[:, None]))
    decoded = codes * scale[:, None]
    missed = np.where(tiny, most * (np.sqrt(x.shape[1]) * (1 + 1e-9)), np.linalg.norm(np.where(tiny[:, None], 0.0, x) - decoded, axis=1))
    return codes.astype(np.int8), scale, np.linalg.norm(decoded, axis=1), missed


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


def _push(heap: list, item: tuple, k: int) -> None:
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def cell(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int = K) -> list[list[tuple]]:
    """For each query the heap of its k best (score, -id) among the candidates with another id."""
    # Of equal vectors only the k + 1 smallest ids can be wanted: ties go to the smaller id.
    rows = np.ascontiguousarray(c + 0.0).view(np.dtype((np.void, c.shape[1] * 8))).ravel()
    group = np.unique(rows, return_inverse=True)[1].ravel()
    order = np.lexsort((cid, group))
    begin = np.append(True, group[order][1:] != group[order][:-1])
    place = np.arange(len(order)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
    order = order[place <= k]
    cid, c = cid[order], c[order]
    heaps: list[list[tuple]] = [[] for _ in qid]
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # either holds the products of codes exactly
    qcode, qscale, qnorm, qmiss = code(q)
    ccode, cscale, cnorm, cmiss = code(c)
    for a in range(0, len(cid), TILE_C):
        cs = slice(a, a + TILE_C)
        right = ccode[cs].astype(kind).T
        for b in range(0, len(qid), TILE_Q):
            qs = slice(b, b + TILE_Q)
            about = (qcode[qs].astype(kind) @ right).astype(np.float64) * qscale[qs, None] * cscale[None, cs]
            slack = qnorm[qs, None] * cmiss[None, cs] + qmiss[qs, None] * (cnorm + cmiss)[None, cs]
            slack = slack * (1 + 1e-9) + 1e-12 * (qnorm[qs, None] * cnorm[None, cs] + 1e-300)
            least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[qs]])
            if about.shape[1] > k + 1:  # the query's own row may be among the best
                lower = about - slack
                lower[np.isnan(lower)] = -np.inf  # bounds beyond the largest number say nothing
                least = np.maximum(least, np.partition(lower, about.shape[1] - k - 1, axis=1)[:, about.shape[1] - k - 1])
            left = ~(about + slack < least[:, None]) & (qid[qs, None] != cid[None, cs])
            i, j = np.nonzero(left)
            scores = exact(q[qs][i], c[cs][j])
            for n, s, d in zip(i.tolist(), scores.tolist(), cid[cs][j].tolist(), strict=True):
                _push(heaps[b + n], (s, -d), k)
    return heaps


_CELL = "query_id long, vec_id long, score double"
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _vectors(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and vectors."""
    ids = t.column("vec_id").to_numpy()
    lists = t.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    sizes = np.diff(offsets)
    out = {}
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out[int(d)] = ids[at], flat[offsets[at][:, None] + np.arange(d)].astype(np.float64)
    return out


def _cells(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, rows = _vectors(left), _vectors(right)
        out: list[tuple] = []
        for d, (qid, q) in queries.items():
            if d in rows:
                for one, heap in zip(qid.tolist(), cell(qid, q, *rows[d], k), strict=True):
                    out += [(one, -n, s) for s, n in heap]
        return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True) if out else ([], [], []), _OUT, strict=True)], schema=_OUT)

    return run


def _merge(k: int):
    def run(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for q, n, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _push(heaps.setdefault(q, []), (s, -n), k)
        rows = [(q, r, -n, s) for q, heap in heaps.items() for r, (s, n) in enumerate(sorted(heap, reverse=True), 1)]
        for a in range(0, len(rows), 10_000):
            q, r, n, s = zip(*rows[a : a + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "rank", "vec_id", "score"])

    return run


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector neither null, empty, zero nor with null or non-finite parts.

    Rows with the same id count as one; the least vector stands for them.
    """
    v = F.col(embedding)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col(vec_id).isNotNull() & fine).groupBy(F.col(vec_id).cast("bigint").alias("vec_id")).agg(F.min(v).cast("array<double>").alias("v"))


def nearest(rows: DataFrame, k: int = K, is_query=None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product for each query, ties to the smaller id.

    Vectors are compared only with those of the same length.  Rows that `usable` leaves out take no part; rows of the same id count
    as one.  A table without usable rows gives none, and extra columns may have any name.
    """
    spark = rows.sparkSession
    vectors = written(usable(rows, vec_id, embedding))
    is_query = F.col("vec_id") % EVERY == 0 if is_query is None else is_query
    n, n_queries = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda m: max(1, math.ceil(m / BLOCK), min(tasks, math.ceil(m / LEAST)))
    down, across = max(1, math.ceil(n_queries / BLOCK)), blocks(n)
    deal = lambda seed, m: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
    queries = vectors.filter(is_query).select("vec_id", "v", deal(1, down).alias("down"), every(across).alias("across"))
    # New names for the right side: where both sides are one frame, pruning may take columns from it otherwise.
    others = vectors.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), every(down).alias("down"), deal(2, across).alias("across"))
    found = queries.groupBy("down", "across").cogroup(others.groupBy("down", "across")).applyInArrow(_cells(k), _CELL)
    parts = max(tasks, math.ceil(n_queries * k * across / 2_000_000))
    return found.repartition(parts, "query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op6_block_neighbours(spark, sf_dir: str) -> DataFrame:
    """The K nearest of all embeddings for each one whose vec_id is divisible by EVERY."""
    return nearest(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(min(embedding), lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY vec_id),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
