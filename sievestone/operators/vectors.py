"""What all operators over vectors (id, v, and more) share: which rows take part, and vectors as numpy rows."""

from __future__ import annotations

import contextvars
import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_INSIDE = contextvars.ContextVar("inside an operator over vectors", default=False)


def usable(rows: DataFrame) -> DataFrame:
    """The rows that take part: an id, and a vector without null or non-finite components, as long as that of the smallest such id.

    One aggregate finds that length.  A table without such rows gives none.
    """
    v = F.col("v")
    fine = rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    size = fine.agg(F.min_by(F.size(v), F.struct("id", F.size(v)))).first()[0]
    return fine.filter(F.size(v) == (size or 0))


def on_usable(operator: Callable) -> Callable:
    """The operator over the usable rows of each frame of vectors that it is given; within another operator they are that already."""

    @functools.wraps(operator)
    def run(*args, **named):
        if _INSIDE.get():
            return operator(*args, **named)
        seen: dict[int, DataFrame] = {}  # a frame that is given twice stays one

        def own(x):
            if not isinstance(x, DataFrame) or not {"id", "v"} <= set(x.columns):
                return x
            if id(x) not in seen:
                seen[id(x)] = usable(x)
            return seen[id(x)]

        mark = _INSIDE.set(True)
        try:
            return operator(*map(own, args), **{k: own(x) for k, x in named.items()})
        finally:
            _INSIDE.reset(mark)

    return run


def matrix(t: pa.Table | pa.RecordBatch, name: str = "v") -> np.ndarray:
    """A column of vectors of one length, as rows."""
    lists = t.column(name)
    if lists.null_count:
        raise ValueError("a vector is null")
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in (lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]) if len(c)]
    return np.concatenate(parts).astype(np.float64).reshape(t.num_rows, -1) if parts else np.zeros((0, 0))


#: Rows of each side whose distances are summed at once: the sums and a component's squares stay in a core's cache.
TILE = (64, 512)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, component by component, so that equal vectors have none; tile by tile, without copies of the whole."""
    out, of_a, of_b = np.zeros((len(a), len(b))), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    square = np.empty(TILE)
    for i in range(0, len(a), TILE[0]):
        for k in range(0, len(b), TILE[1]):
            total = out[i : i + TILE[0], k : k + TILE[1]]
            own = square[: total.shape[0], : total.shape[1]]
            for j in range(a.shape[1]):
                np.subtract(of_a[j, i : i + TILE[0], None], of_b[j, None, k : k + TILE[1]], out=own)
                np.multiply(own, own, out=own)
                np.add(total, own, out=total)
    return np.sqrt(out, out=out)


#: Rows whose squared distances a matrix product gives at once; below which share of the two squared lengths, and within which of a bound, a pair is taken component by component.
STRIP, NEAR, DOUBT = 256, 1e-3, 1e-9


def _strips(a: np.ndarray, b: np.ndarray):
    """(first row, its strip's squared distances by a matrix product, sums of squared lengths, what gives some pairs' own); rounding is some 1e-14 of the sums."""
    middle = b.mean(axis=0)
    near_a, near_b = a - middle, b - middle  # lengths are as small as they can be
    of_a, of_b = (near_a * near_a).sum(axis=1), (near_b * near_b).sum(axis=1)
    for i in range(0, len(a), STRIP):
        own = a[i : i + STRIP]
        sizes = of_a[i : i + STRIP, None] + of_b[None]
        d = near_a[i : i + STRIP] @ near_b.T
        d *= -2
        d += sizes

        def exact(doubtful: np.ndarray, own=own) -> tuple:
            """(where, distances) of the doubtful pairs, as `distances` has them."""
            if doubtful.sum() * 8 > doubtful.size:
                return doubtful, distances(own, b)[doubtful]
            p, q = np.nonzero(doubtful)
            total = np.zeros(len(p))
            for j in range(b.shape[1]):
                total += (own[p, j] - b[q, j]) ** 2
            return (p, q), np.sqrt(total)

        yield i, d, sizes, exact


def _tame(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(len(a) and len(b)) and max(np.abs(a).max(), np.abs(b).max()) < 1e100


def rough_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by a matrix product, right to some 1e-11 of each; for sums, as equal pairs may differ by that."""
    if not _tame(a, b):
        return distances(a, b)
    out = np.empty((len(a), len(b)))
    for i, d, sizes, exact in _strips(a, b):
        doubtful = d < NEAR * sizes
        out[i : i + len(d)] = np.sqrt(np.where(doubtful, 0, d))
        if doubtful.any():
            where, own = exact(doubtful)
            out[i : i + len(d)][where] = own
    return out


#: Rows of each side whose distances are summed while they stay in a core's cache.
SUMMED = (64, 1024)


def distance_sums(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of `rough_distances`: of each row of `a` to the groups of `b`, and of each row of `b` to the groups of `a`.

    Groups are numbers from 0 on, in order within each side; every pair's distance is found once for both sums.
    """
    of_rows, of_cols = np.zeros((len(a), of_b[-1] + 1 if len(b) else 0)), np.zeros((len(b), of_a[-1] + 1 if len(a) else 0))
    if not len(a) or not len(b):
        return of_rows, of_cols
    tame, middle = _tame(a, b), b.mean(axis=0)
    near_a, near_b = (a - middle, b - middle) if tame else (a, b)
    size_a, size_b = ((near_a * near_a).sum(axis=1), (near_b * near_b).sum(axis=1)) if tame else (np.zeros(len(a)), np.zeros(len(b)))
    # With lengths and ones as two more components the product is the squared distance itself.
    left = np.column_stack((-2 * near_a, size_a, np.ones(len(a))))
    right = np.ascontiguousarray(np.column_stack((near_b, np.ones(len(b)), size_b)).T)
    for j in range(0, len(b), SUMMED[1]):
        cols = slice(j, j + SUMMED[1])
        there, col_starts = np.unique(of_b[cols], return_index=True)
        part = np.ascontiguousarray(right[:, cols])
        for i in range(0, len(a), SUMMED[0]):
            rows = slice(i, i + SUMMED[0])
            d = left[rows] @ part if tame else distances(a[rows], b[cols])
            if tame:
                doubtful = None
                if d.min() < NEAR * (size_a[rows].max() + size_b[cols].max()):
                    doubtful = d < NEAR * (size_a[rows, None] + size_b[None, cols])
                    d[doubtful] = 0
                np.sqrt(d, out=d)
                if doubtful is not None and doubtful.any():
                    p, q = np.nonzero(doubtful)
                    total = np.zeros(len(p))
                    for c in range(a.shape[1]):
                        total += (a[i + p, c] - b[j + q, c]) ** 2
                    d[p, q] = np.sqrt(total)
            here, row_starts = np.unique(of_a[rows], return_index=True)
            of_rows[rows, there] += np.add.reduceat(d, col_starts, axis=1)
            of_cols[cols, here] += np.add.reduceat(d, row_starts, axis=0).T
    return of_rows, of_cols


def nearest_numbers(x: np.ndarray, *centres: np.ndarray) -> list[np.ndarray]:
    """For each set of centres the number of the one nearest to each row as `distances` has it, ties to the lower number: by one matrix product, and
    component by component where that leaves a doubt."""
    every = np.concatenate(centres)
    if not _tame(x, every):
        return [distances(x, c).argmin(axis=1) for c in centres]
    middle = every.mean(axis=0)
    own, those = x - middle, every - middle
    size = (those * those).sum(axis=1)
    slack = DOUBT * ((own * own).sum(axis=1) + size.max())
    d = own @ (-2 * those.T)
    d += size
    out, start = [], 0
    for c in centres:
        part = d[:, start : start + len(c)]
        near = part.argmin(axis=1)
        doubtful = np.flatnonzero((part <= (part[np.arange(len(x)), near] + slack)[:, None]).sum(axis=1) > 1)
        if len(doubtful):
            near[doubtful] = distances(x[doubtful], c).argmin(axis=1)
        out.append(near)
        start += len(c)
    return out


#: Vectors in a block that `packed` makes.
PACKED = 1024


def packed(vectors: DataFrame) -> DataFrame:
    """(n, x): the vectors alone, as the bytes of matrices of at most PACKED rows, so that passes over them cost little besides their arithmetic."""

    def work(batches):
        for t in batches:
            x = matrix(t)
            for i in range(0, len(x), PACKED):
                part = x[i : i + PACKED]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["n", "x"])

    return vectors.select("v").mapInArrow(work, "n int, x binary")


def matrices(batches):
    """The matrices in batches of vectors, `packed` or not."""
    for t in batches:
        if "x" in t.schema.names:
            for n, x in zip(t.column("n").to_pylist(), t.column("x"), strict=True):
                yield np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(n, -1)
        elif t.num_rows:
            yield matrix(t)


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """distances(a, b) <= eps: by a matrix product, and component by component where that leaves a doubt."""
    if not _tame(a, b) or not 0 <= eps < 1e100:
        return distances(a, b) <= eps
    out = np.empty((len(a), len(b)), dtype=bool)
    for i, d, sizes, exact in _strips(a, b):
        out[i : i + len(d)] = d <= eps * eps
        doubtful = np.abs(d - eps * eps) <= DOUBT * (sizes + eps * eps)
        if doubtful.any():
            where, own = exact(doubtful)
            out[i : i + len(d)][where] = own <= eps
    return out


#: Rows of either side that are looked at together, so that what is made of their pairs stays small.
SIDE = 4096


def tiles(n: int, m: int, size: int = SIDE):
    """Slices of n and m rows that cover all their pairs."""
    for i in range(0, n, size):
        for j in range(0, m, size):
            yield slice(i, i + size), slice(j, j + size)


def k_nearest(a: np.ndarray, b: np.ndarray, k: int, ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of each row's k nearest with another id, ties to the smaller id, as `distances` has them.

    A matrix product sorts out the pairs that can't be among them; what it leaves in doubt is taken component by component.
    """
    rough = _tame(a, b)
    found = []
    for i in range(0, len(a), STRIP):
        own, n = a[i : i + STRIP], len(a[i : i + STRIP])
        bound, best = np.full(n, np.inf), (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        for j in range(0, len(b), SIDE):
            part = b[j : j + SIDE]
            if rough:
                _, d, sizes, _ = next(_strips(own, part))
                slack = DOUBT * sizes.max(axis=1)
            else:
                d, slack = distances(own, part), np.zeros(n)
            d[ids[i : i + n, None] == others[None, j : j + len(part)]] = np.inf
            limit = bound.copy()
            if not np.isfinite(limit).all():
                limit = np.minimum(limit, np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1] + slack)
            p, q = np.nonzero((d <= (limit + slack)[:, None]) & (d < np.inf))
            if not len(p):
                continue
            if rough:
                near = np.zeros(len(p))
                for c in range(b.shape[1]):
                    near += (own[p, c] - part[q, c]) ** 2
                near = np.sqrt(near)
            else:
                near = d[p, q]
            p, q, near = np.concatenate((best[0], p)), np.concatenate((best[1], q + j)), np.concatenate((best[2], near))
            order = np.lexsort((others[q], near, p))
            p, q, near = p[order], q[order], near[order]
            place = np.arange(len(p)) - np.searchsorted(p, p)
            best = tuple(x[place < k] for x in (p, q, near))
            last = place == k - 1
            # A little above the k-th, so that squaring its root loses no tie.
            bound[p[last]] = near[last] ** 2 * (1 + DOUBT) if rough else near[last]
        found.append((best[0] + i, best[1], best[2]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
