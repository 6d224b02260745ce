"""What the corpus operators share: mapping batches of rows, and counting things in texts."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Bytes of text that are worked on at once, and rows in an Arrow batch, so that a batch of long texts stays small.
CHUNK_CHARS, BATCH_ROWS = 4_000_000, 1000
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: The separators of the words [^\x20\x09-\x0D]+
SPACES = " \t\n\x0b\x0c\r"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, what runs at once has Arrow batches of `rows` rows; BATCH_ROWS give way to a session's own bound, fewer only to a lesser one."""
    held = spark.conf.get(_BATCH)
    bound = held == _DEFAULT or rows < BATCH_ROWS and not 0 < int(held) <= rows
    if bound:
        spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        if bound:
            spark.conf.set(_BATCH, held)


def map_rows(df: DataFrame, text: str, schema: str | StructType, make: Callable[[], Callable[[list], dict]], keep: list[str] = (), arrow: bool = False, chunk: int | None = None) -> DataFrame:
    """The columns `keep` as they are, and those of `schema` computed from the column `text`.

    make() runs once in each task and returns a function from a list of texts (None: null), or from an Arrow array of
    them, to a dict of columns.  Lists hold at most `chunk` (CHUNK_CHARS) bytes, or one text.  Arrow batches hold BATCH_ROWS rows, unless
    the session has a bound of its own.
    """
    if df.sparkSession.conf.get(_BATCH) == _DEFAULT:
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    keep, most = list(keep), chunk or CHUNK_CHARS
    new = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    # Names of its own, as those of the frame may clash with any that were chosen.
    inner = df.select(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)], df[f"`{text}`"].alias("text"))
    kept = [StructField(c, f.dataType, f.nullable) for c, f in zip(keep, inner.schema.fields, strict=False)]
    out = StructType(kept + list(new.fields))
    types = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(len(keep))
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            start = 0
            while start < batch.num_rows:
                end, total = start + 1, int(sizes[start])
                while end < batch.num_rows and total + int(sizes[end]) <= most:
                    total += int(sizes[end])
                    end += 1
                own = texts.slice(start, end - start)
                # Some of Arrow's functions read a slice's offsets wrongly, so it is copied.
                made = work(own.take(pa.array(np.arange(len(own)))) if arrow else own.to_pylist())
                part = batch.slice(start, end - start)
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [x.cast(f.type) if isinstance(x := made[f.name], pa.Array) else pa.array(x, type=f.type) for f in types]
                yield pa.RecordBatch.from_arrays(arrays, names=keep + [f.name for f in types])
                start = end

    return inner.mapInArrow(run, out)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of the frame has (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches of `data` that begin at `starts`, one after the other; where each ends there)."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return data[:0], ends
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])], ends


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of a numpy array, by where they end, as an Arrow array of their bytes."""
    offsets = np.append(0, ends).astype(np.int64) * data.itemsize
    raw = np.ascontiguousarray(data).view(np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def repeated_words(words: list) -> int:
    """How many words lie in a 3-word window that is found at least twice in the list."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    return 0 if len(seen) == n else repeated_ids(ids, len(seen))


def repeated_ids(ids: np.ndarray, size: int) -> int:
    """As repeated_words, for words as numbers below `size`."""
    n = len(ids)
    if n < 4:
        return 0
    pairs = ids[:-1] * size + ids[1:]
    if size > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, dtype=bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def repeated_lines(text: str) -> tuple[int, int]:
    """(lines with a word, those of them that equal an earlier line)."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))
