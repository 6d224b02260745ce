"""Target-distribution importance resampling over hashed word runs (after Xie et al., 2023).

The features of a text are its runs of 1 to 3 words, each dealt into one of BUCKETS by a checksum.  A first pass
over the texts persists the document-by-bucket count matrix as CSR blocks, one row for some CHUNK bytes of text: ids,
row starts, bucket numbers and counts, the latter as packed integers.  Column sums of the matrices of the corpus and of the
target give their two distributions, of BUCKETS numbers each; their log ratio is the gain of a bucket.  A product of the
sparse matrix with the gains gives each document's weight, without a text being read again.

Checksums are made by numpy for all words of a chunk at once: a word's by its bytes, a run's from those of its words, as
crc(a + b) is crc(a), shifted by the length of b, xor crc(b), and a shift is linear: four look-ups.  A text longer than
STRETCH is counted stretch by stretch.

Ranks come from ranges of the scores with one offset each, not from one sorted task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sievestone.llm.common import small_batches
from sievestone.operators.prefix import running_sums
from sievestone.session import table, written

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED, UNIT = 10_000, 3, 20, 5, 42, 1000
#: Bytes of text in a block, and of a long text that are counted at once.
CHUNK, STRETCH = 250_000, 250_000
#: Blocks in a row group of the written matrix and in an Arrow batch of it: readers hold either whole, in every task.
GROUP = 16
#: Zero bytes that one look-up shifts by at most; words longer than WORD go to zlib one by one.
SHIFT, WORD = 255, 48

_STEP = np.zeros(256, dtype=np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _STEP[_i] = _c


def _shifts() -> np.ndarray:
    """[n * 1024 + k * 256 + b]: the byte b at place k of a checksum, shifted by n zero bytes."""
    out = np.empty((SHIFT + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHIFT + 1):
        out[n] = _STEP[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out.ravel()


_SHIFTS = _shifts()
#: For each byte: as it counts after lower-casing A-Z, and whether it is part of a word.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums of what they are of with `by` zero bytes put after it, before a following part's is added by xor."""
    out, left = crc.copy(), by.astype(np.int64)
    at = np.arange(len(out))
    while len(at):
        c, n = out[at], np.minimum(left[at], SHIFT)
        base = n * 1024
        out[at] = _SHIFTS[base + (c & 255)] ^ _SHIFTS[base + 256 + ((c >> 8) & 255)] ^ _SHIFTS[base + 512 + ((c >> 16) & 255)] ^ _SHIFTS[base + 768 + (c >> 24)]
        left[at] -= n
        at = at[left[at] > 0]
    return out


def word_checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of the bytes."""
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    at = np.flatnonzero((sizes > 0) & (sizes <= WORD))
    j = 0
    while len(at):
        c = crc[at]
        crc[at] = _STEP[(c ^ data[starts[at] + j]) & 255] ^ (c >> 8)
        j += 1
        at = at[sizes[at] > j]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > WORD).tolist():
        crc[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    return crc


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, number of the text) of the words of texts that lie one after the other, text i from bounds[i] to bounds[i + 1]."""
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]  # a word ends with its text
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(bounds, starts, side="right") - 1


def run_checksums(crc: np.ndarray, sizes: np.ndarray, owner: np.ndarray, run: int = RUN) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 .. `run` words: (checksums of the words joined by a space, their text)."""
    out, held, whose = [(crc, owner)], crc, owner
    after_space = shifted(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), sizes) ^ crc
    for n in range(2, run + 1):
        if len(crc) < n:
            break
        longer = shifted(held[:-1], sizes[n - 1 :] + 1) ^ after_space[n - 1 :]
        held, whose = longer, owner[n - 1 :]
        same = owner[: len(whose)] == whose
        out.append((longer[same], whose[same]))
    return out


def long_counts(data: np.ndarray, run: int = RUN, stretch: int = STRETCH) -> tuple[np.ndarray, int]:
    """(features in each bucket, words) of one text's bytes, a stretch at a time."""
    totals, n_words, a = np.zeros(BUCKETS, dtype=np.int64), 0, 0
    crc, sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    while a < len(data):
        b = min(a + stretch, len(data))
        while b < len(data) and _IN_WORD[data[b]]:  # not within a word
            rest = np.flatnonzero(~_IN_WORD[data[b : b + stretch]])
            b = b + int(rest[0]) if len(rest) else min(b + stretch, len(data))
        part = data[a:b]
        starts, own, _ = words_of(part, np.array([0, len(part)]))
        n_words += len(starts)
        old = len(crc)  # words of the last stretch, which only begin runs that reach into this one
        crc, sizes = np.concatenate([crc, word_checksums(part, starts, own)]), np.concatenate([sizes, own])
        for n, (values, _) in enumerate(run_checksums(crc, sizes, np.zeros(len(crc), dtype=np.int64), run), 1):
            totals += np.bincount(values[max(0, old - n + 1) :] % BUCKETS, minlength=BUCKETS)
        crc, sizes, a = crc[max(0, len(crc) - run + 1) :], sizes[max(0, len(sizes) - run + 1) :], b
    return totals, n_words


def csr(texts: pa.Array, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, buckets, counts, number of words) of texts without nulls."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _LOWER[np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]]] if raw is not None else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    if len(texts) == 1 and len(data) > STRETCH:
        totals, n_words = long_counts(data, run)
        buckets = np.flatnonzero(totals)
        return np.array([0, len(buckets)]), buckets, totals[buckets], np.array([n_words])
    starts, sizes, owner = words_of(data, bounds)
    keys = [own * BUCKETS + (values % BUCKETS).astype(np.int64) for values, own in run_checksums(word_checksums(data, starts, sizes), sizes, owner, run)]
    key, counts = np.unique(np.concatenate(keys), return_counts=True)
    document, bucket = np.divmod(key, BUCKETS)
    return np.searchsorted(document, np.arange(len(texts) + 1)), bucket, counts, np.bincount(owner, minlength=len(texts))


def _pack(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


#: Kinds of the packed columns: little-endian, as they are on every machine.
_KINDS = {"starts": "<i8", "buckets": "<u2", "counts": "<u4", "words": "<i8"}


def _blocks(id_type: pa.DataType, run: int, chunk: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
            a = 0
            while a < len(texts):
                b, total = a + 1, int(sizes[a])
                while b < len(texts) and total + int(sizes[b]) <= chunk:
                    total += int(sizes[b])
                    b += 1
                made = dict(zip(_KINDS, csr(texts.slice(a, b - a), run), strict=True))
                ids = pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(id_type))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([_pack(made[c], kind)], pa.binary()) for c, kind in _KINDS.items()]], names=["ids", *_KINDS])
                a = b

    return work


def count_matrix(texts: DataFrame, doc_id: str, text: str = "text", run: int = RUN, chunk: int = CHUNK) -> DataFrame:
    """The document-by-bucket matrix as CSR blocks, written: ids, and packed starts, buckets, counts and words.

    A null text has no feature.  Repeated rows have a row each; an empty table has no block.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = texts.schema[doc_id].dataType
    own = texts.select(texts[f"`{doc_id}`"].alias("id"), texts[f"`{text}`"].alias("text"))
    schema = f"ids array<{kind.simpleString()}>, " + ", ".join(f"{c} binary" for c in _KINDS)
    with small_batches(texts.sparkSession):
        return written(own.mapInArrow(_blocks(to_arrow_type(kind), run, chunk), schema), **{"compression": "zstd", "parquet.block.row.count.limit": str(GROUP)})


def _unpack(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(batch.column(c)[i].as_py(), dtype=kind) for c, kind in _KINDS.items() if c in batch.schema.names}


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            x = _unpack(batch, i)
            np.add.at(totals, x["buckets"], x["counts"])
    some = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(totals[some], pa.int64())], names=["bucket", "n"])


def column_sums(matrix: DataFrame) -> np.ndarray:
    """The features in each bucket over all rows: BUCKETS numbers, to which each task adds at most as many."""
    with small_batches(matrix.sparkSession, GROUP):
        found = matrix.select("buckets", "counts").mapInArrow(_sums, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of the target's share to the corpus's, each count raised by 1, in whole thousandths."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(UNIT * math.log((t + 1.0) * (s_all + float(BUCKETS)) / ((s + 1.0) * (t_all + float(BUCKETS))))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _products(gain: np.ndarray, id_type: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _unpack(batch, i)
                n = x["counts"].astype(np.int64)
                # Differences of running sums, so that rows without an entry get 0.
                upto = np.append(0, np.cumsum(n * gain[x["buckets"]]))
                many = np.append(0, np.cumsum(n))
                ids = pa.array(batch.column("ids")[i].as_py(), id_type)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(v, pa.int64()) for v in (x["words"], np.diff(many[x["starts"]]), np.diff(upto[x["starts"]]))]], names=["doc_id", "n_words", "n_features", "weight"])

    return work


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of the matrix: its product with the gains."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = matrix.schema["ids"].dataType.elementType
    out = StructType([StructField("doc_id", kind), *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]])
    return matrix.mapInArrow(_products(gain, to_arrow_type(kind)), out)


def noise(doc_id: str = "doc_id", seed: int = SEED):
    """A Gumbel draw in whole thousandths, from a hash of the id; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_id: str = "item_id", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of `docs`: Gumbel top-k over importance weights.

    Of the rows with at least `least_words` words, `percent` in a hundred with the highest scores are drawn (rounded down), ties
    to the smaller id, null ids last, repeated rows in any order; rank is null for all others.  Null and empty texts have no
    feature and weight 0.  An empty target leaves gains that favour rare buckets; an empty table gives no rows.
    """
    matrix = count_matrix(docs, doc_id, text)
    gain = gains(column_sums(matrix), column_sums(count_matrix(target, target_id, target_text)))
    with small_batches(docs.sparkSession, GROUP):
        scored = written(weights(matrix, gain).withColumn("score", F.col("weight") + noise(seed=seed)).withColumn("row", F.monotonically_increasing_id()))
    enough = scored.filter(F.col("n_words") >= least_words).withColumn("one", F.lit(1).cast("bigint"))
    order = F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d"))
    ranked, upto = running_sums(enough, order, {"rank": "one"})
    drawn = percent * (upto["rank"] or 0) // 100
    columns = [F.col("doc_id").alias(doc_id), "n_features", "weight", "score"]
    some = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint").alias("rank"))
    return some.unionByName(scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def op11_importance_csr(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of `documents`, with `benchmark` as the target."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    steps = ", ".join(f"{int(x)}::UINTEGER" for x in _STEP)
    digits = "list_transform(range(0, octet_length(encode(f))), lambda i: (strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1)"
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    runs = " UNION ALL ".join(f"SELECT rid, side, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS f FROM words WHERE len(w) >= {n}" for n in range(1, RUN + 1))
    return f"""
WITH words AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, 0 AS side, doc_id, {words} AS w FROM documents
    UNION ALL SELECT -row_number() OVER () AS rid, 1, NULL, {words} FROM benchmark),
steps AS MATERIALIZED (SELECT [{steps}] AS s),
runs AS MATERIALIZED (SELECT rid, side, f, count(*) AS n FROM ({runs}) GROUP BY ALL),
coded AS MATERIALIZED (
    SELECT f, xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(d, lambda b: b::UINTEGER)),
        lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1])), 4294967295::UINTEGER) % {BUCKETS} AS bucket
    FROM (SELECT f, {digits} AS d FROM (SELECT DISTINCT f, hex(f) AS x FROM runs)), steps),
counted AS MATERIALIZED (SELECT rid, side, bucket, sum(n)::BIGINT AS n FROM runs JOIN coded USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM counted GROUP BY bucket),
gained AS (SELECT bucket, floor({UNIT} * ln((t + 1) * ((SELECT sum(s) FROM sums) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM sums) + {BUCKETS}))))::BIGINT AS g FROM sums),
weighed AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM counted JOIN gained USING (bucket) GROUP BY rid),
scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-{UNIT} * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN weighed USING (rid) WHERE side = 0)
SELECT doc_id, n_features, weight, score,
    CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * (SELECT count(*) FROM scored WHERE n_words >= {LEAST_WORDS}) // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
"""


OP11_SQL = _sql()
