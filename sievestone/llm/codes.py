"""Product codes of vectors by delta-maintained Lloyd rounds, in whole numbers throughout.

Components become floor(SCALE * x); vectors are cut into PARTS equal parts, and each part position has a codebook of ENTRIES
entries.  The parts lie in blocks of up to BLOCK vectors, one row each, in a table bucketed by block.  A round's
assignments are persisted in a table bucketed alike, so that the next round joins a block to its previous assignments
without a shuffle.  Only parts whose assignment has changed contribute: minus to their old entry, plus to their new one,
summed within a block; these sums, at most PARTS * ENTRIES a block and fewer each round, are all that is shuffled.  Added to the
running counts and sums, persisted after each round, they give the next codebooks exactly.  A round without a
change ends the work, as every later one would be the same.

Distances are exact: by matrix products in double precision where all sums stay below 2 ** 53, else in 64-bit integers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from sievestone.session import dropped, join_keyed, shared_dir, table, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors in a block.
BLOCK = 1024


def _bucketed(df: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """The frame as a table bucketed by its column `block` in the shared folder, and the table's name."""
    spark, name = df.sparkSession, f"sievestone_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name), name


def _free(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dropped(spark, f"{shared_dir(spark)}/{name}")


def usable(rows: DataFrame, embedding: str, names: list[str], parts: int, scale: int) -> DataFrame:
    """The columns `names` and v, whole numbers, of rows whose vector can be cut and coded."""
    v = F.col("v")
    own = rows.select(*[F.col(c) for c in names], F.col(embedding).alias("v")).filter("v is not null and size(v) > 0").filter(F.size(v) % parts == 0)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < 2.0**62))
    whole = own.filter(fine).withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("bigint")))
    limit = F.floor(F.sqrt(F.lit(2.0**61) / F.size(v))) - 2  # the squares of all differences from an entry sum up to less than 2 ** 63
    return whole.filter(F.forall(v, lambda x: F.abs(x) <= limit))


def _blocks(types: dict[str, pa.DataType], size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                x = part.column(part.num_columns - 1).flatten().to_numpy().astype("<i8")
                kept = [pa.array([part.column(i).to_pylist()], pa.list_(t)) for i, t in enumerate(types.values())]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([x.tobytes()], pa.binary())], names=[*types, "x"])

    return work


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest entry of each vector, ties to the lower index; its squared distance), for one part position."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64  # doubles hold all of these sums exactly
    left, right = x.astype(kind), book.astype(kind)
    entry = np.argmin((right * right).sum(axis=1)[None] - 2 * (left @ right.T), axis=1)
    apart = x - book[entry]
    return entry, (apart * apart).sum(axis=1)


_DELTA = StructType([StructField("part", LongType()), StructField("entry", LongType()), StructField("n", LongType()), StructField("sums", ArrayType(LongType()))])
_STATE = StructType([StructField("block", LongType()), StructField("codes", BinaryType()), StructField("deltas", ArrayType(_DELTA))])


def block_round(x: np.ndarray, books: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, list[dict]]:
    """(assignments, contributions) of a block, x by vector, part and component; before: the previous assignments, if any."""
    n, parts, size = x.shape
    entries = books.shape[1]
    codes, deltas = np.zeros((n, parts), dtype=np.uint8), []
    for p in range(parts):
        codes[:, p] = assign(x[:, p], books[p])[0]
        changed = np.arange(n) if before is None else np.flatnonzero(before[:, p] != codes[:, p])
        if not len(changed):
            continue
        count, sums = np.zeros(entries, dtype=np.int64), np.zeros((entries, size), dtype=np.int64)
        for sign, entry in ((1, codes[changed, p]), *(((-1, before[changed, p]),) if before is not None else ())):
            np.add.at(count, entry, sign)
            np.add.at(sums, entry, sign * x[changed, p])
        deltas += [{"part": p, "entry": e, "n": int(count[e]), "sums": sums[e].tolist()} for e in np.flatnonzero((count != 0) | sums.any(axis=1)).tolist()]
    return codes, deltas


def _round(books: np.ndarray):
    parts, _, size = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("x")[i].as_py(), dtype="<i8").reshape(-1, parts, size)
                held = batch.column("codes")[i].as_py()
                codes, deltas = block_round(x, books, None if held is None else np.frombuffer(held, dtype=np.uint8).reshape(-1, parts))
                yield pa.RecordBatch.from_pylist([{"block": batch.column("block")[i].as_py(), "codes": codes.tobytes(), "deltas": deltas}], schema=_ARROW)

    return work


_ARROW = pa.schema([
    ("block", pa.int64()), ("codes", pa.binary()),
    ("deltas", pa.list_(pa.struct([("part", pa.int64()), ("entry", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))),
])


def _coded(books: np.ndarray, types: dict[str, pa.DataType]):
    parts, _, size = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("x")[i].as_py(), dtype="<i8").reshape(-1, parts, size)
                entry, error = zip(*(assign(x[:, p], books[p]) for p in range(parts)), strict=True)
                code = [r.tobytes() for r in np.stack(entry, axis=1).astype(np.uint8)]
                kept = [pa.array(batch.column(c)[i].as_py(), t) for c, t in types.items()]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(code, pa.binary()), pa.array(sum(error), pa.int64())], names=[*types, "code", "error"])

    return work


def product_codes(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", keep: tuple = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list]:
    """(vec_id, the columns `keep`, code and error of each coded vector; the codebooks by part, entry and component).

    code holds a byte for each part.  Rows take part whose vector is neither null nor empty, holds no null or
    non-finite component and none so large that its error wouldn't fit 64 bits, and has the length of the smallest such
    id's, a multiple of `parts`.  Codebooks start as the parts of the `entries` smallest ids (ties by vector, null ids last), or of all
    if there are fewer; an entry that nothing is assigned to stays.  Repeated rows count each; a table without
    such rows gives none, and empty codebooks.
    """
    spark = rows.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    columns = {f"k{i}": c for i, c in enumerate((vec_id, *keep))}
    types = {k: to_arrow_type(rows.schema[c].dataType) for k, c in columns.items()}
    plain = rows.select(*[rows[f"`{c}`"].alias(k) for k, c in columns.items()], rows[f"`{embedding}`"].alias("embedding"))
    fine = usable(plain, "embedding", list(columns), parts, scale)
    order = [F.col("k0").asc_nulls_last(), F.col("v")]
    first = fine.orderBy(*order).limit(1).collect()
    wide = len(first[0]["v"]) if first else parts
    fine = fine.filter(F.size("v") == wide)
    start = [r["v"] for r in fine.orderBy(*order).limit(entries).select("v").collect()]  # `entries` vectors
    out = StructType([*[StructField(c, rows.schema[c].dataType) for c in columns.values()], StructField("code", BinaryType()), StructField("error", LongType())])
    if not start:
        return spark.createDataFrame([], out), []
    books = np.array(start, dtype=np.int64).reshape(len(start), parts, wide // parts).transpose(1, 0, 2)

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*[StructField(k, ArrayType(rows.schema[c].dataType)) for k, c in columns.items()], StructField("x", BinaryType())])
    made = fine.mapInArrow(_blocks(types, BLOCK), schema).withColumn("block", F.monotonically_increasing_id())
    blocks, blocks_name = _bucketed(written(made).repartition(buckets, "block"), buckets)
    held = [blocks_name]
    x, state, totals = blocks.select("block", "x"), None, None
    for _ in range(rounds):
        given = x.withColumn("codes", F.lit(None).cast("binary")) if state is None else x.join(state, "block").select("block", "x", "codes")
        new, name = _bucketed(given.mapInArrow(_round(books), _STATE), buckets)
        held.append(name)
        change = new.select(F.explode("deltas").alias("d")).select("d.*")
        if totals is not None and change.isEmpty():
            break
        sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(wide // parts)]
        added = (change if totals is None else change.unionByName(totals)).groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums)
        totals = written(added.select("part", "entry", "n", F.array(*[f"s{i}" for i in range(wide // parts)]).alias("sums")))
        for r in totals.collect():  # one row an entry
            if r["n"]:
                books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
        if len(held) > 2:
            _free(spark, held.pop(1))
        state = new.select("block", "codes")
    coded = written(blocks.mapInArrow(_coded(books, types), StructType([*[StructField(k, rows.schema[c].dataType) for k, c in columns.items()], *out.fields[-2:]])))
    for name in held:
        _free(spark, name)
    return coded.select(*[F.col(k).alias(c) for k, c in columns.items()], "code", "error"), books.tolist()


def books_digest(books: list) -> str:
    """sha256 of all components by part, entry and place, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()


def op12_delta_lloyd(spark, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the embeddings that can be coded."""
    coded, books = product_codes(table(spark, sf_dir, "embeddings"), keep=("label",))
    rows = coded.withColumns({"bare": F.col("label").isNull(), "own": F.coalesce("label", F.lit(0))})
    sums = rows.groupBy("bare", "own").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    found = join_keyed(rows, sums, ["bare", "own"], "n", rows.count())
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    rounds = []
    near = "(min([list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.e]))"
    for r in range(1, ROUNDS + 2):
        rounds.append(f"a{r} AS MATERIALIZED (SELECT x.rid, x.p, any_value(x.v) AS v, {near} AS found FROM parts x JOIN c{r - 1} c ON x.p = c.p GROUP BY x.rid, x.p)")
        if r <= ROUNDS:
            rounds.append(f"""s{r} AS (SELECT p, found[2] AS e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY ALL),
m{r} AS (SELECT p, e, list((CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY p, e),
c{r} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r - 1} c LEFT JOIN m{r} m ON m.p = c.p AND m.e = c.e)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS v FROM (SELECT *, unnest(range({PARTS})) AS p FROM kept)),
c0 AS MATERIALIZED (SELECT p, e - 1 AS e, v FROM parts JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, v) AS e FROM kept QUALIFY e <= {ENTRIES}) USING (rid)),
{", ".join(rounds)},
coded AS (SELECT rid, string_agg(printf('%02x', found[2]), '' ORDER BY p) AS code, sum(found[1])::BIGINT AS error FROM a{ROUNDS + 1} GROUP BY rid),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid), digest
"""


OP12_SQL = _sql()
