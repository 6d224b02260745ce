import itertools
import random
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from cases import DOCUMENTS, clashing, documents
from pyspark.sql import functions as F

from sievestone.llm import packing as P
from sievestone.session import table

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def cost(lengths, counts, ends):
    return sum(c * min(e for e in ends if e >= n) for n, c in zip(lengths, counts, strict=True))


def test_ends_are_the_best(spark):
    rng = random.Random(5)
    for _ in range(30):
        lengths = sorted(rng.sample(range(0, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        for k in (1, 2, 3, 5):
            best = min(cost(lengths, counts, [*e, lengths[-1]]) for e in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
            ends = P.bucket_ends(lengths, counts, k)
            assert len(ends) == min(k, len(lengths)) and cost(lengths, counts, ends) == best
    assert P.bucket_ends([], []) == []


def test_batches_hold_the_budget_and_every_row(spark):
    rows = P.pack(P.token_lengths(clashing(documents(spark))), budget=1000, buckets=3).collect()
    want = sorted((d, len(PIECES.encode(t or ""))) for d, t, *_ in DOCUMENTS if d is not None)
    assert sorted((r.doc_id, r.n_tokens) for r in rows if r.doc_id is not None) == want
    assert len(rows) == len(DOCUMENTS)
    batches = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.padded_tokens
        batches[r.bucket, r.shard, r.batch].append(r)
    for own in batches.values():
        assert len({r.slot for r in own}) == len(own) and (len(own) == 1 or len(own) * own[0].padded_tokens <= 1000 or own[0].padded_tokens == 0)
    assert P.pack(P.token_lengths(documents(spark, []))).count() == 0


def packing_sql(buckets, budget, shard_rows) -> str:
    """`pack` of a table lengths (doc_id, n_tokens) in DuckDB's SQL; no shard crowded."""
    level = """
l{k} AS (SELECT c.j, min({{'cost': p.best.cost + c.b * (c.upto - p.upto), 'i': p.j}}) AS best, any_value(c.b) AS b, any_value(c.upto) AS upto
    FROM cells c JOIN l{p} p ON p.j < c.j GROUP BY c.j),"""
    levels = "".join(level.format(k=k, p=k - 1) for k in range(2, buckets + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, j, best, b FROM l{k}" for k in range(1, buckets + 1))
    return f"""
WITH RECURSIVE stepped AS (SELECT *, 1::BIGINT << greatest(0, length(bin(n_tokens)) - 10)::INTEGER AS step FROM lengths),
rows AS (SELECT doc_id, n_tokens, ((n_tokens + step - 1) // step) * step AS cell FROM stepped),
cells AS (SELECT cell AS b, row_number() OVER (ORDER BY cell) AS j, CAST(sum(count(*)) OVER (ORDER BY cell) AS BIGINT) AS upto, count(*) AS n FROM rows GROUP BY cell),
l1 AS (SELECT j, {{'cost': b * upto, 'i': 0::BIGINT}} AS best, b, upto FROM cells),{levels}
levels AS ({every}),
walk AS (SELECT k, j, b, best.i AS i FROM levels WHERE k = least({buckets}, (SELECT count(*) FROM cells)) AND j = (SELECT max(j) FROM cells)
    UNION ALL SELECT l.k, l.j, l.b, l.best.i FROM levels l JOIN walk w ON l.k = w.k - 1 AND l.j = w.i),
ends AS (SELECT k - 1 AS bucket, b AS padded_tokens, lag(b, 1, -1) OVER (ORDER BY k) AS lower FROM walk),
placed AS (SELECT r.doc_id, r.n_tokens, CAST(e.bucket AS INTEGER) AS bucket, e.padded_tokens FROM rows r JOIN ends e ON r.cell > e.lower AND r.cell <= e.padded_tokens),
sharded AS (SELECT *, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT % CAST(ceil(count(*) OVER (PARTITION BY bucket) / {shard_rows}.0) AS BIGINT) AS BIGINT) AS shard FROM placed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket, shard ORDER BY doc_id NULLS FIRST, n_tokens) - 1 AS pos, greatest({budget} // greatest(padded_tokens, 1), 1) AS room FROM sharded)
SELECT doc_id, n_tokens, bucket, padded_tokens, shard, pos // room AS batch, pos % room AS slot FROM numbered
"""


@pytest.mark.parametrize(("folder", "buckets", "budget", "shard_rows"), [("sf0.001", 8, 16_384, 4096), ("sf0.01", 5, 3000, 64)])
def test_the_query_is_that_of_sql_over_the_tokens_of_the_library(spark, folder, buckets, budget, shard_rows):
    docs = table(spark, f"/root/testdata/{folder}", "documents")
    lengths = pd.DataFrame([(r.doc_id, len(PIECES.encode(r.text or ""))) for r in docs.collect()], columns=["doc_id", "n_tokens"])
    duck = duckdb.connect()
    duck.register("lengths", lengths)
    found = duck.execute(packing_sql(buckets, budget, shard_rows))
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    out = P.op7_length_buckets(spark, f"/root/testdata/{folder}") if buckets == P.BUCKETS else P.pack(P.token_lengths(docs), "doc_id", buckets, budget, shard_rows)
    assert sorted(out.columns) == sorted(names)
    assert sorted(tuple(r) for r in out.select(*names).collect()) == want


@pytest.mark.parametrize("one", [None, 7])
def test_many_rows_of_one_id_are_dealt_again(spark, one):
    """Most rows have no id, or one: batches still hold the budget, no shard is large, and no row is lost."""
    rows = [(one, 5 + i % 3) for i in range(3000)] + [(100 + i, 6) for i in range(300)]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=2, budget=70, shard_rows=50).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter(rows)
    assert max(Counter((r.bucket, r.shard) for r in out).values()) < 50 * P.CROWD + 50
    batches = Counter((r.bucket, r.shard, r.batch) for r in out)
    padded = {(r.bucket, r.shard, r.batch): r.padded_tokens for r in out}
    assert all(n * padded[b] <= 70 for b, n in batches.items())
    assert len({(r.bucket, r.shard, r.batch, r.slot) for r in out}) == len(rows)


def test_lengths_round_up_by_little(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 1023, 1024, 1025, 5001, 99_999, 10_000_001)], "n_tokens long").select("n_tokens", P.cell(F.col("n_tokens")).alias("c"))
    for r in df.collect():
        assert r.n_tokens <= r.c <= r.n_tokens * 1.002 + 1 and (r.n_tokens > 1024 or r.c == r.n_tokens)
