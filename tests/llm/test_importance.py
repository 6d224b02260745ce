import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from cases import DOCUMENTS, LONG, clashing, documents, same
from pyspark.sql import functions as F

from sievestone.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TARGET = [(1, "alpha beta gamma delta"), (2, None), (3, "Password token secret"), (3, "epsilon zeta")]


def features(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return words, Counter(zlib.crc32(r.encode()) % 10_000 for r in runs)


def brute(rows, target):
    """(doc_id, n_features, weight, score) of each row, and the ids drawn in order."""
    docs = [(r[0], *features(r[1])) for r in rows]
    s, t = sum((d[2] for d in docs), Counter()), sum((features(x[1])[1] for x in target), Counter())
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_t * 0 + big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out, enough = [], []
    for i, words, counts in docs:
        weight = sum(n * gain(b) for b, n in counts.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, sum(counts.values()), weight, score))
        if len(words) >= 20:
            enough.append((-score, i is None, i or 0, i))
    return out, [x[3] for x in sorted(enough, key=lambda x: x[:3])]


def target(spark, rows=TARGET):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_matches_brute_force_on_odd_rows(spark):
    for rows in (DOCUMENTS, [], DOCUMENTS[3:5]):
        wanted, order = brute(rows, TARGET)
        for percent in (5, 40):
            got = I.resample(clashing(documents(spark, rows)), target(spark), percent=percent).collect()
            assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(wanted, key=repr)
            ranked = sorted((r["rank"], r["doc_id"]) for r in got if r["rank"] is not None)
            assert [r[0] for r in ranked] == list(range(1, percent * len(order) // 100 + 1))
            assert [r[1] for r in ranked] == order[: len(ranked)]


def test_no_target(spark):
    wanted, _ = brute(DOCUMENTS, [])
    assert sorted((tuple(r)[:4] for r in I.resample(documents(spark), target(spark, [])).collect()), key=repr) == sorted(wanted, key=repr)


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(I, "noise", lambda seed: F.lit(0).cast("bigint"))
    rows = [(i, "the same twenty words " * 6, None, None, None) for i in range(60)]
    got = I.resample(documents(spark, rows), target(spark), percent=10).filter("rank is not null").orderBy("rank")
    assert [(r["doc_id"], r["rank"]) for r in got.collect()] == [(i, i + 1) for i in range(6)]


def test_checksums_are_zlibs():
    words = [b"", b"a", b"word", "é漢".encode(), b"x" * 47, b"x" * 48, b"y" * 49, b"z" * 700]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    sizes = np.array([len(w) for w in words])
    crc = I.word_checksums(data, np.cumsum(sizes) - sizes, sizes)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    both = I.shifted(crc[:-1], sizes[1:]) ^ crc[1:]
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:], strict=False)]


def test_stretches_of_a_long_text_agree():
    texts = [LONG, "a b c d", "one", "", "x" * 500, "ab " * 400, "É" * 90 + " b " + "c" * 70 + " d"]
    for text in texts:
        words, wanted = features(text)
        data = I._LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
        for stretch in (1, 7, 64, 10**6):
            if len(data) / stretch < 3000:
                totals, n = I.long_counts(data, stretch=stretch)
                assert n == len(words) and {b: c for b, c in enumerate(totals.tolist()) if c} == dict(wanted)


def test_a_block_holds_texts_that_touch():
    texts = ["ab", "cd ef", "", "", "gh", "ab cd"]
    starts, buckets, counts, words = I.csr(pa.array(texts))
    for i, text in enumerate(texts):
        own, wanted = features(text)
        a, b = starts[i], starts[i + 1]
        assert dict(zip(buckets[a:b].tolist(), counts[a:b].tolist(), strict=True)) == dict(wanted) and words[i] == len(own)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as c:
        for t in ("documents", "benchmark"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        assert same(I.op11_importance_csr(spark, sf)) == sorted(c.execute(I.OP11_SQL).fetchall(), key=repr)


def test_readers_of_the_matrix_hold_few_blocks_at_once(spark):
    import pyarrow.parquet as pq

    rows = [(i, f"alpha beta {i}", "en", "a", 1) for i in range(10 * I.GROUP)]
    matrix = I.count_matrix(documents(spark, rows).coalesce(1), "doc_id", chunk=1)
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in matrix.inputFiles()]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == len(rows) and max(groups) <= I.GROUP
    sizes = []
    with I.small_batches(spark, I.GROUP):
        sizes = [r["n"] for r in matrix.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= I.GROUP
    assert I.column_sums(matrix).sum() == sum(sum(features(r[1])[1].values()) for r in rows)
