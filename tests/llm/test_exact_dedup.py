import hashlib

import duckdb
import pytest
from cases import DOCUMENTS, clashing, documents, same
from pyspark.sql import functions as F

from sievestone.llm import exact_dedup as E
from sievestone.session import table

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    """(doc_id, keep_id, group_size) of each row, and how many of a group stay."""
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    return sorted(((i, max((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids), key=repr), len(groups)


def check(spark, rows, **options):
    found = E.exact_duplicates(documents(spark, rows), **options).collect()
    wanted, groups = brute(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in found), key=repr) == wanted
    assert sum(r["kept"] for r in found) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_odd_rows(spark):
    check(spark, DOCUMENTS)
    check(spark, [])
    check(spark, [(None, None, None, None, None)])


def test_each_step_of_the_refinement_tells_texts_apart(spark):
    start = "x" * 200
    texts = ["a", "b", "A", start + "1", start + "2", start + "1", start.upper() + "1", "y" + start, "é" * 10, "É" * 10, "é" * 10, "ǅ", "İ", "K", "k", "K", "", None, " "]
    check(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])


def test_a_crowded_bitmap_loses_nothing(spark, monkeypatch):
    """With every bit shared by many keys, rows are hashed for nothing, and results stay."""
    monkeypatch.setattr(E, "LEAST_BITS", 2)
    monkeypatch.setattr(E, "MOST_BITS", 2)
    rows = [(i, f"text {i % 90} of {'some ' * (i % 7)}", None, None, None) for i in range(300)]
    check(spark, rows)


def test_bits_are_bounded():
    assert E.bits_for(0) == E.LEAST_BITS and E.bits_for(10**12) == E.MOST_BITS
    assert E.bits_for(100_000) == 1 << 21


def test_one_group_of_most_rows(spark):
    rows = [(i, "The same text for all" if i % 3 else f"another {i}", None, None, None) for i in range(4000)]
    check(spark, rows)


def test_marks_are_those_of_the_keys(spark):
    h, bits = F.col("h"), E.bits_for(2)
    keys = E.bitmap(spark.createDataFrame([(5,), (900_000,), (-4,)], "h long"), h, bits)
    seen = E.marked(spark.createDataFrame([(5,), (6,), (900_000,), (-3,), (-4,)], "h long"), h, keys, bits, "met")
    assert {r["h"]: r["met"] for r in seen.collect()} == {5: True, 6: False, 900_000: True, -3: False, -4: True}


def test_columns_may_clash_and_repeated_rows_leave_one(spark):
    docs = clashing(documents(spark)).withColumnRenamed("lang", "keep_id").withColumnRenamed("source", "group_size").withColumn("k0", F.lit(0))
    kept = E.drop_exact_duplicates(docs).collect()
    assert kept[0].asDict().keys() == set(docs.columns)
    wanted, groups = brute(DOCUMENTS)
    assert len(kept) == groups
    assert {r["doc_id"] for r in kept} == {w[1] for w in wanted}
    assert E.drop_exact_duplicates(documents(spark, [])).count() == 0


def test_the_plan_stays_native(spark):
    plan = E.op13_progressive_exact(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "RDDScan"))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    docs = f"/root/testdata/{sf}"
    got = same(E.op13_progressive_exact(spark, docs))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{docs}/documents.parquet'")
        assert got == sorted(c.execute(E.OP13_SQL).fetchall(), key=repr)
    texts = {r["doc_id"]: r["text"] for r in table(spark, docs, "documents").collect()}
    assert all(hashlib.sha256((texts[r[0]] or "").translate(LOWER).encode()).hexdigest() == r[4] for r in got)
