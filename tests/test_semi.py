from pyspark.sql import functions as F

from sievestone.functions import semi

ROWS = ['{"k": 5, "a": {"b": [{"c": "x"}, {"c": 2}]}}', '{"k": "six"}', '{"k": null}', "{}", "[1, 2]", '{"k": 5', "", None, "7", '{"k": 12, "k2": 1} ', '{"a": {"b": []}}']


def frame(spark):
    return spark.createDataFrame(list(enumerate(ROWS)), "id int, props string")


def test_fields_and_what_cannot_be_read(spark):
    got = {r.id: r for r in frame(spark).select("id", semi.parsed(F.col("props"), "k bigint, a struct<b:array<struct<c:string>>>").alias("p"), semi.malformed(F.col("props")).alias("bad")).select("id", "p.k", "p.a", f"p.{semi.MALFORMED}", "bad").collect()}
    assert {i: r.k for i, r in got.items() if r.k is not None} == {0: 5, 9: 12}
    assert [x.c for x in got[0].a.b] == ["x", "2"] and got[3][semi.MALFORMED] is None
    assert {i for i, r in got.items() if r.bad} == {5, 6} and got[5][semi.MALFORMED] == ROWS[5] and got[1][semi.MALFORMED] == ROWS[1]


def test_dotted_paths(spark):
    col = F.col("props")
    rows = frame(spark).select("id", semi.at(col, "a.b[0].c").alias("c"), semi.at(col, "a.b[1].c", "int").alias("n"), semi.at(col, "k", "int").alias("k")).collect()
    assert [(r.id, r.c) for r in rows if r.c is not None] == [(0, "x")] and rows[0].n == 2 and [r.k for r in rows if r.k is not None] == [5, 12]


def test_every_row_is_counted_once(spark):
    r = semi.profile(frame(spark), "props", {"k": "bigint", "a.b[0].c": "string"}).first()
    assert (r.records, r.nulls, r.malformed) == (11, 1, 2) and (r.k_fits, r.k_other, r.k_none) == (2, 1, 8)
    assert (r.a_b_0__c_fits, r.a_b_0__c_other, r.a_b_0__c_none) == (1, 0, 10)
    assert semi.profile(frame(spark).limit(0), "props", {"k": "bigint"}).first().records == 0
