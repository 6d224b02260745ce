import brute
import corpus_pipeline
import pytest
from cases import clashing, documents, prose
from test_packing import PIECES
from test_quality import plain_base
from test_simhash import plain_components, plain_fingerprint

from sievestone.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage got and gave, over the smallest tables."""
    docs, out = table(spark, SF, "documents"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.columns, docs.collect(), after.columns, after.collect()))
        docs = after
    return out


def test_stages_hand_on_the_columns(steps):
    assert [s[0] for s in steps] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "secret_scan", "packing"]
    assert all(s[1] == s[3] == ["doc_id", "text", "lang", "source", "n_chars"] for s in steps[:-1])
    assert all(len(s[4]) > 0 for s in steps)


def test_what_the_base_rules_fail_is_gone(spark, steps):
    """Nothing that the base rules fail stays; of what passes them the bands let clean documents stay and take junk."""
    _, _, before, _, after = steps[0]
    passed, kept = {r.doc_id for r in before if not plain_base(r.text)[5]}, {r.doc_id for r in after}
    assert kept <= passed and len(kept) > 0.9 * len(passed)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect() if r.doc_id in passed}
    clean, junk = ({d for d, q in labels.items() if q == y} for y in (1, 0))
    assert clean <= kept and len(junk - kept) > 0.5 * len(junk)


def test_one_of_each_group_is_left(steps):
    _, _, before, _, after = steps[2]
    least = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(least))


def test_no_known_form_of_secret_is_left(steps):
    _, _, before, _, after = steps[3]
    assert len(before) == len(after)
    new = {r.doc_id: r for r in after}
    for r in before:
        spans = brute.base_spans(r.text)
        if not spans:
            assert new[r.doc_id].text == r.text or "[SECRET]" in new[r.doc_id].text
        else:
            assert not brute.base_spans(new[r.doc_id].text) and new[r.doc_id].n_chars == len(new[r.doc_id].text)


def test_packing_has_every_document(steps):
    _, _, before, _, after = steps[4]
    assert sorted((r.doc_id, r.n_tokens) for r in after) == sorted((r.doc_id, len(PIECES.encode(r.text))) for r in before)


@pytest.mark.parametrize("rows", [None, []])
def test_odd_rows_go_through(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = clashing(table(spark, str(tmp_path), "documents"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.count()
        assert i == 4 or out.columns == docs.columns


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(prose(1).split()) == 80
