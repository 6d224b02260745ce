import json

import pytest

from sievestone.plans import service as S
from sievestone.streaming import quality
from sievestone.plans.rules import Rules


def test_plans():
    assert S.governance_plan("先不清洗, 只看完整性缺失")["do_clean"] is False
    p = S.governance_plan("please clean movielens-1m-v2", "movielens-1m-v3")
    assert p["do_clean"] and p["source"] == "rule" and p["data_version"] == "movielens-1m-v3" and p["notes"]
    assert S.governance_plan(None)["source"] == "default"
    assert S.governance_plan("去重 和 孤儿")["focus"] == ["unique", "consistent"]


@pytest.mark.parametrize(("category", "payload", "code"), [
    ("poetry", {}, "INVALID_REQUEST"), ("clustering", [], "INVALID_REQUEST"), ("clustering", {}, "INVALID_REQUEST"), ("clustering", {"user_id": 1, "data_version": "x"}, "VERSION_MISMATCH"), ("clustering", {"user_id": 1, "algorithm": "pca"}, "MODEL_NOT_FOUND"),
    ("clustering", {"user_ids": [True]}, "INVALID_REQUEST"), ("clustering", {"user_id": 9}, "UNKNOWN_USER"), ("classification", {"user_id": 1}, "INVALID_REQUEST"), ("clustering", {"user_id": 1, "parameters": {"k": "3"}}, "INVALID_PARAMETER"),
    ("clustering", {"user_id": 1, "parameters": {"k": True}}, "INVALID_PARAMETER"), ("clustering", {"user_id": 1, "parameters": {"colour": 1}}, "INVALID_PARAMETER"), ("clustering", {"user_id": 1, "parameters": {"eps": 99}}, "INVALID_PARAMETER"),
])
def test_refusals(category, payload, code):
    with pytest.raises(S.TaskError) as e:
        S.route(category, payload, "v1", lambda u: u < 9)
    assert e.value.code == code


def test_routes():
    plan = S.route("clustering", {"query": "用户 3 和 user 12", "parameters": {"k": 4, "eps": 0.5}}, "v1", lambda u: u != 12)
    assert plan["user_ids"] == [3] and plan["parameters"] == {"kmeans": {"k": 4}, "dbscan": {"eps": 0.5}} and plan["notes"]
    assert S.route("dimensionality_reduction", {}, "v1")["user_ids"] is None
    assert S.route("classification", {"user_id": "7", "movie_id": "5", "algorithm": "gnb"}, "v1")["target"] == {"user_id": 7, "movie_id": 5}


def test_tasks_end_once_and_survive_a_restart(tmp_path):
    store = S.Store(S.Disk(str(tmp_path)))
    scheduler = S.Scheduler(store, lambda plan: {"n": 10 / plan["by"]})
    good, bad = scheduler.submit({"by": 2}), scheduler.submit({"by": 0})
    scheduler.waiting.join()
    assert store.tasks[good]["result"] == {"n": 5.0} and store.tasks[bad]["status"] == S.FAILED
    with pytest.raises(S.TaskError):
        store.update(good, status=S.RUNNING)
    waiting = store.create({})
    (tmp_path / "broken.json").write_text("{")
    again = S.Store(S.Disk(str(tmp_path)))
    assert again.tasks[waiting]["error"]["code"] == "AGENT_EXECUTION_ERROR" and again.tasks[good]["status"] == S.SUCCESS
    assert json.loads((tmp_path / f"{waiting}.json").read_text())["status"] == S.FAILED


def test_results_have_null_where_nothing_applies():
    r = S.governance_result({}, {"accurate": 90.0, "complete": None}, {"accurate": 95.5, "complete": 1.0})
    assert r["change"]["accurate"] == 5.5 and r["change"]["complete"] is None and r["change"]["unique"] is None
    assert S.governance_result({}, None, error=S.TaskError("DATA_NOT_FOUND", "x"))["after"] is None
    long = {"assignments": [{"user_id": i} for i in range(80)]}
    assert len(S.evidence(long)["assignments"]) == 50 and len(S.evidence(long, [79])["assignments"]) == 1
    full = {"coordinates": [{"user_id": i} for i in range(9)], "clusters": [{"cluster": 0, "representative_movies": [1, 2, 3, 4]}]}
    cut = S.evidence(full)
    assert len(cut["coordinates"]) == 5 and cut["coordinates_total"] == 9 and cut["clusters"][0]["representative_movies"] == [1, 2, 3] and cut["assignments"] == []
    assert S.evidence(full, [8, 3])["coordinates"] == [{"user_id": 3}, {"user_id": 8}]
    assert S.fingerprint("mdl", {"a": 1, "b": 2}) == S.fingerprint("mdl", {"b": 2, "a": 1})


def test_results_without_a_needed_key_are_refused():
    whole = dict.fromkeys((*S.NEEDED, *S.NEEDED_BY["clustering"]), 1)
    assert S.accepted("x", whole | {"tables": {"t": object()}}, "clustering")["result_version"] == S.accepted("x", whole, "clustering")["result_version"]
    for key in whole:
        with pytest.raises(S.TaskError) as e:
            S.accepted("x", {k: v for k, v in whole.items() if k != key}, "clustering")
        assert e.value.code == "ALGORITHM_ERROR" and e.value.detail == {"missing": [key]}


def test_totals_are_the_tools_own():
    cut = S.evidence({"assignments": [{"user_id": i} for i in range(50)], "assignments_total": 6040, "coordinates": [], "coordinates_total": 7})
    assert cut["assignments_total"] == 6040 and cut["coordinates_total"] == 7


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.dat").write_bytes("1::10::5::974000000\nx::10::6::1\n".encode())
    q = quality.running_check(quality.line_stream(spark, str(tmp_path / "in")), "ratings", Rules()).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    row = spark.table("running").first()
    assert (row.ratings_total, row.ratings_r_uid_bad, row.ratings_r_rating_bad) == (2, 1, 1)


def test_event_windows_over_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Files that arrive one after the other, and a second run that goes on from the first one's state."""
    rows = [(i, f"2024-01-01 {i % 5:02d}:{i % 60:02d}:00", ("a", "b")[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double")
    where = str(tmp_path / "in")
    stream = lambda: quality.event_windows(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(where), late="30 days")
    for part in (0, 1):
        df.filter(f"event_id % 2 = {part}").coalesce(1).write.mode("append").parquet(where)
        got = quality.run_to_end(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quality.event_windows(spark.read.parquet(where)).collect())) and got.count() == 10
