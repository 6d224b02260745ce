"""Time limits, declared tools, whole results, and versions that several savers make at once."""

import hashlib
import json
import sys
import threading
import time
import types

import pytest
from pyspark.sql import functions as F

from sievestone.plans import config, limits, tools
from sievestone.plans import service as S
from sievestone.plans.rules import Rules
from sievestone.sources import artefacts

RULES = Rules(t1=1_000_000, t2=2_000_000)


def slow(spark, seconds=60):
    """A job of eight tasks that sleep, a tenth of a second a row."""
    nap = F.udf(lambda i: time.sleep(0.1) or i, "long")
    return spark.range(0, seconds * 80, numPartitions=8).select(nap("id").alias("i")).agg(F.sum("i")).first()


def running(spark):
    return len(spark.sparkContext.statusTracker().getActiveJobsIds())


def quiet(spark, within=20):
    end = time.monotonic() + within
    while running(spark) and time.monotonic() < end:
        time.sleep(0.1)
    return not running(spark)


def test_work_that_overruns_has_its_jobs_stopped(spark):
    began = time.monotonic()
    with pytest.raises(limits.Overrun):
        limits.limited(spark, lambda: slow(spark), 2)
    assert time.monotonic() - began < 25 and quiet(spark)
    assert limits.limited(spark, lambda: spark.range(10).count(), 60) == 10


def test_jobs_that_begin_later_are_stopped_too(spark):
    """Work that catches the failure of one job and goes on gets no further."""
    begun = []

    def stubborn():
        for i in range(3):
            begun.append(i)
            try:
                slow(spark)
            except Exception:  # as a loop that tries again may do
                continue

    with pytest.raises(limits.Overrun):
        limits.limited(spark, stubborn, 1)
    assert quiet(spark) and begun == [0, 1, 2]


def test_other_jobs_of_the_session_go_on(spark):
    found = []
    other = threading.Thread(target=lambda: found.append(spark.range(0, 60, numPartitions=2).select(F.udf(lambda i: time.sleep(0.1) or i, "long")("id").alias("i")).agg(F.sum("i")).first()[0]))
    other.start()
    with pytest.raises(limits.Overrun):
        limits.limited(spark, lambda: slow(spark), 1)
    other.join()
    assert found == [sum(range(60))]


def test_tries(spark, monkeypatch):
    seen = []

    def second_time():
        seen.append(1)
        if len(seen) == 1:
            raise OSError("an executor died")
        return "fine"

    found, ran = limits.attempts(spark, second_time, 30, "x")
    assert found == "fine" and ran["attempt"] == 2 and "OSError: an executor died" in ran["failed_tries"][0]

    def semantic():
        seen.append(2)
        raise S.TaskError("UNKNOWN_USER", "none")

    with pytest.raises(S.TaskError) as e:
        limits.attempts(spark, semantic, 30, "x")
    assert e.value.code == "UNKNOWN_USER" and seen.count(2) == 1
    with pytest.raises(S.TaskError) as e:
        limits.attempts(spark, lambda: slow(spark), 1, "clustering_kmeans")
    assert e.value.code == "ALGORITHM_ERROR" and len(e.value.detail["log"]) == 2 and "Overrun" in e.value.detail["log"][1] and quiet(spark)


def declared(entries, **more):
    return config.Config({"algorithms": {"clustering": entries}, **more})


def test_declared_tools(tmp_path, monkeypatch):
    whole = config.Config()
    assert whole.names("clustering") == ["dbscan", "kmeans"] and "dimensionality_reduction_tsne" in whole.tools() and len(whole.tools()) == 6
    tool = whole.tool("clustering", "kmeans", {"k": 4, "colour": 1})
    assert tool.name == "clustering_kmeans" and tool.run is tools.kmeans_tool and tool.seconds == 600 and tool.parameters == {"k_candidates": [2, 3, 4, 5, 6, 7, 8], "seed": 42, "max_iter": 100, "k": 4}
    for args, code in ((("poetry", "kmeans"), "INVALID_REQUEST"), (("clustering", "birch"), "MODEL_NOT_FOUND"), (("clustering", "kmeans", {"k": 99}), "INVALID_PARAMETER")):
        with pytest.raises(S.TaskError) as e:
            whole.tool(*args)
        assert e.value.code == code
    few = declared({"kmeans": {"module": "nowhere.at.all"}, "dbscan": {"module": "sievestone.plans.tools", "entry": "none"}, "_note": "text", "bare": {}}, allowed_parameters={"kmeans": {"k": [2, 3]}})
    assert few.names("clustering") == ["dbscan", "kmeans"] and few.require("clustering", "kmeans")["module"] == "nowhere.at.all"
    for a in ("kmeans", "dbscan", "bare", "_note"):
        with pytest.raises(S.TaskError) as e:
            few.tool("clustering", a)
        assert e.value.code == "MODEL_NOT_FOUND"
    path = tmp_path / "analysis.json"
    path.write_text(json.dumps({"algorithms": {"clustering": {"kmeans": {"module": "sievestone.plans.tools", "entry": "kmeans_tool", "parameters": {"seed": 7, "timeout_s": 9}}}}, "allowed_parameters": {"kmeans": {"k": [3, 5]}}}))
    monkeypatch.setenv("SIEVESTONE_ANALYSIS", str(path))
    own = config.Config.load()
    assert own.tool("clustering", "kmeans", {"k": 3}).seconds == 9 and own.tool("clustering", "kmeans").parameters == {"seed": 7}
    route = lambda **p: S.route("clustering", {"user_id": 1, **p}, "v1", config=own)
    assert route()["algorithms"] == ["kmeans"] and route(parameters={"k": 5})["parameters"] == {"kmeans": {"k": 5}}
    for payload, code in (({"algorithm": "dbscan"}, "MODEL_NOT_FOUND"), ({"parameters": {"k": 2}}, "INVALID_PARAMETER"), ({"parameters": {"seed": 2}}, "INVALID_PARAMETER")):
        with pytest.raises(S.TaskError) as e:
            route(**payload)
        assert e.value.code == code


@pytest.mark.parametrize("text", [None, "{", "[]", "{}", '{"algorithms": {"clustering": []}}', '{"algorithms": {"c": {"a": {"module": "m", "timeout_s": -1}}}}', '{"algorithms": {}, "allowed_parameters": {"kmeans": {"k": [3, 2]}}}'])
def test_a_bad_configuration_is_no_default(tmp_path, text):
    path = tmp_path / "c.json"
    if text is not None:
        path.write_text(text)
    with pytest.raises(config.ConfigError):
        config.Config.load(str(path))


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    """80 users with train history and 5 without."""
    ratings = [(u, m, (u * 7 + m * (u % 3 + 1)) % 5 + 1, 1000 * m + u) for u in range(1, 81) for m in range(1, 31) if (u + m) % 4]
    ratings += [(u, 3, 4, 1_500_000 + u) for u in range(81, 86)]
    movies = [(m, f"M{m} (1990)", RULES.genres[m % len(RULES.genres)]) for m in range(1, 31)]
    users = [(u, "F", "25", "4", "12345") for u in range(1, 86)]
    frames = (
        spark.createDataFrame(ratings, "user_id long, movie_id long, rating long, ts long"), spark.createDataFrame(movies, "movie_id long, title string, genres string"),
        spark.createDataFrame(users, "user_id long, gender string, age string, occup string, zipcode string"),
    )
    return tools.workspace(spark, *frames, RULES, str(tmp_path_factory.mktemp("results")), "data-v1", min_ratings=10)


def test_every_user_is_in_the_result_and_in_what_is_saved(spark, space):
    out = tools.run_plan(space, {"category": "clustering", "algorithms": ["kmeans", "dbscan"], "user_ids": None, "parameters": {"kmeans": {"k": 3}, "dbscan": {"eps": 6.0, "min_samples": 4}}})
    json.dumps(out)
    for name in ("kmeans", "dbscan"):
        r = out["results"][name]
        assert len(r["assignments"]) == tools.SHOWN and r["assignments_total"] == 85 and S.evidence(r)["assignments_total"] == 85
        meta, saved = tools.load_result(space, name, r["saved"]["version"])
        assert {x["user_id"] for x in saved["assignments"].collect()} == set(range(1, 86)) and saved["labels"].count() == 80
        assert meta["envelope"]["metrics"] == json.loads(json.dumps(r["metrics"])) and len(meta["features"]) == len(next(iter(r["clusters"]))["means"])
    asked = tools.run_plan(space, {"category": "clustering", "algorithms": ["kmeans"], "user_ids": [80, 84, 900], "parameters": {"kmeans": {"k": 3}}})["results"]["kmeans"]
    assert [a["user_id"] for a in asked["assignments"]] == [80, 84] and asked["assignments_total"] == 2 and asked["unknown_users"] == [900]
    assert asked["saved"]["version"] == "v2" and asked["clusters"] == out["results"]["kmeans"]["clusters"]


def test_coordinates_are_whole_and_new_users_are_placed(spark, space):
    r = tools.run_plan(space, {"category": "dimensionality_reduction", "algorithms": ["pca"], "user_ids": None, "parameters": {"pca": {"clustering_k": 3}}})["results"]["pca"]
    assert r["coordinates_total"] == 80 and len(r["coordinates"]) == tools.SHOWN
    meta, saved = tools.load_result(space, "pca")
    assert saved["coordinates"].count() == 80 and len(meta["model"]["components"]) == 2
    again = {x["user_id"]: x["coordinates"] for x in tools.place_users(space, "pca", space.profile).collect()}
    assert set(again) == set(range(1, 81))
    for x in saved["coordinates"].collect():
        assert again[x["user_id"]] == pytest.approx(x["coordinates"])
    tools.run_plan(space, {"category": "clustering", "algorithms": ["kmeans"], "user_ids": None, "parameters": {"kmeans": {"k": 3}}})
    _, clustered = tools.load_result(space, "kmeans")
    placed = {x["user_id"]: x["cluster"] for x in tools.place_users(space, "kmeans", space.profile.filter("user_id < 10")).collect()}
    assert placed == {x["user_id"]: x["cluster"] for x in clustered["labels"].filter("user_id < 10").collect()}
    with pytest.raises(S.TaskError) as e:
        tools.place_users(space, "tsne", space.profile)
    assert e.value.code == "MODEL_NOT_FOUND"


def test_a_tool_beyond_its_limit_fails_with_its_code(spark, space, monkeypatch):
    module = types.ModuleType("slow_tools")
    module.run = lambda space, plan, given: slow(spark)
    module.bare = lambda space, plan, given: {"algorithm": "x"}
    monkeypatch.setitem(sys.modules, "slow_tools", module)
    own = declared({"kmeans": {"module": "slow_tools", "timeout_s": 1}, "dbscan": {"module": "slow_tools", "entry": "bare"}})
    plan = {"category": "clustering", "algorithms": ["kmeans"], "user_ids": None, "parameters": {}}
    with pytest.raises(S.TaskError) as e:
        tools.run_plan(space, plan, own)
    assert e.value.code == "ALGORITHM_ERROR" and quiet(spark)
    with pytest.raises(S.TaskError) as e:
        tools.run_plan(space, plan | {"algorithms": ["dbscan"]}, own)
    assert "metrics" in e.value.detail["missing"]
    store = S.Store(artefacts.Shelf(spark, f"{space.folder}/tasks"))
    scheduler = S.Scheduler(store, lambda p: tools.run_plan(space, p, own))
    task = scheduler.submit(plan)
    scheduler.waiting.join()
    assert store.tasks[task]["status"] == S.FAILED and store.tasks[task]["error"]["code"] == "ALGORITHM_ERROR"


def test_stores_on_a_shared_file_system(spark, tmp_path):
    shelf = lambda: artefacts.Shelf(spark, str(tmp_path / "tasks"))
    one, two = S.Store(shelf(), "one"), S.Store(shelf(), "two")
    a, b = one.create({"n": 1}), two.create({"n": 2})
    two.refresh()
    assert {t["task_id"] for t in two.listed()} == {a, b}
    again = S.Store(shelf(), "one")
    assert again.tasks[a]["status"] == S.FAILED and again.tasks[b]["status"] == S.PENDING


def test_savers_at_once_keep_all_versions(spark, tmp_path):
    folder, found, gate = str(tmp_path / "m"), [], threading.Barrier(6)

    def saver(i):
        gate.wait()
        for j in range(3):
            found.append(artefacts.save(spark, folder, "kind", None, {"own": [i, j]}, reports={"r.md": lambda v: f"# {v}"}).rsplit("/", 1)[-1])

    threads = [threading.Thread(target=saver, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(found, key=lambda v: int(v[1:])) == [f"v{i}" for i in range(1, 19)]
    known = artefacts.versions(spark, folder, "kind")
    assert set(known) == set(found)
    assert sorted(artefacts.load(spark, folder, "kind", v)[0]["own"] for v in known) == [[i, j] for i in range(6) for j in range(3)]
    assert artefacts.read_text(spark, f"{folder}/kind/v7/r.md") == "# v7"
    with pytest.raises(artefacts.ArtefactError):
        artefacts.save(spark, folder, "kind", "v3", {})
    assert artefacts.claim(spark, f"{folder}/kind/v99/_claim")  # a saver that died leaves a number, but no version
    assert "v99" not in artefacts.versions(spark, folder, "kind")
    assert artefacts.save(spark, folder, "kind", None, {}).endswith("/v100")


def test_facts_of_files(spark, tmp_path):
    for i, data in enumerate((b"", b"\n", b"a", b"a\n", b"a\r\nb\rc\n\n\nd", b"\xe9\xff\n" * 5000)):
        path = tmp_path / f"f{i}"
        path.write_bytes(data)
        ends = data.count(b"\n")
        assert artefacts.file_facts(spark, str(path)) == (ends + (data[-1:] not in (b"", b"\n")), hashlib.sha256(data).hexdigest())
    assert artefacts.digest(spark, str(tmp_path / "f2"), "MD5") == hashlib.md5(b"a").hexdigest()
