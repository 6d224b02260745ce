"""Tasks on top of the engine: plans from requests, routing, a tool registry, a task store with a queue, and results.

Plain Python; nothing here touches rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import queue
import re
import threading
import time
import uuid
from collections.abc import Callable

from sievestone.plans.rules import DIMENSIONS

#: The error codes of the interface.
CODES = ("INVALID_REQUEST", "DATA_NOT_FOUND", "INVALID_DATA_VERSION", "INVALID_RULE_VERSION", "HADOOP_EXECUTION_ERROR", "QUALITY_SCORE_ERROR", "AGENT_EXECUTION_ERROR", "INTERNAL_ERROR", "DATA_UNAVAILABLE", "VERSION_MISMATCH", "UNKNOWN_USER", "UNKNOWN_MOVIE", "INSUFFICIENT_HISTORY", "MODEL_NOT_FOUND", "INVALID_PARAMETER", "ALGORITHM_ERROR")
#: The code of the first interface that stands for a later one.
LEGACY = {
    "INVALID_REQUEST": "INVALID_REQUEST", "INVALID_PARAMETER": "INVALID_REQUEST", "DATA_UNAVAILABLE": "DATA_NOT_FOUND", "VERSION_MISMATCH": "INVALID_DATA_VERSION", "UNKNOWN_USER": "INVALID_REQUEST",
    "UNKNOWN_MOVIE": "INVALID_REQUEST", "INSUFFICIENT_HISTORY": "INVALID_REQUEST", "MODEL_NOT_FOUND": "DATA_NOT_FOUND", "ALGORITHM_ERROR": "AGENT_EXECUTION_ERROR", "INTERNAL_ERROR": "INTERNAL_ERROR",
}
#: Words of a request that ask for no cleaning, for cleaning, or for a dimension.
ONLY_SCORE = ("不清洗", "不要清洗", "无需清洗", "不用清洗", "别清洗", "先不清洗", "只评估", "仅评估", "只评分", "只打分", "仅评分", "只要评分", "只跑评分", "evaluate only", "before only", "score only", "evaluate-only", "before-only", "score-only")
CLEANING = ("清洗", "治理", "清理", "去重", "隔离", "修复", "规范化", "clean")
DIMENSION_WORDS = {"accurate": ("准确", "合法", "错误值", "格式正确"), "complete": ("完整", "缺失"), "unique": ("唯一", "重复", "去重"), "up_to_date": ("时效", "新鲜", "时间分布"), "consistent": ("一致", "引用", "关联", "孤儿")}
#: Ranges of the parameters that a request may set, by algorithm.
PARAMETERS = {
    "kmeans": {"k": (2, 30), "max_iter": (10, 1000), "seed": (0, 2147483647)}, "dbscan": {"eps": (0.01, 50.0), "min_samples": (3, 100)},
    "pca": {"target_dimensions": (2, 27), "information_retention_threshold": (0.0, 1.0), "clustering_k": (2, 30), "clustering_seed": (0, 2147483647)},
    "tsne": {"perplexity": (5.0, 50.0), "n_iter": (250, 5000), "learning_rate": (10.0, 1000.0), "knn_k": (2, 50), "random_state": (0, 2147483647), "clustering_k": (2, 30), "clustering_seed": (0, 2147483647)}, "gnb": {}, "cart": {},
}
CATEGORIES = {"clustering": ("kmeans", "dbscan"), "classification": ("gnb", "cart"), "dimensionality_reduction": ("pca", "tsne")}
MAX_USERS, SHOWN_USERS, SHOWN_POINTS, SHOWN_MOVIES = 20_000, 50, 5, 3
PENDING, RUNNING, SUCCESS, FAILED = "PENDING", "RUNNING", "SUCCESS", "FAILED"


class TaskError(Exception):
    """A failure with a code of the interface."""

    def __init__(self, code: str, message: str, **detail):
        if code not in CODES:
            raise ValueError(code)
        super().__init__(message)
        self.code, self.detail = code, detail

    def as_dict(self, legacy: bool = False) -> dict:
        code = LEGACY.get(self.code, self.code) if legacy else self.code
        return {"code": code, "message": str(self), **({"detail": self.detail} if self.detail else {})}


def governance_plan(prompt: str | None, data_version: str | None = None, rule_version: str | None = None) -> dict:
    """Whether to clean, and which dimensions a request names; words against cleaning win, and cleaning is the default.

    Versions in the request's fields win over those in its text.
    """
    text = (prompt or "").lower()
    no, yes = any(w in text for w in ONLY_SCORE), any(w in text for w in CLEANING)
    written = {"data": re.search(r"movielens-1m-v\d+(?:-clean-v\d+)?", prompt or ""), "rule": re.search(r"rule-v\d+", prompt or "")}
    notes = [f"{k} version {m[0]} in the text gives way to {own}" for (k, m), own in zip(written.items(), (data_version, rule_version), strict=True) if m and own and m[0] != own]
    return {
        "do_clean": not no, "source": "rule" if no or yes else "default", "focus": [d for d in DIMENSIONS if any(w in text for w in DIMENSION_WORDS[d])],
        "data_version": data_version or (written["data"] and written["data"][0]), "rule_version": rule_version or (written["rule"] and written["rule"][0]), "notes": notes,
    }


def user_ids(given) -> list[int]:
    """Distinct positive ids in order, from integers or strings of digits."""
    out = set()
    for x in given:
        if isinstance(x, bool) or not re.fullmatch(r"[1-9][0-9]*", str(x)):
            raise TaskError("INVALID_REQUEST", f"no user id: {x!r}")
        out.add(int(x))
    if len(out) > MAX_USERS:
        raise TaskError("INVALID_REQUEST", f"more than {MAX_USERS} users")
    return sorted(out)


def checked(algorithm: str, given: dict, ranges: dict | None = None) -> dict:
    """Parameters that the algorithm knows, as numbers in range; text and booleans are no numbers."""
    allowed = PARAMETERS[algorithm] if ranges is None else ranges
    for name, value in given.items():
        if name not in allowed:
            continue
        low, high = allowed[name]
        if isinstance(value, bool) or not isinstance(value, int | float) or (isinstance(low, int) and not isinstance(value, int)) or not low <= value <= high:
            raise TaskError("INVALID_PARAMETER", f"{name} must be a number from {low} to {high}")
    return {k: v for k, v in given.items() if k in allowed}


def route(category: str, payload: dict, data_version: str, known_user: Callable[[int], bool] | None = None, config=None) -> dict:
    """The plan of an analysis request: algorithms, users, parameters by algorithm, target and notes.

    With a configuration its algorithms and ranges hold instead of the built-in ones.
    """
    declared = CATEGORIES.get(category, ()) if config is None else config.names(category)
    ranges = PARAMETERS if config is None else {a: config.ranges(a) for a in declared}
    if category not in CATEGORIES:
        raise TaskError("INVALID_REQUEST", f"unknown category: {category}")
    if not isinstance(payload, dict):
        raise TaskError("INVALID_REQUEST", "the request must be an object")
    if payload.get("data_version", data_version) != data_version:
        raise TaskError("VERSION_MISMATCH", f"data version {data_version} is needed")
    text, notes = payload.get("query") or payload.get("prompt") or "", []
    if not isinstance(text, str) or len(text) > 2000:
        raise TaskError("INVALID_REQUEST", "query must be text of at most 2000 characters")
    algorithms = payload.get("algorithms") or ([payload["algorithm"]] if payload.get("algorithm") else list(declared))
    if unknown := [a for a in algorithms if a not in declared]:
        raise TaskError("MODEL_NOT_FOUND", f"{unknown[0]} is no algorithm of {category}")
    given = ([payload["user_id"]] if payload.get("user_id") is not None else []) + list(payload.get("user_ids") or [])
    users = user_ids(given or re.findall(r"(?:用户|user)\s*#?([1-9]\d*)", text, re.I)) or None
    if users is None and category != "dimensionality_reduction":
        raise TaskError("INVALID_REQUEST", "name the users")
    target = None
    if category == "classification":
        movie = str(payload.get("movie_id", "")).strip()
        if len(users) != 1 or not re.fullmatch("[1-9][0-9]*", movie):
            raise TaskError("INVALID_REQUEST", "classification takes one user_id and one movie_id")
        target = {"user_id": users[0], "movie_id": int(movie)}
    if users and known_user:
        strangers = [u for u in users if not known_user(u)]
        users = [u for u in users if u not in set(strangers)]
        if not users:
            raise TaskError("UNKNOWN_USER", "none of the users is known", unknown=strangers)
        if strangers:
            notes.append(f"unknown users are left out: {strangers}")
    parameters = payload.get("parameters") or {}
    if not isinstance(parameters, dict):
        raise TaskError("INVALID_REQUEST", "parameters must be an object")
    if unknown := set(parameters) - {p for a in algorithms for p in ranges[a]}:
        raise TaskError("INVALID_PARAMETER", f"unknown parameters: {sorted(unknown)}")
    return {"category": category, "algorithms": algorithms, "user_ids": users, "target": target, "parameters": {a: checked(a, parameters, ranges[a]) for a in algorithms}, "data_version": data_version, "notes": notes}


def fingerprint(prefix: str, value, length: int = 12) -> str:
    """prefix-<first digits of SHA-256 over canonical JSON>."""
    return f"{prefix}-{hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:length]}"


#: Keys that every tool's result must have, and those of a category.
NEEDED, NEEDED_BY = ("algorithm", "parameters", "metrics", "data_version", "unknown_users", "limits", "model_version"), {"clustering": ("assignments", "assignments_total", "clusters"), "classification": ("target", "prediction"), "dimensionality_reduction": ("coordinates", "coordinates_total", "comparison")}


def accepted(name: str, result: dict, category: str) -> dict:
    """A tool's result with its version; one without a key that callers rely on is refused."""
    if missing := [k for k in (*NEEDED, *NEEDED_BY.get(category, ())) if k not in result]:
        raise TaskError("ALGORITHM_ERROR", f"{name} gave no {', '.join(missing)}", missing=missing)
    plain = {k: v for k, v in result.items() if k != "tables"}
    return {**result, "result_version": fingerprint("res", plain)}


class Disk:
    """Small named texts in a folder of this machine's disk, each written whole or not at all."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def names(self) -> list[str]:
        return sorted(os.listdir(self.folder))

    def read(self, name: str) -> str:
        with open(os.path.join(self.folder, name), encoding="utf-8") as f:
            return f.read()

    def write(self, name: str, text: str) -> None:
        path = os.path.join(self.folder, name)
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f"{path}.tmp", path)


class Store:
    """Task records as JSON texts: PENDING, RUNNING, then SUCCESS or FAILED for good; what a stop interrupted has failed.

    `shelf` keeps the texts: a Disk, or sources/artefacts.py's Shelf on a file system that several drivers share.  Each of them
    has an owner's name, and a driver that starts again ends only the tasks that it had itself.
    """

    def __init__(self, shelf, owner: str = "service"):
        self.shelf, self.owner, self.lock = shelf, owner, threading.Lock()
        self.tasks: dict[str, dict] = {}
        self.refresh()
        for task in list(self.tasks.values()):
            if task["status"] in (PENDING, RUNNING) and task.get("owner", owner) == owner:
                self._write(task | {"status": FAILED, "error": {"code": "AGENT_EXECUTION_ERROR", "message": "interrupted by a restart", "stage": task.get("stage")}})

    def refresh(self) -> None:
        """Reads the records that others have written meanwhile; what isn't a record is passed over."""
        for name in self.shelf.names():
            if name.endswith(".json"):
                try:
                    task = json.loads(self.shelf.read(name))
                except (OSError, ValueError):
                    continue
                if isinstance(task, dict) and "task_id" in task:
                    self.tasks[task["task_id"]] = task

    def _write(self, task: dict) -> dict:
        self.shelf.write(f"{task['task_id']}.json", json.dumps(task, ensure_ascii=False, default=str))
        self.tasks[task["task_id"]] = task
        return task

    def create(self, plan: dict) -> str:
        with self.lock:
            return self._write({"task_id": f"task_{uuid.uuid4().hex[:10]}", "status": PENDING, "stage": None, "owner": self.owner, "created_at": time.time(), "plan": plan, "result": None, "error": None})["task_id"]

    def update(self, task_id: str, **changes) -> dict:
        with self.lock:
            task = self.tasks[task_id]
            if task["status"] in (SUCCESS, FAILED):
                raise TaskError("INTERNAL_ERROR", "the task has ended")
            if (task["status"], changes.get("status", task["status"])) not in ((PENDING, PENDING), (PENDING, RUNNING), (PENDING, FAILED), (RUNNING, RUNNING), (RUNNING, SUCCESS), (RUNNING, FAILED)):
                raise TaskError("INTERNAL_ERROR", f"no way from {task['status']} to {changes['status']}")
            return self._write(task | changes)

    def listed(self) -> list[dict]:
        return sorted(self.tasks.values(), key=lambda t: t["created_at"])

    def place(self, task_id: str) -> int:
        """How many tasks wait before this one; 0 if it isn't waiting."""
        waiting = [t["task_id"] for t in self.listed() if t["status"] == PENDING]
        return waiting.index(task_id) if task_id in waiting else 0


class Scheduler:
    """One worker that runs tasks in order of arrival."""

    def __init__(self, store: Store, work: Callable[[dict], dict]):
        self.store, self.work, self.waiting = store, work, queue.Queue()
        self.thread = threading.Thread(target=self._loop, daemon=True)
        self.thread.start()

    def submit(self, plan: dict) -> str:
        task_id = self.store.create(plan)
        self.waiting.put(task_id)
        return task_id

    def _loop(self) -> None:
        while (task_id := self.waiting.get()) is not None:
            try:
                task = self.store.update(task_id, status=RUNNING, stage="run")
                self.store.update(task_id, status=SUCCESS, stage=None, result=self.work(task["plan"]))
            except TaskError as e:
                self.store.update(task_id, status=FAILED, error=e.as_dict())
            except Exception as e:  # a task's failure is its result
                self.store.update(task_id, status=FAILED, error={"code": "AGENT_EXECUTION_ERROR", "message": str(e)})
            finally:
                self.waiting.task_done()


def change(before: dict | None, after: dict | None) -> dict:
    """After less before by dimension; null where either is."""
    get = lambda d, k: None if d is None else d.get(k)
    return {k: None if get(before, k) is None or get(after, k) is None else round(after[k] - before[k], 4) for k in DIMENSIONS}


def governance_result(plan: dict, before: dict | None, after: dict | None = None, counts: dict | None = None, problems: list | None = None, error: TaskError | None = None) -> dict:
    """What a governance task gives back; parts that don't apply or weren't reached are null, not zero."""
    return {"plan": plan, "before": before, "after": after, "change": change(before, after) if after else None, "clean": counts, "problems": problems, "status": FAILED if error else SUCCESS, "error": error.as_dict() if error else None}


def evidence(result: dict, users: list[int] | None = None) -> dict:
    """A result cut down for an answer: the asked users' assignments and coordinates, or the first few, and few movies a cluster.

    How many there are in all is told beside them, as the tool has counted them.
    """
    asked = set(users or ())
    mine = lambda rows, shown: [r for r in rows if r.get("user_id") in asked] if asked else rows[:shown]
    rows = result.get("assignments") or []
    out = {**result, "assignments": mine(rows, SHOWN_USERS), "assignments_total": result.get("assignments_total", len(rows))}
    if "coordinates" in result:
        out |= {"coordinates": mine(result["coordinates"], SHOWN_POINTS), "coordinates_total": result.get("coordinates_total", len(result["coordinates"]))}
    if "clusters" in result:
        out["clusters"] = [{**c, "representative_movies": c.get("representative_movies", [])[:SHOWN_MOVIES]} for c in result["clusters"]]
    return out
