"""The analysis configuration: which tools there are, where they are, and their defaults, ranges and time limits.

A JSON file of the form of DEFAULT.  An algorithm is declared by its module, in which `entry` is the tool; what isn't declared
doesn't run.  A time limit stands beside the parameters or among them.
"""

from __future__ import annotations

import copy
import importlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from sievestone.plans.service import PARAMETERS, TaskError, checked

#: Seconds for a tool whose entry has no limit.
LIMIT = 600.0
_HERE = "sievestone.plans.tools"

#: Tools with their defaults and limits in seconds, and the ranges of what a request may set.
DEFAULT: dict = {
    "algorithms": {
        "clustering": {
            "kmeans": {"module": _HERE, "entry": "kmeans_tool", "parameters": {"k_candidates": [2, 3, 4, 5, 6, 7, 8], "seed": 42, "max_iter": 100}, "timeout_s": 600},
            "dbscan": {"module": _HERE, "entry": "dbscan_tool", "parameters": {"min_samples": 15}, "timeout_s": 900},
        },
        "classification": {
            "gnb": {"module": _HERE, "entry": "gnb_tool", "parameters": {}, "timeout_s": 300},
            "cart": {"module": _HERE, "entry": "cart_tool", "parameters": {}, "timeout_s": 300},
        },
        "dimensionality_reduction": {
            "pca": {"module": _HERE, "entry": "pca_tool", "parameters": {"target_dimensions": 2, "information_retention_threshold": 0.8, "clustering_k": 6, "clustering_seed": 42}, "timeout_s": 600},
            "tsne": {"module": _HERE, "entry": "tsne_tool", "parameters": {"perplexity": 30.0, "n_iter": 1000, "knn_k": 10, "random_state": 42, "clustering_k": 6, "clustering_seed": 42}, "timeout_s": 1200},
        },
    },
    "allowed_parameters": {a: {p: list(r) for p, r in own.items()} for a, own in PARAMETERS.items()},
    "min_train_ratings": 10,
}


class ConfigError(RuntimeError):
    """A configuration that is missing or can't be used; there is no falling back to the defaults."""


@dataclass(frozen=True)
class Tool:
    """A declared tool."""

    name: str
    run: Callable
    parameters: dict
    seconds: float


class Config:
    """The declared tools by category and algorithm."""

    def __init__(self, content: dict | None = None):
        self.content = copy.deepcopy(DEFAULT) if content is None else content
        algorithms = self.content.get("algorithms")
        if not isinstance(algorithms, dict) or not all(isinstance(v, dict) for v in algorithms.values()):
            raise ConfigError("algorithms must be an object of objects")
        for category in algorithms:
            for a in self.names(category):
                self._seconds(algorithms[category][a])
        for a, own in (self.content.get("allowed_parameters") or {}).items():
            for p, r in own.items():
                if not isinstance(r, list) or len(r) != 2 or any(isinstance(x, bool) or not isinstance(x, int | float) for x in r) or r[0] > r[1]:
                    raise ConfigError(f"the range of {a}.{p} must be two numbers in order, not {r!r}")

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """The file at a path, else the one that SIEVESTONE_ANALYSIS names, else the defaults."""
        path = path or os.environ.get("SIEVESTONE_ANALYSIS")
        if not path:
            return cls()
        try:
            with open(path, encoding="utf-8") as f:
                content = json.load(f)
        except (OSError, ValueError) as e:
            raise ConfigError(f"{path}: {e}") from e
        if not isinstance(content, dict):
            raise ConfigError(f"{path} holds no object")
        return cls(content)

    @staticmethod
    def _seconds(entry: dict) -> float:
        found = entry.get("timeout_s", (entry.get("parameters") or {}).get("timeout_s", LIMIT))
        if isinstance(found, bool) or not isinstance(found, int | float) or not 0 < found < 1e7:
            raise ConfigError(f"a time limit must be a positive number of seconds, not {found!r}")
        return float(found)

    def names(self, category: str) -> list[str]:
        """The algorithms of a category that are declared with a module, in order of their names."""
        return sorted(a for a, e in self.content["algorithms"].get(category, {}).items() if isinstance(e, dict) and e.get("module"))

    def tools(self) -> list[str]:
        """The unified names of all declared tools."""
        return [f"{c}_{a}" for c in self.content["algorithms"] for a in self.names(c)]

    def ranges(self, algorithm: str) -> dict[str, tuple]:
        """The parameters of an algorithm that a request may set, with their least and greatest values."""
        return {p: tuple(r) for p, r in (self.content.get("allowed_parameters") or {}).get(algorithm, {}).items()}

    def require(self, category: str, algorithm: str) -> dict:
        """The entry of a declared algorithm."""
        if category not in self.content["algorithms"]:
            raise TaskError("INVALID_REQUEST", f"unknown category: {category}")
        if algorithm not in self.names(category):
            raise TaskError("MODEL_NOT_FOUND", f"{category}_{algorithm} isn't declared; these are: {', '.join(self.tools()) or 'none'}", registered=self.tools())
        return self.content["algorithms"][category][algorithm]

    def tool(self, category: str, algorithm: str, given: dict | None = None) -> Tool:
        """A declared tool with the parameters of its entry, those of a request over them."""
        entry = self.require(category, algorithm)
        name, at = f"{category}_{algorithm}", entry.get("entry", "run")
        try:
            run = getattr(importlib.import_module(entry["module"]), at)
        except (ImportError, AttributeError) as e:
            raise TaskError("MODEL_NOT_FOUND", f"{name}: there is no {at} in {entry['module']} ({e})") from e
        own = {p: v for p, v in (entry.get("parameters") or {}).items() if p != "timeout_s"}
        return Tool(name, run, own | checked(algorithm, given or {}, self.ranges(algorithm)), self._seconds(entry))
