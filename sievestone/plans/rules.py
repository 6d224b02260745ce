"""The rules of data governance: domains, formats, weights and policies, from JSON or by default."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace

#: Fixed values of the data model: genres, age codes and what a needless last field holds.
GENRES = ("Action", "Adventure", "Animation", "Children's", "Comedy", "Crime", "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western")
AGES = ("1", "18", "25", "35", "45", "50", "56")
DIMENSIONS = ("accurate", "complete", "unique", "up_to_date", "consistent")
#: Columns of the three tables in file order.
COLUMNS = {"ratings": ("uid", "mid", "rating", "ts"), "movies": ("mid", "title", "genres"), "users": ("uid", "gender", "age", "occup", "zipcode")}
#: Columns whose absence counts against completeness.
REQUIRED = {"ratings": ("uid", "mid", "rating", "ts"), "movies": ("mid", "title"), "users": ("uid",)}


class RuleError(ValueError):
    """A rule file that can't be used."""


@dataclass(frozen=True)
class Rules:
    """Fixed values are the defaults of the data model: bounds, times, marks and weights."""

    separator: str = "::"
    other_separators: tuple = (",", "|", ":")
    extra_field: str = "EXTRA_FIELD"
    genres: tuple = GENRES
    genders: tuple = ("M", "F")
    ages: tuple = AGES
    max_occupation: int = 20
    rating_bounds: tuple = (1, 5)
    year_bounds: tuple = (1900, 2003)
    user_domain: tuple | None = (1, 6040)
    movie_domain: tuple | None = (1, 3952)
    ts_bounds: tuple = (956703932, 1046454590)
    ms_above: int = 100_000_000_000
    t1: int = 974862386
    t2: int = 976422054
    conflict_policy: dict = field(default_factory=lambda: {"ratings": "isolate", "movies": "keep_best", "users": "keep_best"})
    weights: dict = field(default_factory=lambda: {"accurate": 0.25, "complete": 0.25, "unique": 0.15, "up_to_date": 0.10, "consistent": 0.25})

    def __post_init__(self):
        if set(self.weights) != set(DIMENSIONS) or abs(sum(self.weights.values()) - 1) > 1e-6:
            raise RuleError("weights must name the five dimensions and sum to 1")
        if self.t1 >= self.t2:
            raise RuleError("t1 must lie before t2")
        bad = [p for p in self.conflict_policy.values() if p not in ("isolate", "keep_best")]
        if bad:
            raise RuleError(f"unknown conflict policy: {bad[0]}")

    def domain(self, table: str) -> tuple | None:
        return {"users": self.user_domain, "movies": self.movie_domain}[table]

    @classmethod
    def load(cls, path: str) -> Rules:
        """Rules of a JSON object: by the names of this class, or nested in the sections of NESTED.

        Keys that start with '_' are comments, and so are keys of sections that name nothing here; at the top, unknown names
        are refused.  A policy, weight or domain that isn't told keeps its default.
        """
        try:
            with open(path, encoding="utf-8") as f:
                given = _told(json.load(f))
        except (OSError, ValueError) as e:
            raise RuleError(f"no usable rules at {path}: {e}") from e
        if not isinstance(given, dict):
            raise RuleError(f"the rules at {path} are no object")
        names, sections = {f.name for f in fields(cls)}, {x[0] for x in NESTED} | {x[1] for x in BOUNDS}
        if unknown := set(given) - names - sections - TOLD:
            raise RuleError(f"unknown rules: {sorted(unknown)}")
        found = {k: v for k, v in given.items() if k in names and not (k in sections and isinstance(v, dict))}
        for section, key, name in NESTED:
            if isinstance(part := given.get(section), dict) and key in part:
                found[name] = part[key]
        for name, section, low, high in BOUNDS:
            if isinstance(part := given.get(section), dict) and low in part and high in part:
                found[name] = [int(part[low]), int(part[high])]
        for table, name in (("users", "user_domain"), ("movies", "movie_domain")):
            if bounds := (given.get("id_domains") or {}).get(table):
                found[name] = [int(bounds["min"]), int(bounds["max"])]
        for name in ("weights", "conflict_policy"):
            if name in given:
                found[name] = {k: v for k, v in given[name].items() if k in getattr(cls(), name)} if name == "conflict_policy" else given[name]
        if isinstance(found.get("extra_field"), list):
            if len(found["extra_field"]) != 1:
                raise RuleError("one mark of a needless field is needed")
            found["extra_field"] = found["extra_field"][0]
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})

    @classmethod
    def resolve(cls, path: str | None = None, candidates: tuple = ()) -> Rules:
        """The rules at a given path, else at that of the environment's SIEVESTONE_RULES, else at the first candidate that exists.

        A path that is named but isn't there is refused, and so is finding none: rules are never guessed.
        """
        named = path or os.environ.get("SIEVESTONE_RULES")
        if named:
            return cls.load(named)
        for c in candidates:
            if os.path.exists(c):
                return cls.load(c)
        raise RuleError("no rules were named")


def _told(value):
    """Without the keys that are comments."""
    if isinstance(value, dict):
        return {k: _told(v) for k, v in value.items() if not k.startswith("_")}
    return value


#: Sections of a nested rule file, their keys, and the rules that they set; ...
NESTED = (
    ("time", "T1_epoch", "t1"), ("time", "T2_epoch", "t2"), ("parsing", "canonical_separator", "separator"), ("parsing", "tolerated_separators", "other_separators"), ("parsing", "extra_field_markers", "extra_field"), ("genres", "valid", "genres"),
    ("users", "valid_gender", "genders"), ("users", "valid_age", "ages"), ("users", "occupation_max", "max_occupation"), ("ratings", "timestamp_ms_threshold", "ms_above"),
)
#: ... bounds: the rule, its section, and the keys of both ends; ...
BOUNDS = (("year_bounds", "movies", "title_year_min", "title_year_max"), ("rating_bounds", "ratings", "rating_min", "rating_max"), ("ts_bounds", "ratings", "timestamp_min", "timestamp_max"))
#: ... and what such a file may tell besides.
TOLD = frozenset(("rule_version", "input_version", "output_version", "data_version", "required_fields", "unique_keys", "consistency_keys", "id_domains", "output"))


#: The rules under which the driver's tables are looked at as ratings, movies and users.
SAMPLE_RULES = Rules(user_domain=(1, 1_000_000), movie_domain=(1, 1_000_000), ts_bounds=(788918400, 1000000000), t1=925000000, t2=960000000)
