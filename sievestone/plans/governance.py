"""Governance runs, and their queries with DuckDB oracles over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.functions import parse
from sievestone.operators import checks, cleaning, scores
from sievestone.plans.rules import AGES, COLUMNS, GENRES, SAMPLE_RULES, Rules
from sievestone.session import cut, dropped, shared_dir, written
from sievestone.sources import files, sample

R = SAMPLE_RULES
TABLES = tuple(COLUMNS)


def clean_all(lines: dict[str, DataFrame], rules: Rules) -> dict[str, DataFrame]:
    """The cleaned rows of each table; lineage is cut, as several results are drawn from them."""
    return {t: cut(cleaning.clean(lines[t], t, rules)) for t in TABLES}


def cleaned_lines(cleaned: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {t: df.filter("tag <> 'isolated'").select(F.col("record").alias("line")) for t, df in cleaned.items()}


def before_and_after(lines: dict[str, DataFrame], rules: Rules) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Scores before cleaning, scores after it, and the cleaned rows."""
    lines = {t: written(df.select("line")) for t, df in lines.items()}
    cleaned = clean_all(lines, rules)
    sides = []
    for one, write in ((lines, False), (cleaned_lines(cleaned), True)):
        metrics = cut(checks.all_metrics(*(one[t] for t in TABLES), rules, write))
        scores.checked(metrics)
        sides.append(scores.scores(metrics, rules))
    return sides[0], sides[1], cleaned


def govern(lines: dict[str, DataFrame], rules: Rules, out: str | None = None) -> dict:
    """A whole run: scores before and after, what changed, counts and reasons of cleaning, problems, and the cleaned rows.

    Counters are gathered once each; scores of tables without rows are refused.  Each table's cleaned rows are written once and
    counted in that pass; counts that don't add up to the lines that the checks have seen end the run (Unreconciled) before
    anything is told.  With `out`, the three files of each table are written there in one more pass, held against the first.
    """
    metrics = cut(checks.all_metrics(*(lines[t] for t in TABLES), rules))
    seen = scores.checked(metrics)
    told = {t: cut(cleaning.dispositions(lines[t], t, rules)) for t in TABLES}
    cleaned, settled = {}, {}
    for t in TABLES:
        rows, observation = cleaning.observed(cleaning.resolve(told[t], t, rules))
        cleaned[t] = cut(rows)
        settled[t] = cleaning.settle(t, observation.get, int(seen[f"{t}_total"]))
    later = cut(checks.all_metrics(*(df for df in cleaned_lines(cleaned).values()), rules))
    scores.checked(later)
    counts = cut(rollup_counts(cleaned))
    each = {r["tbl"]: r.asDict() for r in counts.collect()}
    for t in TABLES:
        cleaning.settle(t, settled[t], int(seen[f"{t}_total"]), each[t])
        if out:
            files.write_cleaned(cleaned[t], out, t, int(seen[f"{t}_total"]), settled[t])
    before, after = scores.scores(metrics, rules), scores.scores(later, rules)
    problems = scores.problems(metrics, each["total"])
    return {
        "before": before, "after": after, "improvements": scores.improvements(before, after), "counts": counts, "reasons": cleaning.all_reasons(told),
        "problems": problems, "unresolved": scores.problems(later, each["total"]).filter("unresolved = 1"), "by_action": scores.by_action(problems), "cleaned": cleaned, "observed": settled,
    }


def rollup_counts(cleaned: dict[str, DataFrame]) -> DataFrame:
    """Counts of each table and of all together."""
    each = None
    for t, df in cleaned.items():
        one = cleaning.counts(df).withColumn("tbl", F.lit(t))
        each = one if each is None else each.unionByName(one)
    names = [c for c in each.columns if c != "tbl"]
    return each.rollup("tbl").agg(*[F.sum(c).cast("bigint").alias(c) for c in names]).withColumn("tbl", F.coalesce("tbl", F.lit("total")))


def _lines(spark, d: str) -> dict[str, DataFrame]:
    return {t: sample.lines(spark, d, t) for t in TABLES}


def _metrics(spark, d: str) -> DataFrame:
    return checks.all_metrics(*_lines(spark, d).values(), R)


def _parse_strict(spark, d):
    return parse.strict(sample.lines(spark, d, "ratings"), "ratings", R)


def _parse_tolerant(spark, d):
    return parse.tolerant(sample.lines(spark, d, "movies"), "movies", R).select("line", "mid", "title", "genres", F.col("fits").cast("int").alias("fits"), F.array_join("repairs", "+").alias("repairs"))


def _key(name):
    spec = next(c for c in checks.KEY_CHECKS if c[0] == name)
    return lambda spark, d: checks.key_check(sample.lines(spark, d, spec[1]), spec[2], spec[3], spec[4], name, R)


def _freshness(spark, d):
    return checks.freshness(sample.lines(spark, d, "ratings"), R).withColumn("ratings_freshness_sum", F.round("ratings_freshness_sum", 3))


def _delta(spark, d):
    before, after, _ = before_and_after(_lines(spark, d), R)
    return scores.score_delta(before, after)


def _problems(spark, d):
    lines = {t: written(df) for t, df in _lines(spark, d).items()}
    # Only counts are drawn from the cleaned rows, so the rows themselves are not kept.
    counts = rollup_counts({t: cleaning.clean(df, t, R) for t, df in lines.items()}).filter("tbl = 'total'").first().asDict()
    return scores.problems(checks.all_metrics(*lines.values(), R, False), counts).drop("subject", "reason")


def _observed(spark, d: str) -> DataFrame:
    """Each table's three files written from one pass, with the counts seen in it."""
    folder, rows = f"{shared_dir(spark)}/cleaned-{uuid.uuid4().hex}", []
    for t in TABLES:
        lines = sample.lines(spark, d, t)
        n = lines.count()
        counts = files.write_cleaned(cleaning.clean(lines, t, R), folder, t, n)
        rows.append((t, n, *(counts[c] for c in cleaning.OBSERVED)))
    dropped(spark, folder)
    return spark.createDataFrame(rows, "tbl string, lines bigint, " + ", ".join(f"{c} bigint" for c in cleaning.OBSERVED))


def _tagged(t):
    return lambda spark, d: cleaning.clean(sample.lines(spark, d, t), t, R).select("tag", "reason", "record", "copies")


QUERIES = {
    "parse_strict": _parse_strict,
    "parse_tolerant": _parse_tolerant,
    **{f"check_{t}": (lambda t: lambda spark, d: checks.format_check(sample.lines(spark, d, t), t, R))(t) for t in TABLES},
    "xref_users": lambda spark, d: checks.reference_check(sample.lines(spark, d, "ratings"), sample.lines(spark, d, "users"), 0, "users", R),
    "xref_movies": lambda spark, d: checks.reference_check(sample.lines(spark, d, "ratings"), sample.lines(spark, d, "movies"), 1, "movies", R),
    "uniq_pair": _key("ratings_pair_dup"),
    "uniq_movie": _key("movies_movie_dup"),
    "uniq_user": _key("users_user_dup"),
    "multi_value_movies": _key("movies_value_multi"),
    "multi_value_users": _key("users_attr_multi"),
    "freshness": _freshness,
    "all_metrics": lambda spark, d: _metrics(spark, d).withColumn("value", F.round("value", 3)),
    "score_five_dims": lambda spark, d: scores.scores(_metrics(spark, d), R),
    "score_delta": _delta,
    "problems_list": _problems,
    "problems_by_action": lambda spark, d: scores.by_action(_problems(spark, d)),
    "improvements": lambda spark, d: scores.improvements(*before_and_after(_lines(spark, d), R)[:2]).select("dimension", "trend", "description"),
    "reasons_rollup": lambda spark, d: cleaning.all_reasons({t: cleaning.dispositions(sample.lines(spark, d, t), t, R) for t in TABLES}),
    **{f"clean_tagged_{t}": _tagged(t) for t in TABLES},
    "clean_reasons": lambda spark, d: cleaning.reasons(cleaning.dispositions(sample.lines(spark, d, "ratings"), "ratings", R)),
    "clean_counts": lambda spark, d: rollup_counts({t: cleaning.clean(sample.lines(spark, d, t), t, R) for t in TABLES}),
    "clean_observed": _observed,
    "clean_conflict_fact": lambda spark, d: cleaning.clean(sample.lines(spark, d, "ratings"), "ratings", R).filter("reason = 'conflict_isolated'").select("key", "record", "copies"),
    "clean_conflict_dim": lambda spark, d: cleaning.clean(sample.lines(spark, d, "movies"), "movies", R).filter("reason = 'conflict_resolved'").select("key", "record", "copies"),
}

# The oracles, built from common table expressions for DuckDB.  What scores and problems are made of is written out here once more,
# so that a wrong row of the operators' tables shows.

_ACCURATE = "ratings: r_uid_bad, r_mid_bad, r_rating_bad, r_ts_bad; movies: m_mid_bad, m_title_empty, m_year_missing + m_year_bad; users: u_uid_bad, u_gender_bad, u_age_bad, u_occ_bad, u_zip_bad"
_REFERENCES = [("users_orphan_records", "ratings"), ("movies_orphan_records", "ratings")]
_FORMS = [
    ("movies_value_multi_violations", "movies"), ("users_attr_multi_violations", "users"), ("movies_m_genres_dup + movies_m_genres_emptyitem + movies_m_genres_unknown + movies_m_genres_empty", "movies"),
    ("movies_m_title_space", "movies"), ("users_u_zip_bad", "users"),
]
_KEYS = {"ratings_pair_dup": ("ratings", [1, 2], []), "movies_movie_dup": ("movies", [1], []), "users_user_dup": ("users", [1], []), "movies_value_multi": ("movies", [1], [2, 3]), "users_attr_multi": ("users", [1], [2, 3, 4, 5])}
_PROBLEM_ROWS = """
    ('users_u_zip_bad', 'accurate', 'fix', 'low'), ('ratings_r_uid_bad', 'accurate', 'isolate', 'high'), ('ratings_r_mid_bad', 'accurate', 'isolate', 'high'), ('ratings_r_rating_bad', 'accurate', 'isolate', 'high'),
    ('ratings_r_ts_bad', 'accurate', 'isolate', 'medium'), ('movies_m_mid_bad', 'accurate', 'isolate', 'high'), ('movies_m_title_empty', 'accurate', 'isolate', 'high'), ('movies_m_year_missing', 'accurate', 'keep', 'low'),
    ('movies_m_year_bad', 'accurate', 'keep', 'low'), ('users_u_uid_bad', 'accurate', 'isolate', 'high'), ('users_u_gender_bad', 'accurate', 'isolate', 'low'), ('users_u_age_bad', 'accurate', 'isolate', 'low'),
    ('users_u_occ_bad', 'accurate', 'isolate', 'low'), ('ratings_missing', 'complete', 'isolate', 'high'), ('movies_missing', 'complete', 'isolate', 'high'), ('users_missing', 'complete', 'isolate', 'high'),
    ('ratings_pair_dup_violations', 'unique', 'dedupe', 'high'), ('movies_movie_dup_violations', 'unique', 'dedupe', 'high'), ('users_user_dup_violations', 'unique', 'dedupe', 'high'),
    ('users_orphan_records', 'consistent', 'isolate', 'high'), ('movies_orphan_records', 'consistent', 'isolate', 'high'), ('movies_value_multi_violations', 'consistent', 'dedupe', 'high'),
    ('users_attr_multi_violations', 'consistent', 'dedupe', 'medium'), ('movies_m_genres_dup', 'consistent', 'fix', 'low'), ('movies_m_genres_emptyitem', 'consistent', 'fix', 'low'),
    ('movies_m_genres_unknown', 'consistent', 'isolate', 'low'), ('movies_m_genres_empty', 'consistent', 'isolate', 'low'), ('movies_m_title_space', 'consistent', 'fix', 'low'),
    ('movies_m_title_nonascii', 'consistent', 'keep', 'info'), ('ratings_r_ts_bad', 'up_to_date', 'isolate', 'medium')"""

_IN = lambda values: "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WIDE = f"{_BLANK} || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


def _digits(c: str) -> str:
    return f"regexp_full_match({c}, '[0-9]+')"


def _positive(c: str) -> str:
    return f"regexp_full_match({c}, '[1-9][0-9]*')"


def _num(c: str) -> str:
    return f"(CASE WHEN {_digits(c)} THEN TRY_CAST({c} AS HUGEINT) END)"


def _strict_sql(t: str, source: str) -> str:
    cols = ", ".join(f"coalesce(f[{i + 1}], '') AS {c}" for i, c in enumerate(COLUMNS[t]))
    return f"SELECT {cols}, CAST(len(f) AS INTEGER) AS arity, f FROM (SELECT string_split(line, '::') AS f FROM ({source}) WHERE line <> '')"


def _check_sql(t: str, source: str) -> str:
    d1 = f"coalesce({_num('ts')} > 0, false)"
    d2 = f"({d1} AND coalesce({_num('ts')} BETWEEN {R.ts_bounds[0]} AND {R.ts_bounds[1]}, false))"
    items = f"list_transform(string_split(genres, '|'), lambda g: trim(g, {_BLANK}))"
    some = f"trim(genres, {_BLANK}) <> ''"
    year = "TRY_CAST(regexp_extract(title, '\\(([0-9]{4})\\)[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}]*$', 1) AS INTEGER)"
    own = {
        "ratings": {"malformed": "arity <> 4", "missing": "uid = '' OR mid = '' OR rating = '' OR ts = ''", "lines": "true", "r_uid_bad": f"NOT {_positive('uid')}", "r_mid_bad": f"NOT {_positive('mid')}", "r_rating_bad": f"NOT coalesce({_num('rating')} BETWEEN 1 AND 5, false)", "d1_ok": d1, "d2_ok": d2, "r_ts_bad": f"NOT {d2}"},
        "movies": {"malformed": "arity <> 3", "missing": "mid = '' OR title = ''", "m_mid_bad": f"NOT {_positive('mid')}", "m_title_empty": f"trim(title, {_BLANK}) = ''", "m_year_missing": f"{year} IS NULL", "m_year_bad": f"coalesce({year} NOT BETWEEN 1900 AND 2003, false)", "m_title_space": "regexp_matches(title, '^[ \\t]|[ \\t]$')", "m_title_nonascii": "strlen(title) <> length(title)", "m_genres_empty": f"NOT {some}", "m_genres_emptyitem": f"{some} AND list_contains({items}, '')", "m_genres_dup": f"{some} AND len(list_distinct({items})) < len({items})", "m_genres_unknown": f"{some} AND len(list_filter({items}, lambda g: g NOT IN {_IN(GENRES)})) > 0"},
        "users": {"malformed": "arity <> 5", "missing": "uid = ''", "u_uid_bad": f"NOT {_positive('uid')}", "u_gender_bad": "gender NOT IN ('M', 'F')", "u_age_bad": f"age NOT IN {_IN(AGES)}", "u_occ_bad": f"NOT coalesce({_num('occup')} <= 20, false)", "u_zip_bad": "NOT regexp_full_match(zipcode, '[0-9]{5}')", "u_zip_leadingzero": "starts_with(zipcode, '0')", **{f"u_filled_{c}": f"trim({c}, {_BLANK}) <> ''" for c in COLUMNS["users"][1:]}},
    }[t]
    counted = ", ".join(f"count(*) FILTER (WHERE {p}) AS {t}_{n}" for n, p in own.items())
    return f"SELECT count(*) AS {t}_total, {counted} FROM ({_strict_sql(t, source)})"


def _xref_sql(ratings: str, refs: str, i: int, prefix: str) -> str:
    return f"""SELECT count(*) AS {prefix}_rating_records, count(*) FILTER (WHERE hit) AS {prefix}_matched_records, count(*) FILTER (WHERE NOT hit) AS {prefix}_orphan_records, count(DISTINCT CASE WHEN NOT hit THEN id END) AS {prefix}_orphan_ids
        FROM (SELECT f[{i + 1}] AS id, f[{i + 1}] IN (SELECT g[1] FROM (SELECT string_split(line, '::') AS g FROM ({refs}) WHERE line <> '') WHERE {_positive('g[1]')}) AS hit
        FROM (SELECT string_split(line, '::') AS f FROM ({ratings}) WHERE line <> '') WHERE len(f) = 4 AND f[{i + 1}] <> '')"""


def _key_sql(name: str, source: str) -> str:
    _, keys, values = _KEYS[name]
    part = lambda places: "concat_ws('::', " + ", ".join(f"f[{i}]" for i in places) + ")" if places else "''"
    many = "count(DISTINCT v)" if values else "count(*)"
    return f"""SELECT count(*) AS {name}_keys, count(*) FILTER (WHERE n > 1) AS {name}_violations FROM (SELECT k, {many} AS n FROM (SELECT {part(keys)} AS k, {part(values)} AS v
        FROM (SELECT string_split(line, '::') AS f FROM ({source}) WHERE line <> '') WHERE len(f) >= {max(keys + values)}) WHERE k <> '' GROUP BY k)"""


def _fresh_sql(source: str, digits: int = 12) -> str:
    ok = f"coalesce(len(f) >= 4 AND {_digits('f[4]')}, false)"
    return f"""SELECT round(coalesce(sum(CASE WHEN {ok} THEN least(greatest((coalesce(TRY_CAST(f[4] AS HUGEINT)::DOUBLE, 1e38) - {R.t1}) / {R.t2 - R.t1}, 0.0), 1.0) END), 0.0), {digits}) AS ratings_freshness_sum,
        count(*) FILTER (WHERE {ok}) AS ratings_freshness_n, count(*) FILTER (WHERE NOT {ok}) AS ratings_freshness_skipped FROM (SELECT string_split(line, '::') AS f FROM ({source}) WHERE line <> '')"""


def _metric_parts(lines: dict[str, str]) -> list[str]:
    parts = [_check_sql(t, lines[t]) for t in TABLES]
    parts += [_xref_sql(lines["ratings"], lines["users"], 0, "users"), _xref_sql(lines["ratings"], lines["movies"], 1, "movies")]
    parts += [_key_sql(name, lines[t]) for name, (t, *_) in _KEYS.items()]
    return [*parts, _fresh_sql(lines["ratings"])]


def _metrics_sql(lines: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM ({p})) ON COLUMNS(*) INTO NAME metric VALUE value)" for p in _metric_parts(lines))


def _scores_sql(lines: dict[str, str]) -> str:
    g = lambda n: f"m['{n}']"
    mean = lambda items: "(" + " + ".join("(" + " + ".join(map(g, names.split(" + "))) + f") / {g(t + '_total')}" for names, t in items) + f") / {len(items)}.0"
    accurate = [(" + ".join(f"{t}_{n}" for n in x.split(" + ")), t) for t, own in (part.split(": ") for part in _ACCURATE.split("; ")) for x in own.split(", ")]
    rows = "(m['ratings_total'] + m['movies_total'] + m['users_total'])"
    w = R.weights
    return f"""SELECT *, round(accurate * {w['accurate']} + complete * {w['complete']} + "unique" * {w['unique']} + up_to_date * {w['up_to_date']} + consistent * {w['consistent']}, 4) AS overall FROM (
        SELECT round(100 * (1 - {mean(accurate)}), 4) AS accurate, round(100 * (1 - (m['ratings_missing'] + m['movies_missing'] + m['users_missing']) / {rows}), 4) AS complete,
        round(100 * (1 - (m['ratings_pair_dup_violations'] + m['movies_movie_dup_violations'] + m['users_user_dup_violations']) / {rows}), 4) AS "unique",
        round(round(100 * (1 - (m['ratings_total'] - m['ratings_d2_ok']) / m['ratings_total']), 4) * m['ratings_freshness_sum'] / m['ratings_freshness_n'], 4) AS up_to_date,
        round(100 * (1 - ({mean(_REFERENCES)} + {mean(_FORMS)}) / 2), 4) AS consistent
        FROM (SELECT map_from_entries(list(row(metric, value))) AS m FROM ({_metrics_sql(lines)})))"""


def _tolerant_sql(t: str, source: str) -> str:
    n = len(COLUMNS[t])
    cols = ", ".join(f"CASE WHEN fits THEN f[{i + 1}] END AS {c}" for i, c in enumerate(COLUMNS[t]))
    return f"""SELECT line, {cols}, fits, list_concat(CASE WHEN replaced THEN ['sep_replaced'] ELSE [] END, list_resize(CAST([] AS VARCHAR[]), extras + empties, 'extra_field')) AS repairs FROM (
        SELECT *, left_ - empties = {n} AND (contains(line, '::') OR replaced) AS fits FROM (SELECT *, CASE WHEN left_ > {n} AND f[left_] = '' THEN 1 ELSE 0 END AS empties FROM (SELECT *, len(f) - extras AS left_ FROM (
        SELECT line, f, NOT contains(line, '::') AND len(f) > 1 AS replaced, CASE WHEN len(f) > {n} THEN least(len(f) - {n}, coalesce(list_position(list_transform(list_reverse(f), lambda x: x <> 'EXTRA_FIELD'), true), len(f) + 1) - 1) ELSE 0 END AS extras
        FROM (SELECT line, CASE WHEN contains(line, '::') THEN string_split(line, '::') WHEN contains(line, ',') THEN string_split(line, ',') WHEN contains(line, '|') THEN string_split(line, '|') WHEN contains(line, ':') THEN string_split(line, ':') ELSE [line] END AS f FROM ({source}) WHERE line <> '')))))"""


def _domain(c: str, bounds) -> str:
    return f"coalesce({_positive(c)} AND {_num(c)} BETWEEN {bounds[0]} AND {bounds[1]}, false)"


def _judged_sql(t: str, source: str) -> str:
    """tag, reason, key, record."""
    rows = _tolerant_sql(t, source)
    if t == "ratings":
        secs = f"(CASE WHEN {_num('ts')} > {R.ms_above} THEN {_num('ts')} // 1000 ELSE {_num('ts')} END)"
        reason = f"""CASE WHEN NOT fits THEN 'field_count_mismatch' WHEN NOT {_domain('uid', R.user_domain)} THEN 'uid_out_of_domain' WHEN NOT {_domain('mid', R.movie_domain)} THEN 'mid_out_of_domain' WHEN NOT {_digits('rating')} THEN 'rating_not_integer'
            WHEN NOT coalesce({_num('rating')} BETWEEN 1 AND 5, false) THEN 'rating_out_of_range' WHEN NOT {_digits('ts')} THEN 'timestamp_not_numeric' WHEN {_num('ts')} <= 0 THEN 'timestamp_not_positive' WHEN NOT coalesce({secs} BETWEEN {R.ts_bounds[0]} AND {R.ts_bounds[1]}, false) THEN 'timestamp_out_of_range' END"""
        more, key, record = f"CASE WHEN {_num('ts')} > {R.ms_above} THEN ['timestamp_ms'] ELSE [] END", "concat_ws('::', uid, mid)", f"concat_ws('::', uid, mid, rating, CASE WHEN {_num('ts')} > {R.ms_above} THEN CAST({secs} AS VARCHAR) ELSE ts END)"
    elif t == "movies":
        items = "string_split(genres, '|')"
        reason = f"""CASE WHEN NOT fits THEN 'field_count_mismatch' WHEN NOT {_domain('mid', R.movie_domain)} THEN 'mid_out_of_domain' WHEN trim(title, {_BLANK}) = '' THEN 'title_empty' WHEN trim(genres, {_BLANK}) = '' THEN 'genres_empty'
            WHEN len(list_filter({items}, lambda g: trim(g, {_WIDE}) NOT IN {_IN(GENRES)})) > 0 THEN 'genres_invalid' END"""
        once = f"list_filter({items}, lambda g, i: list_position({items}, g) = i)"
        more = f"list_concat(CASE WHEN regexp_matches(title, '^[ \\t]|[ \\t]$') THEN ['title_space'] ELSE [] END, CASE WHEN len({once}) < len({items}) THEN ['genres_deduped'] ELSE [] END)"
        key, record = "mid", f"concat_ws('::', mid, CASE WHEN regexp_matches(title, '^[ \\t]|[ \\t]$') THEN trim(title, {_BLANK}) ELSE title END, array_to_string({once}, '|'))"
    else:
        short = f"regexp_extract(trim(zipcode, {_WIDE}), '^([0-9]{{5}})-[0-9]{{4}}$', 1)"
        reason = f"""CASE WHEN NOT fits THEN 'field_count_mismatch' WHEN NOT {_domain('uid', R.user_domain)} THEN 'uid_out_of_domain' WHEN trim(gender, {_WIDE}) NOT IN ('M', 'F') THEN 'gender_invalid' WHEN trim(age, {_WIDE}) NOT IN {_IN(AGES)} THEN 'age_invalid'
            WHEN NOT coalesce({_num('occup')} <= 20, false) THEN 'occupation_invalid' WHEN {short} = '' AND NOT regexp_full_match(zipcode, '[0-9]{{5}}') THEN 'zipcode_invalid' END"""
        more, key, record = f"CASE WHEN {short} <> '' THEN ['zip4_truncated'] ELSE [] END", "uid", f"concat_ws('::', uid, gender, age, occup, CASE WHEN {short} <> '' THEN {short} ELSE zipcode END)"
    every = "CASE WHEN len(more) > 0 THEN list_concat(CASE WHEN len(repairs) > 1 AND repairs[1] = repairs[2] THEN repairs[1:1] WHEN len(repairs) > 2 THEN repairs[1:2] ELSE repairs END, more) ELSE repairs END"
    return f"""SELECT CASE WHEN why IS NOT NULL THEN 'isolated' WHEN len(done) > 0 THEN 'fixed' ELSE 'clean' END AS tag, coalesce(why, CASE WHEN len(done) > 0 THEN array_to_string(done, '+') ELSE 'ok' END) AS reason,
        CASE WHEN why IS NULL THEN k END AS key, CASE WHEN why IS NULL THEN rec ELSE line END AS record FROM (SELECT line, why, k, rec, {every} AS done FROM (SELECT line, repairs, {reason} AS why, {key} AS k, {record} AS rec, {more} AS more FROM ({rows})))"""


def _clean_sql(t: str, source: str) -> str:
    filled = f"-len(list_filter(string_split(record, '::'), lambda x: trim(x, {_BLANK}) <> ''))"
    kept = f"SELECT key, record, count(*) AS copies, min(CASE tag WHEN 'clean' THEN 0 ELSE 1 END) AS fixed, min({{'f': CASE tag WHEN 'clean' THEN 0 ELSE 1 END, 'r': reason}}).r AS reason FROM ({_judged_sql(t, source)}) WHERE tag <> 'isolated' GROUP BY key, record"
    ranked = f"SELECT *, count(*) OVER (PARTITION BY key) AS variants, sum(copies) OVER (PARTITION BY key) AS all_copies, row_number() OVER (PARTITION BY key ORDER BY fixed, {filled}, encode(record)) AS place FROM ({kept})"
    tag = "CASE WHEN variants > 1 THEN '{}' WHEN fixed = 0 THEN 'clean' ELSE 'fixed' END AS tag, CASE WHEN variants > 1 THEN '{}' ELSE reason END AS reason"
    if R.conflict_policy[t] == "isolate":
        out = f"SELECT {tag.format('isolated', 'conflict_isolated')}, key, record, copies FROM ({ranked})"
    else:
        out = f"SELECT {tag.format('conflict', 'conflict_resolved')}, key, record, CAST(all_copies AS BIGINT) AS copies FROM ({ranked}) WHERE place = 1"
    return f"SELECT * FROM ({out}) UNION ALL SELECT tag, reason, key, record, CAST(1 AS BIGINT) AS copies FROM ({_judged_sql(t, source)}) WHERE tag = 'isolated'"


def _counts_sql(t: str, source: str) -> str:
    conflict = "reason IN ('conflict_isolated', 'conflict_resolved')"
    return f"""SELECT '{t}' AS tbl, {', '.join(f"count(*) FILTER (WHERE tag = '{x}') AS {x}_count" for x in ('clean', 'fixed', 'conflict', 'isolated'))}, count(*) FILTER (WHERE tag NOT IN ('clean', 'fixed', 'conflict', 'isolated')) AS unknown_count, CAST(sum(copies) - count(*) AS BIGINT) AS deduped_count, count(DISTINCT CASE WHEN {conflict} THEN key END) AS conflict_key_count,
        CAST(coalesce(sum(copies) FILTER (WHERE {conflict}), 0) AS BIGINT) AS conflict_record_count, CAST(sum(copies) AS BIGINT) AS total_input_count, count(*) AS total_count FROM ({_clean_sql(t, source)})"""


def oracles() -> dict[str, str]:
    lines = {t: sample.duck(sample.LINES[t]) for t in TABLES}
    after = {t: f"SELECT record AS line FROM ({_clean_sql(t, lines[t])}) WHERE tag <> 'isolated'" for t in TABLES}
    names = ("clean_count", "fixed_count", "conflict_count", "isolated_count", "unknown_count", "deduped_count", "conflict_key_count", "conflict_record_count", "total_input_count", "total_count")
    each = " UNION ALL ".join(_counts_sql(t, lines[t]) for t in TABLES)
    found = f"""SELECT p.code, p.dimension, p.action, p.severity, CAST(m.value AS BIGINT) AS count, CASE p.action WHEN 'keep' THEN 0 ELSE 1 END AS unresolved FROM ({_metrics_sql(lines)}) m
        JOIN (VALUES {_PROBLEM_ROWS}) p(code, dimension, action, severity) ON m.metric = p.code WHERE m.value > 0
        UNION ALL SELECT 'clean_conflict_keys', 'consistent', 'dedupe', 'medium', CAST(sum(conflict_key_count) AS BIGINT), 1 FROM ({each}) HAVING sum(conflict_key_count) > 0"""
    dims = "accurate, complete, \"unique\", up_to_date, consistent"
    delta = f"""SELECT b.dimension, b.v AS before, a.v AS after, round(a.v - b.v, 4) AS change, CASE WHEN abs(round(a.v - b.v, 4)) < 1e-9 THEN 'same' WHEN a.v > b.v THEN 'up' WHEN a.v < b.v THEN 'down' END AS trend
        FROM (UNPIVOT (SELECT {dims} FROM ({_scores_sql(lines)})) ON COLUMNS(*) INTO NAME dimension VALUE v) b JOIN (UNPIVOT (SELECT {dims} FROM ({_scores_sql(after)})) ON COLUMNS(*) INTO NAME dimension VALUE v) a USING (dimension)"""
    return {
        "parse_strict": f"SELECT uid, mid, rating, ts, arity FROM ({_strict_sql('ratings', lines['ratings'])})",
        "parse_tolerant": f"SELECT line, mid, title, genres, CAST(fits AS INTEGER) AS fits, coalesce(array_to_string(repairs, '+'), '') AS repairs FROM ({_tolerant_sql('movies', lines['movies'])})",
        **{f"check_{t}": _check_sql(t, lines[t]) for t in TABLES},
        "xref_users": _xref_sql(lines["ratings"], lines["users"], 0, "users"),
        "xref_movies": _xref_sql(lines["ratings"], lines["movies"], 1, "movies"),
        "uniq_pair": _key_sql("ratings_pair_dup", lines["ratings"]),
        "uniq_movie": _key_sql("movies_movie_dup", lines["movies"]),
        "uniq_user": _key_sql("users_user_dup", lines["users"]),
        "multi_value_movies": _key_sql("movies_value_multi", lines["movies"]),
        "multi_value_users": _key_sql("users_attr_multi", lines["users"]),
        "freshness": _fresh_sql(lines["ratings"], 3),
        "all_metrics": f"SELECT metric, round(value, 3) AS value FROM ({_metrics_sql(lines)})",
        "score_five_dims": _scores_sql(lines),
        "score_delta": delta,
        "problems_list": found,
        "improvements": f"""SELECT dimension, trend, CASE trend WHEN 'same' THEN dimension || ' stayed at ' || printf('%.4f', before) ELSE dimension || CASE trend WHEN 'up' THEN ' rose from ' ELSE ' fell from ' END || printf('%.4f', before) || ' to ' || printf('%.4f', after) || ', by ' || printf('%.4f', change) END AS description
            FROM ({delta}) WHERE change IS NOT NULL""",
        "reasons_rollup": " UNION ALL ".join(f"SELECT '{t}' AS tbl, reason, count(*) AS count FROM ({_judged_sql(t, lines[t])}) GROUP BY reason" for t in TABLES)
        + " UNION ALL SELECT 'total', reason, count(*) FROM (" + " UNION ALL ".join(f"SELECT reason FROM ({_judged_sql(t, lines[t])})" for t in TABLES) + ") GROUP BY reason",
        "problems_by_action": f"SELECT action, CAST(sum(count) AS BIGINT) AS count FROM ({found}) GROUP BY action",
        **{f"clean_tagged_{t}": f"SELECT tag, reason, record, copies FROM ({_clean_sql(t, lines[t])})" for t in TABLES},
        "clean_reasons": f"SELECT reason, count(*) AS count FROM ({_judged_sql('ratings', lines['ratings'])}) GROUP BY reason",
        "clean_counts": f"SELECT * FROM ({each}) UNION ALL SELECT 'total', {', '.join(f'CAST(sum({n}) AS BIGINT)' for n in names)} FROM ({each})",
        "clean_observed": f"SELECT tbl, total_input_count AS lines, {', '.join(cleaning.OBSERVED)} FROM ({each})",
        "clean_conflict_fact": f"SELECT key, record, copies FROM ({_clean_sql('ratings', lines['ratings'])}) WHERE reason = 'conflict_isolated'",
        "clean_conflict_dim": f"SELECT key, record, copies FROM ({_clean_sql('movies', lines['movies'])}) WHERE reason = 'conflict_resolved'",
    }
