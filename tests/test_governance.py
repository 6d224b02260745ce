import json
import random

import pytest
from pyspark.sql import functions as F

from sievestone.functions import parse
from sievestone.functions import text as T
from sievestone.operators import checks, cleaning, scores
from sievestone.plans import governance
from sievestone.plans.rules import RuleError, Rules
from sievestone.sources import files

RULES = Rules()
TS = "974000000"


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "line string")


def one(spark, table, line):
    r = cleaning.dispositions(lines(spark, line), table, RULES).first()
    return r.tag, r.reason, r.record


RATING_CASES = [
    (f"1,10,5,{TS}", "fixed", "sep_replaced", f"1::10::5::{TS}"),
    (f"1::10::5::{TS}::EXTRA_FIELD", "fixed", "extra_field", f"1::10::5::{TS}"),
    (f"1::10::5::{TS}::EXTRA_FIELD::EXTRA_FIELD", "fixed", "extra_field+extra_field", f"1::10::5::{TS}"),
    (f"1::10::5::{TS}::", "fixed", "extra_field", f"1::10::5::{TS}"),
    ("1::10::5", "isolated", "field_count_mismatch", "1::10::5"),
    ("no separator", "isolated", "field_count_mismatch", "no separator"),
    ("10::1320::3::1009669227000", "fixed", "timestamp_ms", "10::1320::3::1009669227"),
    (f"1::10::five::{TS}", "isolated", "rating_not_integer", None),
    (f"1::10::3.5::{TS}", "isolated", "rating_not_integer", None),
    (f"1::10::::{TS}", "isolated", "rating_not_integer", None),
    (f"1::10::0::{TS}", "isolated", "rating_out_of_range", None),
    (f"1::10::6::{TS}", "isolated", "rating_out_of_range", None),
    (f"1::10::05::{TS}", "clean", "ok", f"1::10::05::{TS}"),
    (f"1006040::10::5::{TS}", "isolated", "uid_out_of_domain", None),
    (f"01::10::5::{TS}", "isolated", "uid_out_of_domain", None),
    (f"1::9999::5::{TS}", "isolated", "mid_out_of_domain", None),
    ("1::10::5::-5", "isolated", "timestamp_not_numeric", None),
    ("1::10::5::000", "isolated", "timestamp_not_positive", None),
    ("1::10::5::1", "isolated", "timestamp_out_of_range", None),
    ("1::10::5::1234567890123456789012345", "isolated", "timestamp_out_of_range", None),
    (f"1::10::5::{'9' * 50}", "isolated", "timestamp_out_of_range", None),
]
MOVIE_CASES = [
    ("1|A (1990)|Drama|War", "isolated", "field_count_mismatch", None),
    ("1|A, The (1990)|Drama", "isolated", "field_count_mismatch", None),
    ("1:: A (1990) ::Drama", "fixed", "title_space", "1::A (1990)::Drama"),
    ("1::A (1990)::Drama|Drama", "fixed", "genres_deduped", "1::A (1990)::Drama"),
    ("1:: A (1990)::War|Drama|War", "fixed", "title_space+genres_deduped", "1::A (1990)::War|Drama"),
    ("1::A (1990)::UnknownGenre", "isolated", "genres_invalid", None),
    ("1::A (1990)::Drama|", "isolated", "genres_invalid", None),
    ("1::A (1990)::", "isolated", "genres_empty", None),
    ("1:: ::Drama", "isolated", "title_empty", None),
    ("1::Misérables (1995)::Drama", "clean", "ok", "1::Misérables (1995)::Drama"),
]
USER_CASES = [
    ("1:M:25:7:12143", "fixed", "sep_replaced", "1::M::25::7::12143"),
    ("1::M::25::7::12345-6789", "fixed", "zip4_truncated", "1::M::25::7::12345"),
    ("1:: M::25::7::12345", "clean", "ok", "1:: M::25::7::12345"),
    ("1::X::25::7::12345", "isolated", "gender_invalid", None),
    ("1::M::26::7::12345", "isolated", "age_invalid", None),
    ("1::M::25::21::12345", "isolated", "occupation_invalid", None),
    ("1::M::25::7::1234", "isolated", "zipcode_invalid", None),
]


@pytest.mark.parametrize(("table", "cases"), [("ratings", RATING_CASES), ("movies", MOVIE_CASES), ("users", USER_CASES)])
def test_dispositions(spark, table, cases):
    rows = cleaning.dispositions(lines(spark, *[c[0] for c in cases]), table, RULES).collect()
    got = {(r.tag, r.reason, r.record) for r in rows}
    assert got == {(tag, reason, record if record else line) for line, tag, reason, record in cases}
    assert len(rows) == len(cases)


def test_resolution(spark):
    rows = lines(spark, f"1::10::5::{TS}", f"1::10::5::{TS}", f"1::10::5::{TS}000", f"2::10::5::{TS}000", f"19::2692::1::{TS}", f"19::2692::4::{TS}", f"19::2692::4::{TS}", "bad", "bad")
    out = cleaning.clean(rows, "ratings", RULES)
    assert sorted((r.tag, r.reason, r.record, r.copies) for r in out.collect()) == sorted([
        ("clean", "ok", f"1::10::5::{TS}", 3), ("fixed", "timestamp_ms", f"2::10::5::{TS}", 1), ("isolated", "conflict_isolated", f"19::2692::1::{TS}", 1), ("isolated", "conflict_isolated", f"19::2692::4::{TS}", 2),
        ("isolated", "field_count_mismatch", "bad", 1), ("isolated", "field_count_mismatch", "bad", 1),
    ])
    c = cleaning.counts(out).first().asDict()
    assert (c["clean_count"], c["fixed_count"], c["isolated_count"], c["deduped_count"], c["conflict_key_count"], c["conflict_record_count"], c["total_input_count"]) == (1, 1, 4, 3, 1, 3, 9)
    assert cleaning.reconcile(c, 9) == [] and cleaning.reconcile(c, 10)
    users = cleaning.clean(lines(spark, "1::M::25::7::12345-6789", "1::F::25::7::12345", "1::M::25::7::12345"), "users", RULES).collect()
    assert [(r.tag, r.reason, r.record, r.copies) for r in users] == [("conflict", "conflict_resolved", "1::F::25::7::12345", 3)]


def test_empty_tables_have_zeros(spark):
    none = lines(spark)
    for t in ("ratings", "movies", "users"):
        assert set(checks.format_check(none, t, RULES).first()) == {0}
        assert cleaning.clean(none, t, RULES).count() == 0
    assert set(checks.reference_check(none, none, 0, "users", RULES).first()) == {0}
    s = scores.scores(checks.all_metrics(none, none, none, RULES), RULES).first()
    assert set(s.asDict().values()) == {None}


#: Published counters of a run, with the scores that belong to them.
PUBLISHED = dict(
    ratings_freshness_n=1131112, ratings_freshness_sum=346333.8298798108, ratings_d2_ok=1111608, ratings_missing=23255, ratings_r_mid_bad=9377, ratings_r_rating_bad=49886, ratings_r_ts_bad=38633, ratings_r_uid_bad=9377, ratings_total=1150241,
    movies_m_genres_dup=0, movies_m_genres_empty=50, movies_m_genres_emptyitem=0, movies_m_genres_unknown=174, movies_m_mid_bad=29, movies_m_title_empty=87, movies_m_title_space=47, movies_m_year_bad=0, movies_m_year_missing=145, movies_missing=87, movies_total=4465,
    users_missing=0, users_total=6946, users_u_age_bad=168, users_u_gender_bad=168, users_u_occ_bad=168, users_u_uid_bad=45, users_u_zip_bad=279, users_orphan_records=10502, movies_orphan_records=10502,
    ratings_pair_dup_violations=4815, movies_movie_dup_violations=495, users_user_dup_violations=789, movies_value_multi_violations=384, users_attr_multi_violations=608,
)


def test_published_scores(spark):
    m = spark.createDataFrame([(k, float(v)) for k, v in PUBLISHED.items()], "metric string, value double")
    s = scores.scores(m, RULES).first().asDict()
    assert s == {"accurate": 97.7423, "complete": 97.9906, "unique": 99.475, "up_to_date": 29.5905, "consistent": 96.7995, "overall": 91.0134}
    found = {r.code: r for r in scores.problems(m).filter("dimension <> 'up_to_date'").collect()}
    assert found["movies_m_year_missing"].unresolved == 0 and found["ratings_missing"]["count"] == 23255 and "movies_m_year_bad" not in found


def test_scores_without_freshness_or_a_table(spark):
    m = spark.createDataFrame([(k, float(v)) for k, v in PUBLISHED.items() if "fresh" not in k and not k.startswith("movies")], "metric string, value double")
    s = scores.scores(m, RULES).first()
    assert s.up_to_date == 96.6413 and s.accurate is not None


def test_rules():
    with pytest.raises(RuleError):
        Rules(weights={"accurate": 1.0})
    with pytest.raises(RuleError):
        Rules(t1=5, t2=5)
    with pytest.raises(RuleError):
        Rules.load("/nowhere.json")


def test_rules_from_json(tmp_path):
    p = tmp_path / "rules.json"
    p.write_text('{"_comment": "x", "t1": 1, "t2": 2, "ages": ["1"]}')
    r = Rules.load(str(p))
    assert (r.t1, r.t2, r.ages) == (1, 2, ("1",))
    p.write_text('{"colour": 1}')
    with pytest.raises(RuleError):
        Rules.load(str(p))


def test_latin1_files_there_and_back(spark, tmp_path):
    for name, text in (("ratings", f"1::1::5::{TS}\r\n\r\n1::2::x::{TS}"), ("movies", "1::Misérables (1995)::Drama\n2:: B (1990) ::War\n"), ("users", "1::M::25::7::01234\n")):
        (tmp_path / f"{name}.dat").write_bytes(text.encode("latin-1"))
    got = files.read_tables(spark, str(tmp_path))
    assert got["ratings"].count() == 2 and got["movies"].first().line == "1::Misérables (1995)::Drama"
    assert files.typed(got["ratings"], "ratings", RULES).count() == 1
    with pytest.raises(Exception, match="no ratings row"):
        files.typed(got["ratings"], "ratings", RULES, strict=True).count()
    counts = files.write_cleaned(cleaning.clean(got["movies"], "movies", RULES), str(tmp_path / "out"), "movies", 2)
    assert (counts["clean_count"], counts["fixed_count"], counts["total_input_count"]) == (1, 1, 2)
    raw = b"".join(p.read_bytes() for p in (tmp_path / "out/clean/movies.dat").glob("part*"))
    assert sorted(raw.decode("latin-1").splitlines()) == ["1::Misérables (1995)::Drama", "2::B (1990)::War"]
    with pytest.raises(files.DataNotFound):
        files.read_tables(spark, str(tmp_path / "none"))


def test_text_functions(spark):
    df = spark.createDataFrame([("A (1990) ",), ("A [1990]",), ("A (199x)",), ("Film (x) (2001)",)], "t string")
    assert [r[0] for r in df.select(T.title_year(F.col("t"))).collect()] == [1990, None, None, 2001]
    assert [r[0] for r in df.select(T.last_parenthesis_year(F.col("t"))).collect()] == [None, None, None, 2001]
    row = spark.range(1).select(T.utc_date(F.lit(974862386)), T.slug(F.lit("Children's Film-Noir")), T.sign_class(F.lit(-0.1)), T.sign_class(F.lit(None).cast("double")), T.shown(F.lit(None).cast("double"))).first()
    assert tuple(row) == ("2000-11-22", "childrens_film-noir", "down", None, "—")


def test_before_and_after(spark):
    ls = {t: lines(spark, *[c[0] for c in cases]) for t, cases in (("ratings", RATING_CASES), ("movies", MOVIE_CASES), ("users", USER_CASES))}
    before, after, cleaned = governance.before_and_after(ls, RULES)
    b, a = before.first(), after.first()
    assert a.accurate > b.accurate and a.complete == 100.0
    total = governance.rollup_counts(cleaned).filter("tbl = 'total'").first()
    assert total.total_input_count == total.total_count + total.deduped_count == sum(len(c) for c in (RATING_CASES, MOVIE_CASES, USER_CASES))


def test_nested_rules(tmp_path, monkeypatch):
    """The sections of a nested file set the rules that they name; comments count nowhere, unknown names are refused."""
    path = tmp_path / "rules.json"
    nested = {
        "_comment": "x", "rule_version": "r", "time": {"_note": "y", "T1_epoch": 100, "T2_epoch": 200, "T1": "2000-01-01"}, "parsing": {"canonical_separator": "##", "tolerated_separators": [";"], "extra_field_markers": ["MORE"]},
        "genres": {"valid": ["Drama", "War"]}, "users": {"valid_gender": ["X"], "valid_age": ["1"], "occupation_max": 3}, "movies": {"title_year_min": 1950, "title_year_max": 1999}, "ratings": {"rating_min": 0, "rating_max": 9, "timestamp_min": 1, "timestamp_max": 300, "timestamp_ms_threshold": 1000},
        "id_domains": {"_c": "", "users": {"min": 1, "max": 5}, "movies": {"min": 2, "max": 6}}, "conflict_policy": {"_c": "", "movies": "isolate", "ratings": "isolate", "users": "keep_best", "_more": 1}, "weights": {"_c": "", "accurate": 0.2, "complete": 0.2, "unique": 0.2, "up_to_date": 0.2, "consistent": 0.2},
    }
    path.write_text(json.dumps(nested))
    r = Rules.load(str(path))
    assert (r.t1, r.t2, r.separator, r.other_separators, r.extra_field, r.genres, r.genders, r.ages, r.max_occupation) == (100, 200, "##", (";",), "MORE", ("Drama", "War"), ("X",), ("1",), 3)
    assert (r.year_bounds, r.rating_bounds, r.ts_bounds, r.ms_above, r.user_domain, r.movie_domain) == ((1950, 1999), (0, 9), (1, 300), 1000, (1, 5), (2, 6))
    assert r.conflict_policy["movies"] == "isolate" and r.weights["unique"] == 0.2
    path.write_text(json.dumps(nested | {"colour": 1}))
    with pytest.raises(RuleError):
        Rules.load(str(path))
    path.write_text(json.dumps({"genres": ["Drama"], "t1": 5}))
    assert Rules.resolve(None, (str(tmp_path / "none.json"), str(path))).genres == ("Drama",)
    monkeypatch.setenv("SIEVESTONE_RULES", str(tmp_path / "none.json"))
    with pytest.raises(RuleError):
        Rules.resolve(None, (str(path),))
    monkeypatch.delenv("SIEVESTONE_RULES")
    with pytest.raises(RuleError):
        Rules.resolve()


def metrics(spark, **values):
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "metric string, value double")


def test_problems_and_guards(spark):
    m = metrics(spark, ratings_total=5, movies_total=5, users_total=5, users_u_zip_bad=2, movies_m_year_bad=1, ratings_r_ts_bad=3, users_missing=0)
    found = {(r.code, r.dimension): r for r in scores.problems(m, {"conflict_key_count": 4, "conflict_record_count": 9, "conflict_count": 4}).collect()}
    assert set(found) == {("users_u_zip_bad", "accurate"), ("movies_m_year_bad", "accurate"), ("ratings_r_ts_bad", "accurate"), ("ratings_r_ts_bad", "up_to_date"), ("clean_conflict_keys", "consistent")}
    assert found["movies_m_year_bad", "accurate"].unresolved == 0 and found["users_u_zip_bad", "accurate"].action == "fix"
    conflict = found["clean_conflict_keys", "consistent"]
    assert conflict["count"] == 4 and conflict.unresolved == 1 and "9 records" in conflict.reason and all(r.subject and r.reason for r in found.values())
    assert scores.problems(m, {"conflict_key_count": 0}).count() == 4
    assert scores.checked(m)["users_u_zip_bad"] == 2
    for bad in (m.filter("metric <> 'users_total'"), metrics(spark, ratings_total=1, movies_total=0, users_total=1), m.union(m.limit(1))):
        with pytest.raises(scores.QualityError):
            scores.checked(bad)


def test_a_whole_run(spark):
    tables = {
        "ratings": lines(spark, f"1::10::5::{TS}", f"1::10::5::{TS}", f"2::10::4::{TS}", f"2::10::3::{TS}", f"3::99::5::{TS}", "1::10::9::1"),
        "movies": lines(spark, "10::A (1990)::Drama", "10::B (1991)::Drama", "11::C (1950)::War"), "users": lines(spark, "1::M::25::7::12345-6789", "2::F::1::3::12345", "2::F::18::3::12345"),
    }
    out = governance.govern(tables, RULES)
    counts = {r.tbl: r for r in out["counts"].collect()}
    assert counts["total"].conflict_key_count == 3 and counts["total"].unknown_count == 0 and counts["ratings"].deduped_count == 1
    reasons = {(r.tbl, r.reason): r["count"] for r in out["reasons"].collect()}
    assert reasons["ratings", "rating_out_of_range"] == 1 == reasons["total", "zip4_truncated"] and reasons["total", "ok"] == sum(v for (t, k), v in reasons.items() if k == "ok" and t != "total")
    assert "clean_conflict_keys" in {r.code for r in out["unresolved"].collect()} and out["before"].first().accurate < out["after"].first().accurate
    told = {r.dimension: r for r in out["improvements"].collect()}
    assert told["accurate"].trend == "up" and told["accurate"].description.startswith("accurate rose from ")
    assert {r.action: r["count"] for r in out["by_action"].collect()}["dedupe"] >= 3
    with pytest.raises(scores.QualityError):
        governance.govern(tables | {"users": lines(spark, "")}, RULES)


def written_parts(folder):
    """(part, table) to sorted lines of what a run has written."""
    out = {}
    for part, end in files.PARTS.items():
        for at in sorted((folder / part).glob(f"*.{end}")):
            out[part, at.stem] = sorted(b"".join(p.read_bytes() for p in at.glob("part*")).decode("latin-1").splitlines())
    return out


def test_the_three_way_sink_writes_once_and_reconciles(spark, tmp_path):
    ls = {"ratings": lines(spark, *[c[0] for c in RATING_CASES]), "movies": lines(spark, *[c[0] for c in MOVIE_CASES]), "users": lines(spark, *[c[0] for c in USER_CASES])}
    found = governance.govern(ls, RULES, str(tmp_path))
    parts = written_parts(tmp_path)
    for t, df in found["cleaned"].items():
        rows = df.collect()
        plain = lambda x: "".join(c if ord(c) < 256 else "?" for c in x)
        assert parts["clean", t] == sorted(plain(r.record) for r in rows if r.tag != "isolated")
        assert parts["isolated", t] == sorted(plain(r.record) for r in rows if r.tag == "isolated")
        assert parts["audit", t] == sorted(plain(f"{r.tag}\t{r.reason}\t{r.record}") for r in rows if r.tag != "clean")
        assert found["observed"][t]["total_count"] == len(rows) and found["observed"][t]["total_input_count"] == ls[t].count()
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    cleaned = found["cleaned"]["ratings"]
    for n, again in ((ls["ratings"].count() + 1, None), (ls["ratings"].count(), found["observed"]["ratings"] | {"fixed_count": 99})):
        with pytest.raises(cleaning.Unreconciled):
            files.write_cleaned(cleaned.limit(3), str(tmp_path), "ratings", n, again)
    odd = cleaned.select("tag", "reason", "key", "record", "copies").union(spark.createDataFrame([("strange", "x", "k", "r", 1)], "tag string, reason string, key string, record string, copies bigint"))
    with pytest.raises(cleaning.Unreconciled) as e:
        files.write_cleaned(odd, str(tmp_path), "ratings", ls["ratings"].count() + 1)
    assert "rows with an unknown tag" in e.value.found
    assert written_parts(tmp_path) == parts and not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    files.write_cleaned(cleaned.filter("tag = 'clean'"), str(tmp_path), "ratings")
    again = written_parts(tmp_path)
    assert again["isolated", "ratings"] == [] == again["audit", "ratings"] and again["clean", "movies"] == parts["clean", "movies"]


def test_a_run_that_loses_rows_is_refused(spark, monkeypatch):
    whole = cleaning.resolve
    monkeypatch.setattr(cleaning, "resolve", lambda rows, t, rules: whole(rows, t, rules).filter("record not like '2%'"))
    ls = {"ratings": lines(spark, f"1::10::5::{TS}", f"2::10::4::{TS}"), "movies": lines(spark, "10::A (1990)::Drama"), "users": lines(spark, "1::M::25::7::12345", "2::F::18::3::12345")}
    with pytest.raises(cleaning.Unreconciled) as e:
        governance.govern(ls, RULES)
    assert e.value.table == "ratings" and e.value.found == ["2 lines, 1 rows"]


def test_numbers(spark):
    row = spark.range(1).select(
        T.rounded(F.lit(0.125), 2).alias("even"), T.rounded(F.lit(2.675), 2).alias("below"), T.rounded(F.lit(None).cast("double")).alias("none"),
        T.placed(F.lit(3.0), F.lit(1.0), F.lit(5.0)).alias("middle"), T.placed(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("same"),
        T.finite(F.lit(1.0), F.lit(2.0)).alias("fine"), T.finite(F.lit(1.0), F.lit(float("nan"))).alias("nan"), T.finite(F.lit(None).cast("double")).alias("null"),
    ).first()
    assert (row.even, row.below, row.none, row.middle, row.same, row.fine, row.nan, row.null) == (round(0.125, 2), round(2.675, 2), None, 0.5, 0.5, True, False, False)


def test_rounding_is_that_of_python(spark):
    rng = random.Random(4)
    numbers = [rng.uniform(-200, 200) for _ in range(300)] + [rng.randrange(10**6) / 2e4 for _ in range(300)] + [k / 32 for k in range(-50, 50)] + [0.0, -0.0, 1e-12]
    out = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", T.rounded(F.col("x")).alias("y")).collect()
    assert all(r.y == round(r.x, 4) for r in out)


def test_command_line(spark, tmp_path, capsys):
    from sievestone import __main__ as cli

    rng = random.Random(2)
    rows = [f"{u}::{m}::{rng.randint(1, 5)}::{t}" for u in range(1, 31) for m in range(1, 16) for t in (rng.choice((974862380, 974862390, 976422060)) - rng.randrange(5),)]
    for name, own in (("ratings", rows), ("movies", [f"{m}::T{m} (1990)::Drama|War" for m in range(1, 16)]), ("users", [f"{u}::F::25::{u % 21}::12345" for u in range(1, 31)])):
        (tmp_path / f"{name}.dat").write_text("\n".join(own) + "\n")
    base, folder = ["--models", str(tmp_path / "models")], str(tmp_path)
    args = lambda *x: cli.parser().parse_args([*base, *x])
    governed = cli.run(spark, args("govern", folder, "--out", str(tmp_path / "out")))
    assert governed["before"][0]["complete"] == 100.0 and len(files.read_lines(spark, f"{tmp_path}/out/clean/users.dat").collect()) == 30
    trained = cli.run(spark, args("train", folder, "--algorithm", "gnb"))
    assert trained["gnb"]["version"] == "v1"
    assert cli.run(spark, args("classify", folder, "--user", "1", "--movie", "2", "--algorithm", "gnb"))["results"][0]["algorithm"] == "gnb"
    assert cli.main([*base, "classify", folder, "--user", "999", "--movie", "2"]) == 2 and "UNKNOWN_USER" in capsys.readouterr().err
    assert cli.main([*base, "govern", str(tmp_path / "nowhere")]) == 2


def test_observed_writes_each_table_once(spark, monkeypatch):
    told, write = [], files.write_cleaned
    monkeypatch.setattr(files, "write_cleaned", lambda *a: told.append(a[2]) or write(*a))
    assert governance.QUERIES["clean_observed"](spark, "/root/testdata/sf0.001").count() == 3
    assert told == ["ratings", "movies", "users"]


def test_numbers_are_read_once_and_separators_split_without_a_pattern(spark):
    """A condition that looks at a number doesn't read it again, however long the number; lines with the mark split as before."""
    df = cleaning.dispositions(lines(spark, "1::2::3::4"), "ratings", RULES)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # Once as a long and once as a decimal for the rating and the time each, and two bounds for both ids.
    assert plan.count("RLIKE(ts") <= 3 and plan.count("RLIKE(rating") <= 2
    odd = ["a\x01b::c", "a::\x01::", ":::x", "::", "\x01", "a::::b", ""]
    got = lines(spark, *odd).select(parse.split_strict(F.col("line"), RULES).alias("f")).collect()
    assert [r.f for r in got] == [x.split("::") for x in odd]
    texts = ["0", "007", "9" * 18, "1" + "0" * 18, "9" * 38, "9" * 39, "-1", " 1", "1.0", ""]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(T.to_number(F.col("x")).alias("n"), T.in_domain(F.col("x"), (1, 10**18)).alias("fine")).collect()
    assert [None if r.n is None else int(r.n) for r in got] == [int(x) if x.isdigit() and len(x) <= 38 else None for x in texts]
    assert [r.fine for r in got] == [False, False, True, True] + [False] * 6


def test_lines_are_made_once_for_cleaning_and_checks(spark, monkeypatch):
    """Cleaning and the checks before it read one written table, not the lines' source each."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = {"ratings": [f"1::2::3::{TS}"] * 2, "movies": ["2::A (1990)::Drama"] * 2, "users": ["1::M::25::3::12345"] * 2}
    governance.before_and_after({t: lines(spark, *x).mapInArrow(count, "line string") for t, x in rows.items()}, RULES)
    assert made.value == 6


def test_problems_keep_no_cleaned_rows(spark, monkeypatch):
    """Problems draw counts only from the cleaned rows, which aren't kept for that."""
    from sievestone.plans import governance

    wanted = sorted(map(tuple, governance.QUERIES["problems_list"](spark, "/root/testdata/sf0.001").collect()), key=str)

    def kept(df):
        raise AssertionError("cleaned rows were kept")

    monkeypatch.setattr(governance, "cut", kept)
    assert sorted(map(tuple, governance.QUERIES["problems_list"](spark, "/root/testdata/sf0.001").collect()), key=str) == wanted != []
