import ipaddress
import re
import time

import pytest
from cases import DOCUMENTS, clashing, documents

from sievestone.llm import pii as X
from sievestone.session import shared_dir, table

ROWS = [
    (1, "Mail a.b@mail8.example.com or A.B@mail8.example.com, call +1 (743) 555-3824 / +1 743-555-3824 227.5.221.1, card 4186133740741811 or 4186 1337 4074 1811.", "en", "a", 1),
    (2, "Frau Anna Müller met Mr. John Smith. Mr Smith waved. Dr. JOHN SMITH left. Мария Иванова и Господин Иванов.", "en", "a", 1),
    (3, "x@mail8.example.com y@mail8.example.com 123-45-6789 DE89370400440532013000 2024-01-02 version 3.14.15 clean 12 34 4186133740741812", "en", "a", 1),
]


def test_kinds_forms_and_coreference(spark):
    out = {r.doc_id: r for r in X.replace_entities(clashing(documents(spark, ROWS)), "k", spans="found").collect()}
    text = out[1].text
    for old in ("a.b@mail8", "743", "227.5.221.1", "4186133740741811"):
        assert old not in text
    mails = re.findall(r"\S+@\S+?(?=[ ,])", text)
    assert mails[0] == mails[1] and mails[0].endswith(".com") and re.fullmatch(r"[a-z]\.[a-z]@[a-z]{4}\d\.[a-z]{7}\.example\.com", mails[0])
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1 \d{3}-\d{3}-\d{4}", text)
    assert len(phones) == 2 and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", text)
    assert len(cards) == 2 and cards[1].replace(" ", "") == cards[0] and cards[0][0] == "4"
    assert luhn(cards[0]) == luhn("4186133740741811")
    names = out[2].text
    assert re.match(r"Frau [A-Z][a-z]+(na|lia) ", names) and "John" not in names and "Smith" not in names
    m = re.search(r"Mr\. (\w+) (\w+)\. Mr (\w+) waved\. Dr\. (\w+) (\w+) left", names)
    assert m[2] == m[3] and m[4] == m[1].upper() and m[5] == m[2].upper()
    assert re.search(r"[а-яА-Я]+ и Господин [А-Я][а-я]+\.$", names)
    third = out[3].text
    a, b = re.findall(r"\S+@\S+", third)
    assert a != b and a.split("@")[1] == b.split("@")[1] == mails[0].split("@")[1] and third.endswith("2024-01-02 version 3.14.15 clean 12 34 4186133740741812")
    assert [s.kind for s in out[3].found] == [0, 0, 4, 5]


def test_full_formats_map_one_to_one_and_leave_nothing(spark):
    """Every address of 192.168, every number of a short format, every one-letter name: permutations without a fixed point."""
    rows = [("ip", f"192.168.{i // 256}.{i % 256}") for i in range(65_536)] + [("ip", f"{a}.7.8.9") for a in range(256)] + [("ip", f"172.{b}.1.1") for b in range(256)]
    rows += [("phone", f"|{i}") for i in range(1000, 10_000)] + [("phone", f"49|0{i:02d}") for i in range(100)] + [("phone", "1|1101010101")]
    rows += [("local", c) for c in "abcdefghijklmnopqrstuvwxyz"] + [("local", a + b) for a in "._%+-" for b in "._%+-"] + [("local", "a.b"), ("local", "a_b"), ("ssn", "123456789")]
    rows += [("domain", d) for d in ("a.com", "b.com", "a.org", "a-b.com", "x.a.com", "-.com")] + [("card", f"4{i:04d}13374074{d}") for i in range(20) for d in range(10)]
    out = X.surrogates(spark.createDataFrame(rows, "kind string, norm string"), "k").collect()
    assert len(out) == len(rows) == len({(r.kind, r.surrogate) for r in out})
    assert all(r.surrogate != r.norm for r in out)
    form = lambda s: re.sub("[a-z]", "a", re.sub("[0-9]", "9", s))
    for r in out:
        if r.kind in ("phone", "ssn", "card"):
            assert form(r.norm) == form(r.surrogate) and r.norm.split("|")[0] == r.surrogate.split("|")[0] or r.kind != "phone"
        if r.kind == "card":
            assert r.surrogate[0] == "4" and luhn(r.surrogate) == luhn(r.norm)
        if r.kind == "ip":
            assert kind_of_address(r.norm) == kind_of_address(r.surrogate) and all(0 <= int(x) < 256 for x in r.surrogate.split("."))
        if r.kind == "phone":
            own, new = r.norm.split("|")[1], r.surrogate.split("|")[1]
            assert (own[0] in "01") == (new[0] in "01")


def kind_of_address(a):
    x = ipaddress.ip_address(a)
    if x in ipaddress.ip_network("224.0.0.0/3"):
        return "0.0.0.0/8"  # neither is anybody's
    return next((n for n in ("10.0.0.0/8", "127.0.0.0/8", "192.168.0.0/16", "172.16.0.0/12", "192.0.0.0/8", "172.0.0.0/8", "0.0.0.0/8") if x in ipaddress.ip_network(n)), "")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def test_ibans_keep_their_check(spark):
    rest = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    given = ["DE89370400440532013000", "GB29NWBK60161331926819", "DE88370400440532013000", "FR1420041010050500013M02606"]
    out = {r.norm: r.surrogate for r in X.surrogates(spark.createDataFrame([("iban", g) for g in given], "kind string, norm string"), "k").collect()}
    assert len(set(out.values())) == len(given)
    for old, new in out.items():
        assert old[:2] == new[:2] and re.sub("[A-Z]", "A", re.sub("[0-9]", "9", old)) == re.sub("[A-Z]", "A", re.sub("[0-9]", "9", new)) and old[4:] != new[4:]
        assert (rest(new) == 1) == (rest(old) == 1)


def test_coined_names_are_distinct(spark):
    """More names than hashes of three syllables, so that ranks have to tell them apart."""
    rows = [("name", f"{role}:name{i}") for role in "fmns" for i in range(12_000)] + [("name", f"s:иванов{i}") for i in range(500)] + [("name", f"m:νίκ{i}") for i in range(500)]
    rows += [("name", f"s:{a}{b}{c}son") for a in X.SYLLABLES["latin"] for b in X.SYLLABLES["latin"] for c in X.SYLLABLES["latin"][:8]]
    out = X.surrogates(spark.createDataFrame(rows, "kind string, norm string"), "k").collect()
    assert len(out) == len(rows) == len({r.surrogate.lower() for r in out})
    assert all(r.surrogate.lower() != r.norm and r.surrogate[:2] == r.norm[:2] for r in out)
    assert all(re.fullmatch("[мж]?s?:?[А-Яа-я]+", r.surrogate[2:]) for r in out if "иванов" in r.norm)


def test_names_that_are_found(spark):
    texts = ["Ahmed Khan met Priya Patel and Wei Zhang.", "My name is Zuleika Dobson.", "John F. Kennedy spoke; Mr. F. Kennedy and Dr. Smith left.", "call 0171 2345678 or 020 7946 0958 or 01 23 45 67 89.", "The Red House in Paris. Version 0123 is new."]
    out = {r.doc_id: r for r in X.replace_entities(documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]), "k", spans="found").collect()}
    assert [len(out[i].found) for i in range(5)] == [3, 1, 3, 3, 0]
    for i, old in ((0, ("Ahmed", "Khan", "Priya", "Patel", "Wei", "Zhang")), (1, ("Zuleika", "Dobson")), (2, ("John", "Kennedy", "Smith")), (3, ("2345678", "7946", "67 89"))):
        assert not any(x in out[i].text for x in old)
    m = re.fullmatch(r"(\w+) (\w)\. (\w+) spoke; Mr\. (\w)\. (\w+) and Dr\. (\w+) left\.", out[2].text)
    assert m[3] == m[5] and m[2] == m[4] == m[3][0] and m[6] != m[3]
    more = X.replace_entities(documents(spark, [(1, "Xanthippe Jones", "en", "a", 1)]), "k", given=("Xanthippe",)).first()
    assert "Jones" not in more.text


def test_every_other_character_stays_and_equal_entities_stay_equal(spark):
    """Against a restatement: texts differ only inside spans, and a span's surrogate depends on its normal form alone."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    old, seen = {r.doc_id: r.text for r in docs.collect()}, {}
    for r in X.replace_entities(docs, "k", spans="found").collect():
        pattern, at = "", 0
        for s in r.found:
            assert old[r.doc_id][s.start : s.end] == s.value
            pattern += re.escape(old[r.doc_id][at : s.start]) + "(.+?)"
            at = s.end
        m = re.fullmatch(pattern + re.escape(old[r.doc_id][at:]), r.text, re.S)
        assert m
        for s, new in zip(r.found, m.groups(), strict=True):
            assert new != s.value and seen.setdefault((s.kind, s.value), new) == new
    assert len(seen) > 10 and len({(k, v) for (k, _), v in seen.items()}) == len(seen)


def test_long_texts_with_many_matches(spark):
    text = " é ".join(f"m{i}@mail.org 10.{i % 250}.{i // 250}.1" for i in range(5000))
    began = time.time()
    out = X.replace_entities(documents(spark, [(1, text, "en", "a", 1)]), "k", spans="found").first()
    assert len(out.found) == 10_000 and time.time() - began < 90
    assert len(set(re.findall(r"\S+@\S+", out.text))) == 5000 and not re.search(r"m\d+@mail\.org", out.text)


def test_odd_rows_stay(spark):
    docs = clashing(documents(spark))
    out = X.replace_entities(docs, "k")
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    assert X.replace_entities(documents(spark, []), "k").count() == 0
    assert len(DOCUMENTS) == out.count()


def test_another_key_gives_other_surrogates(spark):
    one, two = (X.replace_entities(documents(spark, ROWS[:1]), k).first().text for k in ("a", "b"))
    assert one != two


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        X.replace_entities(documents(spark, ROWS), "")
    spark.conf.unset(X.KEY_SETTING)
    key = X.session_key(spark)
    assert len(key) == 64 and X.session_key(spark) == key
    spark.conf.unset(X.KEY_SETTING)


def test_no_python_on_the_path(spark, monkeypatch):
    """No plan of the whole run, that of the result included, has a Python worker or Arrow."""
    plans, own = [], (X.cut, X.written)
    show = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(X, "cut", lambda df: plans.append(show(df)) or own[0](df))
    monkeypatch.setattr(X, "written", lambda df: plans.append(show(df)) or own[1](df))
    docs = documents(spark, ROWS)
    path = f"{shared_dir(spark)}/plain-{time.time_ns()}"
    docs.write.parquet(path)
    plans.append(show(X.replace_entities(spark.read.parquet(path), "k", spans="found")))
    assert len(plans) >= 5
    assert not any(x in p for p in plans for x in ("Python", "Arrow", "Pandas"))


def test_numbers_with_and_without_their_code_are_one(spark):
    rows = [(1, "call +1 555-234-5678 or (555) 234-5678 or 555.234.5678 or 555 234 5678, not 555-234-5679", "en", "a", 1), (2, "+44 20 7946 0958 and 555-234-5678", "en", "a", 1)]
    got = {r.doc_id: re.findall(r"\+[\d -]+\d|[(\d][\d() .-]{10,}\d", r.text) for r in X.replace_entities(documents(spark, rows), "k").collect()}
    own = [re.sub(r"\D", "", x)[-10:] for x in got[1]]
    assert len(own) == 5 and len(set(own[:4])) == 1 and own[4] != own[0] and got[1][0].startswith("+1 ") and got[1][1].startswith("(")
    assert re.sub(r"\D", "", got[2][1]) == own[0] != "5552345678" and got[2][0].startswith("+44 ")


def test_capitals_are_names_and_places_and_offices_are_none(spark):
    lines = ["MARY SMITH wrote", "Mary Smith wrote", "San Antonio Texas is warm", "Contact: The Company Ltd", "Name: Quarterly Report", "Contact: Northern Water Company today", "Name: Oluwaseun Adeyemi"]
    got = [r.text for r in X.replace_entities(documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(lines)]), "k").orderBy("doc_id").collect()]
    assert got[2:6] == lines[2:6] and all(g != t for g, t in zip(got[:2] + got[6:], lines[:2] + lines[6:], strict=True))
    assert got[0].split()[:2] == [x.upper() for x in got[1].split()[:2]]


def test_the_plan_holds_each_expression_once(spark):
    """Expressions that stood in the plan as often as they were looked at made its text some 970,000 characters long."""
    docs = spark.createDataFrame([(1, "Mail Anna Smith at anna.smith@mail.com or +44 20 7946 0958"), (2, "nothing")], "doc_id long, text string")
    rows = X.replace_entities(docs, "a key", spans="found")
    assert rows.count() == 2 and len(rows._jdf.queryExecution().toString()) < 150_000
