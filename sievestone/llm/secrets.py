"""Secret scans: known forms, and sliding-window entropy over candidate strings; built-in expressions only.

The known forms (assign, access, hex) are kept always.  Candidates are runs of 20 or more of the
characters of base64 and its URL form that hold a digit and a letter, whether or not they lie in a known form.  A window of WINDOW
characters slides over each.  The sum of c*log2(c) over the counts of its characters, in whole millionths, changes only by
the count of the one that goes and of the one that comes, which are looked up in the window; the entropy
follows from the sum.  The class of the candidate's characters (hexadecimal, base64) sets the entropy that its best window
has to reach.  Candidates of the allow-list are suppressed.  Every candidate is told with its class, its best window's entropy and
the verdict; those that are secrets add spans.

A long candidate is taken in stretches that overlap by a window, so memory doesn't grow with it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievestone.llm import spans as S
from sievestone.llm.common import free_name
from sievestone.session import table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are taken whole, so a least length in the pattern drops just the short ones.
ACCESS, HEX, CANDIDATE = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}", "[A-Za-z0-9+/_=-]{20,}"
ASSIGN_LEAST, WINDOW, UNIT = 12, 20, 1_000_000
#: Characters of a candidate that are slid over at once.
STRETCH = 50_000
#: Bits that the best window of a candidate needs, by class.
HEX_BITS, BASE64_BITS = 3.05, 3.75

#: What shows that a string is no secret: placeholders and runs of the keyboard or the alphabet ...
ALLOWED = ("example", "sample", "placeholder", "changeme", "your_", "your-", "xxxx", "00000000", "12345678", "abcdefgh", "qwerty", "lorem", "redacted", "dummy", "test_", "test-")
#: ... UUIDs, integrity digests, images, fonts and documents in base64, and words in lower, upper or camel case, with up to four digits after or in each, joined by separators.
_HUMPS = "([A-Z]?[a-z]{2,}|[A-Z]{2,})+"
_WORD = f"(({_HUMPS}|[A-Za-z])([0-9]{{1,4}}({_HUMPS})?)?|[0-9]{{1,4}})"
ALLOWED_FORMS = rf"^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$|^sha(1|256|384|512)[-_=/]|^(iVBORw0KGgo|/9j/4|R0lGOD|UklGR|JVBERi0|d09GM|AAABAA)|^[/_=+-]*{_WORD}([/_=+-]+{_WORD})*[/_=+-]*$"
#: The same language without going back, so that a long candidate needs no deep stack: what a group takes, it can't need to give back.
ALLOWED_JAVA = ALLOWED_FORMS.replace("*", "*+").replace("{2,}", "{2,}+").replace(")+", ")++").replace("-]+", "-]++").replace("{1,4}", "{1,4}+").replace("(", "(?:")


def _table() -> Column:
    """c*log2(c) in whole millionths for c = 0 .. WINDOW."""
    return F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("bigint") for c in range(WINDOW + 1)])


def _slide(raw: Column) -> Column:
    """The least sum of c*log2(c), in millionths, over all windows of some bytes of ASCII; null for fewer than WINDOW of them."""
    weigh = _table()
    count = lambda s, c: F.octet_length(s) - F.octet_length(F.replace(s, c, F.lit("")))
    part = lambda a, n: F.substring(raw, a, n).cast("string")

    def change(i: Column) -> Column:
        """What the sum changes by as character i comes and, beyond the first window, character i - WINDOW goes."""
        full = i > WINDOW
        had = count(part(F.when(full, i - WINDOW + 1).otherwise(F.lit(1)), F.when(full, F.lit(WINDOW - 1)).otherwise(i - 1)), part(i, F.lit(1)))
        gone = count(part(i - WINDOW, F.lit(WINDOW)), part(i - WINDOW, F.lit(1)))
        less = F.when(full, F.get(weigh, gone) - F.get(weigh, gone - 1)).otherwise(F.lit(0).cast("bigint"))
        return F.get(weigh, had + 1) - F.get(weigh, had) - less

    def step(state: Column, by: Column) -> Column:
        i, total = state["i"] + 1, state["sum"] + by
        return F.struct(total.alias("sum"), F.when(i >= WINDOW, F.least(state["best"], total)).otherwise(state["best"]).alias("best"), i.alias("i"))

    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("best"), F.lit(0).alias("i"))
    changes = F.when(F.octet_length(raw) >= WINDOW, F.transform(F.sequence(F.lit(1), F.octet_length(raw)), change))
    return F.aggregate(changes, start, step, lambda s: s["best"])


def least_sum(value: Column) -> Column:
    """The least sum of c*log2(c), in millionths, over all windows of a string of ASCII; time grows with the length, memory doesn't."""
    starts = lambda raw: F.sequence(F.lit(0), F.floor((F.octet_length(raw) - 1) / STRETCH).cast("int"))
    parts = lambda raw: F.transform(starts(raw), lambda k: S.let(F.substring(raw, k * STRETCH + 1, F.lit(STRETCH + WINDOW - 1)), _slide))
    return S.let(value.cast("binary"), lambda raw: F.array_min(parts(raw)))


def most_sum(bits: float) -> int:
    """The sum of c*log2(c), in millionths, at which a window has the given entropy."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * UNIT)


#: The sum of a window with one character only, and what an entropy of a thousandth of a bit takes from it.
ALONE, THOUSANDTH = round(math.log2(WINDOW) * WINDOW * UNIT), WINDOW * UNIT // 1000
CLASS_HEX, ALLOWED_NO, ALLOWED_YES = "^([0-9a-f]+|[0-9A-F]+)$", "low", "allowed"


def judged(value: Column) -> Column:
    """(class, entropy in thousandths of a bit, verdict) of a candidate: secret, low, or allowed by the list."""
    low = F.lower(value)
    allowed = value.rlike(ALLOWED_JAVA)
    for x in ALLOWED:
        allowed = allowed | F.contains(low, F.lit(x))

    def told(given: Column) -> Column:
        limit = F.when(given["hex"], F.lit(most_sum(HEX_BITS))).otherwise(F.lit(most_sum(BASE64_BITS)))
        verdict = F.when(given["allowed"], ALLOWED_YES).when(given["sum"] <= limit, "secret").otherwise(ALLOWED_NO)
        bits = F.floor((F.lit(ALONE) - given["sum"]) / THOUSANDTH).cast("bigint")
        return F.struct(F.when(given["hex"], "hex").otherwise("base64").alias("class"), bits.alias("bits"), verdict.alias("verdict"))

    return S.let(F.struct(value.rlike(CLASS_HEX).alias("hex"), allowed.alias("allowed"), least_sum(value).alias("sum")), told)


def base_spans(text: Column) -> Column:
    """The known forms' matches, ordered."""
    assign = F.filter(S.found(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return S.ordered(F.concat(assign, S.found(text, ACCESS, 1), S.found(text, HEX, 2)))


def candidates(text: Column) -> Column:
    """The candidates' spans, each with its `judged`."""
    mixed = F.filter(S.found(text, CANDIDATE, 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    return F.transform(mixed, lambda s: F.struct(s.alias("span"), judged(s["value"]).alias("told")))


def scanned(docs: DataFrame, text: str = "text", base: str = "base", every: str = "every", told: str = "told") -> DataFrame:
    """`docs` with two arrays of spans, the known forms and all, and one of the candidates; null texts have none."""
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.withColumn(base, base_spans(own)).withColumn(told, candidates(own))
    secret = F.transform(F.filter(told, lambda c: c["told"]["verdict"] == "secret"), lambda c: c["span"])
    return out.withColumn(every, S.ordered(F.concat(F.col(base), secret)))


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy, candidates for every row; null and empty texts have none.

    The digest of no spans is that of an empty string.  candidates lists start:end:class:entropy:verdict, the entropy of the best window
    in thousandths of a bit.  Repeated rows have a row each, an empty table gives none, and extra columns may have any name.
    """
    rows = scanned(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    number = lambda k: F.size(F.filter("base" if k < 3 else "every", lambda s: s["kind"] == k)).cast("bigint")
    line = lambda c: F.concat_ws(":", c["span"]["start"].cast("string"), c["span"]["end"].cast("string"), c["told"]["class"], c["told"]["bits"].cast("string"), c["told"]["verdict"])
    return rows.select(
        F.col("doc_id").alias(doc_id), *[number(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(S.joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        S.joined(F.col("every"), KINDS).alias("spans"), number(3).alias("n_entropy"), F.array_join(F.transform("told", line), ",").alias("candidates"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with a mark in place of each span found in the text, and n_chars, where there is one, counted anew.

    A null text stays null; repeated rows stay, an empty table gives no rows, and extra columns may have any name.
    """
    base, every, told = (free_name(docs, f"__{x}") for x in ("base", "every", "told"))
    rows = scanned(docs, text, base, every, told)
    new = F.when(F.size(every) > 0, S.replaced(F.col(f"`{text}`"), F.col(every), lambda s: F.lit(mark))).otherwise(F.col(f"`{text}`"))
    rows = rows.withColumn(text, new)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(every) > 0, F.length(text)).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_secret_entropy(spark, sf_dir: str) -> DataFrame:
    """The secrets of every whole text of `documents`, and every candidate with its entropy."""
    return secret_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    every = " UNION ALL ".join(f"SELECT rid, {k} AS kind, regexp_split_to_array(t, {text(p)}) AS b, regexp_extract_all(t, {text(p)}, 0) AS v FROM docs WHERE regexp_matches(t, {text(p)})" for k, p in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE)))
    weights = ", ".join(str(round(c * math.log2(c) * UNIT) if c else 0) for c in range(WINDOW + 1))
    least = f"""list_min(list_transform(range(1, length(val) - {WINDOW - 2}), lambda j: list_sum(list_transform(list_distinct(string_split(substr(val, j, {WINDOW}), '')), lambda c: ([{weights}])[{WINDOW} - length(replace(substr(val, j, {WINDOW}), c, '')) + 1]))))"""
    allowed = " OR ".join([f"regexp_matches(val, {text(ALLOWED_FORMS)})", *(f"contains(lower(val), {text(x)})" for x in ALLOWED)])
    mark = "([" + ", ".join(map(text, KINDS)) + "])[kind + 1] || ':' || start || ':' || stop"
    listed = lambda most: f"coalesce(string_agg({mark}, ',' ORDER BY start, kind, stop) FILTER (WHERE kind <= {most}), '')"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
matched AS ({every}),
placed AS (SELECT rid, kind, v[i] AS val, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM matched)),
spans AS MATERIALIZED (SELECT rid, kind, val, start, start + length(val) AS stop FROM placed WHERE kind <> 0 OR length(regexp_extract(val, {text(ASSIGN)}, 2)) >= {ASSIGN_LEAST}),
mixed AS MATERIALIZED (SELECT *, {least} AS total, regexp_matches(val, '{CLASS_HEX}') AS hex, {allowed} AS known FROM spans WHERE kind = 3 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')),
told AS MATERIALIZED (SELECT *, CASE WHEN known THEN '{ALLOWED_YES}' WHEN total <= CASE WHEN hex THEN {most_sum(HEX_BITS)} ELSE {most_sum(BASE64_BITS)} END THEN 'secret' ELSE '{ALLOWED_NO}' END AS verdict FROM mixed),
lines AS (SELECT rid, string_agg(start || ':' || stop || ':' || CASE WHEN hex THEN 'hex' ELSE 'base64' END || ':' || (({ALONE} - total) // {THOUSANDTH})::BIGINT || ':' || verdict, ',' ORDER BY start) AS candidates FROM told GROUP BY rid),
kept AS (SELECT rid, kind, start, stop FROM spans WHERE kind < 3 UNION ALL SELECT rid, kind, start, stop FROM told WHERE verdict = 'secret')
SELECT any_value(doc_id) AS doc_id, {', '.join(f'count(*) FILTER (WHERE kind = {k}) AS n_{KINDS[k]}' for k in range(4))}, sha256({listed(2)}) AS base_sha256, {listed(3)} AS spans, coalesce(any_value(candidates), '') AS candidates
FROM docs LEFT JOIN kept USING (rid) LEFT JOIN lines USING (rid) GROUP BY rid
"""


OP10_SQL = _sql()
