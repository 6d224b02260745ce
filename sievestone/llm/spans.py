"""Places of regular-expression matches in texts, in built-in expressions only.

No fold here appends spans or text, which would take time with the square of the matches (`apart`
alone appends one byte a span): running sums and maxima come from doubling (n log n), and texts are
cut by bytes, whose places cost nothing to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: start and end in code points, and the byte that the value begins at.
SPAN = "array<struct<start:int,kind:int,end:int,value:string,at:int>>"


def none() -> Column:
    """No span."""
    return F.array().cast(SPAN)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """At each place, `combine` over the values up to it; each pass doubles how far back a place has seen."""
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(values))) - 1)

    def wider(seen: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(seen, lambda x, i: F.when(i >= back, combine(F.get(seen, i - back), x)).otherwise(x))

    return F.aggregate(steps, values, wider)


def found(text: Column, pattern: str, kind: int, guard: Column | None = None) -> Column:
    """The leftmost non-overlapping matches, from left to right, with code points as places, end exclusive.

    What a split leaves between the matches gives their places.  Texts for which the guard
    is false have no match, and aren't searched.
    """
    between = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(own: Column) -> Column:
        pieces = F.zip_with(
            F.slice(between, F.lit(1), F.size(own)), own,
            lambda b, v: F.struct((F.length(b) + F.length(v)).alias("end"), (F.octet_length(b) + F.octet_length(v)).alias("to")),
        )
        add = lambda x, y: F.struct((x["end"] + y["end"]).alias("end"), (x["to"] + y["to"]).alias("to"))
        span = lambda e, v: F.struct(
            (e["end"] - F.length(v)).alias("start"), F.lit(kind).alias("kind"), e["end"].alias("end"), v.alias("value"), (e["to"] - F.octet_length(v)).alias("at")
        )
        return F.zip_with(running(pieces, add), own, span).cast(SPAN)

    some = text.rlike(pattern) if guard is None else F.when(guard, text.rlike(pattern)).otherwise(F.lit(False))
    return F.when(some, let(values, placed)).otherwise(none())


def ordered(spans: Column) -> Column:
    """By start, then kind, then end."""
    return F.array_sort(spans)


def joined(spans: Column, names: tuple) -> Column:
    """kind:start:end of ordered spans, comma-joined."""
    name = lambda s: F.get(F.array(*map(F.lit, names)), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat(name(s), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def meets(spans: Column, other: Callable[[Column], Column]) -> Column:
    """For each of the ordered spans, whether it overlaps one for which `other` holds (itself left out of account if it is one)."""

    def told(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda s: F.when(other(s), s["end"]).otherwise(F.lit(0))), lambda x, y: F.greatest(x, y))
        most = F.lit(2**31 - 1)
        starts = F.reverse(running(F.reverse(F.transform(all_, lambda s: F.when(other(s), s["start"]).otherwise(most))), lambda x, y: F.least(x, y)))
        after = lambda nexts, i: F.coalesce(F.get(nexts, i + 1), most)
        before = lambda lasts, i: F.when(i > 0, F.get(lasts, i - 1)).otherwise(F.lit(0))
        return let(F.struct(ends.alias("ends"), starts.alias("starts")), lambda b: F.transform(all_, lambda s, i: (before(b["ends"], i) > s["start"]) | (after(b["starts"], i) < s["end"])))

    return let(spans, told)


def apart(spans: Column) -> Column:
    """Of overlapping ordered spans the first (of equal starts the earlier kind), then the next that begins at or after its end."""

    def kept(all_: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("marks"))

        def step(state: Column, s: Column) -> Column:
            free = s["start"] >= state["at"]
            return F.struct(F.when(free, s["end"]).otherwise(state["at"]).alias("at"), F.concat(state["marks"], F.when(free, "1").otherwise("0")).alias("marks"))

        marks = F.aggregate(all_, start, step, lambda s: s["marks"].cast("binary"))  # a byte a span
        return let(marks, lambda m: F.filter(all_, lambda s, i: F.substring(m, i + 1, F.lit(1)) == F.lit(b"1")))

    return F.when(F.size(spans) > 1, let(spans, kept)).otherwise(spans)


def replaced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """The text with put(span) in place of each ordered span; of overlapping ones the first stays, what they cover goes."""

    def made(given: Column) -> Column:
        raw, all_ = given["raw"], given["spans"]
        stop = lambda s: s["at"] + F.octet_length(s["value"])
        cut = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")

        def pieces(ends: Column) -> Column:
            done = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
            each = F.transform(all_, lambda s, i: F.when(s["at"] >= done(i), F.concat(cut(done(i), s["at"]), F.coalesce(put(s), F.lit("")))).otherwise(F.lit("")))
            return F.concat(F.array_join(each, ""), cut(F.element_at(ends, -1), F.octet_length(raw)))

        return let(running(F.transform(all_, stop), lambda x, y: F.greatest(x, y)), pieces)

    return F.when(F.size(spans) > 0, let(F.struct(text.cast("binary").alias("raw"), spans.alias("spans")), made)).otherwise(text)
