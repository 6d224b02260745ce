"""Scalar functions on text, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What strips at a field's ends: ASCII white space, and with text also the further separators and the no-break space.
ASCII_BLANKS, TEXT_BLANKS = " \t\n\r\x0b\x0c", " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def _class(blanks: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in blanks)


def from_latin1(value: Column) -> Column:
    """Text of bytes in ISO-8859-1."""
    return F.decode(value.cast("binary"), "ISO-8859-1")


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


def strip(c: Column, blanks: str = ASCII_BLANKS) -> Column:
    return F.btrim(c, F.lit(blanks))


def is_digits(c: Column) -> Column:
    return c.rlike("^[0-9]+\\z")


def is_positive_int(c: Column) -> Column:
    return c.rlike("^[1-9][0-9]*\\z")


def has_non_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def has_boundary_space(c: Column) -> Column:
    return c.rlike("^[ \\t]|[ \\t]\\z")


def _read(c: Column) -> Column:
    """The integer of a text that is known to be digits; up to 18 of them are read as a long, which costs a fraction of what a decimal's do."""
    return F.when(F.length(c) <= 18, c.try_cast("bigint").cast("decimal(38,0)")).when(F.length(c) <= 38, c.try_cast("decimal(38,0)"))


def to_number(c: Column) -> Column:
    """The integer of a string of digits; null for others and for more than 38 digits."""
    return F.when(is_digits(c), _read(c))


def in_domain(c: Column, domain: tuple | None) -> Column:
    """A positive integer within the domain, where there is one; too long a number lies outside."""
    fine = is_positive_int(c)
    return fine if domain is None else fine & F.coalesce(_read(c).between(*domain), F.lit(False))


def title_year(title: Column) -> Column:
    """The four digits in parentheses that end a title, as a number; null if none."""
    found = F.regexp_extract(title, rf"\(([0-9]{{4}})\)[{_class(TEXT_BLANKS)}]*$", 1)
    return F.when(found != "", found.cast("int"))


def last_parenthesis_year(title: Column) -> Column:
    """What stands after the last '(' of a title that ends in ')', where that is a number."""
    inner = F.substring_index(F.substring(title, F.lit(1), F.length(title) - 1), "(", -1)
    return F.when(F.endswith(title, F.lit(")")), inner.try_cast("int"))


def slug(c: Column) -> Column:
    """Lower case, no apostrophes, underscores for blanks."""
    return F.translate(F.replace(F.lower(c), F.lit("'"), F.lit("")), " ", "_")


def filled(fields: Column) -> Column:
    """How many fields hold more than blanks."""
    return F.size(F.filter(fields, lambda x: strip(x) != ""))


def utc_date(seconds: Column) -> Column:
    """yyyy-MM-dd of seconds since the epoch."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def rounded(c: Column, digits: int = 4) -> Column:
    """To so many digits (7 at most) by the number's exact value; what lies half-way goes to the even one.

    The product with a power of ten may look half-way where the number doesn't lie there; what the product
    lost, told by the halves of the number's digits, then decides.
    """
    scale = float(10**digits)
    product, spread = c * scale, c * 134217729.0
    high = spread - (spread - c)
    lost = (high * scale - product) + (c - high) * scale
    half = (product - F.floor(product)) == 0.5
    return F.when(half & (lost > 0), F.ceil(product)).when(half & (lost < 0), F.floor(product)).otherwise(F.rint(product)) / scale


def placed(c: Column, low: Column, high: Column) -> Column:
    """Where a value lies between two others, as a share; one half where they coincide."""
    return F.coalesce(F.try_divide(c - low, high - low), F.lit(0.5))


def finite(*columns: Column) -> Column:
    """Whether all are numbers, neither null nor infinite nor NaN."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(out, F.lit(False))


def shown(c: Column, digits: int = 4) -> Column:
    """A number with fixed digits; a dash where it doesn't apply."""
    return F.coalesce(F.format_number(c, digits), F.lit("—"))


def sign_class(delta: Column, tolerance: float = 1e-9) -> Column:
    """up, down, same, or null where a delta doesn't apply."""
    return F.when(F.abs(delta) < tolerance, "same").when(delta > 0, "up").when(delta < 0, "down")
