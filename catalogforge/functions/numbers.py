"""Number parsing and formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogforge.functions.text import col, strip

# Decimal or scientific notation, single underscores between digits allowed. Stricter
# than a cast, which also takes type suffixes, hexadecimal floats and infinity.
_DIGITS = r"[0-9]+(_[0-9]+)*"
NUMBER = rf"^[+-]?({_DIGITS}[.]?({_DIGITS})?|[.]{_DIGITS})([eE][+-]?{_DIGITS})?$"

EXACT_LIMIT = 2**53

# The earliest year kept, and bytes per gigabyte.
FIRST_YEAR = 1000
BYTES_PER_GB = 1024**3


def lenient_int(c: Column | str, default: int | None = 0) -> Column:
    """Whole part of a number written as text; ``default`` where it is not one.

    Plain digits, by far the most common, skip the pattern match; they must read back
    unchanged and be small enough for a double to hold exactly.
    """
    c = col(c)
    digits = c.try_cast("bigint")
    plain = (digits.cast("string") == c) & digits.between(-EXACT_LIMIT, EXACT_LIMIT)
    text = strip(c)
    number = F.when(
        text.rlike(NUMBER),
        F.replace(text, F.lit("_"), F.lit("")).try_cast("double").try_cast("bigint"),
    )
    return F.coalesce(F.when(plain, digits), number, F.lit(default).cast("bigint"))


def positive(c: Column | str) -> Column:
    return F.when(col(c) > 0, col(c))


def nonzero(c: Column | str) -> Column:
    return F.when(col(c) != 0, col(c))


def clean_year(c: Column | str, max_year: int | Column | None = None) -> Column:
    """Year from 1000 up to ``max_year`` (this year by default), else null."""
    return year_in_range(lenient_int(c), max_year)


def year_in_range(year: Column | str, max_year: int | Column | None = None) -> Column:
    if max_year is None:
        max_year = F.year(F.current_date())
    return F.when(col(year).between(FIRST_YEAR, max_year), col(year).cast("int"))


def minutes_seconds(c: Column | str) -> Column:
    """Seconds as ``M:SS``; minutes are not limited to 59."""
    whole = F.coalesce(col(c).cast("bigint"), F.lit(0).cast("bigint"))
    seconds = F.pmod(whole, F.lit(60))
    minutes = ((whole - seconds) / 60).cast("bigint")
    return F.concat(
        minutes.cast("string"), F.lit(":"), F.lpad(seconds.cast("string"), 2, "0")
    )


def padded(c: Column | str, width: int) -> Column:
    """Zero-padded to ``width``; longer numbers keep all digits."""
    digits = col(c).cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))


def rounded(c: Column | str, digits: int) -> Column:
    """Round the binary value itself, ties to even (``round`` rounds its decimal text)."""
    text = F.format_number(col(c), digits)
    return F.replace(text, F.lit(","), F.lit("")).cast("double")


def gigabytes(c: Column | str) -> Column:
    return rounded(col(c) / F.lit(float(BYTES_PER_GB)), 2)


def hours(c: Column | str) -> Column:
    return rounded(col(c) / F.lit(3600.0), 1)


def hours_minutes(c: Column | str) -> Column:
    """Seconds as ``1676h 2m``, both parts cut off, not rounded."""
    exact = col(c) / F.lit(3600.0)
    whole = F.floor(exact)
    minutes = F.floor((exact - whole) * 60)
    return F.concat(whole.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))


def whole_days(c: Column | str) -> Column:
    """Seconds as days, halves rounded up."""
    return F.floor(col(c) / F.lit(86400.0) + 0.5)


def whole_minutes(c: Column | str) -> Column:
    return F.floor(col(c) / F.lit(60.0))


def with_thousands(c: Column | str) -> Column:
    return F.format_number(col(c), 0)


def year_or_dash(c: Column | str) -> Column:
    return F.coalesce(nonzero(c).cast("string"), F.lit("-"))
