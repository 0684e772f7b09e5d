"""Partial dates: YYYY, YYYY-MM or YYYY-MM-DD. Each rule is a function of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FULL = r"^[0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2})?)?$"


def first_day(text: Column) -> Column:
    """Padded to the start; null if malformed or before the year 1."""
    ok = text.rlike(_FULL) & ~text.startswith("0000")
    padded = F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text)
    return F.when(ok, F.try_to_date(padded, "yyyy-MM-dd"))


def last_day(text: Column) -> Column:
    """Padded to the end."""
    first = first_day(text)
    return F.when(F.length(text) == 4, F.make_date(F.year(first), F.lit(12), F.lit(31))).when(F.length(text) == 7, F.last_day(first)).otherwise(first)


def bounds(text: Column) -> Column:
    """struct<lo, hi>; both null if malformed."""
    return F.struct(first_day(text).alias("lo"), last_day(text).alias("hi"))


def known_by(text: Column, cutoff: Column) -> Column:
    """The text if it is a date that ends by the cutoff, else null."""
    return F.when(last_day(text) <= cutoff, text)


def end_capped(text: Column, now: Column) -> Column:
    """Padded to the end, but not after now."""
    return F.least(last_day(text), now)


def is_fresh(text: Column, as_of: Column, months: int = 24) -> Column:
    """Ends at most so many months of 30.4 days before as_of."""
    return F.coalesce(F.datediff(as_of, end_capped(text, as_of)) / F.lit(30.4) <= months, F.lit(False))


def months_between(text: Column, as_of: Column) -> Column:
    """Calendar months from the start of a partial date."""
    first = first_day(text)
    return (F.year(as_of) * 12 + F.month(as_of)) - (F.year(first) * 12 + F.month(first))


def plausible_year(text: Column, as_of: Column) -> Column:
    """The first four digits of a compact date if they are a year from 1990 to that of as_of."""
    year = F.regexp_extract(text, r"^([0-9]{4})", 1).try_cast("int")
    return F.when(year.between(1990, F.year(as_of)), year)
