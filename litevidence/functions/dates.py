"""Dates written as month and two-digit year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-digit years from here on belong to the 1900s, as in POSIX.
_CENTURY_PIVOT = 69


def month_part(c: Column | str) -> Column:
    return F.split(c, "-", 2)[0]


def year_part(c: Column | str) -> Column:
    return F.get(F.split(c, "-", 2), F.lit(1))


def month_year(c: Column | str) -> Column:
    """`Mar-15` as the first day of that month; null where the text is no such date."""
    yy = F.try_cast(year_part(c), "int") if hasattr(F, "try_cast") else year_part(c).try_cast("int")
    century = F.when(yy >= _CENTURY_PIVOT, 1900).otherwise(2000)
    text = F.concat(month_part(c), F.lit("-"), (century + yy).cast("string"))
    return F.try_to_timestamp(text, F.lit("MMM-yyyy")).cast("date")
