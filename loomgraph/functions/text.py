"""Column functions on the text fields of the input files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def creation_year(c: Column) -> Column:
    """The leading digits, as a number; null if there are none."""
    return F.regexp_extract(c, r"^(\d+)", 1).try_cast("int")


def post_date(c: Column) -> Column:
    """Date of ``2017-06-22 16:03``; the time of day goes. Null if it can't be read."""
    return F.to_date(F.substring(c, 1, 10).try_cast("date"))


def hashtag_array(c: Column) -> Column:
    """Tags of ``[a, b]``: as written, without leading blanks; empty ones are dropped."""
    inner = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\[|\]$", "")
    return F.array_remove(F.split(F.regexp_replace(inner, "(^|,) +", "$1"), ","), "")
