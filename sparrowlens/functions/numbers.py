"""Rounding and rates with the semantics that each metric names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity (2.5 to 3, -2.5 to -2)."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5).cast("long")


def half_even(x: Column, digits: int = 0) -> Column:
    """Round half to the even neighbour."""
    return F.bround(x, digits)


def percent(part: Column, total: Column) -> Column:
    """part / total x 100, and 0 where the total is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")) * 100, F.lit(0.0))


def band(rate: Column, inverse: bool = False) -> Column:
    """good from 80, warn from 60, else bad; ``inverse`` for rates of failure."""
    value = 100 - rate if inverse else rate
    return F.when(value >= 80, "good").when(value >= 60, "warn").otherwise("bad")


def leading_number(text: Column) -> Column:
    """The number at the start of a text, as in '12%', or null."""
    found = F.regexp_extract(F.trim(text), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    return F.when(found != "", found).cast("double")
