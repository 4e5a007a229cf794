"""Rounding rules, named, because the workload mixes several of them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(value: Column) -> Column:
    """Nearest integer, ties to the even one (``rint``)."""
    return F.rint(value).cast("long")


def nearest_up(value: Column) -> Column:
    """Nearest integer, ties upwards."""
    return F.floor(value + F.lit(0.5)).cast("long")


def clip(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, low), high)
