"""The three validity rules of the data model, kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_finite(value: Column) -> Column:
    """Neither null, NaN nor infinite: the rule of similarity scores."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def valid_metric(value: Column) -> Column:
    """Finite and not zero: zero means "no data" in metric maps."""
    return is_finite(value) & (value != 0)


def valid_density(value: Column) -> Column:
    """Finite: zero is a real density."""
    return is_finite(value)


def nan_to_num(value: Column) -> Column:
    """NaN, infinities and nulls become 0."""
    return F.when(is_finite(value), value).otherwise(F.lit(0.0))
