"""Student-t tail probability and quantile, vectorised.

They run on aggregated rows only (one row per metric), through an Arrow-batched
pandas UDF, because Spark has no incomplete beta function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, dof: float) -> float:
    """P(|T| >= |t|)."""
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def t_quantile(probability: float, dof: float) -> float:
    """Upper quantile for probability > 0.5, by bisection on the tail."""
    target = 2.0 * (1.0 - probability)
    low, high = 0.0, 1.0
    while two_sided_p(high, dof) > target:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if two_sided_p(middle, dof) > target:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation coefficient."""

    @F.pandas_udf(T.DoubleType())
    def tail(r_values: pd.Series, n_values: pd.Series) -> pd.Series:
        out = []
        for r_one, n_one in zip(r_values, n_values):
            if r_one is None or np.isnan(r_one) or n_one is None or n_one < 3:
                out.append(None)
            elif abs(r_one) >= 1.0:
                out.append(0.0)
            else:
                dof = float(n_one) - 2.0
                out.append(two_sided_p(r_one * math.sqrt(dof / (1.0 - r_one * r_one)), dof))
        return pd.Series(out, dtype="float64")

    return tail(r.cast("double"), n.cast("double"))


def t_critical(n: Column, confidence: float = 0.95) -> Column:
    """Two-sided critical value with n-2 degrees of freedom."""

    @F.pandas_udf(T.DoubleType())
    def critical(n_values: pd.Series) -> pd.Series:
        known = {n_one: t_quantile(0.5 + confidence / 2.0, n_one - 2.0)
                 for n_one in n_values.dropna().unique() if n_one >= 3}
        return n_values.map(known).astype("float64")

    return critical(n.cast("double"))
