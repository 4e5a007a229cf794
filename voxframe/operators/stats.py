"""Correlation and regression statistics, all metrics and volumes in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.student import p_value, t_critical
from ..session import cut_lineage
from .ranking import average_ranks, join_groups, many_prefix_sums, picked_quantiles, prefix_sums, quantile_ends, quantile_of, quantiles


def safe_corr(x: str, y: str) -> Column:
    """Pearson coefficient, NULL (not an error) where a column has no spread."""
    return F.covar_pop(x, y) / F.sqrt(F.nullif(F.var_pop(x) * F.var_pop(y), F.lit(0.0)))


def pearson(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr(x, y).alias("pearson_r"))


def spearman(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks.

    Pairs are first reduced to distinct (x, y) with a weight, so that heavily tied
    inputs shrink before the rank joins; the final moments are one aggregation.
    """
    keys = list(keys)
    weighted = pairs.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    weighted = weighted.groupBy(*keys, "_x", "_y").agg(F.count("*").alias("_w"))
    # both columns are ranked in one pass
    sides = F.array(F.struct(F.lit("x").alias("side"), F.col("_x").alias("v")), F.struct(F.lit("y").alias("side"), F.col("_y").alias("v")))
    long = weighted.select(*keys, "_w", F.explode(sides).alias("s")).select(*keys, "_w", "s.side", "s.v")
    ranks = average_ranks(long, [*keys, "side"], "v", weight="_w")
    side = lambda name: ranks.where(F.col("side") == name).select(*keys, F.col("v").alias(f"_{name}"), F.col("rank").alias(f"_r{name}"))
    ranked = weighted.join(side("x"), [*keys, "_x"]).join(side("y"), [*keys, "_y"])
    return _weighted_correlation(ranked, keys)


def _weighted_correlation(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of the ranks ``_rx`` and ``_ry`` of pairs with weight ``_w``."""
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"))
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    return sums.select(*keys, n.alias("n"), F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("spearman_r"))


def _fit_moments(x: str, y: str) -> list[Column]:
    return [F.count("*").alias("n"), F.regr_avgx(y, x).alias("mean_x"), F.regr_avgy(y, x).alias("mean_y"),
            F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")]


def _fit_columns() -> list[Column]:
    """Slope, intercept and standard error from the moments."""
    usable = (F.col("n") >= 3) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    sxx = F.when(usable, F.col("sxx"))  # NULL carries through where the fit is undefined
    slope = F.col("sxy") / sxx
    error = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / sxx, F.lit(0.0))
    freedom = F.when(usable, F.col("n") - 2)
    return [slope.alias("slope"), (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"), F.when(usable, F.sqrt(error / freedom) / F.sqrt(sxx)).alias("slope_se")]


def linear_fit(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and slope standard error from one pass of moments; NULL where undefined."""
    return pairs.groupBy(*keys).agg(*_fit_moments(x, y)).select(*keys, "n", *_fit_columns())


def slope_interval(fit: DataFrame, confidence: float = 0.95) -> DataFrame:
    margin = t_critical(F.col("n"), confidence) * F.col("slope_se")
    return fit.withColumns({"slope_ci_lower": F.col("slope") - margin, "slope_ci_upper": F.col("slope") + margin})


def guarded(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per group: are statistics defined (at least 3 rows and a range in both columns)?"""
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        ((F.count("*") >= 3) & (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))).alias("defined"))


def density_terciles(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Medians and counts of y below, between and above the terciles of x."""
    keys = list(keys)
    grouped = tercile_groups(cut_lineage(pairs.select(*keys, x, y)), keys, x, [y])  # read for limits, medians and counts
    medians = quantiles(grouped, [*keys, "tercile"], y, {"median": 0.5})
    counts = grouped.groupBy(*keys, "tercile").agg(F.count("*").alias("n"))
    both = counts.join(medians, [*keys, "tercile"])
    pieces = []
    for name in ("low", "medium", "high"):
        here = F.col("tercile") == name
        pieces += [F.max(F.when(here, F.col("median"))).alias(f"{name}_median"),
                   F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias(f"{name}_n")]
    return both.groupBy(*keys).agg(*pieces)


def tercile_groups(pairs: DataFrame, keys: Sequence[str], x: str, others: Sequence[str] = ()) -> DataFrame:
    """Pairs with their tercile of x; ``others`` are columns that, with x, tell the rows of a group apart."""
    limits = quantiles(pairs, keys, x, {"q1": 1 / 3, "q2": 2 / 3})
    label = F.when(F.col(x) <= F.col("q1"), "low").when(F.col(x) <= F.col("q2"), "medium").otherwise("high")
    return join_groups(pairs, limits, keys, [x, *others]).withColumn("tercile", label).drop("q1", "q2")


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles and whiskers: the outermost values within 1.5 interquartile ranges of the box."""
    keys = list(keys)
    box = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    whiskers = df.join(box, keys).groupBy(*keys).agg(
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"), F.count("*").alias("n"))
    return box.join(whiskers, keys)


TERCILES = ("low", "medium", "high")


def order_summary(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman coefficient, and median and count of y in each tercile of x, per group.

    Pairs become distinct (x, y) with a weight. One table of the values of x with prefix sums gives ranks and tercile
    limits; one of the values of y, with a prefix sum for all pairs and one for each tercile, gives ranks and medians.
    """
    keys = list(keys)
    weighted = pairs.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).groupBy(*keys, "_x", "_y").agg(F.count("*").alias("_w"))
    of_x = prefix_sums(weighted.groupBy(*keys, "_x").agg(F.sum("_w").alias("n")), keys, "_x", "n", total="_count")
    limits = picked_quantiles(of_x, keys, "_x", {"q1": 1 / 3, "q2": 2 / 3})
    label = F.when(F.col("_x") <= F.col("q1"), "low").when(F.col("_x") <= F.col("q2"), "medium").otherwise("high")
    ranks = join_groups(of_x, limits, keys, ["_x"]).select(*keys, "_x", (F.col("before") + (F.col("n") + 1) / 2.0).alias("_rx"), label.alias("_t"))
    placed = join_groups(weighted, ranks, [*keys, "_x"], ["_y"])  # one value of x may hold most pairs
    counts = {t: F.sum(F.when(F.col("_t") == t, F.col("_w")).otherwise(0)).alias(f"n_{t}") for t in TERCILES}
    of_y = many_prefix_sums(placed.groupBy(*keys, "_y").agg(F.sum("_w").alias("n"), *counts.values()), keys, "_y",
                            {"before": "n", **{f"before_{t}": f"n_{t}" for t in TERCILES}}, {f"{t}_n": f"before_{t}" for t in TERCILES})
    ends = [e for t in TERCILES for e in quantile_ends("_y", F.col(f"{t}_n"), {f"{t}_median": 0.5}, f"before_{t}", f"n_{t}")]
    medians = of_y.groupBy(*keys).agg(*[F.max(f"{t}_n").alias(f"{t}_n") for t in TERCILES], *ends)
    medians = medians.select(*keys, *[c for t in TERCILES for c in (quantile_of(f"{t}_median", F.col(f"{t}_n"), 0.5).alias(f"{t}_median"), F.col(f"{t}_n"))])
    ranked = join_groups(placed, of_y.select(*keys, "_y", (F.col("before") + (F.col("n") + 1) / 2.0).alias("_ry")), [*keys, "_y"], ["_x"])
    return _weighted_correlation(ranked, keys).drop("n").join(medians, keys)


def correlation_summary(pairs: DataFrame, keys: Sequence[str], x: str, y: str, config: dict | None = None) -> DataFrame:
    """One row per group: n, Pearson and Spearman with p-values, slope interval, tercile groups.

    Groups with fewer than two rows are skipped; groups without spread have NULL statistics.
    """
    keys = list(keys)
    pairs = cut_lineage(pairs.select(*keys, x, y))
    defined = (F.count("*") >= 3) & (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    moments = pairs.groupBy(*keys).agg(*_fit_moments(x, y), safe_corr(x, y).alias("pearson_r"), defined.alias("defined")).where("n >= 2")
    joined = moments.select(*keys, "n", "defined", "pearson_r", *_fit_columns()).join(order_summary(pairs, keys, x, y), keys)
    for column in ("pearson_r", "spearman_r", "slope", "intercept", "slope_se"):
        joined = joined.withColumn(column, F.when(F.col("defined"), F.col(column)))
    joined = slope_interval(joined)
    joined = joined.withColumns({"pearson_p": p_value(F.col("pearson_r"), F.col("n")),
                                 "spearman_p": p_value(F.col("spearman_r"), F.col("n"))})
    for name, value in (config or {}).items():
        joined = joined.withColumn(name, F.lit(value))
    return joined.drop("defined")
