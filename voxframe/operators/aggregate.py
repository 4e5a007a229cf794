"""Aggregations over voxel, label and point tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import half_even
from ..functions.validity import is_finite
from .ranking import quantiles

INDEX = ["i", "j", "k"]
KEY = ["volume_id", *INDEX]


def region_props(labels: DataFrame, intensity: DataFrame | None = None) -> DataFrame:
    """Area, centroid, equivalent diameter and mean intensity per label, with the rounded centroid."""
    df = labels
    measures = []
    if intensity is not None:
        df = df.join(intensity.select(*KEY, F.col("value").alias("_intensity")), KEY, "left")
        measures = [F.avg(F.coalesce("_intensity", F.lit(0.0))).alias("mean_intensity")]
    props = df.groupBy("volume_id", "label").agg(
        F.count("*").alias("area"), F.avg("i").alias("centroid_i"), F.avg("j").alias("centroid_j"),
        F.avg("k").alias("centroid_k"), *measures)
    return props.withColumns({
        "equivalent_diameter": F.sqrt(4 * F.col("area") / F.pi()),
        **{f"round_{a}": half_even(F.col(f"centroid_{a}")) for a in INDEX}})


def pixel_to_um(points: DataFrame, factor: float, spacing_um: float, columns=("i", "j")) -> DataFrame:
    """Upsampled pixel coordinates in original pixels and in micrometres."""
    extra = {}
    for c in columns:
        extra[f"{c}_original"] = F.col(c) / F.lit(float(factor))
        extra[f"{c}_um"] = F.col(c) / F.lit(float(factor)) * F.lit(float(spacing_um))
    return points.withColumns(extra)


def value_range(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def bin_index(value: Column, low: Column, width: Column, bins: int) -> Column:
    """Bin of a value; the last bin is closed, an empty range has one bin."""
    position = F.floor((value - low) / F.when(width > 0, width).otherwise(F.lit(1.0)))
    return F.greatest(F.least(position, F.lit(bins - 1)), F.lit(0)).cast("long")


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 50) -> DataFrame:
    """Equal bins over the data range of each group, empty bins included."""
    keys = list(keys)
    ranges = value_range(df.where(is_finite(F.col(value))), keys, value)
    ranges = ranges.withColumn("width", (F.col("high") - F.col("low")) / F.lit(float(bins)))
    placed = df.where(is_finite(F.col(value))).join(ranges, keys) if keys else df.where(is_finite(F.col(value))).crossJoin(F.broadcast(ranges))
    counts = placed.groupBy(*keys, bin_index(F.col(value), F.col("low"), F.col("width"), bins).alias("bin")).agg(F.count("*").alias("n"))
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    left = F.col("low") + F.col("bin") * F.col("width")
    return frame.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", left.alias("bin_left"), (left + F.col("width")).alias("bin_right"),
        (left + F.col("width") / 2).alias("bin_center"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram_fixed(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, width: float) -> DataFrame:
    """Bins of fixed width over a fixed range, the last one closed; values outside are not binned."""
    bins = int(round((high - low) / width))
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
    index = bin_index(F.col(value), F.lit(float(low)), F.lit(float(width)), bins)
    return inside.groupBy(*keys, index.alias("bin")).agg(F.count("*").alias("n"))


def range_counters(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if((v >= low) & (v <= high)).alias("n_inside"),
                                 F.count_if(v > high).alias("n_above"))


def summary_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Min, max, mean, exact median and non-zero share of the finite values."""
    finite = df.where(is_finite(F.col(value)))
    base = finite.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.count_if(F.col(value) != 0).alias("n_nonzero"))
    return base.join(quantiles(finite, keys, value, {"median": 0.5}), list(keys)).withColumn(
        "nonzero_ratio", F.col("n_nonzero") / F.col("n"))


def masked_distribution(voxels: DataFrame, mask: DataFrame, column: str = "value") -> DataFrame:
    """Distribution of a map inside a mask, with the count of values that signal folding (<= 0)."""
    inside = voxels.join(mask.select(*KEY), KEY, "left_semi").where(is_finite(F.col(column)))
    base = inside.groupBy("volume_id").agg(
        F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"), F.count_if(F.col(column) <= 0).alias("n_folding"))
    return base.join(quantiles(inside, ["volume_id"], column, {"p01": 0.01, "median": 0.5, "p99": 0.99}), "volume_id")


def require_no_folding(distribution: DataFrame) -> DataFrame:
    """Pass the rows on; a row with folding is an error when it is read."""
    return distribution.withColumn("n_folding", F.when(F.col("n_folding") > 0, F.raise_error(
        F.concat(F.lit("folding in volume "), F.col("volume_id").cast("string"))).cast("long")).otherwise(F.col("n_folding")))


def foreground_bbox(mask: DataFrame, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    box = mask.groupBy("volume_id").agg(*[f(c).alias(f"{n}_{c}") for c in INDEX for n, f in (("min", F.min), ("max", F.max))])
    return box.withColumns({f"extent_{c}": (F.col(f"max_{c}") - F.col(f"min_{c}") + 1) * F.lit(float(s))
                            for c, s in zip(INDEX, spacing)})


def foreground_centroid(mask: DataFrame, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Mean physical position of the foreground."""
    return mask.groupBy("volume_id").agg(F.count("*").alias("n"), *[
        F.avg(F.col(c) * F.lit(float(s)) + F.lit(float(o))).alias(f"center_{x}")
        for c, x, s, o in zip(INDEX, "xyz", spacing, origin)])


def component_centroids(labels: DataFrame, shape: tuple[int, int, int], label: str = "label") -> DataFrame:
    """Voxel count, mean position and rounded, clipped position per label."""
    props = labels.groupBy("volume_id", label).agg(
        F.count("*").alias("voxel_count"), *[F.avg(c).alias(f"center_{x}") for c, x in zip(INDEX, "xyz")])
    return props.withColumns({
        f"rounded_{x}": F.greatest(F.least(half_even(F.col(f"center_{x}")), F.lit(n - 1)), F.lit(0)).cast("long")
        for x, n in zip("xyz", shape)})


def mask_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Voxels before, after and removed, with the remaining share in percent."""
    b = before.groupBy("volume_id").agg(F.count("*").alias("n_before"))
    a = after.groupBy("volume_id").agg(F.count("*").alias("n_after"))
    return (b.join(a, "volume_id", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
            .withColumn("n_removed", F.col("n_before") - F.col("n_after"))
            .withColumn("remaining_percent", 100.0 * F.col("n_after") / F.col("n_before")))


def normalize_minmax(voxels: DataFrame, column: str = "value", epsilon: float = 1e-8, strict: bool = False) -> DataFrame:
    """Scale each volume to [0, 1]; ``strict`` makes a flat volume an error instead of dividing by epsilon."""
    ranges = value_range(voxels, ["volume_id"], column)
    span = F.col("high") - F.col("low")
    if strict:
        span = F.when(span < epsilon, F.raise_error(F.lit("flat volume")).cast("double")).otherwise(span)
    else:
        span = span + F.lit(epsilon)
    return voxels.join(ranges, "volume_id").withColumn(column, (F.col(column) - F.col("low")) / span).drop("low", "high")


def preview_uint8(voxels: DataFrame, column: str = "value") -> DataFrame:
    return voxels.withColumn(column, F.floor(F.col(column) * 255.0).cast("long"))


def invert_density(densities: DataFrame, mask: DataFrame, column: str = "density", into: str = "inverted") -> DataFrame:
    """``(max-d)/(max-min)`` inside the mask (1 where flat), 0 outside; a volume without mask voxels is an error."""
    marked = densities.join(mask.select(*KEY).withColumn("_in", F.lit(True)), KEY, "left")
    inside = F.when(F.col("_in"), F.col(column))
    ranges = marked.groupBy("volume_id").agg(F.min(inside).alias("low"), F.max(inside).alias("high"))
    high = F.coalesce(F.col("high"), F.raise_error(F.lit("mask selects no voxel")).cast("double"))
    scaled = F.when(F.col("high") > F.col("low"), (high - F.col(column)) / (F.col("high") - F.col("low"))).otherwise(F.lit(1.0))
    return (marked.join(ranges, "volume_id")
            .withColumn(into, F.when(F.col("_in"), scaled).otherwise(F.when(F.col("high").isNull(), high).otherwise(F.lit(0.0))))
            .drop("_in", "low", "high"))


def invert_dark(image: DataFrame, mask: DataFrame, column: str = "value") -> DataFrame:
    """``1 - value`` inside the mask, 0 elsewhere."""
    marked = image.join(mask.select(*KEY).distinct().withColumn("_in", F.lit(True)), KEY, "left")
    return marked.withColumn(column, F.when(F.col("_in"), 1.0 - F.col(column)).otherwise(F.lit(0.0))).drop("_in")


def invert_low_density(densities: DataFrame, bounds: tuple[float, float], column: str = "density", into: str = "inverted") -> DataFrame:
    """Fixed-range inversion of the densities inside the closed range, 0 elsewhere."""
    low, high = map(float, bounds)
    inside = (F.col(column) >= low) & (F.col(column) <= high)
    scaled = (F.lit(high) - F.col(column)) / F.lit(high - low) if high > low else F.lit(1.0)
    return densities.withColumn(into, F.when(inside, scaled).otherwise(F.lit(0.0)))


def pca_moments(points: DataFrame, columns=("x", "y", "z")) -> DataFrame:
    """Count, means and the six sample covariances of a point cloud in one aggregation."""
    pairs = [(a, b) for n, a in enumerate(columns) for b in columns[n:]]
    return points.groupBy("volume_id").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.covar_samp(a, b).alias(f"cov_{a}{b}") for a, b in pairs])


def pca_foreground(voxels: DataFrame, percent: float = 30.0, minimum: int = 10) -> DataFrame:
    """Voxels above the given percentile of the non-zero values of their volume."""
    nonzero = voxels.where(is_finite(F.col("value")) & (F.col("value") != 0))
    limits = quantiles(nonzero, ["volume_id"], "value", {"limit": percent / 100.0})
    kept = voxels.join(limits, "volume_id").where("value > limit").drop("limit")
    sizes = kept.groupBy("volume_id").agg(F.count("*").alias("n_kept")).where(F.col("n_kept") >= minimum)
    return kept.join(sizes.select("volume_id"), "volume_id", "left_semi")


def pca_axis(moments: DataFrame) -> DataFrame:
    """Eigenvalues (descending) and unit long axis from the moment rows (one row per volume)."""
    import numpy as np
    import pandas as pd

    columns = ["cov_xx", "cov_xy", "cov_xz", "cov_yy", "cov_yz", "cov_zz"]

    def decompose(batches):
        for batch in batches:
            c = batch[columns].to_numpy(dtype=float)
            matrices = c[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            values, vectors = np.linalg.eigh(matrices)
            yield pd.DataFrame({
                "volume_id": batch["volume_id"], "n": batch["n"],
                "center_x": batch["mean_x"], "center_y": batch["mean_y"], "center_z": batch["mean_z"],
                "eigenvalue_1": values[:, 2], "eigenvalue_2": values[:, 1], "eigenvalue_3": values[:, 0],
                "axis_x": vectors[:, 0, 2], "axis_y": vectors[:, 1, 2], "axis_z": vectors[:, 2, 2]})

    return moments.mapInPandas(decompose, (
        "volume_id long, n long, center_x double, center_y double, center_z double, eigenvalue_1 double, "
        "eigenvalue_2 double, eigenvalue_3 double, axis_x double, axis_y double, axis_z double"))


def otsu(voxels: DataFrame, keys: Sequence[str] = ("volume_id",), value: str = "value", bins: int = 256) -> DataFrame:
    """Threshold maximising the between-class variance of a histogram over the data range.

    Works on at most ``bins`` rows per group after the histogram. The threshold is the
    centre of the last bin of the lower class; the first maximum wins.
    """
    from pyspark.sql import Window

    keys = list(keys)
    bars = histogram(voxels, keys, value, bins)
    running = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    mass = F.col("n") * F.col("bin_center")
    split = bars.withColumns({
        "n1": F.sum("n").over(running), "m1": F.sum(mass).over(running),
        "n_all": F.sum("n").over(whole), "m_all": F.sum(mass).over(whole)})
    split = split.withColumn("n2", F.col("n_all") - F.col("n1")).where("n1 > 0 and n2 > 0")
    gap = F.col("m1") / F.col("n1") - (F.col("m_all") - F.col("m1")) / F.col("n2")
    split = split.withColumn("between", F.col("n1") * F.col("n2") * gap * gap)
    return split.groupBy(*keys).agg(F.max_by("bin_center", F.struct(F.col("between"), -F.col("bin"))).alias("threshold"))


def hexbin(points: DataFrame, x: str, y: str, gridsize: int = 60, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Counts on a hexagonal lattice: each point goes to the nearer of two shifted rectangular lattices."""
    keys = list(keys)
    nx, ny = gridsize, int(gridsize / 3 ** 0.5)
    ranges = points.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))

    def unit(c, low, high, n):
        pad = F.lit(1e-9) * (F.col(high) - F.col(low))
        return (F.col(c) - (F.col(low) - pad)) / ((F.col(high) + pad - (F.col(low) - pad)) / F.lit(float(n)))

    df = points.join(ranges, keys).withColumns({"ux": unit(x, "x0", "x1", nx), "uy": unit(y, "y0", "y1", ny)})
    df = df.withColumns({"i1": F.rint("ux"), "j1": F.rint("uy"), "i2": F.floor("ux"), "j2": F.floor("uy")})
    d1 = (F.col("ux") - F.col("i1")) ** 2 + 3 * (F.col("uy") - F.col("j1")) ** 2
    d2 = (F.col("ux") - F.col("i2") - 0.5) ** 2 + 3 * (F.col("uy") - F.col("j2") - 0.5) ** 2
    first = d1 < d2
    cells = df.select(*keys, first.alias("main_lattice"),
                      F.when(first, F.col("i1")).otherwise(F.col("i2")).cast("long").alias("hex_i"),
                      F.when(first, F.col("j1")).otherwise(F.col("j2")).cast("long").alias("hex_j"))
    return cells.groupBy(*keys, "main_lattice", "hex_i", "hex_j").agg(F.count("*").alias("n")).withColumn("log10_n", F.log10("n"))


def orient_sign(voxels: DataFrame, mask: DataFrame, column: str = "value") -> DataFrame:
    """Multiply each map by the sign of its masked median; a median near zero is an error."""
    inside = voxels.join(mask.select(*KEY), KEY, "left_semi").where(is_finite(F.col(column)))
    medians = quantiles(inside, ["volume_id"], column, {"median": 0.5})
    sign = F.when(F.abs("median") < 1e-12, F.raise_error(F.lit("median too close to zero")).cast("double")).otherwise(F.signum("median"))
    return voxels.join(medians, "volume_id").withColumn(column, F.col(column) * sign).drop("median")
