"""Drawing as data: rings, grid lines and label overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..grid import Grid, attach_grid

KEY = ["volume_id", "i", "j", "k"]


def rasterize_rings(centres: DataFrame, grid: Grid | DataFrame, radius: float, thickness: float,
                    spacing: Sequence[float], keep: str = "last") -> DataFrame:
    """Pixels whose distance to a centre lies within half the thickness of the radius.

    ``centres`` has ``x, y, label``; where rings cross, the first or last label stays.
    """
    outer, inner = radius + thickness / 2.0, max(0.0, radius - thickness / 2.0)
    df = attach_grid(centres.select("volume_id", "x", "y", "label"), grid, "g_")
    for axis, index, n, s in (("x", "i", "g_nx", spacing[0]), ("y", "j", "g_ny", spacing[1])):
        low = F.greatest(F.floor(F.col(axis) - outer / s - 1), F.lit(0))
        high = F.least(F.ceil(F.col(axis) + outer / s + 1), F.col(n) - 1)
        df = df.where(low <= high).withColumn(index, F.explode(F.sequence(low, high)))
    distance = F.sqrt(((F.col("i") - F.col("x")) * float(spacing[0])) ** 2 + ((F.col("j") - F.col("y")) * float(spacing[1])) ** 2)
    ring = df.where((distance >= inner) & (distance <= outer))
    pick = F.max if keep == "last" else F.min
    return ring.groupBy("volume_id", "i", "j", F.lit(0).cast("long").alias("k")).agg(pick("label").alias("label"))


def grid_lines(volumes: DataFrame, grid: Grid | DataFrame, factors: Sequence[float]) -> DataFrame:
    """Pixels of the lines at every multiple of the factor (rounded half-even) along both axes."""
    sized = attach_grid(volumes.select("volume_id").distinct(), grid, "g_")
    out = None
    for axis, other, n, m, factor in (("i", "j", "g_nx", "g_ny", factors[0]), ("j", "i", "g_ny", "g_nx", factors[1])):
        steps = F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / float(factor)) - 1)
        lines = sized.select("*", F.explode(steps).alias("_m")).withColumn(axis, F.rint(F.col("_m") * float(factor)).cast("long"))
        lines = lines.where(F.col(axis) < F.col(n)).repartition("volume_id", axis)
        pixels = lines.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)))
        part = pixels.select("volume_id", "i", "j", F.lit(0).cast("long").alias("k"))
        out = part if out is None else out.union(part)
    return out.distinct().hint("merge")  # few lines become many pixels, which the planner would still hold to be small enough for a broadcast


def overlay_labels(segmentation: DataFrame, lines: DataFrame, centres: DataFrame) -> DataFrame:
    """1 segmentation, 2 grid, 3 centre, 4 centre on the grid; the later code wins."""
    flag = lambda df, name: df.select(*KEY).distinct().withColumn(name, F.lit(True))
    joined = flag(segmentation, "s").join(flag(lines, "g"), KEY, "full").join(flag(centres, "c"), KEY, "full")
    code = (F.when(F.col("c") & F.col("g"), 4).when(F.col("c"), 3).when(F.col("g"), 2).otherwise(1))
    return joined.select(*KEY, code.cast("long").alias("label"))


def instance_overlay(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """Labels with the grid lines drawn over them as label max+1."""
    top = labels.groupBy("volume_id").agg((F.max("label") + 1).alias("_grid"))
    drawn = lines.select(*KEY).join(top, "volume_id").withColumnRenamed("_grid", "label")
    return labels.select(*KEY, "label").join(lines.select(*KEY), KEY, "left_anti").unionByName(drawn)
