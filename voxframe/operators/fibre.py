"""Fibre cross-sections on a coarser grid: exact overlap, surface and volume."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.circle import GEOMETRY_TOLERANCE, add_overlap
from ..grid import Grid, attach_grid
from .geometry import spacing


def circle_cell_overlap(circles: DataFrame, grid: Grid | DataFrame, radius: float) -> DataFrame:
    """(circle, cell) pairs with the overlap area and the arc length inside the cell.

    ``x, y`` are continuous grid indices; cell ``i`` spans ``[i, i+1)``.  Only circles
    whose centre cell lies inside the grid take part.  A circle is exploded into the
    few cells of its bounding box and everything else is arithmetic.
    """
    df = attach_grid(circles, grid, "g_")
    sx, sy, _ = spacing(F.col("g_affine"))
    r = F.lit(float(radius))
    layer = F.when(F.col("g_nz") == 1, F.lit(0)).otherwise(F.floor("z")).cast("long")
    df = df.withColumns({"sx": sx, "sy": sy, "k": layer, "ic": F.floor("x"), "jc": F.floor("y")})
    df = df.where("ic >= 0 and ic < g_nx and jc >= 0 and jc < g_ny and k >= 0 and k < g_nz")
    df = df.withColumns({"cx": F.col("x") * F.col("sx"), "cy": F.col("y") * F.col("sy")})
    local_x, local_y = (F.col("x") - F.col("ic")) * F.col("sx"), (F.col("y") - F.col("jc")) * F.col("sy")
    corner = ((local_x < r) | (F.col("sx") - local_x < r)) & ((local_y < r) | (F.col("sy") - local_y < r))
    df = df.withColumn("corner_case", corner)

    def cell_range(centre, size, count):
        low = F.greatest(F.floor((F.col(centre) - r) / F.col(size)), F.lit(0))
        return F.sequence(low, F.least(F.floor((F.col(centre) + r) / F.col(size)), F.col(count) - 1))

    df = df.withColumn("i", F.explode(cell_range("cx", "sx", "g_nx"))).withColumn("j", F.explode(cell_range("cy", "sy", "g_ny")))
    box = [F.col("i") * F.col("sx"), (F.col("i") + 1) * F.col("sx"), F.col("j") * F.col("sy"), (F.col("j") + 1) * F.col("sy")]
    # cells that the disc really enters: the nearest point of the cell is closer than r
    gap = lambda low, high, c: F.greatest(low - c, c - high, F.lit(0.0))
    dx, dy = gap(box[0], box[1], F.col("cx")), gap(box[2], box[3], F.col("cy"))
    df = df.where(dx * dx + dy * dy < r * r)
    df = add_overlap(df, F.col("cx"), F.col("cy"), r, box)
    df = df.withColumns({c: F.when(F.col(c) > GEOMETRY_TOLERANCE, F.col(c)).otherwise(F.lit(0.0)) for c in ("area", "arc")})
    return df.select("volume_id", "point_id", "i", "j", "k", "area", "arc", "corner_case")


def sum_overlap(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("volume_id", "i", "j", "k").agg(F.sum("area").alias("area"), F.sum("arc").alias("arc"))


def sv_map(cells: DataFrame, grid: Grid, radius: float, tolerance: float = GEOMETRY_TOLERANCE) -> DataFrame:
    """Surface, free volume and their ratio for unit depth; 0 where the free volume vanishes."""
    sx, sy, _ = grid.spacing
    volume = F.lit(sx * sy) - F.col("area")
    usable = (F.col("area") > tolerance) & (volume > tolerance)
    return cells.select(
        "volume_id", "i", "j", "k", (F.col("area") / F.lit(math.pi * radius * radius)).alias("area_weighted_count"),
        F.col("area").alias("fibre_area"), F.col("arc").alias("s"), volume.alias("v"),
        F.when(usable, F.col("arc") / volume).otherwise(F.lit(0.0)).alias("s_over_v"),
        ((F.col("area") > tolerance) & (volume <= tolerance)).alias("volume_exhausted"))


def circle_assignments(circles: DataFrame, pairs: DataFrame, radius: float) -> DataFrame:
    """One row per circle with totals, fractions and flags; circles outside have zeros."""
    per_circle = pairs.groupBy("volume_id", "point_id").agg(
        F.count_if((F.col("area") > 0) | (F.col("arc") > 0)).alias("n_cells"),
        F.sum("area").alias("area"), F.sum("arc").alias("arc"), F.bool_or("corner_case").alias("corner_case"))
    joined = circles.join(per_circle, ["volume_id", "point_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "volume_id", "point_id", "x", "y", F.col("n_cells").isNotNull().alias("inside"),
        F.coalesce("corner_case", F.lit(False)).alias("corner_case"), zero("n_cells").alias("n_cells"),
        zero("area").alias("area"), zero("arc").alias("arc"),
        (zero("area") / F.lit(math.pi * radius * radius)).alias("area_fraction"),
        (zero("arc") / F.lit(2 * math.pi * radius)).alias("arc_fraction"))


def assignment_summary(assignments: DataFrame) -> DataFrame:
    inside = lambda c: F.avg(F.when(F.col("inside"), F.col(c)))
    return assignments.groupBy("volume_id").agg(
        F.count("*").alias("n_circles"), F.count_if("inside").alias("n_inside"),
        F.count_if(~F.col("inside")).alias("n_outside"), F.count_if("corner_case").alias("n_corner"),
        inside("area_fraction").alias("mean_area_fraction"), inside("arc_fraction").alias("mean_arc_fraction"))


def debug_rows(assignments: DataFrame, top: int = 20) -> DataFrame:
    """Details of the first circles in file order (a top-k report)."""
    return assignments.orderBy("volume_id", "point_id").limit(top)


def sv_from_s(surfaces: DataFrame, grid: Grid) -> DataFrame:
    """S/V from a surface map alone, rounded 4/4/6 half-even."""
    area = grid.spacing[0] * grid.spacing[1]
    return surfaces.where("s > 0").select(
        "volume_id", "i", "j", "k", F.bround("s", 4).alias("s"), F.bround(F.lit(float(area)), 4).alias("v"),
        F.bround(F.col("s") / F.lit(float(area)), 6).alias("s_over_v"))


def expected_single_sv(radius: float, cell_area: float) -> float:
    return 2.0 * math.pi * radius / cell_area
