"""Points on grids: cell assignment, counts, densities, dense grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import half_even
from ..grid import Grid, attach_grid
from .geometry import AXES, spacing

INDEX = ("i", "j", "k")


def points_to_cells(points: DataFrame, source: Grid | DataFrame, target: Grid | DataFrame,
                    keep_all: bool = False) -> DataFrame:
    """Cell of the target grid for every point given in source voxel coordinates.

    Index ``c`` of a grid covers ``[c-½, c+½)``; both grids share their outer edge.
    A point is valid when it lies in the source grid and its cell in the target grid.
    """
    df = attach_grid(attach_grid(points, source, "src_"), target, "dst_")
    src, dst = spacing(F.col("src_affine")), spacing(F.col("dst_affine"))
    in_source, in_target = F.lit(True), F.lit(True)
    cells = {}
    for axis, index, s, t in zip(AXES, INDEX, src, dst):
        p = F.col(axis)
        in_source = in_source & (p >= -0.5) & (p < F.col(f"src_n{axis}") - 0.5)
        cells[index] = F.floor((p + 0.5) * s / t).cast("long")
        in_target = in_target & (F.col(index) >= 0) & (F.col(index) < F.col(f"dst_n{axis}"))
    df = df.withColumns(cells).withColumn("in_source", in_source).withColumn("in_target", in_target)
    df = df.drop(*[f"{p}{c}" for p in ("src_", "dst_") for c in ("nx", "ny", "nz", "affine")])
    if keep_all:
        return df
    return df.where("in_source and in_target").drop("in_source", "in_target")


def assignment_counters(assigned: DataFrame) -> DataFrame:
    """The counters of a ``keep_all`` assignment."""
    return assigned.groupBy("volume_id").agg(
        F.count_if("in_source").alias("n_in_source"), F.count_if(~F.col("in_source")).alias("n_out_source"),
        F.count_if(F.col("in_source") & F.col("in_target")).alias("n_valid"),
        F.count_if(F.col("in_source") & ~F.col("in_target")).alias("n_out_target"))


def points_to_cells_rint(points: DataFrame, source_shape, target_shape, flip_y: bool = False) -> DataFrame:
    """End-aligned mapping with half-even rounding; cells outside the target are dropped."""
    cells, inside = {}, F.lit(True)
    for axis, index, n_src, n_dst in zip(AXES, INDEX, source_shape, target_shape):
        step = (n_src - 1) / max(n_dst - 1, 1)
        cell = half_even(F.col(axis) / F.lit(float(step)))
        if flip_y and axis == "y":
            cell = F.lit(int(n_dst - 1)) - cell
        cells[index] = cell.cast("long")
        inside = inside & (F.col(index) >= 0) & (F.col(index) < int(n_dst))
    return points.withColumns(cells).where(inside)


def count_points(cells: DataFrame) -> DataFrame:
    """Points per occupied cell."""
    return cells.groupBy("volume_id", *INDEX).agg(F.count("*").alias("n_points"))


def conservation(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Per volume: total of the count map and number of mapped points; they must agree."""
    total = counts.groupBy("volume_id").agg(F.sum("n_points").alias("map_total"))
    mapped = cells.groupBy("volume_id").agg(F.count("*").alias("n_mapped"))
    return mapped.join(total, "volume_id", "full").select(
        "volume_id", F.coalesce("map_total", F.lit(0)).alias("map_total"),
        F.coalesce("n_mapped", F.lit(0)).alias("n_mapped"),
        F.coalesce(F.col("map_total") == F.col("n_mapped"), F.lit(False)).alias("preserved"))


def density(count: Column, voxel_um3: Column | float, unit_um3: float = 8000.0) -> Column:
    volume = voxel_um3 if isinstance(voxel_um3, Column) else F.lit(float(voxel_um3))
    return count.cast("double") / volume * F.lit(float(unit_um3))


def dense_cells(volumes: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    """Every cell of every volume.

    Volumes are expanded to planes, spread over the cluster, then expanded to cells,
    so that no task holds a whole volume and no cross join is needed.
    """
    sized = attach_grid(volumes.select("volume_id").distinct(), grid, "g_")
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    planes = sized.select("volume_id", "g_ny", "g_nz", span("g_nx").alias("i")).repartition("volume_id", "i")
    rows = planes.select("volume_id", "i", "g_nz", span("g_ny").alias("j"))
    return rows.select("volume_id", "i", "j", span("g_nz").alias("k"))


def densify(voxels: DataFrame, grid: Grid | DataFrame, columns=("value",), volumes: DataFrame | None = None) -> DataFrame:
    """All cells of the grid, zero where the sparse table has no row."""
    cells = dense_cells(voxels if volumes is None else volumes, grid)
    return cells.join(voxels, ["volume_id", *INDEX], "left").select(
        "volume_id", *INDEX, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])


def unique_density(densities: DataFrame, column: str = "density", top: int = 20) -> DataFrame:
    """The first distinct densities in ascending order (a top-k report)."""
    return densities.select(column).distinct().orderBy(column).limit(top)


def block_of_voxel(voxels: DataFrame, factors, blocks) -> DataFrame:
    """Block of each voxel along i and j, and k where a third factor is given: block ``b`` covers ``[int(b·f), int((b+1)·f))``.

    The block of an index is found by arithmetic: it is the last one that begins before index + 1. Its neighbours are
    looked at too, since the bounds are rounded products. Factors below one make empty blocks, and the trailing partial
    block has no block: its voxels are dropped.
    """
    def block(axis: str, factor: float) -> Column:
        f = F.lit(float(factor))
        near = F.ceil((F.col(axis) + 1) / f).cast("long") - 1
        around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: near + d)
        return F.get(F.filter(around, lambda b: (F.floor(b * f) <= F.col(axis)) & (F.col(axis) < F.floor((b + 1) * f))), F.lit(0))

    out = voxels
    for axis, factor, count in zip(("i", "j", "k"), factors, blocks):
        out = out.withColumn(f"block_{axis}", block(axis, factor)).where(F.col(f"block_{axis}").between(0, int(count) - 1))
    return out


def block_label_count(blocked_labels: DataFrame, radius_um: float, block_volume_um: float) -> DataFrame:
    """Distinct labels per block with surface and surface-to-volume from the fibre radius."""
    block = [c for c in ("block_i", "block_j", "block_k") if c in blocked_labels.columns]
    per_label = blocked_labels.where("label <> 0").select("volume_id", *block, "label").distinct()
    counted = per_label.groupBy("volume_id", *block).agg(F.count("*").alias("n_labels"))
    surface = F.col("n_labels") * F.lit(2.0) * F.pi() * F.lit(float(radius_um))
    return counted.withColumn("surface", surface).withColumn("s_over_v", surface / F.lit(float(block_volume_um)))


def block_summary(counted: DataFrame, blocks) -> DataFrame:
    """Number of blocks, mean and maximum of surface-to-volume per volume; blocks without labels count as 0."""
    total = math.prod(blocks)
    return counted.groupBy("volume_id").agg(F.lit(total).cast("long").alias("n_blocks"), (F.sum("s_over_v") / total).alias("mean"), F.max("s_over_v").alias("max"))
