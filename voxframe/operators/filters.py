"""Filters and value predicates over voxel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import validity
from .geometry import AXES, axis_code, check_geometry, spacing_um

KEY = ["volume_id", "i", "j", "k"]


def threshold(voxels: DataFrame, above: float, column: str = "value") -> DataFrame:
    """Mask of the voxels above the threshold; NaN counts as 0."""
    return voxels.where(validity.nan_to_num(F.col(column)) > F.lit(float(above))).select(*KEY)


def valid_metric(voxels: DataFrame, column: str = "value") -> DataFrame:
    return voxels.where(validity.valid_metric(F.col(column)))


def both_positive(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.where((F.col(left) > 0) & (F.col(right) > 0))


def nan_to_num(voxels: DataFrame, column: str = "value") -> DataFrame:
    return voxels.withColumn(column, validity.nan_to_num(F.col(column)))


def exclude_zero_density(voxels: DataFrame, enabled: bool = True, column: str = "density") -> DataFrame:
    return voxels.where(F.col(column) > 0) if enabled else voxels


def in_closed_range(column: Column, bounds: tuple[float, float]) -> Column:
    return (column >= F.lit(float(bounds[0]))) & (column <= F.lit(float(bounds[1])))


def exclude_ranges(pairs: DataFrame, x_range=None, y_ranges: dict | None = None,
                   x: str = "density", y: str = "value", metric: str = "metric") -> DataFrame:
    """Drop rows whose x lies in the closed x range or whose y lies in the range of their metric."""
    excluded = F.lit(False)
    if x_range is not None:
        excluded = excluded | in_closed_range(F.col(x), x_range)
    for name, bounds in (y_ranges or {}).items():
        if bounds is not None:
            excluded = excluded | ((F.col(metric) == name) & in_closed_range(F.col(y), bounds))
    return pairs.where(~excluded)


def low_density_mask(densities: DataFrame, bounds: tuple[float, float], column: str = "density") -> DataFrame:
    return densities.where(in_closed_range(F.col(column), bounds))


# Letters of the world axis that each slicing plane is stacked along.
PLANE_CODES = {"sagittal": ("L", "R"), "coronal": ("P", "A"), "axial": ("I", "S")}


def slab(voxels: DataFrame, grids: DataFrame, plane: str, range_mm: tuple[float, float]) -> DataFrame:
    """Voxels whose centre along the plane's stacking axis lies in the closed range (mm from the edge).

    A range that is negative or turned round is an error; ``require_nonempty`` tells whether anything is left.
    """
    if not 0 <= range_mm[0] <= range_mm[1]:
        raise ValueError(f"{range_mm} is no slab range")
    affine = F.col("affine")
    scale = spacing_um(affine, F.col("unit"))
    position = F.lit(None).cast("double")
    for axis, index in enumerate(("i", "j", "k")):
        here = (F.col(index) + 0.5) * scale[axis] / 1000.0
        position = F.when(axis_code(affine, axis).isin(*PLANE_CODES[plane]), here).otherwise(position)
    joined = voxels.join(grids.select("volume_id", "affine", "unit"), "volume_id")
    return joined.where(in_closed_range(position, range_mm)).select(*voxels.columns)


def apply_mask(voxels: DataFrame, mask: DataFrame, column: str = "value") -> DataFrame:
    """Keep the value inside the mask, 0 elsewhere."""
    marked = mask.select(*KEY).withColumn("_in", F.lit(True))
    return (voxels.join(marked, KEY, "left")
            .withColumn(column, F.when(F.col("_in"), F.col(column)).otherwise(F.lit(0.0))).drop("_in"))


def mask_violations(images: DataFrame, mask: DataFrame, image_grids: DataFrame, mask_grids: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """(volume_id, reason) of the images that their mask does not fit: no grid, another shape, another affine, an empty mask."""
    geometry = check_geometry(image_grids, mask_grids, tolerance)
    filled = mask.select("volume_id").distinct().withColumn("_filled", F.lit(True))
    known = images.select("volume_id").distinct().join(geometry, "volume_id", "left").join(filled, "volume_id", "left")
    reason = (F.when(F.col("same_shape").isNull(), "no grid").when(~F.col("same_shape"), "shape").when(~F.col("same_affine"), "affine")
              .when(F.col("_filled").isNull(), "empty mask"))
    return known.select("volume_id", reason.alias("reason")).where("reason IS NOT NULL")


def apply_mask_batch(images: DataFrame, mask: DataFrame, image_grids: DataFrame, mask_grids: DataFrame, column: str = "value",
                     tolerance: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """A batch of images under their masks, and the violations; an image with one is left out and stops no other."""
    bad = mask_violations(images, mask, image_grids, mask_grids, tolerance)
    return apply_mask(images.join(bad.select("volume_id"), "volume_id", "left_anti"), mask, column), bad


def mask_check(original: DataFrame, masked: DataFrame, mask: DataFrame, column: str = "value") -> DataFrame:
    """Largest change inside the mask and largest remainder outside, per volume."""
    both = (original.select(*KEY, F.col(column).alias("_before"))
            .join(masked.select(*KEY, F.col(column).alias("_after")), KEY)
            .join(mask.select(*KEY).withColumn("_in", F.lit(True)), KEY, "left"))
    return both.groupBy("volume_id").agg(
        F.max(F.when(F.col("_in"), F.abs(F.col("_after") - F.col("_before")))).alias("max_change_inside"),
        F.max(F.when(F.col("_in").isNull(), F.abs("_after"))).alias("max_left_outside"))


def area_between(labels: DataFrame, low: float, high: float) -> DataFrame:
    """Label voxels of the components whose size lies in the closed range."""
    sizes = labels.groupBy("volume_id", "label").agg(F.count("*").alias("area"))
    kept = sizes.where(in_closed_range(F.col("area"), (low, high))).select("volume_id", "label")
    return labels.join(kept, ["volume_id", "label"], "left_semi")


def expected_area_bounds(diameter_px: float, low: float = 0.3, high: float = 3.0) -> tuple[float, float]:
    """Component size limits as multiples of the expected disc area."""
    area = 3.141592653589793 * (diameter_px / 2.0) ** 2
    return low * area, high * area


# --- set algebra on masks --------------------------------------------------------------------

def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).join(b.select(*KEY), KEY, "left_semi")


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).union(b.select(*KEY)).distinct()


def mask_and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).join(b.select(*KEY), KEY, "left_anti")


# --- guards ----------------------------------------------------------------------------------

def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_nonempty(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


