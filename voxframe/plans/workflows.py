"""Named workflows: compositions of operators behind one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..grid import Grid
from ..operators import cells, filters, stats

KEY = ["volume_id", "i", "j", "k"]


def density_on_grid(points: DataFrame, point_grid: Grid, target: Grid, reference: DataFrame, unit_um3: float = 8000.0) -> DataFrame:
    """Point density at every voxel of the reference map (0 where no point falls)."""
    counts = cells.count_points(cells.points_to_cells(points, point_grid, target))
    joined = reference.join(counts, KEY, "left")
    value = cells.density(F.coalesce("n_points", F.lit(0)), target.voxel_volume, unit_um3)
    return joined.withColumn("density", value).drop("n_points")


def density_pairs(points: DataFrame, point_grid: Grid, target: Grid, metrics: DataFrame, unit_um3: float = 8000.0,
                  exclude_zero: bool = False, x_range=None, y_ranges: dict | None = None) -> DataFrame:
    """(metric, voxel, value, density) after the validity and exclusion rules."""
    pairs = density_on_grid(points, point_grid, target, filters.valid_metric(metrics), unit_um3)
    pairs = filters.exclude_zero_density(pairs, exclude_zero)
    return filters.exclude_ranges(pairs, x_range, y_ranges)


def density_correlation(points: DataFrame, point_grid: Grid, target: Grid, metrics: DataFrame, unit_um3: float = 8000.0,
                        exclude_zero: bool = False, x_range=None, y_ranges: dict | None = None,
                        keys=("metric",)) -> DataFrame:
    """How does point density on a coarse grid relate to the metrics of its voxels?"""
    pairs = density_pairs(points, point_grid, target, metrics, unit_um3, exclude_zero, x_range, y_ranges)
    return stats.correlation_summary(pairs.select(*keys, "density", "value"), list(keys), "density", "value")


def low_density(points: DataFrame, point_grid: Grid, target: Grid, reference: DataFrame, bounds: tuple[float, float]) -> DataFrame:
    """Inverted low densities over the valid voxels of a reference map."""
    from ..operators.aggregate import invert_low_density

    return invert_low_density(density_on_grid(points, point_grid, target, filters.valid_metric(reference)), bounds)


def slab_correlation(points: DataFrame, point_grid: Grid, target: Grid, metrics: DataFrame, grids: DataFrame,
                     plane: str, range_mm: tuple[float, float], **options) -> DataFrame:
    """The density correlation restricted to a slab of the grid."""
    cut = filters.require_nonempty(filters.slab(metrics, grids, plane, range_mm), "the slab")
    out = density_correlation(points, point_grid, target, cut, **options)
    low, high = range_mm
    return out.withColumns({"slab_plane": F.lit(plane), "slab_low_mm": F.lit(float(low)), "slab_high_mm": F.lit(float(high))})


def sv_compare(left: DataFrame, right: DataFrame, keys=("volume_id",)) -> DataFrame:
    """Two maps joined cell by cell; correlation over the cells where both are positive."""
    from ..operators.similarity import align

    pairs = filters.both_positive(align(left, right), "a", "b")
    return stats.pearson(pairs, keys, "a", "b").join(stats.spearman(pairs, keys, "a", "b").drop("n"), list(keys))


def fibre_sv(circles: DataFrame, grid: Grid, radius: float) -> dict[str, DataFrame]:
    """Circles to surface-to-volume cells, with the assignment report and the histogram."""
    from ..operators import aggregate, fibre

    pairs = fibre.circle_cell_overlap(circles, grid, radius)
    assignments = fibre.circle_assignments(circles, pairs, radius)
    cells_ = fibre.sv_map(fibre.sum_overlap(pairs), grid, radius)
    return {
        "cells": cells_, "assignments": fibre.assignment_summary(assignments), "first_circles": fibre.debug_rows(assignments),
        "histogram": aggregate.histogram_fixed(cells_, ["volume_id"], "s_over_v", 0.0, 0.15, 0.0005),
        "counters": aggregate.range_counters(cells_, ["volume_id"], "s_over_v", 0.0, 0.15)}


def merge_patches(patch_labels: DataFrame, patches: DataFrame, sizes: DataFrame, min_voxels: int = 10,
                  min_share: float = 0.3, min_points: int = 10) -> dict[str, DataFrame]:
    """Per-patch labels to one global label volume with its component map and low-point region."""
    from ..operators import patches as p
    from ..session import cut_lineage

    patch_labels = cut_lineage(patch_labels)  # read for the overlaps, the nodes and the merged volume
    matches = p.greedy_match(p.label_overlap(patch_labels, patches, min_voxels, min_share))
    component_map = p.merge_patch_components(patch_labels, matches)
    owned = p.owned_boxes(patches, sizes)
    merged = p.to_global_labels(p.owned_labels(patch_labels, owned), component_map)
    labels = merged.select(*KEY, F.col("global_component_id").alias("label"))
    return {"matches": matches, "component_map": component_map, "labels": labels, "mask": labels.select(*KEY),
            "low_point_mask": p.low_point_region(patches, patch_labels, sizes, min_points)}


def erode_and_mask(images: DataFrame, mask: DataFrame, iterations: int) -> DataFrame:
    """A batch of images under an eroded mask, the removed outline flagged."""
    from ..operators.morphology import erode_iter

    core = erode_iter(mask, iterations)
    outline = filters.mask_and_not(mask, core).withColumn("_outline", F.lit(True))
    masked = filters.apply_mask(images, core)
    return masked.join(outline, KEY, "left").withColumn("outline", F.coalesce("_outline", F.lit(False))).drop("_outline")


def grid_overlay(labels: DataFrame, centres: DataFrame, grid: Grid, factors) -> DataFrame:
    """Pixels per overlay code and volume."""
    from ..operators import raster

    lines = raster.grid_lines(labels, grid, factors)
    return raster.overlay_labels(labels, lines, centres).groupBy("volume_id", "label").agg(F.count("*").alias("n"))


def fibre_segmentation(image: DataFrame, grid: Grid, diameter_um: float, spacing_um: float, scales: int = 15,
                       disk_size: int = 15, growth_px: float = 2.0, area=(1, 50)) -> DataFrame:
    """Image to region table: disc, dots, blob seeds, limited watershed, area filter, properties."""
    from ..operators import aggregate, regions
    from ..operators.morphology import gaussian
    from ..operators.ranking import dense_relabel
    from ..session import cut_lineage

    scaled = aggregate.normalize_minmax(image)
    disk = cut_lineage(regions.disk_mask(scaled, grid, disk_size))
    dots = cut_lineage(regions.dot_mask(scaled, disk, grid))
    blobs = regions.log_blobs(gaussian(aggregate.invert_dark(scaled, disk), grid, 1.0), grid, regions.blob_sigmas(diameter_um, spacing_um, scales))
    markers = cut_lineage(regions.blob_markers(blobs, disk, dots).select(*KEY, "label"))
    flooded = regions.seeded_watershed(regions.limited_relief(dots, markers, grid, growth_px), markers)
    kept = dense_relabel(filters.area_between(flooded, *area)).select(*KEY, "label")
    return aggregate.region_props(kept, scaled)


def regrid_counts(points: DataFrame, point_grid: Grid, spacings, mask: DataFrame | None = None) -> DataFrame:
    """Count maps on isotropic grids of several spacings over the same outer edge."""
    import numpy as np

    out = None
    for spacing in spacings:
        shape = tuple(max(1, int(np.rint(n * s / spacing))) for n, s in zip(point_grid.shape, point_grid.spacing))
        counted = cells.count_points(cells.points_to_cells(points, point_grid, Grid.regular(shape, (spacing,) * 3)))
        counted = counted.withColumn("spacing", F.lit(float(spacing)))
        out = counted if out is None else out.unionByName(counted)
    return out if mask is None else out.join(mask.select(*KEY), KEY, "left_semi")


def evaluate_registration(existing: DataFrame, runs: DataFrame, fixed: DataFrame, mask: DataFrame, images: DataFrame, chains: DataFrame,
                          fixed_grid: Grid | DataFrame, moving_grid: Grid | DataFrame, native_spacing, names, bins: int = 64) -> DataFrame:
    """The summary table with one wide row per run: MI and NCC of the transformed images, in both scopes, on the native grid.

    ``runs`` names the run of a volume: volume_id, input_image, registration, row_order (from 0). The fixed map and the
    mask are sampled at the native spacing over the fixed extent. Rows of the same run are replaced in place, others
    appended; ``existing`` holds the run names, row_order and mi and ncc per scope and image.
    """
    from ..grid import grid_rows
    from ..operators import geometry, registration
    from ..operators.resample import resample
    from ..session import cut_lineage

    grids = grid_rows(fixed, fixed_grid) if isinstance(fixed_grid, Grid) else fixed_grid
    native = geometry.native_spacing_grid(grids, native_spacing)
    ones = mask.select(*KEY, F.lit(1.0).alias("value"))
    # stored, for both are read several times and their plans are long
    fixed_native = cut_lineage(resample(fixed, grids, native, "linear", "half_voxel"))
    mask_native = cut_lineage(resample(ones, grids, native, "nearest", "half_voxel").where("value > 0.5").select(*KEY))
    metrics = registration.evaluate_transforms(fixed_native, mask_native, images, chains, moving_grid, native, bins)
    wide = registration.metrics_wide(metrics, ["volume_id"], names)
    figures = [F.round(c, 9).alias(c) for c in wide.columns if c != "volume_id"]
    new = wide.join(runs, "volume_id").select("input_image", "registration", "row_order", *figures)
    return registration.upsert_summary(existing, new, ["input_image", "registration"])
