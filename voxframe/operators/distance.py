"""Distances to pixel sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..grid import Grid, attach_grid
from .components import expand_runs, line_runs
from .lines import along_lines, distance_pass
from .morphology import label_edges, sweep

KEY = ["volume_id", "i", "j", "k"]


def distance_within(seeds: DataFrame, grid: Grid | DataFrame, radius: float, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Voxels within ``radius`` of a seed voxel and their Euclidean distance to the nearest one."""
    reach = [int(radius // s) for s in spacing]
    offsets = []
    for di in range(-reach[0], reach[0] + 1):
        for dj in range(-reach[1], reach[1] + 1):
            for dk in range(-reach[2], reach[2] + 1):
                d2 = (di * spacing[0]) ** 2 + (dj * spacing[1]) ** 2 + (dk * spacing[2]) ** 2
                if d2 <= radius * radius:
                    offsets.append((di, dj, dk, d2))
    table = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk"), F.lit(float(d)).alias("d2"))
                      for a, b, c, d in offsets])
    moved = attach_grid(seeds.select(*KEY, F.explode(table).alias("o")), grid, "g_").select(
        "volume_id", *[(F.col(c) + F.col(f"o.d{c}")).cast("long").alias(c) for c in "ijk"], "o.d2", "g_nx", "g_ny", "g_nz")
    inside = moved.where("i >= 0 and i < g_nx and j >= 0 and j < g_ny and k >= 0 and k < g_nz")
    return inside.groupBy(*KEY).agg(F.sqrt(F.min("d2")).alias("distance"))


def squared_distance(mask: DataFrame, grid: Grid | DataFrame, dims: int = 2) -> DataFrame:
    """Exact squared distance of every mask voxel to the nearest voxel of another label or none.

    Separable: each axis takes the lower envelope of the parabolas that stand on the squared distances so far, run by
    run of equal labels along the grid line; beyond a run the nearest other voxel is the one beside it. A voxel moves
    once per axis as one row, whatever the size of its object. NULL where the grid holds no other voxel.
    """
    if "label" not in mask.columns:
        mask = mask.withColumn("label", F.lit(0).cast("long"))
    best = mask.select(*KEY, F.col("label").cast("long").alias("label"), F.lit(None).cast("double").alias("d2"))
    for axis in "ijk"[:dims]:
        sized = attach_grid(best, grid, "g_").select(*best.columns, F.col(f"g_n{'xyz'['ijk'.index(axis)]}").alias("n"))
        best = along_lines(sized, axis, distance_pass(axis), "volume_id long, i long, j long, k long, label long, d2 double")
    return best


def distance_transform(mask: DataFrame, grid: Grid | DataFrame, dims: int = 2) -> DataFrame:
    return squared_distance(mask, grid, dims).select(*KEY, F.sqrt("d2").alias("distance"))


def object_depth(labels: DataFrame, grid: Grid | DataFrame, edge: float = 0.35, centre: float = 1.35, border: float = 0.12) -> DataFrame:
    """Depth shading per label: distance over the label's largest distance, border pixels darkened, clipped to [0, 1]."""
    d = squared_distance(labels, grid, 2).withColumn("distance", F.sqrt("d2"))
    deepest = d.groupBy("volume_id", "label").agg(F.max("distance").alias("deepest"))
    edges = label_edges(labels, grid).withColumn("_edge", F.lit(True))
    share = F.col("distance") / F.col("deepest")
    weight = F.lit(edge) + F.lit(centre - edge) * share
    joined = d.join(deepest, ["volume_id", "label"]).join(edges, KEY, "left")
    value = F.when(F.col("_edge"), weight * border).otherwise(weight)
    return joined.select(*KEY, "label", F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)).alias("value"))


def expand_mask(mask: DataFrame, grid: Grid | DataFrame, spacing: Sequence[float], fraction: float) -> DataFrame:
    """Add the voxels within half the fraction of the largest physical side of each volume's bounding box.

    Every run is copied to the lines within reach of its volume and widened there; one
    sweep joins the copies, so the cost follows runs times lines, not voxels times ball.
    """
    if not 0 <= fraction < 1:
        raise ValueError("fraction must satisfy 0 <= fraction < 1")
    if fraction == 0:
        return mask.select(*KEY)
    si, sj, sk = map(float, spacing)
    sides = [(F.max(c) - F.min(c) + 1) * s for c, s in zip("ijk", (si, sj, sk))]
    reach = mask.groupBy("volume_id").agg((F.greatest(*sides) * fraction / 2.0).alias("r"))
    runs = attach_grid(line_runs(mask).join(reach, "volume_id"), grid, "g_")
    for axis, size, n in (("j", sj, "g_ny"), ("k", sk, "g_nz")):
        far = F.floor(F.col("r") / size)
        low, high = F.greatest(-far, -F.col(axis)), F.least(far, F.col(n) - 1 - F.col(axis))
        runs = runs.withColumn(f"d{axis}", F.explode(F.sequence(low, high)))
    rest = F.col("r") ** 2 - (F.col("dj") * sj) ** 2 - (F.col("dk") * sk) ** 2
    runs = runs.withColumn("rest", rest).where("rest >= 0").withColumn("w", F.floor(F.sqrt("rest") / si + 1e-9))
    copies = runs.select("volume_id", (F.col("j") + F.col("dj")).alias("j"), (F.col("k") + F.col("dk")).alias("k"),
                         F.greatest(F.col("i0") - F.col("w"), F.lit(0)).alias("i0"),
                         F.least(F.col("i1") + F.col("w"), F.col("g_nx") - 1).alias("i1"))
    return expand_runs(sweep(copies, 1))
