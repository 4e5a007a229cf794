"""Scoring candidate poses and evaluating given transforms, all volumes and images in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..grid import Grid, attach_grid
from ..session import keep_table
from . import similarity
from .blocks import PLACE
from .posed import pose_similarity
from .ranking import join_groups, top_candidates
from .transforms import apply_chain

KEY = ["volume_id", "i", "j", "k"]
SIDE = 64  # of the blocks in which pairs are made


def sparse_pairs(fixed: DataFrame, moved: DataFrame, names: DataFrame, name: str, grid: Grid | DataFrame) -> DataFrame:
    """(volume_id, i, j, k, ``name``, a, b) wherever the fixed or the moved image has a voxel, absent values as 0.

    ``names`` lists the moved images of each volume, a fixed, small number.
    """
    known = attach_grid(fixed, grid, "g_").where("i >= 0 and i < g_nx and j >= 0 and j < g_ny and k >= 0 and k < g_nz")
    base = known.select(*KEY, F.coalesce("value", F.lit(0)).cast("double").alias("a")).join(names, "volume_id")
    pairs = base.join(moved.select(*KEY, name, F.col("value").cast("double").alias("b")), [*KEY, name], "full")
    fixed_volumes = fixed.select("volume_id").distinct()  # a volume without a fixed voxel has no pairs
    return pairs.select(*KEY, name, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "ab"]).join(fixed_volumes, "volume_id", "left_semi")


def masked_pairs(fixed: DataFrame, moved: DataFrame, mask: DataFrame, names: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    """(volume_id, image, a, b, inside): ``sparse_pairs``, and whether their cell is in the mask.

    Fixed, moved and mask voxels meet by block of the grid in one shuffle. The pairs of a volume stay in the tasks of its
    few blocks, so that counts by volume and value shrink before they are shuffled.
    """
    known = attach_grid(fixed, grid, "g_").where("i >= 0 and i < g_nx and j >= 0 and j < g_ny and k >= 0 and k < g_nz")
    rows = (known.select(*KEY, F.coalesce("value", F.lit(0)).cast("double").alias("a"))
            .unionByName(moved.select(*KEY, "image", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("b")), allowMissingColumns=True)
            .unionByName(mask.select(*KEY, F.lit(True).alias("inside")), allowMissingColumns=True))
    block = ["volume_id", *PLACE]
    rows = rows.withColumns({place: F.floor(F.col(c) / SIDE) for place, c in zip(PLACE, KEY[1:])}).repartition(*block)
    cells = rows.groupBy(*block, *KEY[1:]).agg(
        F.collect_list("a").alias("fixed"), F.collect_list(F.when(F.col("b").isNotNull(), F.struct("image", "b"))).alias("moved"), F.max("inside").alias("inside"))
    # a volume without a fixed voxel has no pairs
    images = names.join(fixed.select("volume_id").distinct(), "volume_id", "left_semi").groupBy("volume_id").agg(F.collect_set("image").alias("images"))
    cells = join_groups(cells, images, ["volume_id"], few=similarity.FEW_KEY_SETS)
    image = F.when(F.size("fixed") > 0, F.col("images")).otherwise(F.array_distinct("moved.image"))
    or_zero = lambda values: F.explode(F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(0.0))))
    of_image = F.transform(F.filter("moved", lambda m: m["image"] == F.col("image")), lambda m: m["b"])
    inside = F.coalesce("inside", F.lit(False)).alias("inside")
    pairs = cells.select("volume_id", "fixed", "moved", inside, F.explode(image).alias("image"))
    pairs = pairs.select("volume_id", "image", "inside", "fixed", or_zero(of_image).alias("b"))
    return pairs.select("volume_id", "image", or_zero(F.col("fixed")).alias("a"), "b", "inside")


def cells_left(pairs: DataFrame, names: DataFrame, name: str, cells: DataFrame) -> DataFrame:
    """(volume_id, ``name``, n_empty): the cells of each volume (volume_id, n_cells) that have no pair."""
    taken = pairs.groupBy("volume_id", name).agg(F.count("*").alias("_n"))
    return names.join(cells, "volume_id").join(taken, ["volume_id", name], "left").select(
        "volume_id", name, (F.col("n_cells") - F.coalesce("_n", F.lit(0))).alias("n_empty"))


def grid_cells(volumes: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    return attach_grid(volumes.select("volume_id").distinct(), grid, "g_").select("volume_id", (F.col("g_nx") * F.col("g_ny") * F.col("g_nz")).alias("n_cells"))


def score_candidates(fixed: DataFrame, moving: DataFrame, poses: DataFrame, grid: Grid | DataFrame,
                     moving_grid: Grid | DataFrame | None = None, bins: int = 64) -> DataFrame:
    """MI and NCC of every pose (``volume_id, candidate, matrix``: fixed world → moving world).

    The moving image is resampled to the fixed grid under every pose; outside it is 0, and 0 counts as a value. Pairs
    are counted where they are made and never stored. A pose without a score has status ``failed``.
    """
    scores = pose_similarity(fixed, moving, poses, grid, moving_grid or grid, bins)
    status = F.when(F.col("mi").isNull() | F.col("ncc").isNull(), "failed").otherwise("success")
    return scores.withColumn("status", status)


def rank_candidates(scores: DataFrame, method: str = "mi") -> DataFrame:
    """Rank per volume: best score first, failed ones last (-inf), ties in search order.

    The window spans the candidates of one volume, a fixed small number.
    """
    usable = (F.col("status") == "success") & (F.abs(F.col(method)) < float("inf"))  # neither null nor NaN
    combined = F.when(usable, F.col(method)).otherwise(F.lit(float("-inf")))
    order = Window.partitionBy("volume_id").orderBy(F.col("combined_score").desc(), F.col("candidate"))
    return scores.withColumn("combined_score", combined).withColumn("rank", F.row_number().over(order)).withColumn("score_method", F.lit(method))


def select_candidate(scores: DataFrame, method: str = "mi") -> DataFrame:
    """The best candidate per volume; a volume without any valid score is an error."""
    ranked = scores.withColumn("combined_score", F.when(F.col("status") == "success", F.col(method)))
    best = top_candidates(ranked, "combined_score", "candidate", ["volume_id"])
    return best.withColumn("combined_score", F.when(F.col("combined_score").isNull(), F.raise_error(
        F.concat(F.lit("no valid candidate for volume "), F.col("volume_id").cast("string"))).cast("double")).otherwise(F.col("combined_score")))


def normalize_weights(weights: DataFrame, keys: Sequence[str], column: str = "weight") -> DataFrame:
    """Weights over their sum per group; a sum of 0 or less is an error."""
    sums = weights.groupBy(*keys).agg(F.sum(column).alias("_sum"))
    total = F.when(F.col("_sum") <= 0, F.raise_error(F.lit("weights must have a positive sum")).cast("double")).otherwise(F.col("_sum"))
    return weights.join(sums, list(keys)).withColumn(column, F.col(column) / total).drop("_sum")


def apply_transforms(images: DataFrame, masks: DataFrame, chains: DataFrame, source: Grid | DataFrame,
                     target: Grid | DataFrame) -> DataFrame:
    """Apply a chain per volume to all its images (linear) and to its mask (nearest), then mask the images.

    ``images`` carries an ``image`` name next to the voxel columns.
    """
    names = images.select("volume_id", "image").distinct()
    jobs = names.join(chains, "volume_id").select("volume_id", "image", "matrix")
    moved = apply_chain(images, jobs, source, target, keys=("volume_id", "image"), source_keys=("volume_id", "image"))
    ones = masks.select(*KEY, F.lit(1.0).alias("value"))
    mask = apply_chain(ones, chains, source, target, "nearest").where("value > 0.5").select(*KEY)
    return moved.join(mask, KEY, "left_semi")


def evaluate_transforms(fixed: DataFrame, mask: DataFrame, images: DataFrame, chains: DataFrame,
                        source: Grid | DataFrame, target: Grid | DataFrame, bins: int = 64) -> DataFrame:
    """(volume, image, scope, n, ncc, mi) of the transformed images against the fixed map.

    Cells of the grid, or of the mask, in which neither image has a voxel are one weighted (0, 0) row.
    """
    names = images.select("volume_id", "image").distinct()
    jobs = names.join(chains, "volume_id").select("volume_id", "image", "matrix")
    moved = apply_chain(images, jobs, source, target, keys=("volume_id", "image"), source_keys=("volume_id", "image"))
    inside = attach_grid(mask.select(*KEY), target, "g_").where("i >= 0 and i < g_nx and j >= 0 and j < g_ny and k >= 0 and k < g_nz").select(*KEY)
    scopes = F.when(F.col("inside"), F.array(F.lit("global"), F.lit("mask"))).otherwise(F.array(F.lit("global")))
    pairs = keep_table(masked_pairs(fixed, moved, inside, names, target), "pairs").select("volume_id", "image", F.explode(scopes).alias("scope"), "a", "b")
    masked = inside.distinct().join(fixed.select("volume_id").distinct(), "volume_id", "left_semi").groupBy("volume_id").agg(F.count("*").alias("n_cells"))
    empty = None
    for scope, cells in (("global", grid_cells(fixed, target)), ("mask", masked)):
        left = cells_left(pairs.where(F.col("scope") == scope), names, "image", cells).withColumn("scope", F.lit(scope))
        empty = left if empty is None else empty.unionByName(left)
    return similarity.similarity(pairs, ["volume_id", "image", "scope"], bins, empty=empty, stored=True)


def metrics_wide(metrics: DataFrame, keys: Sequence[str], images: Sequence[str]) -> DataFrame:
    """One row per run: MI and NCC of every image and scope as columns."""
    pieces = []
    for image in images:
        for scope in ("global", "mask"):
            here = (F.col("image") == image) & (F.col("scope") == scope)
            pieces += [F.max(F.when(here, F.col(m))).alias(f"{m}_{scope}_{image}") for m in ("mi", "ncc")]
    return metrics.groupBy(*keys).agg(*pieces)


def upsert_summary(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str = "row_order") -> DataFrame:
    """Replace the rows whose keys match, keeping their place; append the others behind the last row.

    ``new`` numbers its own rows in ``order`` from 0.
    """
    keys = list(keys)
    places = existing.groupBy(*keys).agg(F.min(order).alias("_place"))
    last = existing.agg(F.coalesce(F.max(order), F.lit(-1)).alias("_last"))  # one row
    placed = new.join(places, keys, "left").join(F.broadcast(last))
    placed = placed.withColumn(order, F.coalesce(F.col("_place"), F.col("_last") + 1 + F.col(order))).drop("_place", "_last")
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(placed.select(*existing.columns))


def sample_rows(df: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """A fixed number of rows without replacement, the same for the same seed (hash order)."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(count)
