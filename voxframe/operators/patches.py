"""Overlapping patches: cutting, normalising, matching labels and merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rounding import clip
from ..functions.validity import is_finite
from ..session import cut_lineage
from .components import component_roots
from .ranking import dense_ids, quantiles

KEY = ["volume_id", "i", "j", "k"]
BOX_AXES = (("i", "x"), ("j", "y"), ("k", "z"))


def axis_stride(patch: int, overlap: float) -> int:
    return max(1, round(patch * (1.0 - overlap)))


def patch_grid(grids: DataFrame, patch: Sequence[int], overlap: Sequence[float]) -> DataFrame:
    """Patch boxes (x, y, z order of arguments) of every volume, indexed with x fastest.

    Starts run with a fixed stride; the last one is moved so that it ends at the border.
    """
    df = grids.select("volume_id", "nx", "ny", "nz")
    for axis, size, share in zip("xyz", patch, overlap):
        last = F.col(f"n{axis}") - int(size)
        stepped = F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)), F.lit(axis_stride(size, share)).cast("long"))
        df = df.withColumn(f"starts_{axis}", F.when(last <= 0, F.array(F.lit(0).cast("long")))
                           .otherwise(F.array_distinct(F.concat(stepped, F.array(last)))))
    count_x, count_y = F.size("starts_x"), F.size("starts_y")
    df = df.withColumns({"count_x": count_x, "count_y": count_y})
    for axis in "zyx":
        df = df.select("*", F.posexplode(f"starts_{axis}").alias(f"n_{axis}", f"{axis}0"))
    index = (F.col("n_z") * F.col("count_y") + F.col("n_y")) * F.col("count_x") + F.col("n_x")
    ends = [F.least(F.col(f"{a}0") + int(p), F.col(f"n{a}")).alias(f"{a}1") for a, p in zip("xyz", patch)]
    return df.select("volume_id", index.cast("long").alias("patch_index"), "z0", ends[2], "y0", ends[1], "x0", ends[0])


BLOCK_BITS = 5  # edge 2^BLOCK_BITS of the blocks in which voxels look up their boxes
BLOCK = ["_bi", "_bj", "_bk"]


def boxes_of_blocks(patches: DataFrame) -> DataFrame:
    """(volume_id, block, boxes): the patches that touch each block of voxels, as many as overlap around it."""
    out = patches.select("volume_id", F.struct(*[F.col(f"{a}{n}").cast("long").alias(f"{a}{n}") for a in "xyz" for n in (0, 1)], "patch_index").alias("box"))
    for name, (_, axis) in zip(BLOCK, BOX_AXES):
        low, high = F.col(f"box.{axis}0"), F.col(f"box.{axis}1")
        out = out.where(low < high).withColumn(name, F.explode(F.sequence(F.shiftright(low, BLOCK_BITS), F.shiftright(high - 1, BLOCK_BITS))))
    return out.groupBy("volume_id", *BLOCK).agg(F.collect_list("box").alias("boxes"))


def with_boxes(voxels: DataFrame, patches: DataFrame) -> DataFrame:
    """Voxels with ``boxes``, the patches that contain them: one equi-join on blocks, so no key has more rows than a block has voxels."""
    placed = voxels.withColumns({name: F.shiftright(index, BLOCK_BITS) for name, (index, _) in zip(BLOCK, BOX_AXES)})
    inside = lambda b: (F.col("i") >= b["x0"]) & (F.col("i") < b["x1"]) & (F.col("j") >= b["y0"]) & (F.col("j") < b["y1"]) & (F.col("k") >= b["z0"]) & (F.col("k") < b["z1"])
    return placed.join(boxes_of_blocks(patches), ["volume_id", *BLOCK]).withColumn("boxes", F.filter("boxes", inside))


def cut_patches(voxels: DataFrame, patches: DataFrame) -> DataFrame:
    """Every voxel once per patch that contains it, with the box; rows multiply only with the true overlap."""
    return with_boxes(voxels, patches).select(*voxels.columns, F.explode("boxes").alias("_box")).select(*voxels.columns, "_box.*")


def normalize_percentile(patch_voxels: DataFrame, low: float = 0.01, high: float = 0.99, mask: DataFrame | None = None) -> DataFrame:
    """Clip each patch to its percentile range and scale to [0, 1]; flat patches become 0.

    With a mask (voxels of the whole volume) only voxels inside it count for the range, and all others become 0.
    """
    keys = ["volume_id", "patch_index"]
    usable = is_finite(F.col("value"))
    if mask is not None:
        patch_voxels = patch_voxels.join(mask.select(*KEY).distinct().withColumn("_inside", F.lit(True)), KEY, "left")
        usable = usable & F.coalesce("_inside", F.lit(False))
    limits = quantiles(patch_voxels.where(usable), keys, "value", {"lo": low, "hi": high})
    span = F.col("hi") - F.col("lo")
    scaled = F.when(span > 0, clip((F.col("value") - F.col("lo")) / span, 0.0, 1.0)).otherwise(F.lit(0.0))
    value = F.when(usable, F.coalesce(scaled, F.lit(0.0))).otherwise(F.lit(0.0))
    return patch_voxels.join(limits, keys, "left").withColumn("value", value).drop("lo", "hi", "_inside")


def patch_status(patches: DataFrame, mask_voxels: DataFrame, normalised: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Why a patch needs prediction or not: existing, outside (no mask), zero_input or predicted."""
    keys = ["volume_id", "patch_index"]
    inside = cut_patches(mask_voxels.select(*KEY), patches).select(*keys).distinct().withColumn("_inside", F.lit(True))
    signal = normalised.where("value <> 0").select(*keys).distinct().withColumn("_signal", F.lit(True))
    out = patches.join(inside, keys, "left").join(signal, keys, "left")
    status = F.when(F.col("_inside").isNull(), "outside").when(F.col("_signal").isNull(), "zero_input").otherwise("predicted")
    if done is not None:
        out = out.join(done.select(*keys).distinct().withColumn("_done", F.lit(True)), keys, "left")
        status = F.when(F.col("_done"), "existing").otherwise(status)
    return out.select(*keys, status.alias("status"))


def patch_status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("volume_id", "status").agg(F.count("*").alias("n"))


def pending_patches(patches: DataFrame, done: DataFrame) -> DataFrame:
    """Patches without a finished prediction."""
    return patches.join(done.select("volume_id", "patch_index").distinct(), ["volume_id", "patch_index"], "left_anti")


def low_point_patches(patches: DataFrame, patch_labels: DataFrame, minimum: int = 10) -> DataFrame:
    """Patches with fewer than ``minimum`` labels, patches without labels included."""
    counted = (patch_labels.where("local_label > 0").select("volume_id", "patch_index", "local_label").distinct()
               .groupBy("volume_id", "patch_index").agg(F.count("*").alias("point_count")))
    joined = patches.join(counted, ["volume_id", "patch_index"], "left")
    return (joined.withColumn("point_count", F.coalesce("point_count", F.lit(0)))
            .where(F.col("point_count") < minimum).select("volume_id", "patch_index", "point_count"))


# --- matching ----------------------------------------------------------------------------------

PAIR = ["volume_id", "patch_a", "patch_b"]


def overlap_pairs(patch_labels: DataFrame) -> DataFrame:
    """Labels of two patches on the same voxel, the later patch first."""
    a = patch_labels.select(*KEY, F.col("patch_index").alias("patch_a"), F.col("local_label").alias("label_a"))
    b = patch_labels.select(*KEY, F.col("patch_index").alias("patch_b"), F.col("local_label").alias("label_b"))
    return a.join(b, KEY).where("patch_a > patch_b")


def label_overlap(patch_labels: DataFrame, patches: DataFrame, min_voxels: int = 10, min_share: float = 0.3) -> DataFrame:
    """Candidate label matches: intersection over the smaller label, sizes counted inside the overlap of the two patches.

    The labels of a voxel, one per patch over it, meet in the block join already, so intersections and sizes come from
    one pass: each label of a voxel counts once for every other box there, and once for every label of that patch.
    """
    labels = patch_labels.where("local_label > 0").select(*KEY, F.struct(F.col("patch_index").alias("patch"), F.col("local_label").alias("label")).alias("own"))
    voxels = with_boxes(labels, patches).where(F.size("boxes") > 1).groupBy("volume_id", *BLOCK, "i", "j", "k").agg(F.collect_list("own").alias("cells"), F.first("boxes").alias("boxes"))
    count = lambda own, other, label: F.struct(own["patch"].alias("patch_a"), other.alias("patch_b"), own["label"].alias("label_a"), label.alias("label_b"))
    nothing = F.lit(None).cast(patch_labels.schema["local_label"].dataType)
    sizes_of = F.flatten(F.transform("cells", lambda c: F.transform(F.filter("boxes", lambda b: b["patch_index"] != c["patch"]), lambda b: count(c, b["patch_index"], nothing))))
    meets_of = F.flatten(F.transform("cells", lambda c: F.transform(F.filter("cells", lambda d: d["patch"] < c["patch"]), lambda d: count(c, d["patch"], d["label"]))))
    counted = cut_lineage(voxels.select("volume_id", F.explode(F.concat(sizes_of, meets_of)).alias("m")).select("volume_id", "m.*")
                          .groupBy(*PAIR, "label_a", "label_b").agg(F.count("*").alias("n")))  # one row per pair of labels that meet
    inter = counted.where("label_b IS NOT NULL").where(F.col("n") >= min_voxels).withColumnRenamed("n", "intersection")
    sizes = counted.where("label_b IS NULL")
    size_a = sizes.select(*PAIR, "label_a", F.col("n").alias("size_a"))
    size_b = sizes.select("volume_id", F.col("patch_a").alias("patch_b"), F.col("patch_b").alias("patch_a"), F.col("label_a").alias("label_b"), F.col("n").alias("size_b"))
    joined = inter.join(size_a, [*PAIR, "label_a"]).join(size_b, [*PAIR, "label_b"])
    return (joined.withColumn("iomin", F.col("intersection") / F.least("size_a", "size_b"))
            .where(F.col("iomin") >= min_share)
            .select(*PAIR, "label_a", "label_b", "intersection", "iomin"))


def greedy_match(candidates: DataFrame) -> DataFrame:
    """One-to-one matching per patch pair in descending (iomin, intersection, label_a, label_b) order.

    Under a strict order a pair that is the best of both its labels is always taken by
    the sequential greedy, so rounds of mutual-best pairs give the same result.  The
    windows span the candidates of one label in one patch overlap; each round is stored once.
    """
    score = F.struct("iomin", "intersection", "label_a", "label_b")
    of_a, of_b = (Window.partitionBy(*PAIR, side) for side in ("label_a", "label_b"))
    rest, taken = candidates, None
    while True:  # the best remaining pair is taken in every round
        judged = rest.withColumn("_b", F.max(score).over(of_b)).withColumn("_best", (score == F.max(score).over(of_a)) & (score == F.col("_b")))
        judged = cut_lineage(judged.withColumn("_gone", F.max("_best").over(of_a)).withColumn("_gone", F.col("_gone") | F.max("_best").over(of_b)).drop("_b"))
        best = judged.where("_best").drop("_best", "_gone")
        taken = best if taken is None else taken.unionByName(best)
        rest = judged.where("NOT _gone").drop("_best", "_gone")
        if rest.isEmpty():
            return taken


def _node(patch: str, label: str):
    """One number for (patch, label); ids of 2^31 and more, or labels of 2^32 and more, are an error."""
    fits = F.col(patch).between(0, (1 << 31) - 1) & F.col(label).between(0, (1 << 32) - 1)
    return F.when(fits, F.shiftleft(F.col(patch).cast("long"), 32) + F.col(label)).otherwise(
        F.raise_error(F.lit("patch index or label out of range")).cast("long"))


def merge_patch_components(patch_labels: DataFrame, matches: DataFrame) -> DataFrame:
    """(volume, patch, local label) → global id 1..n; matched labels share one id.

    Labels are 32-bit, so (patch, label) packs into one node number; ids follow the
    smallest node of each component.
    """
    nodes = (patch_labels.where("local_label > 0").select("volume_id", "patch_index", "local_label").distinct()
             .withColumn("node", _node("patch_index", "local_label")))
    edges = matches.select("volume_id", _node("patch_a", "label_a").alias("u"), _node("patch_b", "label_b").alias("v"))
    rooted = cut_lineage(component_roots(nodes, edges))  # one row per label of a patch, read for the ids and for the map
    ids = dense_ids(rooted, ["volume_id"], "root", into="global_component_id")
    return rooted.join(ids, ["volume_id", "root"]).select("volume_id", "patch_index", "local_label", "global_component_id")


# --- ownership ---------------------------------------------------------------------------------

def owner_intervals(patches: DataFrame, sizes: DataFrame, axis: str) -> DataFrame:
    """Per volume and start of one axis the half-open interval that this start owns.

    Boundaries lie midway between the centres of neighbouring starts.  Windows run over
    the distinct starts of one axis of one volume.
    """
    start, end = f"{axis}0", f"{axis}1"
    starts = patches.groupBy("volume_id", start).agg(F.max_by(F.col(end) - F.col(start), "patch_index").alias("size"))
    starts = starts.join(sizes.select("volume_id", F.col(f"n{axis}").alias("full")), "volume_id")
    line = Window.partitionBy("volume_id").orderBy(start)
    centre = 0.5 * (F.col(start) + F.least(F.col(start) + F.col("size"), F.col("full")) - 1)
    starts = starts.withColumn("centre", centre)
    low = F.coalesce(F.floor(0.5 * (F.lag("centre").over(line) + F.col("centre"))) + 1, F.lit(0))
    high = F.coalesce(F.floor(0.5 * (F.col("centre") + F.lead("centre").over(line))) + 1, F.col("full"))
    return starts.select("volume_id", start, low.cast("long").alias(f"own_{axis}0"), high.cast("long").alias(f"own_{axis}1"))


def owned_boxes(patches: DataFrame, sizes: DataFrame) -> DataFrame:
    """Patches with the part of their box that they own."""
    out = patches
    for axis in "xyz":
        out = out.join(owner_intervals(patches, sizes, axis), ["volume_id", f"{axis}0"])
    for axis in "xyz":
        out = out.withColumns({f"own_{axis}0": F.greatest(f"own_{axis}0", f"{axis}0"),
                               f"own_{axis}1": F.least(f"own_{axis}1", f"{axis}1")})
    return out


def owned_labels(patch_labels: DataFrame, owned: DataFrame) -> DataFrame:
    """Label voxels that lie in the owned part of their own patch."""
    bounds = owned.select("volume_id", "patch_index", *[f"own_{a}{n}" for a in "xyz" for n in (0, 1)])
    joined = patch_labels.join(bounds, ["volume_id", "patch_index"])
    for index, axis in BOX_AXES:
        joined = joined.where((F.col(index) >= F.col(f"own_{axis}0")) & (F.col(index) < F.col(f"own_{axis}1")))
    return joined.select(*patch_labels.columns)


def to_global_labels(patch_labels: DataFrame, component_map: DataFrame) -> DataFrame:
    return patch_labels.join(component_map, ["volume_id", "patch_index", "local_label"])


def owned_region(owned: DataFrame) -> DataFrame:
    """All voxels of the owned boxes."""
    span = lambda a: F.explode(F.sequence(F.col(f"own_{a}0"), F.col(f"own_{a}1") - 1))
    kept = owned.where("own_x1 > own_x0 and own_y1 > own_y0 and own_z1 > own_z0")
    return (kept.select("volume_id", "patch_index", "own_y0", "own_y1", "own_z0", "own_z1", span("x").alias("i"))
            .select("volume_id", "patch_index", "i", "own_z0", "own_z1", span("y").alias("j"))
            .select("volume_id", "patch_index", "i", "j", span("z").alias("k")))


def low_point_region(patches: DataFrame, patch_labels: DataFrame, sizes: DataFrame, minimum: int = 10) -> DataFrame:
    """Voxels owned by patches with fewer than ``minimum`` labels."""
    low = low_point_patches(patches, patch_labels, minimum).select("volume_id", "patch_index")
    return owned_region(owned_boxes(patches, sizes).join(low, ["volume_id", "patch_index"], "left_semi")).select(*KEY)
