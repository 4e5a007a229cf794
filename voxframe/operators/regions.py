"""Segmentation steps: foreground masks, markers, watershed and region growing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..grid import Grid, attach_grid
from ..session import cut_lineage
from . import components as cc, lines
from .aggregate import normalize_minmax, otsu
from .filters import mask_and, require_nonempty
from .morphology import FACE_OFFSETS, closing, dilate_box, erode_box, gaussian, gaussian_kernel, send
from .ranking import dense_relabel

KEY = ["volume_id", "i", "j", "k"]


def above_otsu(image: DataFrame, bins: int = 256) -> DataFrame:
    limits = otsu(image, bins=bins)
    return image.join(limits, "volume_id").where("value > threshold").select(*KEY)


def below_otsu_inside(image: DataFrame, mask: DataFrame, bins: int = 256) -> DataFrame:
    """Mask pixels darker than the threshold of the values inside the mask."""
    inside = image.join(mask.select(*KEY), KEY, "left_semi")
    return inside.join(otsu(inside, bins=bins), "volume_id").where("value < threshold").select(*KEY)


def disk_mask(image: DataFrame, grid: Grid | DataFrame, size: int = 15) -> DataFrame:
    """The large bright disc: threshold, largest component, fill, dilate, fill, erode."""
    largest = cc.largest_component(above_otsu(image), grid)
    filled = cc.fill_holes(largest, grid)
    wide = cc.fill_holes(dilate_box(filled, grid, (size, size, 1)), grid)
    return erode_box(wide, (size, size, 1))


def dot_mask(image: DataFrame, disk: DataFrame, grid: Grid | DataFrame, minimum: int = 2) -> DataFrame:
    return cc.remove_small(below_otsu_inside(image, disk), grid, minimum)


def label_foreground_fallback(image: DataFrame, minimum: int = 20, bins: int = 128) -> DataFrame:
    """Otsu foreground, or the positive voxels where it has too few; still too few is an error."""
    marked = image.join(otsu(image, bins=bins), "volume_id", "left").withColumn("_bright", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)))
    sizes = marked.groupBy("volume_id").agg(F.count_if("_bright").alias("_n"), F.count_if(F.col("value") > 0).alias("_p"))
    use = F.when(F.col("_n") >= minimum, F.col("_bright")).when(F.col("_p") >= minimum, F.col("value") > 0).otherwise(
        F.raise_error(F.lit("no foreground")).cast("boolean"))
    return marked.join(sizes, "volume_id").where(use).select(*KEY)


def segment_foreground(image: DataFrame, grid: Grid | DataFrame, sigma: float = 1.0, threshold: float | None = None,
                       minimum: int = 8, radius: int = 1, dims: int = 2) -> DataFrame:
    """Normalise, smooth, threshold, drop small parts, close, fill, keep the largest component."""
    smooth = gaussian(normalize_minmax(image, strict=True), grid, sigma, "ijk"[:dims])
    mask = above_otsu(smooth) if threshold is None else smooth.where(F.col("value") > threshold).select(*KEY)
    kept = cc.remove_small(mask, grid, minimum, dims)
    return cc.largest_component(cc.fill_holes(closing(kept, grid, radius, dims), grid, dims), grid, dims, False)


def seeds_in_mask(seeds: DataFrame, mask: DataFrame) -> DataFrame:
    """Seeds inside the mask; none at all is an error."""
    return require_nonempty(seeds.join(mask.select(*KEY), KEY, "left_semi"), "the seeds inside the mask")


def prepare_markers(markers: DataFrame, mask: DataFrame, grid: Grid | DataFrame, relabel: bool = True) -> DataFrame:
    """Marker labels inside the mask.

    Volumes whose markers carry a single label are component-labelled, others keep
    their labels; either way labels become dense on request.
    """
    inside = markers.join(mask.select(*KEY), KEY, "left_semi").where("label > 0")
    spread = inside.groupBy("volume_id").agg((F.min("label") == F.max("label")).alias("_binary"))
    flagged = inside.join(spread, "volume_id")
    parts = cc.connected_components(flagged.where("_binary").select(*KEY), grid)
    out = flagged.where("not _binary").select(*KEY, "label").unionByName(parts.select(*KEY, "label"))
    return dense_relabel(out).select(*KEY, "label") if relabel else out


def seeded_watershed(relief: DataFrame, markers: DataFrame, dims: int = 2) -> DataFrame:
    """Flood ``relief`` (voxels with ``value``; absent voxels are walls) from the markers through faces.

    A voxel joins the neighbour that the flood reaches first.  Arrival order is
    (highest level on the way, steps since that level was reached, label), which does
    not depend on row order; every round recomputes arrivals from the neighbours by one
    aggregation until nothing changes, so no task ever holds a whole region.
    """
    offsets = FACE_OFFSETS[:2 * dims]
    field = cut_lineage(relief.select(*KEY, "value"))
    start = field.join(markers.where("label > 0").select(*KEY, "label"), KEY).select(
        *KEY, F.struct(F.col("value").alias("level"), F.lit(0).cast("long").alias("steps"), F.col("label").alias("label")).alias("a"))
    start = cut_lineage(start)
    state, seen = start, None
    fixed = start.select(*KEY)
    while True:  # arrivals only get earlier, so this ends
        first = send(state, offsets, ["a"]).groupBy(*KEY).agg(F.min("a").alias("b"))
        reached = field.join(first, KEY).join(fixed, KEY, "left_anti")
        rises = F.col("value") > F.col("b.level")
        arrival = F.struct(F.when(rises, F.col("value")).otherwise(F.col("b.level")).alias("level"),
                           F.when(rises, F.lit(0)).otherwise(F.col("b.steps") + 1).cast("long").alias("steps"),
                           F.col("b.label").alias("label"))
        state = cut_lineage(reached.select(*KEY, arrival.alias("a")).unionByName(start))
        mark = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64(*KEY, "a.level", "a.steps", "a.label")),
                               F.sum(F.xxhash64(*KEY, "a.level", "a.steps", "a.label").cast("decimal(38,0)"))).first())
        if mark == seen:
            return state.select(*KEY, F.col("a.label").alias("label"))
        seen = mark


def limited_relief(mask: DataFrame, markers: DataFrame, grid: Grid | DataFrame, limit: float, dims: int = 2) -> DataFrame:
    """Negative distance inside the mask, restricted to voxels within ``limit`` of a marker."""
    from .distance import distance_transform, distance_within

    depth = distance_transform(mask, grid, dims)
    near = distance_within(markers, grid, limit).select(*KEY)
    return depth.join(near, KEY, "left_semi").select(*KEY, (-F.coalesce("distance", F.lit(0.0))).alias("value"))


# --- region growing ------------------------------------------------------------------------------

def _spread(pixels: list[tuple], tolerance: float) -> list[int]:
    """Rows of one marker's window (i, j, value, own, usable) that its growing region takes, when the region's mean moves.

    Works ring by ring: the candidates of a ring are the open neighbours of the last ring in the order in which
    that ring took its members, and each is measured against the mean of all members so far.
    """
    rows = {(i, j): row for row, (i, j, *_) in enumerate(pixels)}
    members = [row for row, pixel in enumerate(pixels) if pixel[3]]
    taken, offered = set(members), set(members)
    weight, mass = len(members), float(np.sum([pixels[row][2] for row in members]))
    ring = sorted(members, key=lambda row: pixels[row][:2])
    while ring:
        beside = []
        for row in ring:
            i, j, value, _, usable = pixels[row]
            if usable and abs(value - mass / weight) <= tolerance:
                beside += [(i - 1, j - 1), (i - 1, j), (i - 1, j + 1), (i, j - 1), (i, j + 1), (i + 1, j - 1), (i + 1, j), (i + 1, j + 1)]
                if row not in taken:
                    taken.add(row)
                    weight, mass = weight + 1, mass + value
        ring = []
        for place in beside:
            row = rows.get(place)
            if row is not None and row not in offered:
                offered.add(row)
                ring.append(row)
    return sorted(taken)


def _spread_claims(free: DataFrame, tolerance: float) -> DataFrame:
    """With a moving mean: the pixels of every marker's region. A task meets one window after the other, in sorted batches."""
    columns = ["volume_id", "label", "i", "j", "value", "own", "usable", "k"]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, out = None, [], []

        def taken() -> None:
            pixels = [row[2:7] for row in held]
            out.extend((here[0], *held[row][2:4], held[row][7], here[1]) for row in _spread(pixels, tolerance))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != here:
                    taken()
                    here, held = row[:2], []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[*KEY, "label"])
                out.clear()
        taken()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[*KEY, "label"])

    windows = free.select(*columns).repartition("volume_id", "label").sortWithinPartitions("volume_id", "label", "i", "j")
    return windows.mapInArrow(grow, "volume_id long, i long, j long, k long, label long")


def _connected_claims(free: DataFrame, tolerance: float) -> DataFrame:
    """With the mean of the marker fixed: its own pixels, and the components of similar usable pixels that hold one of them."""
    mean = free.where("own").groupBy("volume_id", "label").agg(F.avg("value").alias("mean"))
    similar = cut_lineage(free.where("usable").join(mean, ["volume_id", "label"]).where(F.abs(F.col("value") - F.col("mean")) <= tolerance)
                          .select(*KEY, "label", "own"))
    place = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    here = similar.select("volume_id", "label", "k", "i", "j", place(F.col("i"), F.col("j")).alias("u"))
    half = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    moved = here.select("volume_id", "label", "k", F.col("u").alias("v"), F.explode(half).alias("o"), "i", "j").select(
        "volume_id", "label", "k", "v", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"))
    edges = here.join(moved, ["volume_id", "label", "k", "i", "j"]).select("volume_id", "label", "k", "u", "v")
    keys = ["volume_id", "label", "k"]
    rooted = cc.component_roots(similar.select(*keys, "i", "j", "own", place(F.col("i"), F.col("j")).alias("node")), edges, keys)
    seeded = rooted.where("own").select(*keys, "root").distinct()
    grown = rooted.join(seeded, [*keys, "root"], "left_semi").select(*KEY, "label")
    return grown.unionByName(free.where("own").select(*KEY, "label")).distinct()


def region_grow(image: DataFrame, markers: DataFrame, mask: DataFrame, grid: Grid | DataFrame, tolerance: float, radius: int,
                running_mean: bool = True) -> DataFrame:
    """Grow markers in ascending label order over similar mask pixels within ``radius`` of their centre.

    A marker only ever sees its own disc of pixels, so each group is bounded.  The sequential rule (lower labels
    take pixels first) is the fixed point of: grow every marker around the pixels that lower labels hold, then
    give each pixel to its lowest claimant.  By induction over the labels the rounds end with the sequential
    result.  Only markers whose window changed hands in the last round grow again.
    """
    seeds = markers.where("label > 0").select(*KEY, "label")
    centres = seeds.groupBy("volume_id", "label", "k").agg(F.rint(F.avg("i")).cast("long").alias("ci"), F.rint(F.avg("j")).cast("long").alias("cj"))
    disc = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(-radius, radius + 1)
                     for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius])
    reach = centres.select("volume_id", "label", "k", F.explode(disc).alias("o"), "ci", "cj").select(
        "volume_id", "label", (F.col("ci") + F.col("o.di")).alias("i"), (F.col("cj") + F.col("o.dj")).alias("j"), "k")
    taken = seeds.select(*KEY, F.col("label").alias("marker"))
    # pixels of the disc that are in the mask, plus the marker's own pixels wherever they lie
    near = reach.join(mask.select(*KEY).withColumn("usable", F.lit(True)), KEY).join(taken, KEY, "left")
    near = near.where("marker is null or marker = label").select(*KEY, "label", "usable")
    both = near.join(seeds.withColumn("own", F.lit(True)), [*KEY, "label"], "full")
    window = cut_lineage(both.join(image.select(*KEY, "value"), KEY, "left").select(
        *KEY, "label", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("usable", "own")], F.coalesce("value", F.lit(0.0)).alias("value")))

    def claimed(free: DataFrame) -> DataFrame:
        if not running_mean:
            return _connected_claims(free, tolerance)
        return _spread_claims(free, tolerance)

    claims = cut_lineage(claimed(window))
    owner = cut_lineage(claims.groupBy(*KEY).agg(F.min("label").alias("label")))
    before = None
    while True:  # markers settle in label order, at least one more in each round
        held = owner.select(*KEY, F.col("label").alias("holder"))
        changed = held if before is None else held.join(before, [*KEY, "holder"], "left_anti").unionByName(before.join(held, [*KEY, "holder"], "left_anti"))
        again = cut_lineage(window.join(changed.select(*KEY).distinct(), KEY, "left_semi").select("volume_id", "label").distinct())
        if again.isEmpty():
            return owner
        free = (window.join(again, ["volume_id", "label"], "left_semi").join(held, KEY, "left")
                .where("own or holder is null or holder >= label").drop("holder"))
        claims = cut_lineage(claims.join(again, ["volume_id", "label"], "left_anti").unionByName(claimed(free)))
        before, owner = held, cut_lineage(claims.groupBy(*KEY).agg(F.min("label").alias("label")))


# --- blobs -----------------------------------------------------------------------------------------

def blob_sigmas(diameter_um: float, spacing_um: float, count: int = 15) -> list[float]:
    """Evenly spaced scales around the expected one, from 0.8 to 1.2 times."""
    expected = diameter_um / spacing_um / 2.0 / math.sqrt(2.0)
    return np.linspace(0.8 * expected, 1.2 * expected, count).tolist()


def log_peaks(image: DataFrame, grid: Grid | DataFrame, sigmas: list[float], threshold: float) -> DataFrame:
    """Maxima over (i, j, scale number ``k``) of the scale-normalised negative Laplacian of Gaussian of flat images.

    Three passes over grid lines: both kernels of all scales along ``i``; the response along ``j``, with the highest of
    its neighbours there and in scale; the neighbours along ``i``. A pixel moves once per pass, with all its scales.
    """
    flat, curved = ([[w for _, w in gaussian_kernel(s, order)] for s in sigmas] for order in (0, 2))
    count, key = len(sigmas), "volume_id long, i long, j long, k long"
    schema = lambda *names: ", ".join([key, *(f"{c} double" for name in names for c in lines.scale_names(name, count))])
    sized = attach_grid(image.where("value IS NOT NULL"), grid, "g_")
    sized = sized.select("volume_id", "i", "j", F.lit(0).cast("long").alias("k"), F.col("value").cast("double").alias("value"), F.col("g_nx").alias("n"))
    first = lines.along_lines(sized, "i", lines.log_first(flat, curved), schema("flat", "curved"))
    first = attach_grid(first, grid, "g_").select(*first.columns, F.col("g_ny").alias("n"))
    second = lines.along_lines(first, "j", lines.log_second(flat, curved, [-s * s for s in sigmas]), schema("v", "m"))
    return lines.along_lines(second, "i", lines.log_peaks(count, threshold), f"{key}, value double")


def log_blobs(image: DataFrame, grid: Grid | DataFrame, sigmas: list[float], threshold: float = 0.02, overlap: float = 0.5) -> DataFrame:
    """Scale-normalised Laplacian-of-Gaussian maxima over (i, j, σ) above a threshold of 0 or more; of two blobs that
    overlap more than ``overlap`` the smaller one goes.

    Pruning is an equi-join on the cells of a spatial hash.
    """
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    peaks = log_peaks(image, grid, sigmas, threshold)
    scale = F.array(*[F.lit(float(s)) for s in sigmas])
    blobs = cut_lineage(peaks.select("volume_id", "i", "j", F.element_at(scale, (F.col("k") + 1).cast("int")).alias("sigma"), "value"))
    return prune_blobs(blobs, max(sigmas), overlap)


def _disc_overlap(d, r1, r2):
    """Area shared by two discs over the area of the smaller one."""
    small, big = F.least(r1, r2), F.greatest(r1, r2)
    a = F.acos(F.greatest(F.least((d * d + r1 * r1 - r2 * r2) / (2 * d * r1), F.lit(1.0)), F.lit(-1.0)))
    b = F.acos(F.greatest(F.least((d * d + r2 * r2 - r1 * r1) / (2 * d * r2), F.lit(1.0)), F.lit(-1.0)))
    s = (-d + r2 + r1) * (d - r2 + r1) * (d + r2 - r1) * (d + r2 + r1)
    area = r1 * r1 * a + r2 * r2 * b - 0.5 * F.sqrt(F.abs(s))
    share = area / (F.pi() * small * small)
    return F.when(d >= r1 + r2, F.lit(0.0)).when(d <= big - small, F.lit(1.0)).otherwise(share)


def prune_blobs(blobs: DataFrame, largest_sigma: float, overlap: float = 0.5) -> DataFrame:
    """Drop every blob that overlaps a larger surviving one too much (the later one when equal).

    Partners are found in the 3×3 cells of a spatial hash whose cells are as wide as the largest possible
    distance of two overlapping blobs. Blobs are settled from the largest down: in each round those without an
    unsettled larger partner stay, and their smaller partners go, so a dropped blob drops no other.
    """
    width = 2.0 * math.sqrt(2.0) * largest_sigma
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    a = blobs.select("volume_id", "i", "j", "sigma", cell("i").alias("gi"), cell("j").alias("gj"))
    hood = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    b = a.select("volume_id", F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("sigma").alias("bs"), "gi", "gj", F.explode(hood).alias("h"))
    b = b.select("volume_id", "bi", "bj", "bs", (F.col("gi") + F.col("h.x")).alias("gi"), (F.col("gj") + F.col("h.y")).alias("gj"))
    pairs = a.join(b, ["volume_id", "gi", "gj"]).where("not (i = bi and j = bj and sigma = bs)")
    root2 = math.sqrt(2.0)
    d = F.sqrt((F.col("i") - F.col("bi")) ** 2 + (F.col("j") - F.col("bj")) ** 2)
    share = _disc_overlap(d, F.col("sigma") * root2, F.col("bs") * root2)
    loses = (F.col("sigma") < F.col("bs")) | ((F.col("sigma") == F.col("bs")) & (F.struct("i", "j") > F.struct("bi", "bj")))
    small, large = ["volume_id", "i", "j", "sigma"], ["volume_id", "bi", "bj", "bs"]
    as_small = lambda df: df.select("volume_id", F.col("bi").alias("i"), F.col("bj").alias("j"), F.col("bs").alias("sigma"))
    rivals = cut_lineage(pairs.where((share > overlap) & loses).select(*small, "bi", "bj", "bs").distinct())
    lost = rivals.select(*small).limit(0)
    while not rivals.isEmpty():  # the largest unsettled blob settles in every round
        settled = as_small(rivals).distinct().join(rivals.select(*small), small, "left_anti")
        at = settled.select("volume_id", F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("sigma").alias("bs"))
        gone = cut_lineage(rivals.join(at, large, "left_semi").select(*small).distinct())
        lost = lost.unionByName(gone)
        gone_large = gone.select("volume_id", F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("sigma").alias("bs"))
        rivals = cut_lineage(rivals.join(gone, small, "left_anti").join(gone_large, large, "left_anti"))
    return blobs.join(lost, small, "left_anti")


def blob_markers(blobs: DataFrame, disk: DataFrame, dots: DataFrame) -> DataFrame:
    """Blobs whose rounded centre lies in both masks, numbered, with radius √2·σ."""
    from .ranking import dense_ids

    rounded = blobs.select("volume_id", F.rint("i").cast("long").alias("i"), F.rint("j").cast("long").alias("j"),
                           F.lit(0).cast("long").alias("k"), "sigma", "value")
    kept = rounded.join(mask_and(disk, dots), KEY, "left_semi").groupBy(*KEY).agg(F.max("sigma").alias("sigma"))
    ranked = kept.withColumn("_order", F.struct("i", "j"))
    ids = dense_ids(ranked, ["volume_id"], "_order", into="label")
    return ranked.join(ids, ["volume_id", "_order"]).drop("_order").withColumns({
        "radius_px": F.col("sigma") * math.sqrt(2.0), "diameter_px": F.col("sigma") * 2 * math.sqrt(2.0)})
