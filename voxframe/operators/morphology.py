"""Binary morphology on run tables and small-neighbourhood filters.

Masks are handled as runs per grid line.  A structuring element is a list of spans
``(dj, dk, lo, hi)``: offsets lo..hi along ``i`` on a neighbouring line.  A dilation
copies every run once per span, widened; an erosion copies it once per span, narrowed,
and keeps what all spans cover.  Both finish with one sweep over the run ends of each
line, so the work grows with runs times spans instead of voxels times neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..grid import Grid, attach_grid
from ..session import cut_lineage
from .components import expand_runs, line_runs
from .filters import require_nonempty
from .lines import along_lines, convolution

KEY = ["volume_id", "i", "j", "k"]
Span = tuple[int, int, int, int]


def box_spans(size: Sequence[int]) -> list[Span]:
    """Ones of the given size; an even size reaches one further towards lower indices."""
    low = [-(n // 2) for n in size]
    high = [n - 1 - n // 2 for n in size]
    return [(dj, dk, low[0], high[0]) for dj in range(low[1], high[1] + 1) for dk in range(low[2], high[2] + 1)]


def ball_spans(radius: int, dims: int = 3) -> list[Span]:
    """Offsets with ``dx²+dy²+dz² <= r²``."""
    spans = []
    for dj in range(-radius, radius + 1):
        for dk in range(-radius, radius + 1) if dims == 3 else (0,):
            rest = radius * radius - dj * dj - dk * dk
            if rest >= 0:
                reach = math.isqrt(rest)
                spans.append((dj, dk, -reach, reach))
    return spans


def _span_table(spans: Sequence[Span]) -> Column:
    names = ("dj", "dk", "lo", "hi")
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(span, names)]) for span in spans])


def sweep(runs: DataFrame, need: int | Column, grid: Grid | DataFrame | None = None) -> DataFrame:
    """Runs of the positions that at least ``need`` of the given (overlapping) runs cover.

    ``need`` may depend on the line (``j``, ``k``) and, where ``grid`` is given, on its sizes (``g_ny``, ``g_nz``).
    """
    ends = F.array(F.struct(F.col("i0").alias("at"), F.lit(1).alias("step")),
                   F.struct((F.col("i1") + 1).alias("at"), F.lit(-1).alias("step")))
    events = (runs.select("volume_id", "j", "k", F.explode(ends).alias("e"))
              .groupBy("volume_id", "j", "k", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step")).where("step <> 0"))
    if grid is not None:
        events = attach_grid(events, grid, "g_")
    line = Window.partitionBy("volume_id", "j", "k").orderBy("at")
    level = F.sum("step").over(line.rowsBetween(Window.unboundedPreceding, 0)) >= need
    flagged = events.withColumn("on", level)
    turns = flagged.where(F.lit(True)).withColumn("before", F.coalesce(F.lag("on").over(line), F.lit(False))).where("on <> before")
    closed = turns.withColumn("next", F.lead("at").over(line))
    return closed.where("on").select("volume_id", "j", "k", F.col("at").alias("i0"), (F.col("next") - 1).alias("i1"))


def dilate_runs(runs: DataFrame, grid: Grid | DataFrame, spans: Sequence[Span]) -> DataFrame:
    """A set voxel ``p`` sets ``p - o`` for every offset ``o`` of the element; clipped to the grid."""
    copies = attach_grid(runs.select("*", F.explode(_span_table(spans)).alias("s")), grid, "g_")
    moved = copies.select(
        "volume_id", (F.col("j") - F.col("s.dj")).alias("j"), (F.col("k") - F.col("s.dk")).alias("k"),
        F.greatest(F.col("i0") - F.col("s.hi"), F.lit(0)).alias("i0"),
        F.least(F.col("i1") - F.col("s.lo"), F.col("g_nx") - 1).alias("i1"), "g_ny", "g_nz")
    inside = moved.where("j >= 0 and j < g_ny and k >= 0 and k < g_nz and i0 <= i1")
    return sweep(inside, 1)


def erode_runs(runs: DataFrame, spans: Sequence[Span], grid: Grid | DataFrame | None = None) -> DataFrame:
    """A voxel stays when the element placed on it lies inside the mask.

    Outside the grid counts as empty; with ``grid`` it counts as set: runs that touch the border go on beyond
    it, and spans on lines outside the grid are not asked for.
    """
    if grid is not None:
        reach = max(max(abs(lo), abs(hi)) for _, _, lo, hi in spans)
        sized = attach_grid(runs, grid, "g_")
        runs = sized.withColumn("i0", F.when(F.col("i0") == 0, -reach).otherwise(F.col("i0"))).withColumn(
            "i1", F.when(F.col("i1") == F.col("g_nx") - 1, F.col("i1") + reach).otherwise(F.col("i1")))
    copies = runs.select("*", F.explode(_span_table(spans)).alias("s"))
    moved = copies.select(
        "volume_id", (F.col("j") - F.col("s.dj")).alias("j"), (F.col("k") - F.col("s.dk")).alias("k"),
        (F.col("i0") - F.col("s.lo")).alias("i0"), (F.col("i1") - F.col("s.hi")).alias("i1"),
        *([] if grid is None else ["g_nx", "g_ny", "g_nz"])).where("i0 <= i1")
    if grid is None:
        return sweep(moved, len(spans))
    moved = moved.withColumn("i0", F.greatest(F.col("i0"), F.lit(0))).withColumn("i1", F.least(F.col("i1"), F.col("g_nx") - 1))
    moved = moved.where("j >= 0 and j < g_ny and k >= 0 and k < g_nz and i0 <= i1")
    asked = F.size(F.filter(_span_table(spans), lambda s: (F.col("j") + s["dj"] >= 0) & (F.col("j") + s["dj"] < F.col("g_ny"))
                            & (F.col("k") + s["dk"] >= 0) & (F.col("k") + s["dk"] < F.col("g_nz"))))
    return sweep(moved.drop("g_nx", "g_ny", "g_nz"), asked, grid)


def _mirrored(spans: Sequence[Span]) -> list[Span]:
    return [(-dj, -dk, -hi, -lo) for dj, dk, lo, hi in spans]


def dilate(mask: DataFrame, grid: Grid | DataFrame, spans: Sequence[Span]) -> DataFrame:
    return expand_runs(dilate_runs(line_runs(mask), grid, spans))


def erode(mask: DataFrame, spans: Sequence[Span]) -> DataFrame:
    return expand_runs(erode_runs(line_runs(mask), spans))


def dilate_box(mask: DataFrame, grid: Grid | DataFrame, size: Sequence[int]) -> DataFrame:
    return dilate(mask, grid, _mirrored(box_spans(size)))


def erode_box(mask: DataFrame, size: Sequence[int]) -> DataFrame:
    return erode(mask, box_spans(size))


def erode_iter(mask: DataFrame, iterations: int, dims: int = 3) -> DataFrame:
    """``iterations`` erosions by 3-wide ones equal one erosion by a box of radius ``iterations``.

    It is an error if nothing is left of any volume; ``emptied_volumes`` names those of a batch of which nothing is left.
    """
    side = 2 * iterations + 1
    return require_nonempty(cut_lineage(erode_box(mask, (side, side, side if dims == 3 else 1))), "the eroded mask")


def emptied_volumes(mask: DataFrame, core: DataFrame) -> DataFrame:
    return mask.select("volume_id").distinct().join(core.select("volume_id").distinct(), "volume_id", "left_anti")


def dilate_ball(mask: DataFrame, grid: Grid | DataFrame, radius: int, dims: int = 3) -> DataFrame:
    return dilate(mask, grid, ball_spans(radius, dims))


def erode_ball(mask: DataFrame, radius: int, dims: int = 3) -> DataFrame:
    return erode(mask, ball_spans(radius, dims))


def closing(mask: DataFrame, grid: Grid | DataFrame, radius: int, dims: int = 3) -> DataFrame:
    """Dilation then erosion by a ball, staying in run form between the two.

    Outside the grid counts as set for the erosion, so a closing never removes a mask voxel.
    """
    spans = ball_spans(radius, dims)
    return expand_runs(erode_runs(dilate_runs(line_runs(mask), grid, spans), spans, grid))


def boundary(mask: DataFrame, grid: Grid | DataFrame, radius: int, dims: int = 3) -> DataFrame:
    """Mask voxels that an erosion with a set outside removes; the whole mask for a radius of 0 or less."""
    if radius <= 0:
        return mask.select(*KEY)
    core = expand_runs(erode_runs(line_runs(mask), ball_spans(radius, dims), grid))
    return mask.select(*KEY).join(core, KEY, "left_anti")


# --- neighbourhood filters -----------------------------------------------------------------------

FACE_OFFSETS = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def offset_table(offsets: Sequence[tuple], names=("di", "dj", "dk")) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in offsets])


def send(df: DataFrame, offsets: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Every row once per offset, moved by it."""
    moved = df.select(*KEY, *columns, F.explode(offset_table(offsets)).alias("o"))
    return moved.select("volume_id", *[(F.col(c) + F.col(f"o.d{c}")).cast("long").alias(c) for c in "ijk"], *columns)


def label_edges(labels: DataFrame, grid: Grid | DataFrame, thicken: bool = True) -> DataFrame:
    """Label pixels with a differing 4-neighbour inside the grid, thickened by 2×2 and kept on labels."""
    same = (send(labels, FACE_OFFSETS[:4], ["label"]).groupBy(*KEY, "label").agg(F.count("*").alias("same")))
    df = attach_grid(labels.select(*KEY, "label").join(same, [*KEY, "label"], "left"), grid, "g_")
    inside = sum(((c.cast("int")) for c in (F.col("i") > 0, F.col("i") < F.col("g_nx") - 1, F.col("j") > 0,
                                            F.col("j") < F.col("g_ny") - 1)), F.lit(0))
    edges = df.where(F.coalesce("same", F.lit(0)) < inside).select(*KEY)
    if not thicken:
        return edges
    return dilate_box(edges, grid, (2, 2, 1)).join(labels.select(*KEY), KEY, "left_semi")


def reflected(position: str, n: Column, radius: int) -> Column:
    """All positions from ``-radius`` to ``n - 1 + radius`` that a mirrored border maps to the voxel: ``2mn + p`` and ``2mn - 1 - p``."""
    p, turn = F.col(position), (2 * n).cast("long")

    def images(base: Column) -> Column:
        first, last = F.ceil((F.lit(-radius) - base) / turn), F.floor((n - 1 + radius - base) / turn)
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda m: m * turn + base)).otherwise(F.array().cast("array<bigint>"))

    return F.concat(images(p), images(-1 - p))


def median3(image: DataFrame, grid: Grid | DataFrame) -> DataFrame:
    """3×3 median with mirrored border; absent pixels count as 0, pixels without any neighbour are left out."""
    df = attach_grid(image, grid, "g_")
    for c, n in (("i", "g_nx"), ("j", "g_ny")):
        df = df.withColumn("_p", F.explode(reflected(c, F.col(n), 1)))
        df = df.withColumn(c, F.explode(F.sequence(F.col("_p") - 1, F.col("_p") + 1))).where((F.col(c) >= 0) & (F.col(c) < F.col(n)))
    nine = df.groupBy(*KEY).agg(F.collect_list("value").alias("v"))
    padded = F.array_sort(F.concat("v", F.array_repeat(F.lit(0.0), (F.lit(9) - F.size("v")).cast("int"))))
    return nine.select(*KEY, padded[4].alias("value"))


def gaussian_kernel(sigma: float, order: int = 0, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Sampled Gaussian (order 0) or its second derivative (order 2) with radius ``int(truncate·σ+½)``."""
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * x * x / (sigma * sigma)) for x in range(-radius, radius + 1)]
    total = sum(weights)
    out = []
    for x, w in zip(range(-radius, radius + 1), weights):
        factor = 1.0 if order == 0 else x * x / sigma ** 4 - 1.0 / sigma ** 2
        out.append((x, factor * w / total))
    return out


def convolve_axis(image: DataFrame, grid: Grid | DataFrame, axis: str, weights: Sequence[float]) -> DataFrame:
    """Symmetric kernel along one axis, mirrored border. Every voxel moves once, as one row; absent ones count as 0."""
    n = f"g_n{'xyz'['ijk'.index(axis)]}"
    sized = attach_grid(image.where("value IS NOT NULL"), grid, "g_").select(*KEY, F.col("value").cast("double").alias("value"), F.col(n).alias("n"))
    return along_lines(sized, axis, convolution(axis, weights), "volume_id long, i long, j long, k long, value double")


def gaussian(image: DataFrame, grid: Grid | DataFrame, sigma: float, axes: str = "ij") -> DataFrame:
    weights = [w for _, w in gaussian_kernel(sigma)]
    for axis in axes:
        image = convolve_axis(image, grid, axis, weights)
    return image
