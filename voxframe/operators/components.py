"""Connected components of edge tables and voxel masks.

Voxel masks are first compressed to runs along ``i`` (a window per grid line), then
touching runs become edges, and the edges are contracted to stars by alternating
large-star and small-star steps: partial aggregation plus equi-joins, a checkpoint
per round, and no task ever sees a whole component.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..grid import Grid, attach_grid
from ..session import cut_lineage
from .geometry import flat_index

KEY = ["volume_id", "i", "j", "k"]
BLOCK = 16


def _fingerprint(edges: DataFrame, columns: Sequence[str]) -> tuple:
    code = F.xxhash64(*columns)
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(code).alias("x"),
                    F.sum(code.cast("decimal(38,0)")).alias("s")).first()
    return tuple(row)


def contract_edges(edges: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """(keys, node, root) for every node of the edge table; the root is the smallest node of its component."""
    keys = list(keys)
    columns = [*keys, "u", "v"]
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    current = cut_lineage(edges.where("u <> v").select(*keys, high, low).distinct())
    seen = _fingerprint(current, columns)
    while True:  # every round that changes something shortens paths, so this ends
        # large star: link every greater neighbour to the smallest node around
        both = current.unionByName(current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(smallest, [*keys, "u"])
                 .select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: link every smaller neighbour, and the node itself, to the smallest of them
        smallest = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        pulled = (large.join(smallest, [*keys, "u"]).where("v <> m")
                  .select(*keys, F.col("v").alias("u"), F.col("m").alias("v")))
        following = cut_lineage(pulled.unionByName(smallest.select(*keys, "u", F.col("m").alias("v"))).distinct())
        state = _fingerprint(following, columns)
        current = following
        if state == seen:
            break
        seen = state
    roots = current.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(*keys, F.col("root").alias("node"), "root").distinct())


def component_roots(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Root of every node; nodes without edges are their own root."""
    keys = list(keys)
    return (nodes.join(contract_edges(edges, keys), [*keys, "node"], "left")
            .withColumn("root", F.coalesce("root", "node")))


# --- voxel masks -------------------------------------------------------------------------------

def line_runs(mask: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Maximal runs of consecutive ``i`` per grid line: (volume, j, k, i0, i1)."""
    line = Window.partitionBy("volume_id", "j", "k", *extra).orderBy("i")
    islands = mask.select(*KEY, *extra).withColumn("_island", F.col("i") - F.row_number().over(line))
    return islands.groupBy("volume_id", "j", "k", *extra, "_island").agg(
        F.min("i").alias("i0"), F.max("i").alias("i1")).drop("_island")


def run_links(runs: DataFrame, dims: int, diagonal: bool) -> DataFrame:
    """Pairs (u, v) of run ids on neighbouring lines that touch.

    The range condition becomes an equi-join on blocks of the line; a pair that shares
    several blocks is kept in the first one only.
    """
    offsets = [(1, 0)]
    if dims == 3:
        offsets = [(1, 0), (0, 1), (1, 1), (1, -1)] if diagonal else [(1, 0), (0, 1)]
    slack = 1 if diagonal else 0
    lines = F.array(*[F.struct(F.lit(dj).cast("long").alias("dj"), F.lit(dk).cast("long").alias("dk")) for dj, dk in offsets])
    block = lambda c: F.floor(c / BLOCK).cast("long")
    near = (runs.select("volume_id", "node", F.explode(lines).alias("o"), "j", "k",
                        (F.col("i0") - slack).alias("a0"), (F.col("i1") + slack).alias("a1"))
            .select("volume_id", F.col("node").alias("u"), (F.col("j") + F.col("o.dj")).alias("j"), (F.col("k") + F.col("o.dk")).alias("k"),
                    "a0", "a1", F.explode(F.sequence(block(F.col("a0")), block(F.col("a1")))).alias("block")))
    far = runs.select("volume_id", F.col("node").alias("v"), "j", "k", "i0", "i1",
                      F.explode(F.sequence(block(F.col("i0")), block(F.col("i1")))).alias("block"))
    joined = near.join(far, ["volume_id", "j", "k", "block"])
    touching = (F.col("a0") <= F.col("i1")) & (F.col("i0") <= F.col("a1"))
    first_block = F.col("block") == F.greatest(block(F.col("a0")), block(F.col("i0")))
    return joined.where(touching & first_block).select("volume_id", "u", "v")


def labelled_runs(mask: DataFrame, grid: Grid | DataFrame, dims: int = 2, diagonal: bool = True) -> DataFrame:
    """Runs of the mask with the root of their component (the smallest flat index of its voxels)."""
    runs = attach_grid(line_runs(mask), grid, "g_")
    node = flat_index(F.col("i0"), F.col("j"), F.col("k"), F.col("g_ny"), F.col("g_nz"))
    runs = cut_lineage(runs.select("volume_id", "j", "k", "i0", "i1", node.alias("node")))
    return component_roots(runs, run_links(runs, dims, diagonal))


def expand_runs(runs: DataFrame, *columns) -> DataFrame:
    return runs.select("volume_id", F.explode(F.sequence("i0", "i1")).alias("i"), "j", "k", *columns)


def connected_components(mask: DataFrame, grid: Grid | DataFrame, dims: int = 2, diagonal: bool = True) -> DataFrame:
    """Label voxels; the label is one more than the smallest flat index of the component.

    ``diagonal`` selects 8-/26-neighbours, otherwise 4-/6-neighbours.
    """
    return expand_runs(labelled_runs(mask, grid, dims, diagonal), (F.col("root") + 1).alias("label"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("volume_id", "label").agg(F.count("*").alias("area"))


def largest_component(mask: DataFrame, grid: Grid | DataFrame, dims: int = 2, diagonal: bool = True) -> DataFrame:
    """The biggest component of each volume; the first label wins ties."""
    runs = labelled_runs(mask, grid, dims, diagonal)
    sizes = runs.groupBy("volume_id", "root").agg(F.sum(F.col("i1") - F.col("i0") + 1).alias("area"))
    best = sizes.groupBy("volume_id").agg(F.max_by("root", F.struct(F.col("area"), -F.col("root"))).alias("root"))
    return expand_runs(runs.join(best, ["volume_id", "root"], "left_semi"))


def remove_small(mask: DataFrame, grid: Grid | DataFrame, minimum: int, dims: int = 2, diagonal: bool = False) -> DataFrame:
    """Drop components with fewer voxels than ``minimum``."""
    runs = labelled_runs(mask, grid, dims, diagonal)
    sizes = runs.groupBy("volume_id", "root").agg(F.sum(F.col("i1") - F.col("i0") + 1).alias("area"))
    kept = sizes.where(F.col("area") >= minimum)
    return expand_runs(runs.join(kept, ["volume_id", "root"], "left_semi"))


def fill_holes(mask: DataFrame, grid: Grid | DataFrame, dims: int = 2) -> DataFrame:
    """Add the background that cannot reach the grid border through faces.

    Works on background runs only: gaps between mask runs are the candidates. A gap is
    open when it reaches the border, lies on a border line, or has a neighbour line
    without any mask voxel; openness spreads through the components of the gaps.
    """
    runs = line_runs(mask)
    line = Window.partitionBy("volume_id", "j", "k").orderBy("i0")
    sized = attach_grid(runs, grid, "g_")
    parts = sized.withColumns({"next": F.lead("i0").over(line), "first": F.row_number().over(line) == 1})
    after = F.struct((F.col("i1") + 1).alias("i0"), (F.coalesce("next", F.col("g_nx")) - 1).alias("i1"))
    before = F.struct(F.lit(0).cast("long").alias("i0"), (F.col("i0") - 1).alias("i1"))
    gaps = (parts.withColumn("gap", F.explode(F.when(F.col("first"), F.array(before, after)).otherwise(F.array(after))))
            .select("volume_id", "j", "k", F.col("gap.i0").alias("i0"), F.col("gap.i1").alias("i1"), "g_nx", "g_ny", "g_nz")
            .where("i1 >= i0"))
    node = flat_index(F.col("i0"), F.col("j"), F.col("k"), F.col("g_ny"), F.col("g_nz"))
    edge = (F.col("i0") == 0) | (F.col("i1") == F.col("g_nx") - 1) | (F.col("j") == 0) | (F.col("j") == F.col("g_ny") - 1)
    if dims == 3:
        edge = edge | (F.col("k") == 0) | (F.col("k") == F.col("g_nz") - 1)
    gaps = gaps.select("volume_id", "j", "k", "i0", "i1", node.alias("node"), edge.alias("open"))
    lines = runs.select("volume_id", "j", "k").distinct()
    for dj, dk in [(1, 0), (-1, 0)] + ([(0, 1), (0, -1)] if dims == 3 else []):
        beside = lines.select("volume_id", (F.col("j") - dj).alias("j"), (F.col("k") - dk).alias("k"), F.lit(True).alias("_busy"))
        gaps = (gaps.join(beside, ["volume_id", "j", "k"], "left")
                .withColumn("open", F.col("open") | F.col("_busy").isNull()).drop("_busy"))
    gaps = cut_lineage(gaps)
    rooted = component_roots(gaps, run_links(gaps, dims, False))
    closed = rooted.groupBy("volume_id", "root").agg(F.bool_or("open").alias("open")).where(~F.col("open"))
    holes = expand_runs(rooted.join(closed.select("volume_id", "root"), ["volume_id", "root"], "left_semi"))
    return mask.select(*KEY).unionByName(holes)
