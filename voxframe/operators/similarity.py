"""Image similarity: mutual information and normalised cross-correlation.

Images are compared as aligned rows ``(keys…, a, b)``; any number of image pairs,
candidates and scopes are scored in the same jobs, one result row per key set. Sparse
images need no row where both are 0: ``empty`` tells the number of such cells by key set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.validity import is_finite
from ..session import cut_lineage
from .ranking import join_groups, prefix_sums, quantile_ends, quantile_of
from .stats import safe_corr
from .filters import require_nonempty

KEY = ["volume_id", "i", "j", "k"]
FLAT = 1e-12
CELLS = 256
FEW_KEY_SETS = 100_000  # so many are sent to every task with their few numbers (some 10 MB), for else all pairs are shuffled


def finite_pairs(pairs: DataFrame) -> DataFrame:
    """Rows in which both values are finite; zero is a valid value here."""
    return pairs.where(is_finite(F.col("a")) & is_finite(F.col("b")))


def with_empty(pairs: DataFrame, keys: Sequence[str], empty: DataFrame | None) -> DataFrame:
    """The pairs with ``weight`` 1 and, for each key set of ``empty`` (keys, n_empty), one (0, 0) row that weighs n_empty."""
    weighed = pairs.select(*keys, "a", "b", F.lit(1).cast("long").alias("weight"))
    if empty is None:
        return weighed
    zeros = empty.where("n_empty > 0").select(*keys, F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.col("n_empty").alias("weight"))
    return weighed.unionByName(zeros)


def robust_limits(pairs: DataFrame, keys: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """1st and 99th percentile of both images per key set (rows with ``weight``), exact.

    The range of each image is cut into cells; only the values of the cells that hold a wanted rank are counted one by one.
    """
    keys = list(keys)
    group, wanted = [*keys, "side"], {"lo": low, "hi": high}
    ends = pairs.groupBy(*keys).agg(*[of(c).alias(f"_{n}_{c}") for c in "ab" for n, of in (("min", F.min), ("max", F.max))])
    side = lambda c: F.struct(F.lit(c).alias("side"), F.col(c).alias("v"), F.col(f"_min_{c}").alias("first"), F.col(f"_max_{c}").alias("last"))
    long = join_groups(pairs.select(*keys, "a", "b", "weight"), ends, keys, few=FEW_KEY_SETS).select(*keys, "weight", F.explode(F.array(side("a"), side("b"))).alias("s")).select(*keys, "weight", "s.*")
    # halves, so that no difference overflows
    place = F.floor((F.col("v") / 2 - F.col("first") / 2) / (F.col("last") / 2 - F.col("first") / 2) * CELLS)
    long = long.where("v IS NOT NULL").select(*group, "weight", "v", F.when(F.col("last") / 2 > F.col("first") / 2, F.least(place, F.lit(CELLS - 1))).otherwise(F.lit(0)).cast("long").alias("cell"))
    kept = cells_of_ranks(long.groupBy(*group, "cell").agg(F.sum("weight").alias("n")), group, wanted)
    few_cells = kept.groupBy(*keys).agg(F.collect_list(F.struct("side", "cell", "_before", "_count")).alias("_kept"))  # at most four of a side
    held = F.filter("_kept", lambda x: (x["side"] == F.col("side")) & (x["cell"] == F.col("cell")))
    counted = (join_groups(long, few_cells, keys, few=FEW_KEY_SETS).select(*group, "cell", "weight", "v", F.explode(held).alias("_held"))
               .groupBy(*group, "cell", "_held._before", "_held._count", "v").agg(F.sum("weight").alias("n")))
    limits = quantiles_in_cells(counted, group, wanted)
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{c}_{side}")
    return limits.groupBy(*keys).agg(pick("a", "lo"), pick("a", "hi"), pick("b", "lo"), pick("b", "hi"))


def cells_of_ranks(cells: DataFrame, group: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    """(group, cell, _before, _count): the cells (group, cell, n) that hold a rank of a wanted quantile, with the rows before them and in all."""
    inside = Window.partitionBy(*group)  # at most CELLS rows each
    cells = cells.withColumns({
        "_count": F.sum("n").over(inside), "_before": F.coalesce(F.sum("n").over(inside.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    holds = F.lit(False)
    for probability in wanted.values():
        position = F.lit(float(probability)) * (F.col("_count") - 1)
        for rank in (F.floor(position), F.ceil(position)):
            holds = holds | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("n")))
    return cells.where(holds).select(*group, "cell", "_before", "_count")


def quantiles_in_cells(counted: DataFrame, group: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    """The wanted quantiles from the values (group, cell, _before, _count, v, n) of ``cells_of_ranks``."""
    ranked = prefix_sums(counted, [*group, "cell"], "v", "n").withColumn("before", F.col("before") + F.col("_before"))
    picked = ranked.groupBy(*group).agg(F.max("_count").alias("_count"), *quantile_ends("v", F.col("_count"), wanted))
    return picked.select(*group, *[quantile_of(name, F.col("_count"), probability).alias(name) for name, probability in wanted.items()])


def mutual_information(pairs: DataFrame, keys: Sequence[str], bins: int = 64, minimum: int = 100, empty: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """MI (nats) of the joint histogram of the clipped images; NULL for few rows or a flat image. ``stored`` as in ``similarity``."""
    keys = list(keys)
    pairs = finite_pairs(pairs.select(*keys, "a", "b"))
    usable = with_empty(pairs if stored else cut_lineage(pairs), keys, empty)
    limits = robust_limits(usable, keys)

    def bin_of(side: str):
        low, high = F.col(f"lo_{side}"), F.col(f"hi_{side}")
        clipped = F.least(F.greatest(F.col(side), low), high)
        return F.least(F.floor((clipped - low) / (high - low) * bins), F.lit(bins - 1)).cast("long")

    sound = (F.col("hi_a") - F.col("lo_a") >= FLAT) & (F.col("hi_b") - F.col("lo_b") >= FLAT)
    joint = (join_groups(usable, limits.where(sound), keys, few=FEW_KEY_SETS)
             .groupBy(*keys, bin_of("a").alias("bin_a"), bin_of("b").alias("bin_b")).agg(F.sum("weight").alias("n")))
    # at most bins² rows per key set from here on
    total = lambda *by: F.sum("n").over(Window.partitionBy(*keys, *by))
    joint = joint.withColumns({"n_a": total("bin_a"), "n_b": total("bin_b"), "n_all": total()})
    p = F.col("n") / F.col("n_all")
    term = p * F.ln(F.col("n") * F.col("n_all") / (F.col("n_a") * F.col("n_b")))
    return joint.groupBy(*keys).agg(F.sum(term).alias("mi"), F.sum("n").alias("n")).where(F.col("n") >= minimum).select(*keys, "mi")


def cross_correlation(pairs: DataFrame, keys: Sequence[str], minimum: int = 100, empty: DataFrame | None = None) -> DataFrame:
    """NCC over the unclipped values; NULL for few rows or a vanishing denominator."""
    keys = list(keys)
    sums = finite_pairs(pairs).groupBy(*keys).agg(
        F.count("*").alias("_m"), F.avg("a").alias("_a"), F.avg("b").alias("_b"),
        F.covar_pop("a", "b").alias("_ab"), F.var_pop("a").alias("_aa"), F.var_pop("b").alias("_bb"))
    if empty is None:
        sums = sums.withColumn("n", F.col("_m"))
    else:  # moments of the rows and of n_empty zeros, put together
        sums = sums.join(empty, keys, "full").withColumn("n", F.coalesce("_m", F.lit(0)) + F.coalesce("n_empty", F.lit(0)))
        share, rest = F.col("_m") / F.col("n"), F.col("n_empty") / F.col("n")
        sums = sums.where("n > 0").withColumns({name: F.col(name) * share + F.col(f"_{x}") * F.col(f"_{y}") * share * rest for name, x, y in (("_ab", "a", "b"), ("_aa", "a", "a"), ("_bb", "b", "b"))})
    spread = F.sqrt(F.col("_aa") * F.col("_bb"))
    sound = (F.col("n") >= minimum) & (spread * F.col("n") >= FLAT)
    return sums.select(*keys, "n", F.when(sound, F.col("_ab") / F.nullif(spread, F.lit(0.0))).alias("ncc"))


def similarity(pairs: DataFrame, keys: Sequence[str], bins: int = 64, minimum: int = 100, empty: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """(keys, n, mi, ncc) of every image pair; ``stored`` says that reading the pairs again costs no work."""
    keys = list(keys)
    pairs = finite_pairs(pairs.select(*keys, "a", "b"))
    if not stored:
        pairs = cut_lineage(pairs)  # limits, histogram and moments all read it
    return cross_correlation(pairs, keys, minimum, empty).join(mutual_information(pairs, keys, bins, minimum, empty, stored=True), keys, "left")


def align(fixed: DataFrame, moving: DataFrame) -> DataFrame:
    """Join two maps voxel by voxel as ``a`` and ``b``; a map without ``k`` lies in plane 0, maps without a common voxel are an error."""
    fixed, moving = (m if "k" in m.columns else m.withColumn("k", F.lit(0).cast("long")) for m in (fixed, moving))
    both = fixed.select(*KEY, F.col("value").alias("a")).join(moving.select(*KEY, F.col("value").alias("b")), KEY)
    return require_nonempty(both, "the join of the maps")


def scoped(pairs: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows of both scopes: ``global`` and, for voxels inside the mask, ``mask``."""
    marked = pairs.join(mask.select(*KEY).withColumn("_in", F.lit(True)), KEY, "left")
    scopes = F.when(F.col("_in"), F.array(F.lit("global"), F.lit("mask"))).otherwise(F.array(F.lit("global")))
    return marked.withColumn("scope", F.explode(scopes)).drop("_in")


def metrics_global_and_mask(pairs: DataFrame, mask: DataFrame, keys: Sequence[str] = ("volume_id",), bins: int = 64) -> DataFrame:
    return similarity(scoped(pairs, mask), [*keys, "scope"], bins)
