"""Order-dependent operators without whole-group windows.

One volume may hold a third of all rows, so nothing here sorts a whole group in
one task.  Values are first reduced to (group, value, count); that table is range
partitioned, each chunk is summed, chunk offsets are prefix-summed (one row per
chunk), and running sums are finished inside the chunks.  The chunk number is
materialised by a checkpoint, since range bounds are sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


FEW_GROUPS = 10_000  # so many rows are sent to every task
PARTS = 512          # parts of a key set's rows where there are more groups


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], by: Sequence[str] = (), few: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``groups``, one row per key set, however many rows share a key set.

    Few groups (``few`` at most, else FEW_GROUPS) go to every task. Of more, the rows of a key set are cut into parts by a hash of ``by``, and its group
    is repeated for the parts that exist; without ``by`` all rows of a key set meet.
    """
    keys, stored = list(keys), cut_lineage(groups)
    few = FEW_GROUPS if few is None else few
    if stored.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(stored), keys)
    if not by:
        return rows.join(stored, keys)
    cut = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(PARTS)))
    return cut.join(cut.select(*keys, "_part").distinct().join(stored, keys), [*keys, "_part"]).drop("_part")


def prefix_sums(df: DataFrame, keys: Sequence[str], order: str, weight: str, into: str = "before", total: str | None = None) -> DataFrame:
    """Add ``into``: the sum of ``weight`` over the rows of the group with a smaller ``order``; ``total``: that over all its rows.

    ``order`` must be unique inside a group.
    """
    return many_prefix_sums(df, keys, order, {into: weight}, {} if total is None else {total: into})


def many_prefix_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], totals_of: dict[str, str] | None = None) -> DataFrame:
    """Several prefix sums in one pass: ``sums`` maps added columns to their weights, ``totals_of`` names for sums over whole groups to those columns."""
    keys, totals_of = list(keys), totals_of or {}
    chunked = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in [*keys, order]]).withColumn("_chunk", F.spark_partition_id()))
    earlier_chunks = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy(*keys, "_chunk").agg(*[F.sum(weight).alias(f"_total_{into}") for into, weight in sums.items()])
    offsets = totals.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_total_{into}").over(earlier_chunks), F.lit(0)).alias(f"_offset_{into}") for into in sums],
                            *[F.sum(f"_total_{into}").over(Window.partitionBy(*keys)).alias(name) for name, into in totals_of.items()])
    earlier_rows = (Window.partitionBy(*keys, "_chunk").orderBy(order)
                    .rowsBetween(Window.unboundedPreceding, -1))
    inside = chunked.withColumns({f"_inside_{into}": F.coalesce(F.sum(weight).over(earlier_rows), F.lit(0)) for into, weight in sums.items()})
    return (inside.join(offsets, [*keys, "_chunk"])
            .withColumns({into: F.col(f"_inside_{into}") + F.col(f"_offset_{into}") for into in sums})
            .drop("_chunk", *[f"_{part}_{into}" for into in sums for part in ("inside", "offset")]))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    count = F.count("*") if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.alias("n"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    ``probabilities`` maps output column names to probabilities; ``weight`` (a whole number) counts a row several times.
    """
    keys = list(keys)
    return picked_quantiles(prefix_sums(value_counts(df, keys, value, weight), keys, value, "n", total="_count"), keys, value, probabilities)


def picked_quantiles(ranked: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], before: str = "before", n: str = "n") -> DataFrame:
    """Quantiles from values with their counts ``n``, prefix sums ``before`` and the sum ``_count`` of their group."""
    keys = list(keys)
    picked = ranked.groupBy(*keys).agg(F.max("_count").alias("_count"), *quantile_ends(value, F.col("_count"), probabilities, before, n))
    return picked.select(*keys, *[quantile_of(name, F.col("_count"), probability).alias(name) for name, probability in probabilities.items()])


def quantile_ends(value: str, count: Column, probabilities: dict[str, float], before: str = "before", n: str = "n") -> list[Column]:
    """Aggregates that pick the values on both sides of each quantile."""
    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col(before) <= rank) & (rank < F.col(before) + F.col(n)), F.col(value)))

    pieces = []
    for name, probability in probabilities.items():
        position = F.lit(float(probability)) * (count - 1)
        pieces += [value_at(F.floor(position)).alias(f"_lo_{name}"), value_at(F.ceil(position)).alias(f"_hi_{name}")]
    return pieces


def quantile_of(name: str, count: Column, probability: float) -> Column:
    position = F.lit(float(probability)) * (count - 1)
    low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
    return low + (high - low) * (position - F.floor(position))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(group, value, rank) with ties sharing their mean rank, starting at 1; ``weight`` counts a row several times."""
    counts = value_counts(df, keys, value) if weight is None else df.groupBy(*keys, value).agg(F.sum(weight).alias("n"))
    ranked = prefix_sums(counts, keys, value, "n")
    return ranked.select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))


def dense_ids(df: DataFrame, keys: Sequence[str], label: str, into: str = "new_label") -> DataFrame:
    """(group, label, 1..n) in ascending label order."""
    distinct = df.select(*keys, label).distinct().withColumn("_one", F.lit(1).cast("long"))
    return (prefix_sums(distinct, keys, label, "_one", into="_before")
            .select(*keys, label, (F.col("_before") + 1).cast("long").alias(into)))


def dense_relabel(labels: DataFrame, keys: Sequence[str] = ("volume_id",), label: str = "label") -> DataFrame:
    """Renumber the labels of each volume to 1..n in ascending order of the old label."""
    ids = dense_ids(labels, keys, label)
    return labels.join(ids, [*keys, label]).drop(label).withColumnRenamed("new_label", label)


def last_wins(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Where several rows write one cell, the row with the highest ``order`` stays."""
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])


def top_candidates(df: DataFrame, score: str, sequence: str, keys: Sequence[str] = ()) -> DataFrame:
    """The best row per key set; the earlier ``sequence`` wins ties, invalid scores count as -inf."""
    usable = F.when(F.abs(F.col(score)) < float("inf"), F.col(score)).otherwise(F.lit(float("-inf")))
    best = F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in keys]), F.struct(usable, -F.col(sequence)))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")
