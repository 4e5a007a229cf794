"""Row numbers and running sums inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sum(df: DataFrame, keys: Sequence[str], part: str, order: Sequence[Column | str], weight: Column, name: str) -> DataFrame:
    """Add the sum of ``weight`` over the rows of the same key that stand before each row.

    ``part`` is a stored column that splits every key into bounded portions, such as the task that wrote the
    row: sums run inside a portion, and the totals of the portions before it are added, so a key's rows never
    meet. ``df`` should be materialised, for it is read twice. Keys and ``part`` must not be null.
    """
    keys = list(keys)
    weighed = df.withColumn("_w", weight)
    totals = weighed.groupBy(*keys, part).agg(F.sum("_w").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = weighed.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return local.join(offsets, [*keys, part]).withColumn(name, F.col("_before") + F.col("_local")).drop("_before", "_local", "_w")


def number_rows(df: DataFrame, keys: Sequence[str], part: str, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Number the rows of each key from 0; see ``running_sum``."""
    return running_sum(df, keys, part, order, F.lit(1).cast("long"), name)
