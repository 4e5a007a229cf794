"""Point tables from CSV."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.filters import require_nonempty
from ..operators.geometry import inverse_affine, transform_point

WORLD = ("world_x", "world_y", "world_z")
VOXEL = ("voxel_center_x", "voxel_center_y", "voxel_center_z")


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column text: types are cast by the caller, never inferred."""
    return spark.read.option("header", True).csv(path)


def cast_or_drop(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """Cast columns; rows with a value that cannot be cast are dropped."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c in columns}).dropna(subset=list(columns))


def read_points(spark: SparkSession, path: str, affine: Column | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Voxel coordinates ``x, y, z`` of a centre table.

    World columns win over voxel columns and go through the inverse of ``affine``. An empty table is an error.
    """
    raw = require_nonempty(read_text_table(spark, path), path)
    if all(c in raw.columns for c in WORLD):
        world = cast_or_drop(raw, WORLD)
        moved = transform_point(inverse_affine(affine), *[F.col(c) for c in WORLD])
        return world.select(*extra, *[m.alias(a) for m, a in zip(moved, "xyz")])
    if all(c in raw.columns for c in VOXEL):
        return cast_or_drop(raw, VOXEL).select(*extra, *[F.col(c).alias(a) for c, a in zip(VOXEL, "xyz")])
    raise ValueError("neither world nor voxel centre columns found")


def read_fibre_centroids(spark: SparkSession, path: str, axis_order: tuple[str, str] = ("x", "y"), order: str | None = None) -> DataFrame:
    """Fibre centroids as ``x, y`` with a label.

    ``axis_order`` says which grid axis the file's columns (x, y) belong to. Without a
    label column the row number of ``order`` (a numeric file column) plus one is the label.
    """
    raw = read_text_table(spark, path)
    missing = [c for c in ("centroid_y", "centroid_x") if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    named = {"x": F.col("centroid_x").cast("double"), "y": F.col("centroid_y").cast("double")}
    label = F.col("label").cast("long") if "label" in raw.columns else F.col(order).cast("long") + 1
    return raw.select(label.alias("label"), named[axis_order[0]].alias("x"), named[axis_order[1]].alias("y"))


COMPONENT_COLUMNS = ("voxel_count", *VOXEL)


def read_components(spark: SparkSession, path: str, minimum: int | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Component centres: four required columns, incomplete rows dropped, optional smallest size."""
    raw = read_text_table(spark, path)
    missing = [c for c in COMPONENT_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = cast_or_drop(raw, COMPONENT_COLUMNS).withColumn("voxel_count", F.col("voxel_count").cast("long"))
    if minimum is not None:
        out = out.where(F.col("voxel_count") >= minimum)
    return out.select(*extra, "voxel_count", *[F.col(c).alias(a) for c, a in zip(VOXEL, "xyz")])


def formatted(value: Column, form: str) -> Column:
    """Numbers as ``form`` writes them, rounded from the exact binary value (Java's formatter rounds its shortest decimal); null stays null."""
    @F.pandas_udf("string")
    def show(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda v: form % v)

    return F.when(value.isNotNull(), show(value))


def write_table(df: DataFrame, path: str, formats: dict[str, str] | None = None) -> None:
    """CSV with fixed float formats per column (for example ``%.6f``)."""
    shown = [formatted(F.col(c), formats[c]).alias(c) if c in (formats or {}) else F.col(c) for c in df.columns]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)
