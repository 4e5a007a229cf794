"""Grid geometry: one shared constant grid, or a ``grids`` relation with one row per volume."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .schema import GRIDS

IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)


@dataclass(frozen=True)
class Grid:
    """Shape and row-major 4×4 affine (index → world) of a grid that many volumes share."""

    shape: tuple[int, int, int]
    affine: tuple[float, ...] = IDENTITY
    unit: str = "um"

    @classmethod
    def regular(cls, shape, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), unit="um") -> "Grid":
        matrix = np.diag([*map(float, spacing), 1.0])
        matrix[:3, 3] = origin
        return cls(tuple(int(n) for n in shape), tuple(matrix.ravel().tolist()), unit)

    @property
    def matrix(self) -> np.ndarray:
        return np.array(self.affine, dtype=float).reshape(4, 4)

    @property
    def spacing(self) -> tuple[float, float, float]:
        return tuple(float(v) for v in np.sqrt((self.matrix[:3, :3] ** 2).sum(axis=0)))

    @property
    def voxel_volume(self) -> float:
        return float(abs(np.linalg.det(self.matrix[:3, :3])))

    @property
    def size(self) -> int:
        return int(np.prod(self.shape))


def matrix_columns(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def attach_grid(df: DataFrame, grid: Grid | DataFrame, prefix: str = "") -> DataFrame:
    """Add ``<prefix>nx, ny, nz, affine``: literals for a shared grid, an equi-join for a relation.

    The join carries no broadcast hint: the grid table has one row per volume, so
    Spark decides by its size.
    """
    if isinstance(grid, Grid):
        for name, value in zip(("nx", "ny", "nz"), grid.shape):
            df = df.withColumn(prefix + name, F.lit(int(value)).cast("long"))
        return df.withColumn(prefix + "affine", matrix_columns(grid.affine))
    side = grid.select("volume_id", *[F.col(c).alias(prefix + c) for c in ("nx", "ny", "nz", "affine")])
    return df.join(side, "volume_id")


def grid_rows(volumes: DataFrame, grid: Grid, dense: bool = False, qform_code: int = 1, sform_code: int = 1) -> DataFrame:
    """A ``grids`` relation giving every volume of ``volumes`` the same geometry."""
    base = volumes.select("volume_id").distinct()
    out = attach_grid(base, grid)
    return out.select(
        "volume_id", "nx", "ny", "nz", "affine", F.lit(grid.unit).alias("unit"),
        F.lit(qform_code).alias("qform_code"), F.lit(sform_code).alias("sform_code"), F.lit(dense).alias("dense"))


def grids_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Small hand-written grid tables (configuration)."""
    return spark.createDataFrame(rows, GRIDS)
