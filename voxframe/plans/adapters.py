"""Image-like relations derived from the given tables.

Every adapter keys its rows by ``volume_id`` and cuts the key range into volumes of
constant size, so the number of volumes (not the fill of one grid) grows with the
tables.  All source rows take part.  Values are built from integer sums, which makes
them exact and independent of the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..grid import Grid, grid_rows
from ..session import keep_table

VOX_GRID = Grid.regular((50, 11, 9), (3.0, 9.0, 24.0 / 9.0))
PTS_GRID = Grid.regular((150, 100, 24))
FIBRE_GRID = Grid.regular((150, 100, 1), (50.0, 50.0, 1.0))
FIBRE_RADIUS = 12.5
IMAGE_GRID = Grid.regular((64, 64, 1), (8.0, 8.0, 1.0))
MASK2_GRID = Grid.regular((48, 48, 1))
MASK3_GRID = Grid.regular((16, 16, 8))
PLANE_GRID = Grid.regular((128, 96, 1))
PATCH_SIZE = 48
PATCH_X0 = (0, 36, 72, 80)
PATCH_Y0 = (0, 36, 48)


def _div(column: str, size: int):
    return F.floor(F.col(column) / size).cast("long")


class Tables:
    """Adapters bound to one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._maps: DataFrame | None = None

    def keep_vox(self) -> None:
        """From here on the voxel maps are read from a stored table, for a query that reads them several times."""
        self._maps = keep_table(self.vox(), "vox")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def vox(self, *extra: str) -> DataFrame:
        """Two scalar maps on one grid: ``value_a`` and ``value_b``; ``extra`` columns split the maps further."""
        if self._maps is not None and not extra:
            return self._maps
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        percent = F.round(F.col("l_discount") * 100).cast("long")
        rows = self.table("lineitem").select(
            *extra, _div("l_orderkey", 3000).alias("volume_id"), (F.col("l_quantity").cast("long") - 1).alias("i"),
            percent.alias("j"), F.round(F.col("l_tax") * 100).cast("long").alias("k"),
            cents.alias("a"), (cents * (100 - percent)).alias("b"))
        n = F.count("*")
        return rows.groupBy(*extra, "volume_id", "i", "j", "k").agg(
            (F.sum("a").cast("double") / (n * 100)).alias("value_a"),
            (F.sum("b").cast("double") / (n * 10000)).alias("value_b"))

    def vox_a(self) -> DataFrame:
        return self.vox().select("volume_id", "i", "j", "k", F.col("value_a").alias("value"))

    def vox_b(self) -> DataFrame:
        return self.vox().select("volume_id", "i", "j", "k", F.col("value_b").alias("value"))

    def metrics(self) -> DataFrame:
        """Both maps in long form, one row per metric and voxel."""
        pairs = F.array(F.struct(F.lit("a").alias("metric"), F.col("value_a").alias("value")),
                        F.struct(F.lit("b").alias("metric"), F.col("value_b").alias("value")))
        return self.vox().select("volume_id", "i", "j", "k", F.explode(pairs).alias("p")).select(
            "volume_id", "i", "j", "k", "p.metric", "p.value")

    def pts(self) -> DataFrame:
        return self.table("events").select(
            _div("event_id", 2000).alias("volume_id"), F.col("event_id").alias("point_id"),
            (F.col("user_id") % 150 + (F.col("event_id") % 7) / 7.0).alias("x"), (F.col("value") / 5.0).alias("y"),
            (F.hour("ts") + F.minute("ts") / 60.0).alias("z"), "event_type")

    def circles(self) -> DataFrame:
        return self.pts().select("volume_id", "point_id", "x", "y", F.lit(0.0).alias("z"))

    def image(self) -> DataFrame:
        """Dense 2-D image tiles of 64×64 pixels."""
        return self.table("part").select(
            _div("p_partkey", 4096).alias("volume_id"), (F.col("p_partkey") % 64).alias("i"),
            (_div("p_partkey", 64) % 64).alias("j"), F.lit(0).cast("long").alias("k"), F.col("p_retailprice").alias("value"))

    def field2(self) -> DataFrame:
        """2-D pixel field: the largest quantity per pixel."""
        return self.table("lineitem").groupBy(
            _div("l_orderkey", 500).alias("volume_id"), (F.col("l_partkey") % 48).alias("i"),
            ((F.col("l_suppkey") + 7 * F.col("l_linenumber")) % 48).alias("j"), F.lit(0).cast("long").alias("k"),
        ).agg(F.max("l_quantity").alias("value"))

    def mask2(self) -> DataFrame:
        return self.field2().where("value > 38").select("volume_id", "i", "j", "k")

    def seeds2(self) -> DataFrame:
        """Markers: the brightest pixels of the field, labelled by position."""
        return self.field2().where("value > 49").select(
            "volume_id", "i", "j", "k", (F.col("i") * 48 + F.col("j") + 1).alias("label"))

    def labels2(self) -> DataFrame:
        """Label pixels: the field above 20 cut into 6×6 blocks."""
        return self.field2().where("value > 20").select(
            "volume_id", "i", "j", "k",
            (1 + F.floor(F.col("i") / 6) * 8 + F.floor(F.col("j") / 6)).cast("long").alias("label"))

    def field3(self) -> DataFrame:
        return self.table("lineitem").groupBy(
            _div("l_orderkey", 2000).alias("volume_id"), (F.col("l_partkey") % 16).alias("i"),
            (F.col("l_orderkey") % 16).alias("j"), (F.col("l_suppkey") % 8).alias("k"),
        ).agg(F.max("l_quantity").alias("value"))

    def mask3(self) -> DataFrame:
        return self.field3().where("value > 20").select("volume_id", "i", "j", "k")

    def cloud(self) -> DataFrame:
        """Every vector as points of three consecutive coordinates each, the last one filled up with 0."""
        parts = F.sequence(F.lit(0), F.ceil(F.size("embedding") / 3).cast("int") - 1)
        cut = self.table("embeddings").select("label", "vec_id", "embedding", F.explode(parts).alias("n"))
        at = lambda k: F.coalesce(F.get("embedding", F.col("n") * 3 + k), F.lit(0.0)).cast("double")
        return cut.select(F.col("label").cast("long").alias("volume_id"), (F.col("vec_id") * 1000 + F.col("n")).alias("point_id"),
                          *[at(k).alias(c) for k, c in enumerate("xyz")])

    def plane(self) -> DataFrame:
        """Foreground pixels of a plane that patches are cut from."""
        return (self.table("lineitem").groupBy(
            _div("l_orderkey", 4000).alias("volume_id"), (F.col("l_partkey") % 128).alias("i"),
            ((F.col("l_suppkey") + 13 * F.col("l_linenumber")) % 96).alias("j"), F.lit(0).cast("long").alias("k"))
            .agg(F.max("l_quantity").alias("value")).where("value > 20"))

    def patches(self) -> DataFrame:
        """The patch boxes of every volume of the plane."""
        volumes = self.table("lineitem").select(_div("l_orderkey", 4000).alias("volume_id")).distinct()
        boxes = [(n * len(PATCH_X0) + m, y0, x0) for n, y0 in enumerate(PATCH_Y0) for m, x0 in enumerate(PATCH_X0)]
        layout = F.array(*[F.struct(F.lit(p).cast("long").alias("patch_index"), F.lit(y).cast("long").alias("y0"),
                                    F.lit(x).cast("long").alias("x0")) for p, y, x in boxes])
        return volumes.select("volume_id", F.explode(layout).alias("b")).select(
            "volume_id", "b.patch_index", F.lit(0).cast("long").alias("z0"), F.lit(1).cast("long").alias("z1"),
            "b.y0", (F.col("b.y0") + PATCH_SIZE).alias("y1"), "b.x0", (F.col("b.x0") + PATCH_SIZE).alias("x1"))

    def patch_labels(self) -> DataFrame:
        """Label pixels as a per-patch segmentation would deliver them: blocks whose offset differs by patch."""
        from ..operators.patches import cut_patches

        cut = cut_patches(self.plane().drop("value"), self.patches())
        shift_x, shift_y = F.col("patch_index") % 3, F.col("patch_index") % 2
        label = 1 + F.floor((F.col("i") - F.col("x0") + shift_x) / 6) * 9 + F.floor((F.col("j") - F.col("y0") + shift_y) / 6)
        return cut.select("volume_id", "patch_index", "i", "j", "k", label.cast("long").alias("local_label"))

    def varied_grids(self) -> DataFrame:
        """One grid per volume of the voxel maps; spacing, direction, unit and codes differ between volumes."""
        v = F.col("volume_id")
        sizes = self.vox().groupBy("volume_id").agg(*[(F.max(c) + 1).alias(n) for c, n in zip("ijk", ("nx", "ny", "nz"))])
        sign = F.when(v % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        zero, one = F.lit(0.0), F.lit(1.0)
        affine = F.array(sign * (3.0 + v % 3), zero, zero, v.cast("double"), zero, F.lit(9.0), zero, F.lit(-2.0),
                         zero, zero, F.lit(2.5), F.lit(0.5), zero, zero, zero, one)
        unit = F.when(v % 3 == 0, F.lit("um")).when(v % 3 == 1, F.lit("mm")).otherwise(F.lit("micron"))
        return sizes.select("volume_id", "nx", "ny", "nz", affine.alias("affine"), unit.alias("unit"),
                            (v % 2).cast("int").alias("qform_code"), (v % 2).cast("int").alias("sform_code"),
                            F.lit(False).alias("dense"))

    def grids(self, relation: DataFrame, grid: Grid, **options) -> DataFrame:
        return grid_rows(relation, grid, **options)
