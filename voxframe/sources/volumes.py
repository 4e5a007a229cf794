"""Voxel tables: the Parquet layout, and single-file NIfTI-1 images as rows.

Images are planned from their headers: every uncompressed file is cut into ranges of voxels, and each range is read by
itself, so one large file is shared by many tasks. A compressed file can't be entered in the middle; one task streams it.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..grid import Grid, grid_rows

# NIfTI-1 data type codes, and unit codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
NIFTI_UNITS = {1: "m", 2: "mm", 3: "um"}
HEADER_BYTES = 352
RANGE_VOXELS = 1 << 22
ROWS_PER_BATCH = 1 << 20
HEADER = ("path string, compressed boolean, big boolean, code int, data_start long, nx long, ny long, nz long, channels long, slope double, intercept double, "
          "affine array<double>, unit string, qform_code int, sform_code int")
VOXEL_ROWS = "path string, i long, j long, k long, value double"


def write_voxels(voxels: DataFrame, grids: DataFrame, path: str) -> None:
    """Voxels partitioned by volume and sorted by position, with their grid rows beside them."""
    spread = voxels.repartition("volume_id", F.floor(F.col("i") / 64)).sortWithinPartitions("volume_id", "i", "j", "k")
    spread.write.mode("overwrite").partitionBy("volume_id").parquet(f"{path}/voxels")
    grids.write.mode("overwrite").parquet(f"{path}/grids")


def read_voxels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    voxels = spark.read.parquet(f"{path}/voxels").withColumn("volume_id", F.col("volume_id").cast("long"))
    return voxels, spark.read.parquet(f"{path}/grids")


# --- images --------------------------------------------------------------------------------------

def _located(path: str) -> tuple[fs.FileSystem, str]:
    scheme, found, rest = path.partition(":")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), ("/" + rest.lstrip("/") if found else path)
    return fs.FileSystem.from_uri(path)


def _quaternion_axes(b: float, c: float, d: float, pixdim: np.ndarray) -> np.ndarray:
    """Axis columns of the orientation that a header states as a unit quaternion."""
    a = np.sqrt(max(0.0, 1.0 - (b * b + c * c + d * d)))
    turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
                     [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
                     [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
    return turn * np.array([pixdim[1], pixdim[2], -pixdim[3] if pixdim[0] < 0 else pixdim[3]])


def parse_header(path: str, raw: bytes, compressed: bool) -> dict:
    """What the first ``HEADER_BYTES`` of an image say.

    The affine is the stated matrix where its code is positive, else the quaternion form where its code is, else the
    spacing around the centre with the first axis turned.
    """
    if len(raw) < HEADER_BYTES - 4 or 348 not in struct.unpack("<i", raw[:4]) + struct.unpack(">i", raw[:4]):
        raise ValueError(f"{path} is no NIfTI-1 image")
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dims = struct.unpack_from(order + "8h", raw, 40)
    code, = struct.unpack_from(order + "h", raw, 70)
    if code not in NIFTI_TYPES:
        raise ValueError(f"{path}: data type {code} is not supported")
    pixdim = np.array(struct.unpack_from(order + "8f", raw, 76))
    start, slope, intercept = struct.unpack_from(order + "3f", raw, 108)
    qform, sform = struct.unpack_from(order + "2h", raw, 252)
    sizes = [max(1, n) for n in dims[1:dims[0] + 1]] + [1, 1, 1]
    shape = np.array(sizes[:3])
    affine = np.eye(4)
    if sform > 0:
        affine[:3] = np.array(struct.unpack_from(order + "12f", raw, 280)).reshape(3, 4)
    elif qform > 0:
        affine[:3, :3] = _quaternion_axes(*struct.unpack_from(order + "3f", raw, 256), pixdim)
        affine[:3, 3] = struct.unpack_from(order + "3f", raw, 268)
    else:
        zooms = pixdim[1:4] * (-1, 1, 1)
        affine[:3, :3], affine[:3, 3] = np.diag(zooms), -(shape - 1) / 2 * zooms
    scaled = slope != 0 and np.isfinite(slope)
    return {"path": path, "compressed": compressed, "big": order == ">", "code": code, "data_start": int(start), **dict(zip(("nx", "ny", "nz"), map(int, shape))),
            "channels": int(np.prod(sizes[3:])), "slope": float(slope) if scaled else 1.0, "intercept": float(intercept) if scaled else 0.0, "affine": affine.ravel().tolist(),
            "unit": NIFTI_UNITS.get(raw[123] & 7, "unknown"), "qform_code": qform, "sform_code": sform}


def image_header(shape, spacing, affine, unit: str) -> bytes:
    """The header of a little-endian float64 image with a stated matrix."""
    raw = bytearray(HEADER_BYTES)
    struct.pack_into("<i", raw, 0, 348)
    struct.pack_into("<8h", raw, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", raw, 70, 64, 64)
    struct.pack_into("<8f", raw, 76, 1.0, *spacing, 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", raw, 108, HEADER_BYTES, 1.0, 0.0)
    raw[123] = {name: code for code, name in NIFTI_UNITS.items()}.get(unit, 0)
    struct.pack_into("<2h", raw, 252, 0, 1)
    struct.pack_into("<12f", raw, 280, *affine[:12])
    raw[344:348] = b"n+1\0"
    return bytes(raw)


def read_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per image file (``HEADER``); only the beginning of each file is read, by tasks."""
    files = spark.read.format("binaryFile").load(pattern).select("path")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in HEADER.split(", ")]
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                system, place = _located(path)
                with system.open_input_stream(place, compression=None) as stream:
                    raw = stream.read(HEADER_BYTES)
                compressed = raw[:2] == b"\x1f\x8b"
                if compressed:
                    with system.open_input_stream(place, compression="gzip") as stream:
                        raw = stream.read(HEADER_BYTES)
                rows.append(parse_header(path, raw, compressed))
            if rows:
                kinds = {"code": pa.int32(), "qform_code": pa.int32(), "sform_code": pa.int32()}
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n)) for n in names], names=names)

    return files.mapInArrow(look, HEADER)


def image_grids(spark: SparkSession, pattern: str, volume_id: Column | None = None) -> DataFrame:
    """Grid rows of image files, keyed by ``path`` and, where an expression over it is given, ``volume_id``."""
    grids = read_headers(spark, pattern).select("path", "nx", "ny", "nz", "affine", "unit", "qform_code", "sform_code", F.lit(True).alias("dense"))
    return grids if volume_id is None else grids.withColumn("volume_id", volume_id)


def read_volumes(spark: SparkSession, pattern: str, channel: int = 0, keep_zero: bool = False, range_voxels: int = RANGE_VOXELS) -> DataFrame:
    """(path, i, j, k, value) of many image files, scaled as their headers say; single axes count as one voxel.

    Uncompressed files are cut into ranges of ``range_voxels``, each read by a task of its own; a task holds one batch of
    voxels at a time, also of compressed files. ``channel`` picks from a
    further axis where there is one; a channel that such an image does not have is an error.
    """
    plan = read_headers(spark, pattern).withColumn("total", F.col("nx") * F.col("ny") * F.col("nz"))
    step = F.when(F.col("compressed"), F.col("total")).otherwise(F.lit(int(range_voxels)))
    plan = plan.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, step)))
    plan = plan.withColumn("last", F.least(F.col("first") + step, F.col("total"))).drop("affine", "unit")
    # A plan row is small but its range is not: with a stated number of partitions they are not put together by size.
    plan = plan.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "first")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                picked = channel if r["channels"] > 1 else 0
                if picked >= r["channels"]:
                    raise ValueError(f"{r['path']} has {r['channels']} channels")
                kind = np.dtype((">" if r["big"] else "<") + NIFTI_TYPES[r["code"]])
                system, place = _located(r["path"])
                start = r["data_start"] + (picked * r["total"] + r["first"]) * kind.itemsize
                with (system.open_input_stream(place, compression="gzip") if r["compressed"] else system.open_input_file(place)) as stream:
                    if r["compressed"]:
                        while start:
                            start -= len(stream.read(min(start, 1 << 20))) or start
                    else:
                        stream.seek(start)
                    for first in range(r["first"], r["last"], ROWS_PER_BATCH):
                        count = min(ROWS_PER_BATCH, r["last"] - first)
                        raw = stream.read(count * kind.itemsize)
                        if len(raw) < count * kind.itemsize:
                            raise ValueError(f"{r['path']} ends early")
                        value = np.frombuffer(raw, kind).astype(float) * r["slope"] + r["intercept"]
                        at = np.arange(first, first + count)
                        if not keep_zero:
                            at, value = at[value != 0], value[value != 0]
                        yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(at), pa.string()), pa.array(at % r["nx"]), pa.array(at // r["nx"] % r["ny"]),
                                                          pa.array(at // (r["nx"] * r["ny"])), pa.array(value)], names=["path", "i", "j", "k", "value"])

    return plan.mapInArrow(decode, VOXEL_ROWS)


def write_patches(voxels: DataFrame, patches: DataFrame, grids: Grid | DataFrame, folder: str, compress: bool = True) -> DataFrame:
    """One image file per patch, ``folder/volume_<id>/patch_….nii[.gz]``, and a manifest row for each.

    ``voxels`` hold ``value``; absent ones are written as 0. A task holds one patch, which is bounded by its box. A file
    is written beside its place and then moved there, so a repeated task leaves whole files. The work is done when
    the manifest is computed: volume_id, patch_index, path, n_voxels (not 0).
    """
    from ..operators.geometry import patch_grids
    from ..operators.patches import BOX_AXES, cut_patches
    from .runs import patch_file_name

    box = [f"{a}{n}" for a in "xyz" for n in (0, 1)]
    boxes = patch_grids(patches.select("volume_id", "patch_index", *box), grid_rows(patches, grids) if isinstance(grids, Grid) else grids)
    inside = cut_patches(voxels.select("volume_id", "i", "j", "k", F.col("value").cast("double").alias("value")), patches.select("volume_id", "patch_index", *box))
    # one row per patch carries its box and name; voxels carry their place and value only
    marks = patch_file_name(boxes).select("volume_id", "patch_index", *[F.lit(None).cast("long").alias(c) for c in "ijk"], F.lit(None).cast("double").alias("value"),
                                          F.struct("volume_id", "patch_index", "name", "affine", "unit", *box).alias("box"))
    rows = marks.unionByName(inside.select("volume_id", "patch_index", "i", "j", "k", "value"), allowMissingColumns=True)

    def write(table: pa.Table) -> pa.Table:
        box = table["box"].drop_null()[0].as_py()
        shape = tuple(box[f"{a}1"] - box[f"{a}0"] for a in "xyz")
        data = np.zeros(shape, order="F")
        held = table.filter(table["i"].is_valid())
        at = tuple(held[c].to_numpy() - box[f"{a}0"] for c, a in BOX_AXES)
        data[at] = held["value"].to_numpy()
        affine = np.array(box["affine"])
        spacing = np.sqrt((affine.reshape(4, 4)[:3, :3] ** 2).sum(axis=0))
        content = image_header(shape, spacing, affine, box["unit"]) + data.tobytes(order="F")
        name = box["name"] if compress else box["name"].removesuffix(".gz")
        path = f"{folder.rstrip('/')}/volume_{box['volume_id']}/{name}"
        system, place = _located(path)
        parent, _, file = place.rpartition("/")
        system.create_dir(parent, recursive=True)
        draft = f"{parent}/.{file}.{np.random.default_rng().integers(1 << 62):x}"
        with system.open_output_stream(draft, compression=None) as stream:
            stream.write(gzip.compress(content, mtime=0) if compress else content)
        system.move(draft, place)
        return pa.table({"volume_id": [box["volume_id"]], "patch_index": [box["patch_index"]], "path": [path], "n_voxels": [int((data != 0).sum())]})

    return rows.groupBy("volume_id", "patch_index").applyInArrow(write, "volume_id long, patch_index long, path string, n_voxels long")
