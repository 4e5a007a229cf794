"""Image files in ranges, the summary table in versions, the bucketed patch store, batches of masks."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.grid import Grid
from voxframe.operators import filters
from voxframe.sources import summary, volumes
from voxframe.streaming import patch_stream as ps

QUARTER = (0.0, 0.0, 2 ** -0.5)  # a quarter turn about z


def image(data, order="<", code=16, kind="f4", sform=None, qform=None, slope=0.0, pixdim=(1, 2, 3, 4)):
    raw = bytearray(352)
    struct.pack_into(order + "i", raw, 0, 348)
    struct.pack_into(order + "8h", raw, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into(order + "h", raw, 70, code)
    struct.pack_into(order + "8f", raw, 76, *pixdim, 1, 1, 1, 1)
    struct.pack_into(order + "3f", raw, 108, 352, slope, 1.0)
    raw[123] = 2
    struct.pack_into(order + "2h", raw, 252, int(qform is not None), int(sform is not None))
    if qform is not None:
        struct.pack_into(order + "6f", raw, 256, *qform)
    if sform is not None:
        struct.pack_into(order + "12f", raw, 280, *sform)
    return bytes(raw) + data.astype(order + kind).tobytes(order="F")


@pytest.mark.parametrize("step", [1, 5, 1000])
def test_ranges_give_the_same_voxels(spark, tmp_path, step):
    data = np.arange(1, 61, dtype=float).reshape(3, 4, 5)
    (tmp_path / "a.nii").write_bytes(image(data, ">", 4, "i2", slope=2.0))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(image(data)))
    rows = volumes.read_volumes(spark, str(tmp_path), range_voxels=step).collect()
    for name, scale in (("a.nii", lambda v: 2 * v + 1), ("b.nii.gz", lambda v: v)):
        assert {(r.i, r.j, r.k): r.value for r in rows if r.path.endswith(name)} == {at: scale(v) for at, v in np.ndenumerate(data)}
    assert len(rows) == 120


def test_a_file_is_shared_by_tasks(spark, tmp_path):
    (tmp_path / "a.nii").write_bytes(image(np.ones((10, 10, 10))))
    parts = volumes.read_volumes(spark, str(tmp_path), range_voxels=100).select(F.spark_partition_id().alias("p")).distinct()
    assert parts.count() > 1


def test_affines(spark, tmp_path):
    data = np.ones((2, 3, 4))
    (tmp_path / "s.nii").write_bytes(image(data, sform=range(12), qform=(*QUARTER, 7, 8, 9)))
    (tmp_path / "q.nii").write_bytes(image(data, qform=(*QUARTER, 7, 8, 9), pixdim=(-1, 2, 3, 4)))
    (tmp_path / "n.nii").write_bytes(image(data))
    got = {r.path.rpartition("/")[2]: np.reshape(r.affine, (4, 4)) for r in volumes.image_grids(spark, str(tmp_path)).collect()}
    assert np.allclose(got["s.nii"][:3], np.arange(12).reshape(3, 4))
    assert np.allclose(got["q.nii"], [[0, -3, 0, 7], [2, 0, 0, 8], [0, 0, -4, 9], [0, 0, 0, 1]], atol=1e-6)
    assert np.allclose(got["n.nii"], [[-2, 0, 0, 1], [0, 3, 0, -3], [0, 0, 4, -6], [0, 0, 0, 1]])


@pytest.mark.parametrize(("content", "message"), [(b"x" * 400, "no NIfTI-1"), (image(np.ones((4, 4, 4)))[:-8], "ends early"), (image(np.ones((2, 2, 2)), code=99), "data type 99")])
def test_bad_files_are_named(spark, tmp_path, content, message):
    (tmp_path / "bad.nii").write_bytes(content)
    with pytest.raises(Exception, match=f"bad.nii.*{message}"):
        volumes.read_volumes(spark, str(tmp_path)).collect()


def test_patches_come_back_and_repeat(spark, voxels, tmp_path):
    data = {(i, j, k): float(i + 10 * j + 100 * k + 1) for i in range(6) for j in range(5) for k in range(3) if (i + j) % 2}
    boxes = spark.createDataFrame([(0, 0, 0, 3, 0, 5, 0, 4), (0, 1, 0, 3, 0, 5, 3, 6), (0, 2, 0, 1, 0, 1, 0, 1)], "volume_id long, patch_index long, z0 long, z1 long, y0 long, y1 long, x0 long, x1 long")
    for _ in range(2):
        manifest = volumes.write_patches(voxels([(*at, v) for at, v in data.items()], dims=3), boxes, Grid.regular((6, 5, 3)), str(tmp_path / "out")).collect()
    assert sorted((r.patch_index, r.n_voxels > 0) for r in manifest) == [(0, True), (1, True), (2, False)]
    files = sorted(p.name for p in (tmp_path / "out").rglob("*.nii.gz"))
    assert files == ["patch_000000_z0-3_y0-5_x0-4.nii.gz", "patch_000001_z0-3_y0-5_x3-6.nii.gz", "patch_000002_z0-1_y0-1_x0-1.nii.gz"]
    rows = volumes.read_volumes(spark, str(tmp_path / "out" / "*")).where("path like '%patch_000001%'").collect()
    assert {(r.i + 3, r.j, r.k): r.value for r in rows} == {at: v for at, v in data.items() if at[0] >= 3}


def test_a_crash_before_the_commit_leaves_the_old_summary(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "summary")
    table = lambda *rows: spark.createDataFrame(rows, "run string, mi double, row_order long")
    assert summary.read_summary(spark, root) is None
    summary.upsert_stored(spark, root, table(("a", 1.0, 0), ("b", 2.0, 1)), ["run"])
    with monkeypatch.context() as broken:
        broken.setattr(summary, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            summary.upsert_stored(spark, root, table(("a", 9.0, 0)), ["run"])
    assert sorted(map(tuple, summary.read_summary(spark, root).collect())) == [("a", 1.0, 0), ("b", 2.0, 1)]
    summary.upsert_stored(spark, root, table(("b", 3.0, 0), ("c", 4.0, 1)), ["run"])
    assert sorted(map(tuple, summary.read_summary(spark, root).collect())) == [("a", 1.0, 0), ("b", 3.0, 1), ("c", 4.0, 3)]


def test_old_buckets_are_not_read(spark, tmp_path):
    incoming, store, mark = (str(tmp_path / n) for n in ("incoming", "store", "mark"))
    labels = lambda *patches: spark.createDataFrame([(0, p, i, 0, 0, 5) for p in patches for i in range(4)], ps.PATCH_LABELS)
    bucket = {r.p: r.b for r in spark.range(40).selectExpr("0L as volume_id", "id as patch_index").select(F.col("patch_index").alias("p"), ps.bucket_of(*ps.KEYS).alias("b")).collect()}
    other = next(p for p in bucket if bucket[p] != bucket[0])
    labels(0, other).write.mode("append").parquet(incoming)
    ps.stream_patch_results(spark, incoming, store, mark).awaitTermination()
    for file in (tmp_path / "store" / f"bucket={bucket[0]}").rglob("*.parquet"):
        file.write_bytes(b"spoilt")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    labels(other).write.mode("append").parquet(incoming)
    ps.stream_patch_results(spark, incoming, store, mark).awaitTermination()
    held = ps.label_counts(spark.read.schema(ps.STORED).parquet(store).where(F.col("bucket") == bucket[other])).collect()
    assert [(r.patch_index, r.voxels) for r in held] == [(other, 4)]


def test_one_bad_mask_stops_no_other(spark, voxels):
    both = voxels([(0, 0, 1.0), (1, 0, 2.0)]).unionByName(voxels([(0, 0, 3.0)], volume=1))
    grids = spark.createDataFrame([(v, 2, 1, 1, [float(x) for x in np.eye(4).ravel()], "um") for v in (0, 1)], "volume_id long, nx long, ny long, nz long, affine array<double>, unit string")
    wrong = grids.withColumn("nx", F.when(F.col("volume_id") == 1, 3).otherwise(F.col("nx")).cast("long"))
    kept, bad = filters.apply_mask_batch(both, voxels([(1, 0)], "").unionByName(voxels([(0, 0)], "", volume=1)), grids, wrong)
    assert sorted((r.volume_id, r.i, r.value) for r in kept.collect()) == [(0, 0, 0.0), (0, 1, 2.0)]
    assert [tuple(r) for r in bad.collect()] == [(1, "shape")]
