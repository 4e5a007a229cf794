"""Resampling rules, reorientation, transforms, files and plans."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.grid import Grid, grid_rows
from voxframe.operators import geometry, registration, resample as rs, transforms
from voxframe.sources import volumes


def test_edge_rules(voxels):
    """Two cells onto four: the array rule drops the outer ones, the half-voxel rule clamps them."""
    row = voxels([(0, 0, 10.0), (1, 0, 20.0)])
    fine = Grid.regular((4, 1, 1), (0.5, 1, 1), (-0.25, 0, 0))
    coarse = Grid.regular((2, 1, 1))
    values = lambda edge: {r.i: r.value for r in rs.resample(row, coarse, fine, "linear", edge).collect()}
    assert values("array") == pytest.approx({1: 12.5, 2: 17.5})
    assert values("half_voxel") == pytest.approx({0: 10.0, 1: 12.5, 2: 17.5, 3: 20.0})
    through_axes = {r.i: r.value for r in rs.resample_diagonal(row, coarse, fine, "linear", "half_voxel").collect()}
    assert through_axes == pytest.approx(values("half_voxel"))


def test_weighted_resampling_without_valid_neighbours(voxels):
    row = voxels([(0, 0, 0.0), (1, 0, float("nan")), (2, 0, 8.0), (3, 0, 6.0)])
    fine = Grid.regular((7, 1, 1), (0.5, 1, 1))
    out = {r.i: r.value for r in rs.resample_weighted(row, Grid.regular((4, 1, 1)), fine).collect()}
    assert out == pytest.approx({3: 8.0, 4: 8.0, 5: 7.0, 6: 6.0})


def test_reorient_twice_is_identity(spark, voxels):
    data = voxels([(0, 1, 2, 1.0), (3, 0, 1, 2.0)], dims=3)
    grid = Grid((4, 3, 5), (0.0, -2.0, 0.0, 7.0, 0.0, 0.0, 3.0, 1.0, 1.5, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0))
    grids = grid_rows(data, grid)
    world = lambda v, g: {tuple(np.round((np.array(m).reshape(4, 4) @ [i, j, k, 1])[:3], 9)) + (value,)
                          for i, j, k, value, m in v.join(g, "volume_id").select("i", "j", "k", "value", "affine").collect()}
    once, once_grid = geometry.reorient(data, grids, "LAS")
    assert once_grid.select(geometry.orientation_codes(F.col("affine"))).first()[0] == "LAS"
    assert world(once, once_grid) == world(data, grids)
    twice, _ = geometry.reorient(once, once_grid, "LAS")
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in once.collect()}


def test_known_transform_is_recovered(voxels):
    """A pose applied and inverted brings every interior voxel back."""
    rng = np.random.default_rng(42)
    data = voxels([(i, j, k, float(rng.integers(1, 9))) for i in range(6) for j in range(6) for k in range(6)], dims=3)
    grid = Grid.regular((6, 6, 6))
    quarter = data.select("volume_id").distinct().select("volume_id", *[F.lit(2.5).alias(f"center_{a}") for a in "xyz"],
        *[F.lit(v).alias(f"axis_{a}") for a, v in zip("xyz", (0.0, 0.0, 1.0))], F.lit(True).alias("flip"), F.lit(90.0).alias("roll_deg"))
    chain = transforms.roll_flip_matrices(quarter).select("volume_id", "matrix")
    back = chain.withColumn("matrix", geometry.inverse_affine(F.col("matrix")))
    moved = transforms.apply_chain(data, chain, grid, grid)
    restored = transforms.apply_chain(moved, back, grid, grid)
    assert {(r.i, r.j, r.k): round(r.value, 6) for r in restored.collect()} == {(r.i, r.j, r.k): r.value for r in data.collect()}


def test_jacobian_of_a_stretch(voxels):
    field = voxels([(i, j, k, 0.1 * i, 0.0, -0.5 * k) for i in range(4) for j in range(3) for k in range(3)],
                   "dx double, dy double, dz double", dims=3)
    out = transforms.jacobian_map(field).collect()
    assert len(out) == 2 and all(r.value == pytest.approx(1.1 * 0.5) for r in out)


def test_candidates(spark):
    rows = [(0, 0, 0.5, "success"), (0, 1, 0.9, "success"), (0, 2, 0.9, "success"), (0, 3, None, "failed")]
    scores = spark.createDataFrame(rows, "volume_id long, candidate long, mi double, status string")
    assert registration.select_candidate(scores).first().candidate == 1
    ranked = registration.rank_candidates(scores).orderBy("rank").collect()
    assert [r.candidate for r in ranked] == [1, 2, 0, 3]
    with pytest.raises(Exception, match="no valid candidate"):
        registration.select_candidate(scores.where("candidate = 3")).collect()


def nifti(data, slope=0.0):
    header = bytearray(352)
    struct.pack_into("<i", header, 0, 348)
    struct.pack_into("<8h", header, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<h", header, 70, 16)
    struct.pack_into("<8f", header, 76, 1, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into("<3f", header, 108, 352, slope, 1.0)
    return bytes(header) + data.astype("<f4").tobytes(order="F")


def test_read_volumes(spark, tmp_path):
    data = np.arange(24, dtype=float).reshape(2, 3, 2, 2)
    (tmp_path / "a.nii").write_bytes(nifti(data))
    (tmp_path / "b.nii").write_bytes(nifti(data[..., 0], slope=2.0))
    rows = volumes.read_volumes(spark, str(tmp_path / "*.nii"), channel=1, keep_zero=True).collect()
    first = {(r.i, r.j, r.k): r.value for r in rows if r.path.endswith("a.nii")}
    second = {(r.i, r.j, r.k): r.value for r in rows if r.path.endswith("b.nii")}
    assert first == {(i, j, k): data[i, j, k, 1] for i in range(2) for j in range(3) for k in range(2)}
    assert second[(1, 2, 1)] == data[1, 2, 1, 0] * 2 + 1


def test_errors_name_the_problem(spark):
    from voxframe.operators.filters import require_columns, require_nonempty

    df = spark.createDataFrame([], "a long")
    with pytest.raises(ValueError, match="missing columns: b"):
        require_columns(df, ["a", "b"])
    with pytest.raises(ValueError, match="points is empty"):
        require_nonempty(df, "points")


@pytest.mark.parametrize("name", ["points_to_cells", "density", "sv_map", "density_vs_metrics", "resample_diagonal", "block_label_count"])
def test_plans_have_no_bottleneck(spark, name):
    """No nested-loop join, no cross product, no single-partition exchange, and pruned scans."""
    from voxframe.plans.catalog import REGISTRY

    df = REGISTRY[name].run(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "PythonUDF"):
        assert bad not in plan, f"{bad} in the plan of {name}"
    assert "l_shipdate" not in plan and "props" not in plan
