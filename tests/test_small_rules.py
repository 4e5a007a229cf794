"""Rules that single queries do not reach: missing planes, empty erosions, masked ranges, blur of copies, splines, blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.grid import Grid
from voxframe.operators import aggregate, cells, morphology as mo, patches, similarity, transforms


def test_a_map_without_plane_lies_in_plane_0(voxels):
    flat = voxels([(1, 2, 5.0)]).drop("k")
    both = similarity.align(flat, voxels([(1, 2, 0, 7.0), (1, 2, 1, 8.0)], dims=3)).collect()
    assert [(r.i, r.j, r.k, r.a, r.b) for r in both] == [(1, 2, 0, 5.0, 7.0)]


def test_an_erosion_that_leaves_nothing(voxels):
    block = voxels([(i, j) for i in range(5) for j in range(5)], "")
    thin = voxels([(0, j) for j in range(5)], "", volume=1)
    with pytest.raises(ValueError, match="eroded mask is empty"):
        mo.erode_iter(thin, 1, 2)
    core = mo.erode_iter(block.unionByName(thin), 2, 2)
    assert [(r.i, r.j) for r in core.collect()] == [(2, 2)]
    assert [r.volume_id for r in mo.emptied_volumes(block.unionByName(thin), core).collect()] == [1]


def test_range_under_a_mask(voxels):
    cut = voxels([(i, 0, float(i * i)) for i in range(10)]).withColumn("patch_index", F.lit(0))
    got = {r.i: r.value for r in patches.normalize_percentile(cut, 0.0, 1.0, voxels([(i, 0) for i in range(2, 6)] * 2, "")).collect()}
    assert got == {i: (i * i - 4) / 21 if 2 <= i < 6 else 0.0 for i in range(10)}
    assert {r.value for r in patches.normalize_percentile(cut, mask=voxels([(99, 0)], "")).collect()} == {0.0}


def test_dark_inside_only(voxels):
    got = aggregate.invert_dark(voxels([(0, 0, 0.25), (1, 0, 0.5)]), voxels([(0, 0)], "")).collect()
    assert {(r.i, r.value) for r in got} == {(0, 0.75), (1, 0.0)}


def test_blur_of_each_copy(spark, voxels):
    rng = np.random.default_rng(1)
    data = rng.random((6, 5, 4))
    rows = voxels([(*at, float(v)) for at, v in np.ndenumerate(data)], dims=3)
    copies = rows.withColumn("copy", F.explode(F.array(*[F.lit(n).cast("long") for n in range(3)])))
    sigmas = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.3), (0, 2, 1.1)], "volume_id long, copy long, sigma double")
    got = transforms.blur_copies(copies, sigmas, Grid.regular((6, 5, 4))).collect()
    for copy, sigma in ((0, 0.0), (1, 0.3), (2, 1.1)):
        wanted = data
        if sigma:
            w = np.array([v for _, v in mo.gaussian_kernel(sigma)])
            for axis in range(3):
                wanted = np.apply_along_axis(lambda line: np.convolve(np.pad(line, len(w) // 2, mode="symmetric"), w, "valid"), axis, wanted)
        found = np.zeros_like(data)
        for r in got:
            if r.copy == copy:
                found[r.i, r.j, r.k] = r.value
        assert np.allclose(found, wanted)


def test_spline_against_all_control_points(spark):
    rng = np.random.default_rng(2)
    control = {(a, b, c): rng.random(3) for a in range(-1, 6) for b in range(-1, 6) for c in range(-1, 6) if rng.random() < 0.7}
    points = [(0, n, *map(float, rng.random(3) * 12 - 1)) for n in range(40)] + [(0, 40, 1e6, 0.0, 0.0), (1, 41, 1.0, 1.0, 1.0)]
    table = spark.createDataFrame([(0, *at, *map(float, d)) for at, d in control.items()], "volume_id long, ci long, cj long, ck long, dx double, dy double, dz double")
    spacing, origin = (2.0, 3.0, 2.5), (0.5, -1.0, 0.0)
    got = {r.point_id: (r.x, r.y, r.z) for r in transforms.apply_bspline(spark.createDataFrame(points, "volume_id long, point_id long, x double, y double, z double"), table, spacing, origin).collect()}

    def basis(t):
        t = abs(t)
        return (4 - 6 * t * t + 3 * t ** 3) / 6 if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0

    for volume, number, *at in points:
        u = [(x - o) / s for x, o, s in zip(at, origin, spacing)]
        moved = np.array(at) + (sum((math.prod(basis(a - b) for a, b in zip(u, c)) * d for c, d in control.items()), np.zeros(3)) if volume == 0 else 0)
        assert got[number] == pytest.approx(moved, abs=1e-9)


@pytest.mark.parametrize("factor", [0.4, 1.0, 3.3, 5.3, 0.1])
def test_blocks(voxels, factor):
    got = {r.i: r.block_i for r in cells.block_of_voxel(voxels([(i, 0) for i in range(30)], ""), (factor, 1.0), (40, 1)).collect()}
    wanted = {i: b for b in range(40) for i in range(int(b * factor), int((b + 1) * factor)) if i < 30}
    assert got == wanted


def test_copies_are_blurred_and_scaled_without_a_shuffle_by_copy(spark):
    """The cells used to meet their sigma, their scale and their range in three joins of the whole table."""
    grid = Grid.regular((6, 5, 4))
    image = spark.createDataFrame([(v, i, j, k, float(i * j + k + v)) for v in (1, 2) for i in range(6) for j in range(5) for k in range(4)],
                                  "volume_id long, i long, j long, k long, value double")
    box = spark.createDataFrame([(v, 6.0, 5.0, 4.0, 2.5, 2.0, 1.5) for v in (1, 2)],
                                "volume_id long, extent_x double, extent_y double, extent_z double, center_x double, center_y double, center_z double")
    parameters = transforms.augmentation_parameters(box, copies=3).withColumns({"blur": F.lit(0.5), "scale": F.lit(1.0), "bias": F.lit(2.0), "noise": F.lit(0.0)})
    got = transforms.augment_volumes(image, parameters, grid, intensity=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "strategy=broadcast" in plan
    plain = transforms.augment_volumes(image, parameters, grid)
    blurred = transforms.blur_copies(plain, parameters.select("volume_id", "copy", F.col("blur").alias("sigma")), grid)
    wanted = {(r.volume_id, r["copy"], r.i, r.j, r.k): r.value + 2.0 for r in blurred.collect()}
    found = {(r.volume_id, r["copy"], r.i, r.j, r.k): r.value for r in got.collect()}
    assert len({key[:2] for key in found}) == 6 and found == pytest.approx(wanted)
