"""Resampling and splines block by block, against plain loops, on grids of more than one block."""

import math

import numpy as np
import pytest

from voxframe.grid import Grid
from voxframe.operators import resample as rs

SOURCE = Grid.regular((70, 35, 3), (1.0, 1.5, 2.0), (0.5, -1.0, 2.0))
TARGET = Grid((40, 30, 4), (1.7, 0.3, 0.1, 3.0, -0.2, 1.6, 0.05, 1.0, 0.02, 0.01, 1.1, 1.7, 0.0, 0.0, 0.0, 1.0))


def _plain(values, method, edge):
    matrix, out = np.linalg.inv(SOURCE.matrix) @ TARGET.matrix, {}
    for index in np.ndindex(*TARGET.shape):
        c = [float(r[0] * index[0] + r[1] * index[1] + r[2] * index[2] + r[3]) for r in matrix[:3]]
        c = [float(round(v)) if abs(v - round(v)) < 1e-9 else v for v in c]
        low, high = (0.0, -1.0) if edge == "array" else (-0.5, -0.5)
        if any(v < low or (v > n + high if edge == "array" else v >= n + high) for v, n in zip(c, SOURCE.shape)):
            continue
        c = [min(max(v, 0.0), n - 1) for v, n in zip(c, SOURCE.shape)]
        if method == "nearest":
            at = tuple(math.floor(v + 0.5) for v in c)
            if at in values:
                out[index] = values[at]
            continue
        found = [(w, values[at]) for w, at in (
            (np.prod([v - math.floor(v) if u else 1 - (v - math.floor(v)) for v, u in zip(c, up)]), tuple(math.floor(v) + u for v, u in zip(c, up)))
            for up in np.ndindex(2, 2, 2)) if w > 0 and at in values]
        if found:
            known = [w * v for w, v in found if v is not None]
            out[index] = sum(known) if known else None
    return out


@pytest.mark.parametrize("method", ["linear", "nearest"])
@pytest.mark.parametrize("edge", ["array", "half_voxel"])
def test_resampling_over_several_blocks(spark, method, edge):
    rng = np.random.default_rng(3)
    values = {tuple(int(v) for v in p): (None if rng.random() < 0.05 else float(rng.random())) for p in np.ndindex(*SOURCE.shape) if rng.random() < 0.6}
    rows = spark.createDataFrame([(7, *p, v) for p, v in values.items()], "volume_id long, i long, j long, k long, value double")
    out = rs.resample(rows, SOURCE, TARGET, method, edge)
    found = {(r.i, r.j, r.k): r.value for r in out.collect()}
    expected = _plain(values, method, edge)
    assert found.keys() == expected.keys()
    assert all((found[p] is None) == (v is None) and (v is None or abs(found[p] - v) < 1e-9) for p, v in expected.items())


def test_no_table_of_output_cells_is_joined(spark, voxels):
    """Cells made from a small table of jobs looked small to the planner, which sent them all to the driver for a broadcast."""
    rows = voxels([(i, j, k, 1.0) for i in range(3) for j in range(3) for k in range(3)], dims=3)
    out = rs.resample(rows, Grid.regular((3, 3, 3)), Grid.regular((300, 300, 300), (0.01, 0.01, 0.01)))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 201 ** 3


def test_spline_over_several_blocks(spark):
    from voxframe.operators import transforms

    rng = np.random.default_rng(4)
    control = {p: rng.normal(size=3) for p in ((int(a), int(b), int(c)) for a, b, c in rng.integers(-40, 80, (6000, 3)))}
    control.update({(a, b, c): rng.normal(size=3) for a in range(29, 37) for b in range(-4, 5) for c in range(60, 68)})
    points = [(n, float(x), float(y), float(z)) for n, (x, y, z) in enumerate([*rng.uniform(-50, 90, (300, 3)), *rng.uniform((30, -2, 61), (35, 3, 66), (200, 3))])]
    points += [(900, float("nan"), 1.0, 1.0), (901, None, 1.0, 1.0), (902, 1e6, 0.0, 0.0)]
    cubic = lambda t: [(1 - t) ** 3 / 6, (3 * t ** 3 - 6 * t ** 2 + 4) / 6, (-3 * t ** 3 + 3 * t ** 2 + 3 * t + 1) / 6, t ** 3 / 6]
    rows = spark.createDataFrame([(5, n, "name", *p) for n, *p in points], "volume_id long, point_id long, name string, x double, y double, z double")
    table = spark.createDataFrame([(5, *p, *map(float, d)) for p, d in control.items()], "volume_id long, ci long, cj long, ck long, dx double, dy double, dz double")
    out = transforms.apply_bspline(rows, table, (2.0, 1.0, 1.5), (0.5, 0.0, -1.0))
    assert out.columns == rows.columns
    found = {r.point_id: r for r in out.collect()}
    assert len(found) == len(points) and found[901].x is None and found[901].y == 1.0 and math.isnan(found[900].x)
    for n, *p in points:
        if n in (900, 901):
            continue
        u = [(v - o) / s for v, o, s in zip(p, (0.5, 0.0, -1.0), (2.0, 1.0, 1.5))]
        low, weights = [math.floor(v) for v in u], [cubic(v - math.floor(v)) for v in u]
        shift = sum((weights[0][a] * weights[1][b] * weights[2][c] * control.get((low[0] - 1 + a, low[1] - 1 + b, low[2] - 1 + c), np.zeros(3))
                     for a, b, c in np.ndindex(4, 4, 4)), np.zeros(3))
        assert np.allclose([found[n].x, found[n].y, found[n].z], p + shift, atol=1e-9)


def test_spline_repeats_no_control_point_for_its_neighbours(spark):
    """Every control point used to be copied into the neighbourhoods of 64 cells."""
    from voxframe.operators import transforms

    table = spark.range(64).selectExpr("0L as volume_id", "id % 4 as ci", "id div 4 % 4 as cj", "id div 16 as ck", "1D as dx", "2D as dy", "3D as dz")
    points = spark.range(9).selectExpr("0L as volume_id", "id / 4D + 1 as x", "1.5D as y", "1.25D as z")
    out = transforms.apply_bspline(points, table, (1.0, 1.0, 1.0), (0.0, 0.0, 0.0))
    assert out.count() == 9 and "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_grid_lines_are_not_broadcast(spark, voxels):
    from voxframe.operators import raster

    labels = voxels([(1, 1, 1), (5, 7, 2)], "label long")
    plan = raster.instance_overlay(labels, raster.grid_lines(labels, Grid.regular((48, 48, 1)), (6.25, 5.5)))
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in physical and "BroadcastHashJoin" not in physical.split("LeftAnti")[0]
    assert plan.count() == 2 + raster.grid_lines(labels, Grid.regular((48, 48, 1)), (6.25, 5.5)).count()
