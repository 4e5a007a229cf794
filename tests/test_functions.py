"""Hand-computed values for column functions."""

import math

import pytest
from pyspark.sql import functions as F

from voxframe.functions import rounding, units, validity
from voxframe.functions.student import t_quantile, two_sided_p
from voxframe.grid import Grid
from voxframe.operators import fibre, patches


def test_rounding_rules(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "v double")
    rows = df.select(rounding.half_even(F.col("v")), rounding.nearest_up(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [(0, 1), (2, 2), (2, 3), (0, 0)]


def test_units(spark):
    df = spark.createDataFrame([("µm",), ("mm",), ("meter",), ("Micron",)], "u string")
    assert [r[0] for r in df.select(units.unit_to_um(F.col("u"))).collect()] == [1.0, 1000.0, 1e6, 1.0]
    unknown = spark.createDataFrame([("unknown",)], "u string")
    assert unknown.select(units.unit_to_um(F.col("u"), True)).first()[0] == 1000.0
    with pytest.raises(Exception):
        unknown.select(units.unit_to_um(F.col("u"))).collect()


def test_validity(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    v = F.col("v")
    rows = df.select(validity.valid_metric(v), validity.valid_density(v), validity.nan_to_num(v)).collect()
    assert [bool(r[0]) for r in rows] == [False, True, False, False, False]
    assert [bool(r[1]) for r in rows] == [True, True, False, False, False]
    assert [r[2] for r in rows] == [0.0, 1.0, 0.0, 0.0, 0.0]


def test_student_table():
    for dof, critical in ((1, 12.7062), (10, 2.2281), (30, 2.0423), (1000, 1.9623)):
        assert t_quantile(0.975, dof) == pytest.approx(critical, abs=1e-4)
        assert two_sided_p(critical, dof) == pytest.approx(0.05, abs=1e-5)


@pytest.mark.parametrize("x, y, cells, area", [
    (2.5, 2.5, 1, math.pi * 100), (3.0, 2.5, 2, math.pi * 100), (3.0, 3.0, 4, math.pi * 100), (0.0, 2.5, 1, math.pi * 50)])
def test_circle_positions(spark, x, y, cells, area):
    """Centre of a cell, on an edge, on a corner, and half outside."""
    circles = spark.createDataFrame([(0, 1, x, y, 0.0)], "volume_id long, point_id long, x double, y double, z double")
    pairs = fibre.circle_cell_overlap(circles, Grid.regular((6, 6, 1), (50.0, 50.0, 1.0)), 10.0).collect()
    assert len(pairs) == cells
    assert sum(r.area for r in pairs) == pytest.approx(area, rel=1e-9)
    assert sum(r.arc for r in pairs) == pytest.approx(area / 5.0, rel=1e-9)


def test_circle_outside_and_wide(spark):
    circles = spark.createDataFrame([(0, 1, -0.01, 2.5, 0.0), (0, 2, 3.2, 3.1, 0.0)], "volume_id long, point_id long, x double, y double, z double")
    pairs = fibre.circle_cell_overlap(circles, Grid.regular((6, 6, 1), (10.0, 10.0, 1.0)), 17.0).collect()
    assert {r.point_id for r in pairs} == {2}
    assert sum(r.area for r in pairs) == pytest.approx(math.pi * 289, rel=1e-9)


def test_axis_starts(spark):
    def starts(n):
        grids = spark.createDataFrame([(0, n, 1, 1)], "volume_id long, nx long, ny long, nz long")
        return [r.x0 for r in patches.patch_grid(grids, (4, 4, 4), (0.3, 0.3, 0.3)).orderBy("patch_index").collect()]

    assert starts(10) == [0, 3, 6]
    assert starts(11) == [0, 3, 6, 7]
    assert starts(3) == [0]
