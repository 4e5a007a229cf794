"""Scores of poses against those of a table of all pairs, and the room that they take."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from voxframe.grid import Grid
from voxframe.operators import posed, registration, similarity, transforms
from voxframe.session import checkpoint_root

GRID = Grid.regular((21, 7, 5), (1.0, 1.5, 2.0))
KEYS = ["volume_id", "candidate"]


def images(spark, odd):
    """Two volumes with gaps; with ``odd`` there are also repeated, outer, null and infinite values and a volume without moving voxels."""
    rows = [(v, i, j, k, float((i * 37 + j * 11 + k * 5 + v * 3) % 50)) for v in (0, 1) for i in range(21) for j in range(7) for k in range(5)]
    fixed = [r for r in rows if (r[1] + 2 * r[2] + r[0]) % 5]
    moving = [(*r[:4], r[4] * 1.5 - 20 + r[1] % 3) for r in rows if (r[1] + r[3]) % 4]
    if odd:
        fixed += [fixed[40], (0, 500, 0, 0, 7.0), (0, 2, 2, 2, None), (1, 3, 2, 2, math.inf), *[(2, i, 1, 1, float(i)) for i in range(9)]]
        moving = [(*r[:4], math.inf if n == 100 else math.nan if n == 300 else None if n == 20 else r[4]) for n, r in enumerate(moving)]
    schema = "volume_id long, i long, j long, k long, value double"
    return spark.createDataFrame(fixed, schema), spark.createDataFrame(moving, schema)


def poses_of(spark, step):
    axes = spark.createDataFrame([(v, 1.0, 0.2, 0.1, 10.0, 5.0, 4.0) for v in (0, 1, 2)],
                                 "volume_id long, axis_x double, axis_y double, axis_z double, center_x double, center_y double, center_z double")
    return transforms.roll_flip_matrices(transforms.pose_table(axes, step))


@pytest.mark.parametrize("side, odd", [(64, False), (64, True), (4, True)])
def test_scores_of_all_pairs(spark, monkeypatch, side, odd):
    monkeypatch.setattr(posed, "SIDE", side)
    fixed, moving = images(spark, odd)
    poses = poses_of(spark, 90)
    moved = transforms.apply_chain(moving, poses.select(*KEYS, "matrix"), GRID, GRID, keys=KEYS)
    names = poses.select(*KEYS).distinct()
    pairs = registration.sparse_pairs(fixed, moved, names, "candidate", GRID).select(*KEYS, "a", "b").localCheckpoint()
    empty = registration.cells_left(pairs, names, "candidate", registration.grid_cells(fixed, GRID))
    wanted = {(r.volume_id, r.candidate): r for r in similarity.similarity(pairs, KEYS, 64, empty=empty).collect()}
    got = {(r.volume_id, r.candidate): r for r in registration.score_candidates(fixed, moving, poses, GRID).collect()}
    assert set(got) == set(wanted) and len(got) == (24 if odd else 16)
    for key, row in got.items():
        assert row.n == wanted[key].n
        for c in ("ncc", "mi"):
            assert (row[c] is None) == (wanted[key][c] is None), (key, c)
            assert row[c] is None or row[c] == pytest.approx(wanted[key][c], abs=1e-9), (key, c)


def test_room_does_not_grow_with_the_poses(spark):
    """A row per pair and pose used to be stored."""
    fixed, moving = images(spark, False)
    folder = Path(checkpoint_root(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("part-*"))
    before = size()
    few = registration.score_candidates(fixed, moving, poses_of(spark, 180), GRID)
    middle = size()
    many = registration.score_candidates(fixed, moving, poses_of(spark, 10), GRID)
    rows = many.agg(F.count("*"), F.sum("n")).first()
    assert few.count() == 8 and rows[0] == 144
    assert size() - middle < rows[1] * 8, (middle - before, size() - middle)  # two numbers a pair are 16 bytes


def test_voxels_travel_in_pieces(spark, monkeypatch):
    """A row per voxel, with its place and that of both blocks, took most of the room of every pass."""
    fixed, moving = images(spark, False)
    met, tally = [], posed.tally_pairs
    monkeypatch.setattr(posed, "tally_pairs", lambda voxels, *rest: met.append(voxels) or tally(voxels, *rest))
    registration.score_candidates(fixed, moving, poses_of(spark, 90), GRID).collect()
    assert len(met) == 3
    for voxels in met:
        assert voxels.count() * 10 < fixed.count() + moving.count() == voxels.agg(F.sum(F.size("cells"))).first()[0]
