"""Evaluation of given transforms: both scores in both scopes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.grid import Grid, IDENTITY
from voxframe.operators import ranking, registration, similarity


def test_evaluation_returns_mutual_information(spark):
    from voxframe.plans.catalog import REGISTRY

    rows = REGISTRY["evaluate_transforms"].run(spark, "/root/testdata/sf0.001").collect()
    assert {r.scope for r in rows} == {"global", "mask"} and all(r.mi is not None and r.mi >= 0 for r in rows if r.n >= 100)


def scores(a, b, bins=64):
    def binned(x):
        low, high = np.quantile(x, [0.01, 0.99])
        return np.minimum((np.clip(x, low, high) - low) / (high - low) * bins // 1, bins - 1).astype(int)

    joint = np.zeros((bins, bins))
    np.add.at(joint, (binned(a), binned(b)), 1 / len(a))
    apart = joint.sum(1, keepdims=True) * joint.sum(0)
    return (joint[joint > 0] * np.log(joint[joint > 0] / apart[joint > 0])).sum(), np.corrcoef(a, b)[0, 1]


def test_evaluate_registration_on_the_native_grid(spark, voxels):
    from voxframe.plans.workflows import evaluate_registration

    rng = np.random.default_rng(3)
    fixed = rng.integers(1, 1000, (16, 16, 8)).astype(float)
    moving = {name: rng.integers(1, 1000, (9, 9, 5)).astype(float) for name in ("B9", "MD")}
    table = lambda x: [(*at, float(v)) for at, v in np.ndenumerate(x)]
    images = None
    for name, values in moving.items():
        one = voxels(table(values), dims=3).selectExpr("*", f"'{name}' as image")
        images = one if images is None else images.unionByName(one)
    mask = voxels([r for r in table(fixed) if r[3] > 300], dims=3)
    chains = spark.createDataFrame([(0, list(IDENTITY))], "volume_id long, matrix array<double>")
    columns = [f"{m}_{scope}_{name}" for name in moving for scope in ("global", "mask") for m in ("mi", "ncc")]
    existing = spark.createDataFrame([("x", "rigid", 0, *[0.0] * 8), ("x", "affine", 1, *[0.0] * 8)],
                                     "input_image string, registration string, row_order long, " + ", ".join(f"{c} double" for c in columns))
    for registration, place, count in (("rigid", 0, 2), ("new", 2, 3)):
        runs = spark.createDataFrame([(0, "x", registration, 0)], "volume_id long, input_image string, registration string, row_order long")
        out = evaluate_registration(existing, runs, voxels(table(fixed), dims=3), mask, images, chains, Grid.regular((16, 16, 8)),
                                    Grid.regular((9, 9, 5), (2, 2, 2)), (2.0, 2.0, 2.0), list(moving)).collect()
        row = next(r for r in out if r.registration == registration)
        assert len(out) == count and row.row_order == place
        a = np.zeros((9, 9, 5))  # the last sample of each axis lies outside
        a[:8, :8, :4] = fixed[::2, ::2, ::2]
        for name, b in moving.items():
            for scope, at in (("global", a >= 0), ("mask", a > 300)):
                assert (row[f"mi_{scope}_{name}"], row[f"ncc_{scope}_{name}"]) == pytest.approx(scores(a[at], b[at]), abs=1e-8)


def test_maps_are_made_once(spark):
    """The maps were made from their source again for each of the inputs and steps, with a shuffle each."""
    from voxframe.plans.catalog import REGISTRY

    out = REGISTRY["evaluate_transforms"].run(spark, "/root/testdata/sf0.001")
    assert not [f for f in out.inputFiles() if "lineitem" in f]


def test_pairs_of_more_volumes_than_few_groups_are_not_shuffled(spark, monkeypatch):
    """Beyond 10,000 key sets all pairs were shuffled for their ends, once more for each side and cell, and for their limits."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(ranking, "FEW_GROUPS", 1)
    pairs = spark.range(0, 4000, 1, 8).selectExpr("id % 2 as g", "double(id % 101) as a", "double(id % 97) as b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = similarity.mutual_information(pairs, ["g"])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
    every = np.arange(4000)
    for r in out.collect():
        x = every[every % 2 == r.g]
        assert r.mi == pytest.approx(scores(x % 101 * 1.0, x % 97 * 1.0)[0], abs=1e-8)


def test_pairs_by_block_are_those_of_the_joins(spark, voxels):
    """Repeated, missing and null voxels, cells of the mask without any, a volume without a fixed voxel; blocks of both signs."""
    rng = np.random.default_rng(8)
    grid = Grid.regular((70, 3, 2))
    at = lambda n: [tuple(int(x) for x in rng.integers((-2, 0, 0), (72, 3, 2))) for _ in range(n)]
    fixed = voxels([(*c, None if n % 9 == 0 else float(n)) for n, c in enumerate(at(120))], dims=3).unionByName(voxels([(0, 0, 0, 5.0)], dims=3, volume=2))
    cells = lambda: sorted({(abs(i) % 70, j, k) for i, j, k in at(150)})
    moved = None
    for volume, image in ((0, "a"), (0, "b"), (1, "a"), (2, "b")):
        one = voxels([(*c, None if n % 7 == 0 else float(-n)) for n, c in enumerate(cells())], dims=3, volume=volume).withColumn("image", F.lit(image))
        moved = one if moved is None else moved.unionByName(one)
    mask = voxels([(*c,) for c in at(100)], columns="", dims=3)
    names = moved.select("volume_id", "image").distinct()
    joined = similarity.scoped(registration.sparse_pairs(fixed, moved, names, "image", grid), mask.distinct())
    pairs = registration.masked_pairs(fixed, moved, mask, names, grid)
    rows = lambda df: sorted(map(tuple, df.select("volume_id", "image", "a", "b").collect()))
    assert rows(pairs) == rows(joined.where("scope = 'global'")) and rows(pairs.where("inside")) == rows(joined.where("scope = 'mask'"))
    assert pairs.where("inside").count() > 20
