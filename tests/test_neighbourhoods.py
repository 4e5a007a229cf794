"""Brute-force comparisons on small random masks and images."""

import itertools
import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from voxframe.grid import Grid
from voxframe.operators import components as cc, distance, morphology as mo, patches, ranking, regions, stats

N = 12
GRID = Grid.regular((N, N, 1))


def random_mask(seed, share):
    rng = random.Random(seed)
    return {(i, j) for i in range(N) for j in range(N) if rng.random() < share}


def pixels(df):
    return {(r.i, r.j) for r in df.collect()}


def brute_components(mask, diagonal):
    steps = [s for s in itertools.product((-1, 0, 1), repeat=2) if s != (0, 0) and (diagonal or abs(s[0]) + abs(s[1]) == 1)]
    labels = {}
    for start in sorted(mask):
        if start in labels:
            continue
        labels[start], queue = start[0] * N + start[1] + 1, deque([start])
        while queue:
            i, j = queue.popleft()
            for a, b in steps:
                nxt = (i + a, j + b)
                if nxt in mask and nxt not in labels:
                    labels[nxt] = labels[start]
                    queue.append(nxt)
    return labels


@pytest.mark.parametrize("share, diagonal", [(0.4, True), (0.6, False)])
def test_components(voxels, share, diagonal):
    mask = random_mask(5, share)
    out = cc.connected_components(voxels(mask, ""), GRID, 2, diagonal).collect()
    assert {(r.i, r.j): r.label for r in out} == brute_components(mask, diagonal)


def test_snake_is_one_component(voxels):
    snake = {(i, j) for j in range(0, N, 2) for i in range(N)} | {(N - 1 if j % 4 == 1 else 0, j) for j in range(1, N - 1, 2)}
    assert cc.connected_components(voxels(snake, ""), GRID, 2, False).select("label").distinct().count() == 1


def test_ring_is_filled_but_open_ring_is_not(voxels):
    ring = {(i, j) for i in range(2, 8) for j in range(2, 8)} - {(i, j) for i in range(3, 7) for j in range(3, 7)}
    assert len(pixels(cc.fill_holes(voxels(ring, ""), GRID))) == 36
    opened = ring - {(2, 4)}
    assert pixels(cc.fill_holes(voxels(opened, ""), GRID)) == opened


def test_morphology_duality(voxels):
    """Eroding equals removing the dilation of the complement, away from the border."""
    mask = random_mask(3, 0.8)
    outside = {(i, j) for i in range(N) for j in range(N)} - mask
    eroded = pixels(mo.erode_ball(voxels(mask, ""), 1, 2))
    grown = pixels(mo.dilate_ball(voxels(outside, ""), GRID, 1, 2))
    inner = {(i, j) for i in range(1, N - 1) for j in range(1, N - 1)}
    assert eroded & inner == (mask - grown) & inner
    assert not eroded - inner


def test_distance_transform(voxels):
    mask = random_mask(8, 0.85)
    back = [(i, j) for i in range(N) for j in range(N) if (i, j) not in mask]
    out = {(r.i, r.j): r.distance for r in distance.distance_transform(voxels(mask, ""), GRID).collect()}
    assert out.keys() == mask
    for (i, j), d in out.items():
        assert d == pytest.approx(min(math.hypot(i - a, j - b) for a, b in back))


def flood(relief, markers):
    """Sequential flood with the same arrival order."""
    import heapq

    label, done = {}, {}
    heap = [(relief[p], 0, lab, p, None) for p, lab in markers.items()]
    heapq.heapify(heap)
    while heap:
        level, steps, lab, p, _ = heapq.heappop(heap)
        if p in done:
            continue
        done[p] = (level, steps, lab)
        label[p] = lab
        for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            q = (p[0] + a, p[1] + b)
            if q in relief and q not in done and q not in markers and q not in label:
                label[q] = lab
                up = relief[q] > level
                heapq.heappush(heap, (relief[q] if up else level, 0 if up else steps + 1, lab, q, None))
    return label


def test_watershed(voxels):
    rng = random.Random(2)
    relief = {p: float(rng.randrange(6)) for p in random_mask(4, 0.85)}
    markers = {p: n + 1 for n, p in enumerate(rng.sample(sorted(relief), 6))}
    out = regions.seeded_watershed(voxels([(*p, v) for p, v in relief.items()]), voxels([(*p, v) for p, v in markers.items()], "label long"))
    assert {(r.i, r.j): r.label for r in out.collect()} == flood(relief, markers)


def test_watershed_ridge_tie(voxels):
    """Two seeds at equal distance of the middle: the smaller label takes it."""
    relief = [(i, 0, 0.0) for i in range(5)]
    out = regions.seeded_watershed(voxels(relief), voxels([(0, 0, 7), (4, 0, 3)], "label long"))
    assert [r.label for r in out.orderBy("i").collect()] == [7, 7, 3, 3, 3]


def grown_by_rings(image, markers, mask, tolerance, radius, moving):
    """Owner of every pixel when the labels grow one after the other, each in rings around its own pixels."""
    owner = dict(markers)
    for label in sorted(set(markers.values())):
        core = sorted((p for p, v in markers.items() if v == label), key=lambda p: (p[0], p[1]))
        centre = tuple(round(sum(axis) / len(core)) for axis in zip(*core))
        values = [image[p] for p in core]
        start = sum(values) / len(values)
        allowed = {p for p in mask if math.dist(p, centre) <= radius and owner.get(p, label) == label}
        ring, offered = core, set(core)
        while ring:
            following = []
            for p in ring:
                level = sum(values) / len(values) if moving else start
                if p in allowed and abs(image[p] - level) <= tolerance:
                    if p not in core:
                        owner[p] = label
                        values.append(image[p])
                    following += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            ring = [p for p in dict.fromkeys(following) if p not in offered]
            offered.update(ring)
    return owner


@pytest.mark.parametrize("moving", [True, False])
def test_region_grow(voxels, moving):
    rng = random.Random(9)
    image = {(i, j): float(rng.randrange(20)) for i in range(N) for j in range(N)}
    mask = random_mask(1, 0.8)
    markers = {p: n % 7 + 1 for n, p in enumerate(rng.sample(sorted(image), 9))}
    out = regions.region_grow(voxels([(*p, v) for p, v in image.items()]), voxels([(*p, v) for p, v in markers.items()], "label long"),
                              voxels(mask, ""), GRID, 6.0, 4, moving)
    assert {(r.i, r.j): r.label for r in out.collect()} == grown_by_rings(image, markers, mask, 6.0, 4, moving)


def test_regions_grow_without_a_call_per_marker(spark, voxels):
    """Windows that go on in the next batch are grown as a whole; every marker used to be a group of its own for Python."""
    rng = random.Random(4)
    image = {(i, j): float(rng.randrange(20)) for i in range(N) for j in range(N)}
    mask = random_mask(2, 0.8)
    markers = {p: n + 1 for n, p in enumerate(rng.sample(sorted(image), 9))}
    free = voxels([(*p, 1, v, False, p in mask) for p, v in image.items()], "label long, value double, own boolean, usable boolean")
    assert "FlatMapGroups" not in regions._spread_claims(free, 6.0)._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = regions.region_grow(voxels([(*p, v) for p, v in image.items()]), voxels([(*p, v) for p, v in markers.items()], "label long"),
                                  voxels(mask, ""), GRID, 6.0, 4)
        assert {(r.i, r.j): r.label for r in out.collect()} == grown_by_rings(image, markers, mask, 6.0, 4, True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_closing_contains_its_input_and_the_edge_is_no_boundary(voxels):
    grid, full = Grid.regular((5, 5, 1)), {(i, j) for i in range(5) for j in range(5)}
    assert pixels(mo.closing(voxels(full, ""), grid, 1, 2)) == full
    assert pixels(mo.boundary(voxels(full, ""), grid, 1, 2)) == set()
    for seed in range(3):
        mask = random_mask(seed, 0.5)
        assert mask <= pixels(mo.closing(voxels(mask, ""), GRID, 2, 2))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_smoothing_keeps_a_constant(voxels, n):
    flat = voxels([(i, 0, 10.0) for i in range(n)])
    out = mo.gaussian(flat, Grid.regular((n, 1, 1)), 2.0, "i").collect()
    assert [r.value for r in out] == pytest.approx([10.0] * n)


def test_pruned_blobs_prune_no_others(spark):
    rows = [(0, 0, 10, 2.0, 1.0), (0, 0, 12, 2.2, 1.0), (0, 0, 14, 2.4, 1.0), (0, 30, 30, 2.0, 1.0), (0, 30, 30, 2.4, 1.0)]
    blobs = spark.createDataFrame(rows, "volume_id long, i long, j long, sigma double, value double")
    kept = lambda df: {(r.i, r.j, r.sigma) for r in regions.prune_blobs(df, 2.4).collect()}
    assert kept(blobs) == {(0, 10, 2.0), (0, 14, 2.4), (30, 30, 2.4)}
    assert kept(blobs.where("j <> 12")) == kept(blobs)


def test_ranking_needs_finite_scores(spark):
    from voxframe.operators import registration

    rows = [(1, 1, float("nan"), "success"), (1, 2, 0.5, "success"), (1, 3, float("inf"), "success"), (1, 4, 0.7, "failed"), (1, 5, 0.2, "success")]
    scores = spark.createDataFrame(rows, "volume_id long, candidate long, mi double, status string")
    order = [r.candidate for r in registration.rank_candidates(scores).orderBy("rank").collect()]
    assert order[:2] == [2, 5]
    assert registration.select_candidate(scores).first().candidate == 2


def test_patch_names_begin_the_file_name(spark):
    from voxframe.sources.runs import list_patches

    names = ["patch_000001_z0-1_y0-2_x0-3.nii.gz", "old_patch_000001_z0-1_y0-2_x0-3.nii.gz", "run/patch_2_z0-1_y0-2_x0-3.nii"]
    found = list_patches(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {r.patch_index for r in found} == {1, 2}


def test_greedy_match(spark):
    rng = random.Random(6)
    rows = {(a, b): (rng.randrange(3, 11) / 10, rng.randrange(10, 14)) for a in range(8) for b in range(8) if rng.random() < 0.5}
    df = spark.createDataFrame([(0, 2, 1, a, b, n, s) for (a, b), (s, n) in rows.items()],
                               "volume_id long, patch_a long, patch_b long, label_a long, label_b long, intersection long, iomin double")
    expected, used_a, used_b = set(), set(), set()
    for s, n, a, b in sorted(((s, n, a, b) for (a, b), (s, n) in rows.items()), reverse=True):
        if a not in used_a and b not in used_b:
            expected.add((a, b))
            used_a.add(a)
            used_b.add(b)
    assert {(r.label_a, r.label_b) for r in patches.greedy_match(df).collect()} == expected


def test_quantiles_and_ranks_do_not_depend_on_partitions(spark):
    import numpy as np

    rng = random.Random(1)
    values = [float(rng.randrange(30)) for _ in range(500)]
    df = spark.createDataFrame([(0, v) for v in values], "g long, v double")
    for parts in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        row = ranking.quantiles(df, ["g"], "v", {"a": 0.01, "b": 1 / 3, "c": 0.99}).first()
        assert [row.a, row.b, row.c] == pytest.approx(list(np.quantile(values, [0.01, 1 / 3, 0.99])))
        ranks = {r.v: r["rank"] for r in ranking.average_ranks(df, ["g"], "v").collect()}
        ordered = sorted(values)
        assert ranks == {v: ordered.index(v) + (values.count(v) + 1) / 2 for v in set(values)}
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_statistics_guards(spark):
    rows = [("two", 1.0, 1.0), ("two", 2.0, 3.0), ("flat", 1.0, 5.0), ("flat", 2.0, 5.0), ("flat", 3.0, 5.0),
            *[("line", float(x), 2.0 * x + (x % 2)) for x in range(10)], ("one", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "metric string, x double, y double")
    out = {r.metric: r for r in stats.correlation_summary(df, ["metric"], "x", "y").collect()}
    assert set(out) == {"two", "flat", "line"}
    for name in ("two", "flat"):
        assert out[name].pearson_r is None and out[name].slope is None and out[name].pearson_p is None
    line = out["line"]
    assert line.slope_ci_lower < line.slope < line.slope_ci_upper
    assert line.slope_ci_upper - line.slope == pytest.approx(2.306004 * line.slope_se, rel=1e-5)


def test_blob_is_found(voxels):
    grid = Grid.regular((24, 24, 1))
    image = [(i, j, math.exp(-((i - 11) ** 2 + (j - 9) ** 2) / 8.0)) for i in range(24) for j in range(24)]
    found = regions.log_blobs(voxels(image), grid, [1.6, 1.8, 2.0, 2.2, 2.4], 0.02).collect()
    assert [(r.i, r.j) for r in found] == [(11, 9)]
    assert found[0].sigma == pytest.approx(2.0)


def test_even_boxes_are_off_centre(voxels):
    point = voxels([(5, 5)], "")
    assert pixels(mo.dilate_box(point, GRID, (2, 2, 1))) == {(4, 4), (4, 5), (5, 4), (5, 5)}
    square = voxels([(5, 5), (5, 6), (6, 5), (6, 6)], "")
    assert pixels(mo.erode_box(square, (2, 2, 1))) == {(6, 6)}


def test_dense_relabel(voxels):
    labels = voxels([(0, 0, 9), (1, 0, 4), (2, 0, 9)], "label long")
    assert {(r.i, r.label) for r in ranking.dense_relabel(labels).collect()} == {(0, 2), (1, 1), (2, 2)}
