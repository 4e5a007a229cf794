"""Similarity of a fixed image and a moving one under many poses, without a table of pairs.

A task meets the moving voxels of one block of the source grid and the fixed voxels of one block of the target grid, and
makes the pairs of every pose between the two, a bounded number at a time. Only counts and sums of the pairs leave it:
first the moments and a histogram, then the values in the cells of the wanted ranks, then the joint histogram. Pairs
without a moving voxel are the same for all poses, so they are counted once per volume and the others taken away.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.validity import is_finite
from ..grid import Grid, attach_grid
from ..session import cut_lineage, keep_table
from .blocks import PLACE, on_blocks, placed
from .ranking import join_groups, quantiles
from .resample import INDEX, cells_of_block, geometry_of, requested, resample_jobs, target_box, weighted_sums
from .similarity import FLAT, cells_of_ranks, quantiles_in_cells

KEYS = ["volume_id", "candidate"]
TARGET = ["fi", "fj", "fk"]
WANTED = {"lo": 0.01, "hi": 0.99}
SIDE = 64     # of a block on both grids
CELLS = 128   # of the moving image's range
AT_ONCE = 64  # poses whose counts leave a task together
PIECE = 500   # voxels of a block that go together


def between_blocks(asked: DataFrame) -> DataFrame:
    """One row per request of a source block and block of the target grid that its cells can lie in."""
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, blocks = [], []
            for n in range(batch.num_rows):
                matrix, _, shape = geometry_of(batch, n)
                low = np.array([SIDE * batch.column(c)[n].as_py() for c in PLACE], dtype=float)
                first, last = target_box(matrix[:3], low - 1.0, low + SIDE + 1.0, shape)
                found = list(product(*(range(a // SIDE, b // SIDE + 1) for a, b in zip(first.tolist(), last.tolist()))))
                blocks += found
                rows += [n] * len(found)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array([b[a] for b in blocks], pa.int64()) for a in range(3))], names=[*batch.schema.names, *TARGET])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema), *(f"{c} long" for c in TARGET)])
    return asked.mapInArrow(reach, schema)


def in_pieces(voxels: DataFrame, place: Sequence[str], reach: int = 0) -> DataFrame:
    """(volume_id, *place, cells, numbers): the voxels of a task by block, up to ``PIECE`` in a row; a cell is numbered in its block,
    which has ``reach`` further cells of the next ones on every axis.

    Voxels go to the pairs three times, and as rows of their own with their keys they take several times the room.
    """
    block = ["volume_id", *place]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turn = np.zeros(batch.num_rows, dtype=bool)
            for c in (batch.column(n) for n in range(len(block))):
                turn[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(turn | (np.arange(batch.num_rows) % PIECE == 0))
            offsets = pa.array(np.append(first, batch.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(len(block) + n)) for n in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(first)) for n in range(len(block))), *lists], names=[*block, "cells", "numbers"])

    rows = placed(voxels.dropna(subset=["volume_id"]), INDEX, -reach, 0, SIDE)
    inner, width = [F.col(c) - F.col(p) * SIDE for c, p in zip(INDEX, PLACE)], SIDE + reach
    cell = ((inner[0] * width + inner[1]) * width + inner[2]).cast("int")
    rows = rows.select("volume_id", *[F.col(p).alias(name) for p, name in zip(PLACE, place)], cell.alias("cell"), "value")
    kind = voxels.schema["volume_id"].dataType.simpleString()
    return rows.sortWithinPartitions(*block, "cell").mapInArrow(
        gather, ", ".join([f"volume_id {kind}", *(f"{p} long" for p in place), "cells array<int>", "numbers array<double>"]))


def voxels_between(fixed: DataFrame, moving: DataFrame, asked: DataFrame) -> DataFrame:
    """The voxels of both images (``in_pieces``) at every pair of blocks that some pose connects."""
    def others(here: Sequence[str], there: Sequence[str]) -> DataFrame:
        return asked.groupBy("volume_id", *here).agg(F.collect_set(F.struct(*there)).alias("_others"))

    sides = []
    for pieces, here, there in ((fixed, TARGET, PLACE), (moving, PLACE, TARGET)):
        met = join_groups(pieces, others(here, there), ["volume_id", *here]).withColumn("_other", F.explode("_others"))
        sides.append(met.select("volume_id", "cells", "numbers", *here, *[F.col(f"_other.{c}").alias(c) for c in there], F.lit(here is TARGET).alias("fixed")))
    return sides[0].unionByName(sides[1])


def tally_pairs(voxels: DataFrame, asked: DataFrame, tally: Callable, schema: str) -> DataFrame:
    """(volume_id, candidate, …) rows of ``tally(request, a, b, matched)`` over the pairs that have a moving voxel.

    ``a`` is 0 where the fixed image has no voxel (``matched`` is False there); ``request`` gives a column of the pose.
    """
    def prepare(corner, table):
        here, moving = table.filter(table["fixed"]), table.filter(pc.invert(table["fixed"]))
        if not moving.num_rows:
            return None
        flat = lambda column: pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], column.type.value_type)
        values = flat(moving["numbers"])
        known = values.is_valid().to_numpy(zero_copy_only=False)
        numbers = np.where(known, values.to_numpy(zero_copy_only=False), 0.0)
        place = np.full((SIDE + 1,) * 3, -1, dtype=np.int32)
        place[np.unravel_index(flat(moving["cells"]).to_numpy(), place.shape)] = np.arange(len(values), dtype=np.int32)
        first = [SIDE * table[c][0].as_py() for c in TARGET]
        cell = flat(here["cells"]).to_numpy().astype(np.int64)
        order = np.argsort(cell, kind="stable")
        count = np.bincount(cell, minlength=SIDE ** 3)
        return place, known, numbers, first, flat(here["numbers"]).to_numpy()[order], count, np.cumsum(count) - count

    def answer(corner, state, requests):
        if state is None:
            return
        place, known, numbers, first, fixed, count, begin = state
        requests, held = pa.RecordBatch.from_struct_array(requests.column("pose")), []
        for n in range(requests.num_rows):
            matrix, size, shape = geometry_of(requests, n)
            of = lambda name: requests.column(name)[n].as_py()
            within = (np.array(first), np.array(first) + SIDE - 1)
            for index, at, share in cells_of_block(corner, matrix[:3], size, shape, "linear", "half_voxel", SIDE, within):
                hits, total, _, _ = weighted_sums(place, known, numbers, at, share)
                hit = hits > 0
                if not hit.any():
                    continue
                b = total[hit]
                cell = ((index[0][hit] - first[0]) * SIDE + index[1][hit] - first[1]) * SIDE + index[2][hit] - first[2]
                many = np.maximum(count[cell], 1)  # repeated fixed voxels make a pair each
                start, matched = np.repeat(begin[cell], many), np.repeat(count[cell] > 0, many)
                nth = np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)
                a = np.zeros(len(start))
                a[matched] = fixed[(start + nth)[matched]]
                columns = tally(of, a, np.repeat(b, many), matched)
                if columns:
                    length = len(columns[0])
                    held.append([*(pa.repeat(requests.column(k)[n], length) for k in KEYS), *columns])
                    if len(held) == AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names=names)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names=names)

    names = [*KEYS, *(part.split()[0] for part in schema.split(", "))]
    keys = ", ".join(f"{k} {asked.schema[k].dataType.simpleString()}" for k in KEYS)
    block = ["volume_id", *TARGET, *PLACE]
    poses = asked.select(*block, F.struct("volume_id", *[c for c in asked.columns if c not in block]).alias("pose"))  # one empty column in the rows of voxels
    return on_blocks(voxels, poses, ["volume_id", *TARGET], prepare, answer, f"{keys}, {schema}", SIDE)


def _place(b: np.ndarray, first: float, last: float) -> np.ndarray:
    """Cell of the range from ``first`` to ``last``; halves, so that no difference overflows."""
    if not last / 2 > first / 2:
        return np.zeros(len(b), np.int64)
    return np.clip(np.floor((b / 2 - first / 2) / (last / 2 - first / 2) * CELLS), 0, CELLS - 1).astype(np.int64)


SUMS = ["n", "n_matched", "n_new", "n_lost", "sa", "sb", "sab", "sbb", "lost_a", "lost_aa"]


def _moments(of, a, b, matched):
    """``SUMS`` of the pairs, a and b less their shifts: usable ones, those with a finite fixed voxel, those without a fixed
    voxel, finite fixed voxels lost to a value that is not finite; and the histogram of b."""
    fa, fb = np.isfinite(a), np.isfinite(b)
    good, lost = fa & fb, fa & matched & ~fb
    da, db, la = a[good] - of("shift_a"), b[good] - of("shift_b"), a[lost] - of("shift_a")
    cell, n = np.unique(_place(b[good], of("first_b"), of("last_b")), return_counts=True)
    sums = [good.sum(), (matched & fa).sum(), (~matched).sum(), lost.sum(), da.sum(), db.sum(), (da * db).sum(), (db * db).sum(), la.sum(), (la * la).sum()]
    return [*(pa.array([float(s)]) for s in sums), pa.array([cell], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))]


def _values(of, a, b, matched):
    """Values of b in the wanted cells, and values of a that are lost, which count as -1."""
    fa, fb = np.isfinite(a), np.isfinite(b)
    cell = _place(b[fa & fb], of("first_b"), of("last_b"))
    v, n = np.unique(b[fa & fb][np.isin(cell, of("cells") or [])], return_counts=True)
    lost, m = np.unique(a[fa & matched & ~fb], return_counts=True)
    side = ["b"] * len(v) + ["a"] * len(lost)
    return [pa.array(side, pa.string()), pa.array(_place(v, of("first_b"), of("last_b")).tolist() + [0] * len(lost), pa.int64()),
            pa.array(np.concatenate((v, lost))), pa.array(np.concatenate((n, -m)))] if side else None


def _bin(x, low: float, high: float, bins: int) -> np.ndarray:
    return np.minimum(np.floor((np.minimum(np.maximum(x, low), high) - low) / (high - low) * bins), bins - 1).astype(np.int64)


def _joint(bins: int):
    """Joint bins of the pairs; every finite fixed voxel that has one is taken out of the bin where b is 0."""
    def tally(of, a, b, matched):
        limits = of("lo_a"), of("hi_a"), of("lo_b"), of("hi_b")
        if None in limits:
            return None
        fa, fb = np.isfinite(a), np.isfinite(b)
        zero = int(_bin(np.zeros(1), *limits[2:], bins)[0])
        bin_a = _bin(np.where(fa, a, 0.0), *limits[:2], bins)
        there = np.bincount(bin_a[fa & fb] * bins + _bin(b[fa & fb], *limits[2:], bins), minlength=bins * bins)
        there[np.arange(bins) * bins + zero] -= np.bincount(bin_a[fa & matched], minlength=bins)
        code = np.flatnonzero(there)
        return [pa.array([zlib.compress(np.stack((code, there[code])).astype("<i8").tobytes(), 1)], pa.binary())]

    return tally


def _information(bins: int, minimum: int):
    """MI of one pose from its parts of the joint histogram, each of at most bins² cells."""
    def merged(table: pa.Table) -> pa.Table:
        joint = np.zeros(bins * bins)
        for codes, counts in zip(table["codes"], table["counts"]):
            if codes.is_valid:
                np.add.at(joint, codes.values.to_numpy(), counts.values.to_numpy())
        for packed in table["packed"]:
            if packed.is_valid:
                codes, counts = np.frombuffer(zlib.decompress(packed.as_buffer()), "<i8").reshape(2, -1)
                joint[codes] += counts
        joint = joint.reshape(bins, bins)
        total, n_a, n_b = joint.sum(), joint.sum(1), joint.sum(0)
        x, y = np.nonzero(joint > 0)
        n = joint[x, y]
        mi = [float((n / total * np.log(n * total / (n_a[x] * n_b[y]))).sum())] if total >= minimum else [None]
        return pa.table([*(table[k].slice(0, 1) for k in KEYS), pa.array(mi, pa.float64())], names=[*KEYS, "mi"])

    return merged


def _ncc(stats: DataFrame, minimum: int) -> DataFrame:
    """NCC from the shifted sums of the pairs with a moving voxel, the moments of the fixed voxels and the zeros of all other cells."""
    all_a, n_a = F.col("fixed_n"), F.col("fixed_n") - F.col("n_lost")
    # sums of a less its shift over its usable voxels, whose mean is the shift before any is lost
    s_a, s_aa = -F.col("lost_a"), F.col("fixed_var") * all_a - F.col("lost_aa")
    n = F.col("n_all")
    sum_a, sum_b = s_a + n_a * F.col("shift_a"), F.col("sb") + F.col("n") * F.col("shift_b")
    spread_of = lambda s, ss, m, shift: ss - s * s / m + m * (1 - m / n) * (s / m + shift) ** 2  # noqa: E731  with n - m zeros
    aa = F.coalesce(spread_of(s_a, s_aa, F.nullif(n_a, F.lit(0.0)), F.col("shift_a")), F.lit(0.0))
    bb = F.coalesce(spread_of(F.col("sb"), F.col("sbb"), F.nullif(F.col("n"), F.lit(0.0)), F.col("shift_b")), F.lit(0.0))
    # sum of (a - A)(b - 0) over the pairs that have a b: A is the mean over all cells
    mean_a = sum_a / n
    ab = F.col("sab") + F.col("shift_b") * F.col("sa") + (F.col("shift_a") - mean_a) * sum_b
    spread = F.sqrt(F.greatest(aa, F.lit(0.0)) * F.greatest(bb, F.lit(0.0)))
    return F.when((n >= minimum) & (spread >= FLAT), ab / F.nullif(spread, F.lit(0.0)))


def pose_similarity(fixed: DataFrame, moving: DataFrame, poses: DataFrame, grid: Grid | DataFrame, moving_grid: Grid | DataFrame,
                    bins: int = 64, minimum: int = 100) -> DataFrame:
    """(volume_id, candidate, n, ncc, mi) of every pose (``matrix``: fixed world → moving world) of a volume with a fixed voxel.

    The moving image is resampled to the fixed grid, 0 outside; a cell without a voxel counts as 0 in either image. Rows in
    which a value is not finite don't count.
    """
    inside = attach_grid(fixed, grid, "g_").where("i >= 0 and i < g_nx and j >= 0 and j < g_ny and k >= 0 and k < g_nz")
    known = keep_table(inside.select("volume_id", *INDEX, F.coalesce("value", F.lit(0)).cast("double").alias("a")), "fixed")
    moving = keep_table(moving.select("volume_id", *INDEX, F.col("value").cast("double").alias("value")), "moving")
    usable = known.where(is_finite(F.col("a")))
    volumes = attach_grid(fixed.select("volume_id").distinct(), grid, "g_").select("volume_id", (F.col("g_nx") * F.col("g_ny") * F.col("g_nz")).alias("n_cells"))
    fixed_pieces = keep_table(in_pieces(known.withColumnRenamed("a", "value"), TARGET), "fixed-pieces")
    moving_pieces = keep_table(in_pieces(moving, PLACE, 1), "moving-pieces")
    volumes = volumes.join(known.groupBy("volume_id").agg(F.count("*").alias("rows_n")), "volume_id", "left")
    volumes = volumes.join(usable.groupBy("volume_id").agg(F.count("*").alias("fixed_n"), F.avg("a").alias("shift_a"), F.var_pop("a").alias("fixed_var")), "volume_id", "left")
    volumes = volumes.join(moving.where(is_finite(F.col("value"))).groupBy("volume_id").agg(
        F.avg("value").alias("shift_b"), F.least(F.min("value"), F.lit(0.0)).alias("first_b"), F.greatest(F.max("value"), F.lit(0.0)).alias("last_b")), "volume_id", "left")
    volumes = cut_lineage(volumes.na.fill(0).na.fill(0.0))

    jobs = resample_jobs(poses.select(*KEYS, "matrix"), moving_grid, grid, F.col("matrix"), KEYS)
    ranges = volumes.select("volume_id", "shift_a", "shift_b", "first_b", "last_b")
    asked = cut_lineage(between_blocks(requested(jobs.join(ranges, "volume_id"), [*KEYS, "shift_a", "shift_b", "first_b", "last_b"], SIDE)))
    voxels = voxels_between(fixed_pieces, moving_pieces, asked)

    # moments, and the histogram of b over the range of the moving image
    parts = cut_lineage(tally_pairs(voxels, asked, _moments, ", ".join([*(f"{c} double" for c in SUMS), "cells array<long>", "counts array<long>"])))
    names = poses.select(*KEYS).distinct().join(volumes, "volume_id")
    stats = names.join(parts.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]), KEYS, "left").na.fill(0.0, SUMS)
    stats = stats.withColumn("n_empty", F.col("n_cells") - F.col("rows_n") - F.col("n_new"))
    stats = stats.withColumns({"n_pairs": F.col("n") + F.col("fixed_n") - F.col("n_matched"), "n_zero": F.greatest("n_empty", F.lit(0.0))})
    stats = cut_lineage(stats.withColumn("n_all", F.col("n_pairs") + F.col("n_empty")).where("n_all > 0"))
    scores = stats.select(*KEYS, F.col("n_all").cast("long").alias("n"), _ncc(stats, minimum).alias("ncc"))

    # limits of b: its zeros are cells without a moving voxel
    span = F.col("last_b") / 2 - F.col("first_b") / 2
    zero = F.when(span > 0, F.greatest(F.least(F.floor(-F.col("first_b") / 2 / span * CELLS), F.lit(CELLS - 1)), F.lit(0))).otherwise(F.lit(0)).cast("long")
    zeros = stats.select(*KEYS, zero.alias("cell"), (F.col("n_pairs") - F.col("n") + F.col("n_zero")).cast("long").alias("n")).where("n > 0")
    cells = parts.select(*KEYS, F.explode(F.arrays_zip("cells", "counts")).alias("c")).select(*KEYS, F.col("c.cells").alias("cell"), F.col("c.counts").alias("n")).unionByName(zeros)
    kept = cut_lineage(cells_of_ranks(cells.groupBy(*KEYS, "cell").agg(F.sum("n").alias("n")), KEYS, WANTED))
    search = asked.join(kept.groupBy(*KEYS).agg(F.collect_set("cell").alias("cells")), KEYS, "left")
    found = keep_table(tally_pairs(voxels, search, _values, "side string, cell long, v double, n long").groupBy(*KEYS, "side", "cell", "v").agg(F.sum("n").alias("n")), "found")
    values = found.where("side = 'b'").drop("side").unionByName(zeros.select(*KEYS, "cell", F.lit(0.0).alias("v"), "n"))
    counted = values.join(kept, [*KEYS, "cell"]).groupBy(*KEYS, "cell", "_before", "_count", "v").agg(F.sum("n").alias("n"))
    limits_b = quantiles_in_cells(counted, KEYS, WANTED).toDF(*KEYS, "lo_b", "hi_b")

    # limits of a: the same for all poses of a volume, but for those that lose fixed voxels
    rows_of = lambda keys, groups: (
        join_groups(usable.select("volume_id", F.col("a").alias("v")), groups.groupBy("volume_id").agg(F.collect_set(keys[-1]).alias("_each")), ["volume_id"])
        .withColumn(keys[-1], F.explode("_each")).select(*keys, "v", F.lit(1).cast("long").alias("n")))
    added = stats.select(*KEYS, (F.col("n_pairs") - F.col("fixed_n") + F.col("n_lost") + F.col("n_zero")).cast("long").alias("n"), "n_lost")
    whole = added.where("n_lost = 0").select("volume_id", "candidate", F.col("n").alias("zeros"))
    same = usable.select("volume_id", F.col("a").alias("v"), F.lit(1).cast("long").alias("n"))
    alike = cut_lineage(whole.select("volume_id", "zeros").distinct())
    tables = join_groups(same.groupBy("volume_id", "v").agg(F.sum("n").alias("n")), alike, ["volume_id"]).unionByName(
        alike.where("zeros > 0").select("volume_id", F.lit(0.0).alias("v"), F.col("zeros").alias("n"), "zeros"))
    limits_a = whole.join(quantiles(tables, ["volume_id", "zeros"], "v", {"lo_a": 0.01, "hi_a": 0.99}, "n"), ["volume_id", "zeros"]).drop("zeros")
    losing = added.where("n_lost > 0")
    if not losing.isEmpty():
        of_pose = (rows_of(KEYS, losing).unionByName(losing.where("n > 0").select(*KEYS, F.lit(0.0).alias("v"), "n"))
                   .unionByName(found.where("side = 'a'").select(*KEYS, "v", "n")))
        limits_a = limits_a.unionByName(quantiles(of_pose, KEYS, "v", {"lo_a": 0.01, "hi_a": 0.99}, "n"))
    limits = cut_lineage(limits_a.join(limits_b, KEYS).where((F.col("hi_a") - F.col("lo_a") >= FLAT) & (F.col("hi_b") - F.col("lo_b") >= FLAT)))

    # the joint histogram
    there = tally_pairs(voxels, asked.join(limits, KEYS), _joint(bins), "packed binary")

    def bin_of(x, side: str):
        low, high = F.col(f"lo_{side}"), F.col(f"hi_{side}")
        return F.least(F.floor((F.least(F.greatest(x, low), high) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")

    ends = ["volume_id", "lo_a", "hi_a"]
    flat = join_groups(usable, limits.select(*ends).distinct().groupBy("volume_id").agg(F.collect_set(F.struct("lo_a", "hi_a")).alias("_e")), ["volume_id"])
    flat = flat.withColumn("_e", F.explode("_e")).select("volume_id", "a", "_e.*").groupBy(*ends, bin_of(F.col("a"), "a").alias("bin_a")).agg(F.count("*").alias("n"))
    flat = flat.groupBy(*ends).agg(F.collect_list(F.struct("bin_a", "n")).alias("bars"))  # at most ``bins``
    base = limits.join(flat, ends, "left").join(stats.select(*KEYS, F.col("n_zero").cast("long").alias("n_zero")), KEYS)
    bars = F.concat(F.coalesce("bars", F.array().cast("array<struct<bin_a:int,n:long>>")), F.array(F.struct(bin_of(F.lit(0.0), "a").alias("bin_a"), F.col("n_zero").alias("n"))))
    base = base.select(*KEYS, bars.alias("bars"), bin_of(F.lit(0.0), "b").alias("zero")).select(
        *KEYS, F.transform("bars", lambda x: x["bin_a"] * bins + F.col("zero")).alias("codes"), F.transform("bars", lambda x: x["n"]).alias("counts"))
    kinds = ", ".join(f"{k} {stats.schema[k].dataType.simpleString()}" for k in KEYS)
    mi = there.unionByName(base, allowMissingColumns=True).groupBy(*KEYS).applyInArrow(_information(bins, minimum), f"{kinds}, mi double")
    return scores.join(mi, KEYS, "left")
