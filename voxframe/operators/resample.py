"""Resampling of sparse voxel tables onto other grids.

The work list is a *jobs* relation: one row per output volume with the output shape,
the source shape and one 4×4 matrix from output index to source index.  Jobs meet
the source voxels block by block (``blocks``), and every block yields the output cells
that read from it, so that one huge volume is spread over the cluster.

Two edge rules: ``array`` accepts source coordinates in [0, n-1]; ``half_voxel``
accepts [-½, n-½) and clamps.  Outside is 0, that is: no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.validity import valid_metric
from ..grid import Grid, attach_grid, matrix_columns
from ..session import cut_lineage
from .blocks import PLACE, SIDE, on_blocks, placed, slots
from .geometry import inverse_affine, matrix_product

INDEX = ["i", "j", "k"]
SNAP = 1e-9
CHUNK = 1 << 16


def resample_jobs(volumes: DataFrame, source: Grid | DataFrame, target: Grid | DataFrame,
                  transform: Column | None = None, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Jobs for volumes whose output grid is ``target``; ``transform`` maps target world to source world.

    Jobs are few (one row per output volume).  They are materialised between the matrix
    steps, since nested matrix expressions would otherwise be inlined into each other.
    """
    keys = list(keys)
    if isinstance(source, Grid) and isinstance(target, Grid) and transform is None:
        matrix = matrix_columns((np.linalg.inv(source.matrix) @ target.matrix).ravel())
        out = attach_grid(attach_grid(volumes.select(*keys), source, "m"), target).drop("affine", "maffine")
        return out.withColumn("matrix", matrix)
    base = volumes.select(*keys, *([transform.alias("_t")] if transform is not None else []))
    out = attach_grid(attach_grid(cut_lineage(base), source, "m"), target)
    world = F.col("affine") if transform is None else matrix_product(F.col("_t"), F.col("affine"))
    inverse = matrix_columns(np.linalg.inv(source.matrix).ravel()) if isinstance(source, Grid) else inverse_affine(F.col("maffine"))
    out = cut_lineage(out.withColumn("_inverse", inverse).withColumn("_world", world).drop("affine", "maffine", "_t"))
    return cut_lineage(out.withColumn("matrix", matrix_product(F.col("_inverse"), F.col("_world"))).drop("_inverse", "_world"))


def target_box(matrix: np.ndarray, low: np.ndarray, high: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last output index (per axis) of the cells that can read from the source box; all of them where the matrix is close to singular."""
    linear = matrix[:3, :3]
    if np.isfinite(matrix).all() and np.linalg.cond(linear) < 1e9:
        corners = np.array([[(low, high)[n >> a & 1][a] for a in range(3)] for n in range(8)], dtype=float)
        reached = np.linalg.solve(linear, (corners - matrix[:3, 3]).T)
        first, last = np.floor(reached.min(axis=1)) - 1, np.ceil(reached.max(axis=1)) + 1
        return np.clip(first, 0, shape).astype(np.int64), np.clip(last, -1, shape - 1).astype(np.int64)
    return np.zeros(3, dtype=np.int64), shape - 1


def cells_of_block(corner, matrix, size, shape, method, edge, side=SIDE, within=None) -> Iterator[tuple[list, list, list]]:
    """Output indices, source voxels and fractions of the output cells whose lower (nearest) source voxel lies in a block, a bounded number at a time.

    ``within`` is the first and the last index per axis of the output cells that are wanted.
    """
    low = np.array(corner, dtype=float)
    first, last = target_box(matrix, low - 1.0, low + side + 1.0, shape)
    if within is not None:
        first, last = np.maximum(first, within[0]), np.minimum(last, within[1])
    n = last - first + 1
    for start in range(0, int(np.prod(np.maximum(n, 0))), CHUNK):
        flat = np.arange(start, min(start + CHUNK, int(np.prod(n))))
        index = [first[0] + flat // (n[1] * n[2]), first[1] + flat // n[2] % n[1], first[2] + flat % n[2]]
        kept, at, share = np.ones(len(flat), dtype=bool), [], []
        for row, m, begin in zip(matrix, size, corner):
            c = row[0] * index[0] + row[1] * index[1] + row[2] * index[2] + row[3]
            whole = np.rint(c)
            c = np.where(np.abs(c - whole) < SNAP, whole, c)
            if edge == "array":
                kept &= (c >= 0) & (c <= m - 1)
            else:
                kept &= (c >= -0.5) & (c < m - 0.5)
                c = np.minimum(np.maximum(c, 0.0), m - 1)
            lower = np.floor(c + 0.5 if method == "nearest" else c)
            kept &= (lower >= begin) & (lower < begin + side)
            at.append(lower - begin)
            share.append(c - lower)
        yield [x[kept] for x in index], [x[kept].astype(np.int64) for x in at], [x[kept] for x in share]


def weighted_sums(place, known, numbers, at, share) -> tuple[np.ndarray, ...]:
    """Of the eight source voxels around each output cell: how many exist, their weighted sum, their weight, how many have a value."""
    count, total, weight, sound = (np.zeros(len(at[0])) for _ in range(4))
    for end in range(8):
        up = [end >> a & 1 for a in range(3)]
        w = np.prod([s if u else 1 - s for s, u in zip(share, up)], axis=0)
        row = place[at[0] + up[0], at[1] + up[1], at[2] + up[2]]
        w = np.where(row >= 0, w, 0.0)
        with np.errstate(invalid="ignore"):
            total += np.where(w > 0, w * numbers[row], 0.0)
        weight += w
        count += w > 0
        sound += (w > 0) & known[row]
    return count, total, weight, sound


def requested(jobs: DataFrame, columns: Sequence[str], side: int = SIDE) -> DataFrame:
    """One row per job and block of its source grid; ``columns`` are kept beside the sizes and the matrix."""
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / side)))
    asked = jobs.where("mnx > 0 and mny > 0 and mnz > 0 and matrix is not null").select(*columns, "nx", "ny", "nz", "mnx", "mny", "mnz", "matrix")
    for place, n in zip(PLACE, ("mnx", "mny", "mnz")):
        asked = asked.withColumn(place, blocks(n))
    return asked


def geometry_of(requests: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, source size and output shape of a request; what is null in a matrix is NaN."""
    of = lambda name: requests.column(name)[n].as_py()
    matrix = np.array([np.nan if v is None else v for v in of("matrix")], dtype=float).reshape(4, 4)
    return matrix, np.array([of(c) for c in ("mnx", "mny", "mnz")]), np.array([of(c) for c in ("nx", "ny", "nz")])


def sample(voxels: DataFrame, jobs: DataFrame, keys: Sequence[str] = ("volume_id",), method: str = "linear",
           edge: str = "array", source_keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """(keys, i, j, k, value, weight): weighted sums over the source voxels that exist.

    ``source_keys`` are the keys that name the source volume of a job. Output cells are made where the block of their
    source voxels is, so they are never shuffled; an output cell belongs to the block of its lower (nearest) source voxel.
    """
    if edge not in ("array", "half_voxel"):
        raise ValueError(f"unknown edge rule {edge}")
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown method {method}")
    keys, source_keys = list(keys), list(source_keys)
    linear = method == "linear"
    source = voxels.select(*source_keys, *INDEX, F.col("value").cast("double") if linear else "value")
    asked = requested(jobs, keys)
    kind = "double" if linear else voxels.schema["value"].dataType.simpleString()
    schema = ", ".join([*(f"{k} {jobs.schema[k].dataType.simpleString()}" for k in keys), "i long", "j long", "k long", f"value {kind}", "weight double"])

    def prepare(corner, table):
        return slots(table, INDEX, corner, 1 if linear else 0), table["value"].combine_chunks()

    def answer(corner, state, requests):
        if state is None:
            return
        place, values = state
        known, numbers = values.is_valid().to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False) if linear else None
        numbers = np.where(known, numbers, 0.0) if linear else None
        for n in range(requests.num_rows):
            of = lambda name: requests.column(name)[n]
            matrix, size, shape = geometry_of(requests, n)
            for index, at, share in cells_of_block(corner, matrix[:3], size, shape, method, edge):
                if linear:
                    count, total, weight, sound = weighted_sums(place, known, numbers, at, share)
                    hit = count > 0
                    out = [pa.array(total[hit], mask=sound[hit] == 0), pa.array(weight[hit])]
                else:
                    row = place[at[0], at[1], at[2]]
                    hit = row >= 0
                    out = [values.take(pa.array(row[hit])), pa.array(np.ones(int(hit.sum())))]
                if hit.any():
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(of(k), int(hit.sum())) for k in keys), *(pa.array(x[hit]) for x in index), *out],
                                                     names=[*keys, *INDEX, "value", "weight"])

    reach = (-1, 0) if linear else (0, 0)
    blocks = placed(source, INDEX, *reach).where(" and ".join(f"{c} >= 0" for c in PLACE))  # no job asks for others
    return on_blocks(blocks, asked, source_keys, prepare, answer, schema)


def resample(voxels: DataFrame, source: Grid | DataFrame, target: Grid | DataFrame, method: str = "linear",
             edge: str = "array", transform: Column | None = None) -> DataFrame:
    """Voxels on the target grid (sparse: cells without support have no row)."""
    if isinstance(source, Grid) and source == target and transform is None:
        return voxels
    jobs = resample_jobs(voxels.select("volume_id").distinct(), source, target, transform)
    return sample(voxels, jobs, ["volume_id"], method, edge).drop("weight")


def resample_weighted(voxels: DataFrame, source: Grid | DataFrame, target: Grid | DataFrame, edge: str = "array",
                      minimum_weight: float = 1e-6) -> DataFrame:
    """Linear resampling that ignores invalid voxels: value over support where the nearest voxel is valid."""
    valid = voxels.where(valid_metric(F.col("value")))
    if isinstance(source, Grid) and source == target:
        return valid
    jobs = resample_jobs(voxels.select("volume_id").distinct(), source, target)
    linear = sample(valid, jobs, ["volume_id"], "linear", edge)
    nearest = sample(valid, jobs, ["volume_id"], "nearest", edge).select("volume_id", *INDEX)
    supported = linear.where(F.col("weight") > minimum_weight).join(nearest, ["volume_id", *INDEX], "left_semi")
    return supported.withColumn("value", F.col("value") / F.col("weight")).drop("weight")


# --- separable grids ---------------------------------------------------------------------------

def resample_axes(voxels: DataFrame, n_source: Sequence[int], n_target: Sequence[int], scales: Sequence[float],
                  offsets: Sequence[float], method: str = "linear", edge: str = "array") -> DataFrame:
    """Resampling with a diagonal matrix, given by its scales and offsets."""
    matrix = np.eye(4)
    matrix[range(3), range(3)], matrix[:3, 3] = scales, offsets
    sizes = {name: F.lit(int(n)).cast("long") for name, n in zip(("mnx", "mny", "mnz", "nx", "ny", "nz"), [*n_source, *n_target])}
    jobs = voxels.select("volume_id").distinct().withColumns({**sizes, "matrix": matrix_columns(matrix.ravel())})
    return sample(voxels, jobs, ["volume_id"], method, edge).drop("weight")


def resample_diagonal(voxels: DataFrame, source: Grid, target: Grid, method: str = "linear", edge: str = "array") -> DataFrame:
    """``resample`` for two constant grids without rotation between them."""
    matrix = np.linalg.inv(source.matrix) @ target.matrix
    if np.abs(matrix[:3, :3] - np.diag(np.diag(matrix[:3, :3]))).max() > 1e-12:
        raise ValueError("the grids are rotated against each other")
    return resample_axes(voxels, source.shape, target.shape, np.diag(matrix)[:3], matrix[:3, 3], method, edge)


def zoom(voxels: DataFrame, shape: Sequence[int], factors: Sequence[float], method: str = "linear") -> DataFrame:
    """End-aligned scaling by factors: output index ``o`` reads ``o·(n_in-1)/(n_out-1)``."""
    out = [max(1, int(round(n * f))) for n, f in zip(shape, factors)]
    scales = [(n - 1) / (m - 1) if m > 1 else 0.0 for n, m in zip(shape, out)]
    return resample_axes(voxels, shape, out, scales, [0.0] * 3, method, "array")


def mask_to_native(mask: DataFrame, analysis: Grid | DataFrame, native: Grid | DataFrame) -> DataFrame:
    """A mask on another grid, nearest voxel."""
    ones = mask.select("volume_id", *INDEX, F.lit(1.0).alias("value"))
    return resample(ones, analysis, native, "nearest", "array").where("value > 0.5").select("volume_id", *INDEX)


def apply_low_density(native: DataFrame, mask: DataFrame, fill: float = 0.0) -> DataFrame:
    """Set the valid native voxels under the mask to the fill value."""
    marked = mask.select("volume_id", *INDEX).withColumn("_hit", F.lit(True))
    joined = native.join(marked, ["volume_id", *INDEX], "left")
    return joined.withColumn("value", F.when(F.col("_hit") & valid_metric(F.col("value")), F.lit(float(fill))).otherwise(F.col("value"))).drop("_hit")
