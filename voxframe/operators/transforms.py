"""Spatial transforms as rows: parameter tables, chains, displacement fields, Jacobians."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..grid import Grid, IDENTITY, attach_grid, matrix_columns
from ..session import cut_lineage, keep_table
from .blocks import PLACE, SIDE, on_blocks, placed, slots
from .geometry import determinant, matrix_product
from .ranking import join_groups
from .resample import resample_jobs, sample

KEY = ["volume_id", "i", "j", "k"]


def _matrix(rows: list[list[Column]]) -> Column:
    cells = []
    for row in rows:
        cells += [c.cast("double") for c in row]
    return F.array(*cells, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def centred(linear: list[list[Column]], centre: Sequence[Column], shift: Sequence[Column] | None = None) -> Column:
    """``x → M(x-c)+c+t`` as a 4×4 matrix."""
    rows = []
    for r in range(3):
        moved = centre[r] - (linear[r][0] * centre[0] + linear[r][1] * centre[1] + linear[r][2] * centre[2])
        rows.append([*linear[r], moved if shift is None else moved + shift[r]])
    return _matrix(rows)


def _product3(a, b):
    return [[a[r][0] * b[0][c] + a[r][1] * b[1][c] + a[r][2] * b[2][c] for c in range(3)] for r in range(3)]


def roll_flip_matrices(poses: DataFrame) -> DataFrame:
    """Matrix per pose: optional flip along the long axis, then a roll about it, around the centre.

    Needs ``axis_x..z, center_x..z, flip, roll_deg``.
    """
    length = F.sqrt(F.col("axis_x") ** 2 + F.col("axis_y") ** 2 + F.col("axis_z") ** 2) + 1e-12
    df = poses.withColumns({"_x": F.col("axis_x") / length, "_y": F.col("axis_y") / length, "_z": F.col("axis_z") / length,
                            "_c": F.cos(F.radians("roll_deg")), "_s": F.sin(F.radians("roll_deg"))})
    axis = [F.col("_x"), F.col("_y"), F.col("_z")]
    cross = [[None, -axis[2], axis[1]], [axis[2], None, -axis[0]], [-axis[1], axis[0], None]]
    # Rodrigues rotation; the flip changes the component along the axis only
    along = F.when(F.col("flip"), -F.lit(1.0)).otherwise(F.lit(1.0))
    linear = []
    for r in range(3):
        row = []
        for c in range(3):
            outer = axis[r] * axis[c] * (along - F.col("_c"))
            row.append(F.col("_c") + outer if r == c else outer + F.col("_s") * cross[r][c])
        linear.append(row)
    centre = [F.col(f"center_{a}") for a in "xyz"]
    return df.withColumn("matrix", centred(linear, centre)).drop("_x", "_y", "_z", "_c", "_s")


def pose_table(axes: DataFrame, roll_step: int = 30) -> DataFrame:
    """Both flips times all rolls for every volume, numbered in search order."""
    rolls = list(range(0, 360, roll_step))
    poses = F.array(*[F.struct(F.lit(n * len(rolls) + m).cast("long").alias("candidate"), F.lit(flip).alias("flip"),
                               F.lit(float(roll)).alias("roll_deg"))
                      for n, flip in enumerate((False, True)) for m, roll in enumerate(rolls)])
    return axes.select("*", F.explode(poses).alias("_p")).select(*axes.columns, "_p.*")


def euler_matrices(params: DataFrame) -> DataFrame:
    """``Rz·Ry·Rx·F`` around a centre, then a translation.

    Needs ``rot_x..z`` (degrees), ``flip_x..z``, ``center_x..z``, ``shift_x..z``.
    """
    c = {a: F.cos(F.radians(f"rot_{a}")) for a in "xyz"}
    s = {a: F.sin(F.radians(f"rot_{a}")) for a in "xyz"}
    sign = {a: F.when(F.col(f"flip_{a}"), -F.lit(1.0)).otherwise(F.lit(1.0)) for a in "xyz"}
    zero, one = F.lit(0.0), F.lit(1.0)
    rx = [[one, zero, zero], [zero, c["x"], -s["x"]], [zero, s["x"], c["x"]]]
    ry = [[c["y"], zero, s["y"]], [zero, one, zero], [-s["y"], zero, c["y"]]]
    rz = [[c["z"], -s["z"], zero], [s["z"], c["z"], zero], [zero, zero, one]]
    turned = _product3(rz, _product3(ry, rx))
    linear = [[turned[r][n] * sign[a] for n, a in enumerate("xyz")] for r in range(3)]
    return params.withColumn("matrix", centred(linear, [F.col(f"center_{a}") for a in "xyz"], [F.col(f"shift_{a}") for a in "xyz"]))


def compose_chains(transforms: DataFrame, keys: Sequence[str] = ("chain_id",)) -> DataFrame:
    """One matrix per chain: steps are applied in ascending order. A chain has a handful of steps."""
    steps = F.sort_array(F.collect_list(F.struct("step", "matrix")))
    composed = F.aggregate(steps, matrix_columns(IDENTITY), lambda done, step: matrix_product(step["matrix"], done))
    return transforms.groupBy(*keys).agg(composed.alias("matrix"))


def apply_chain(voxels: DataFrame, chains: DataFrame, source: Grid | DataFrame, target: Grid | DataFrame,
                method: str = "linear", edge: str = "half_voxel", keys: Sequence[str] = ("volume_id",),
                source_keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Resample every volume once through the composed matrix of its chain (target world → source world).

    ``chains`` holds ``keys`` (with ``volume_id``) and ``matrix``.
    """
    jobs = resample_jobs(chains, source, target, F.col("matrix"), keys)
    return sample(voxels, jobs, keys, method, edge, source_keys).drop("weight")


def transform_points(points: DataFrame, chains: DataFrame) -> DataFrame:
    from .geometry import apply_affine

    joined = points.join(chains.select("volume_id", F.col("matrix").alias("_m")), "volume_id")
    return apply_affine(joined, F.col("_m")).drop("_m")


# --- displacement fields -----------------------------------------------------------------------

def _cubic(t: np.ndarray, n: int) -> np.ndarray:
    """Weight of control point ``n`` (0..3) of a uniform cubic B-spline at fraction ``t``."""
    if n == 0:
        return (1 - t) * (1 - t) * (1 - t) / 6.0
    if n == 1:
        return (3 * t * t * t - 6 * t * t + 4) / 6.0
    if n == 2:
        return (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6.0
    return t * t * t / 6.0


CONTROL = ["ci", "cj", "ck"]


def apply_bspline(points: DataFrame, coefficients: DataFrame, spacing: Sequence[float], origin: Sequence[float]) -> DataFrame:
    """Move points by a cubic B-spline displacement.

    ``coefficients``: ``volume_id, ci, cj, ck, dx, dy, dz`` on a control grid, one row per control point; missing control
    points count as zero. Points meet the control points of their block and of its border in one sorted pass, so neither
    is repeated for the 64 neighbours of a point.
    """
    names = points.columns
    at = [F.floor((F.col(axis) - F.lit(float(o))) / F.lit(float(s))).cast("long") for axis, s, o in zip("xyz", spacing, origin)]
    sound = F.col("volume_id").isNotNull()
    for c in "xyz":
        sound = sound & (F.abs(F.col(c)) < float("inf"))
    lost = points.where(~F.coalesce(sound, F.lit(False)))  # without a volume or a finite place they stay as they are
    asked = points.where(sound).select(F.struct(*names).alias("point"), "volume_id", *[F.col(c).cast("double").alias(f"_{c}") for c in "xyz"],
                                                                      *[F.floor(c / SIDE).cast("long").alias(place) for place, c in zip(PLACE, at)])
    control = coefficients.select("volume_id", *CONTROL, *[F.col(f"d{a}").cast("double").alias(f"d{a}") for a in "xyz"])
    control = control.join(asked.select("volume_id").distinct(), "volume_id", "left_semi")
    kind = points.select(F.struct(*names).alias("point")).schema["point"].dataType.simpleString()

    def prepare(corner, table):
        shift = np.zeros((table.num_rows + 1, 3))  # the last row stands for missing control points
        for n, a in enumerate("xyz"):
            shift[:-1, n] = np.nan_to_num(table[f"d{a}"].combine_chunks().to_numpy(zero_copy_only=False), nan=0.0)
        return slots(table, CONTROL, corner, 3, 1), shift

    def answer(corner, state, requests):
        moved = np.zeros((requests.num_rows, 3))
        if state is not None:
            place, shift = state
            u = [(requests.column(f"_{a}").to_numpy() - o) / s for a, s, o in zip("xyz", spacing, origin)]
            low = [np.floor(v) for v in u]
            weights = [[_cubic(v - l, n) for n in range(4)] for v, l in zip(u, low)]
            index = [l.astype(np.int64) - first for l, first in zip(low, corner)]
            for i in range(4):
                for j in range(4):
                    for k in range(4):
                        w = weights[0][i] * weights[1][j] * weights[2][k]
                        moved += w[:, None] * shift[place[index[0] + i, index[1] + j, index[2] + k]]
        yield pa.RecordBatch.from_arrays([requests.column("point"), *(pa.array(moved[:, n]) for n in range(3))], names=["point", "_dx", "_dy", "_dz"])

    out = on_blocks(placed(control, CONTROL, -2, 1), asked, ["volume_id"], prepare, answer, f"point {kind}, _dx double, _dy double, _dz double")
    out = out.select(*[(F.col(f"point.{c}") + F.col(f"_d{c}")).alias(c) if c in ("x", "y", "z") else F.col(f"point.{c}").alias(c) for c in names])
    return out.unionByName(lost)


def jacobian_map(field: DataFrame, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Determinant of ``x → x + d(x)`` by central differences, where all six neighbours exist.

    One window per axis, over a grid line: a voxel moves once per axis as one row, and no row is made for its neighbours.
    """
    gathered, inner = field.select(*KEY, "dx", "dy", "dz"), F.lit(True)
    for a, (axis, s) in enumerate(zip("ijk", spacing)):
        line = Window.partitionBy("volume_id", *[c for c in "ijk" if c != axis]).orderBy(axis)
        gathered = gathered.withColumns({f"n{a}": F.lead(axis).over(line) - F.lag(axis).over(line) == 2,
                                         **{f"g{d}{a}": (F.lead(f"d{d}").over(line) - F.lag(f"d{d}").over(line)) / F.lit(2.0 * float(s)) for d in "xyz"}})
        inner = inner & F.col(f"n{a}")
    rows = [[F.col(f"g{d}{a}") + (1.0 if "xyz"[a] == d else 0.0) for a in range(3)] + [F.lit(0.0)] for d in "xyz"]
    return gathered.where(inner).withColumn("_m", _matrix(rows)).select(*KEY, determinant(F.col("_m")).alias("value"))


def affine_jacobian(chains: DataFrame) -> DataFrame:
    """Constant determinant of an affine chain."""
    return chains.withColumn("determinant", determinant(F.col("matrix"))).drop("matrix")


def augmentation_parameters(volumes: DataFrame, seed: int = 42, copies: int = 4, max_rotation: float = 30.0,
                            max_shift: float = 0.2, flip_probability: float = 0.5) -> DataFrame:
    """Random poses per volume copy.

    Draws come from a hash of (seed, volume, copy, name), so they do not depend on
    partitioning and survive a lost executor.
    """
    def uniform(name: str) -> Column:
        code = F.xxhash64(F.lit(seed), F.col("volume_id"), F.col("copy"), F.lit(name))
        return F.pmod(code, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))

    rows = volumes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"))
    for a in "xyz":
        rows = rows.withColumns({
            f"rot_{a}": (uniform(f"rot_{a}") * 2 - 1) * max_rotation,
            f"shift_{a}": (uniform(f"shift_{a}") * 2 - 1) * max_shift * F.col(f"extent_{a}"),
            f"flip_{a}": uniform(f"flip_{a}") < flip_probability})
    return rows.withColumns({"scale": 0.95 + 0.1 * uniform("scale"), "bias": -0.02 + 0.04 * uniform("bias"),
                             "noise": 0.01 * uniform("noise"), "blur": 0.3 * uniform("blur")})


def blur_copies(voxels: DataFrame, sigmas: DataFrame, grid: Grid | DataFrame, axes: str = "ijk") -> DataFrame:
    """Gaussian smoothing of every (volume, copy) by its own ``sigma`` (volume_id, copy, sigma; in voxels), mirrored borders."""
    out = voxels.join(sigmas.select("volume_id", "copy", F.col("sigma").cast("double").alias("sigma")), ["volume_id", "copy"]).select(*KEY, "copy", "value", "sigma")
    return _blurred(out, grid, axes)


def _blurred(out: DataFrame, grid: Grid | DataFrame, axes: str = "ijk") -> DataFrame:
    """``blur_copies`` of rows that carry their ``sigma``."""
    from .lines import along_lines, varied_convolution
    from .morphology import gaussian_kernel

    weights = lambda sigma: [w for _, w in gaussian_kernel(sigma)] if sigma > 0 else [1.0]
    for axis in axes:
        sized = attach_grid(out, grid, "g_").select(*out.columns, F.col(f"g_n{'xyz'['ijk'.index(axis)]}").alias("n"))
        out = along_lines(sized, axis, varied_convolution(axis, weights, ("copy",)), "volume_id long, i long, j long, k long, copy long, sigma double, value double", ("copy",))
    return out.select(*KEY, "copy", "value")


def augment_volumes(voxels: DataFrame, parameters: DataFrame, grid: Grid | DataFrame, intensity: bool = False,
                    seed: int = 42) -> DataFrame:
    """Rotated, shifted and flipped copies of every volume, resampled through the inverse transform.

    With ``intensity`` each copy is then blurred, scaled and shifted, and gets noise relative to its range (0 included).
    """
    from .geometry import inverse_affine

    parameters = cut_lineage(parameters)  # one row per copy, read for the poses, the blur and the noise
    posed = euler_matrices(parameters).withColumn("matrix", inverse_affine(F.col("matrix")))
    if not intensity:
        return apply_chain(voxels, posed.select("volume_id", "copy", "matrix"), grid, grid, keys=("volume_id", "copy"))
    jobs = posed.select("volume_id", "copy", F.col("blur").cast("double").alias("sigma"), "matrix")  # the cells carry their sigma, so no join brings it
    out = apply_chain(voxels, jobs, grid, grid, keys=("volume_id", "copy", "sigma"))
    out = keep_table(_blurred(out.select(*KEY, "copy", "value", "sigma"), grid), "augmented")
    ranges = out.groupBy("volume_id", "copy").agg((F.greatest(F.max("value"), F.lit(0.0)) - F.least(F.min("value"), F.lit(0.0))).alias("_range"))
    draws = [(F.pmod(F.xxhash64(F.lit(seed), "volume_id", "copy", "i", "j", "k", F.lit(n)), F.lit(1 << 52)).cast("double") + 1)
             / F.lit(float((1 << 52) + 1)) for n in ("radius", "angle")]
    normal = F.sqrt(-2 * F.ln(draws[0])) * F.cos(2 * F.pi() * draws[1])
    joined = join_groups(out, parameters.select("volume_id", "copy", "scale", "bias", "noise").join(ranges, ["volume_id", "copy"]), ["volume_id", "copy"])
    value = F.col("value") * F.col("scale") + F.col("bias") + normal * F.col("noise") * F.greatest("_range", F.lit(1e-8))
    return joined.withColumn("value", value).drop("scale", "bias", "noise", "_range")
