"""Grid geometry as column arithmetic over ``grids`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import half_even
from ..functions.units import unit_to_um

AXES = ("x", "y", "z")


def element(affine: Column, row: int, column: int) -> Column:
    return affine[4 * row + column]


def spacing(affine: Column) -> list[Column]:
    """Column norms of the 3×3 part."""
    return [F.sqrt(sum((element(affine, r, c) * element(affine, r, c) for r in range(3)), F.lit(0.0)))
            for c in range(3)]


def determinant(affine: Column) -> Column:
    m = lambda r, c: element(affine, r, c)
    return (m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1))
            - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0))
            + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0)))


def voxel_volume(affine: Column) -> Column:
    return F.abs(determinant(affine))


def transform_point(affine: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """``M · [x, y, z, 1]`` as three columns."""
    return [element(affine, r, 0) * x + element(affine, r, 1) * y + element(affine, r, 2) * z + element(affine, r, 3)
            for r in range(3)]


def matrix_product(left: Column, right: Column) -> Column:
    """Product of two row-major 4×4 matrices."""
    return F.array(*[
        sum((element(left, r, n) * element(right, n, c) for n in range(1, 4)), element(left, r, 0) * element(right, 0, c))
        for r in range(4) for c in range(4)])


def inverse_affine(affine: Column) -> Column:
    """Inverse of an affine matrix by the adjugate of its 3×3 part."""
    m = lambda r, c: element(affine, r, c)
    det = determinant(affine)
    rows = []
    for r in range(3):
        row = []
        for c in range(3):
            a, b = [n for n in range(3) if n != c]
            d, e = [n for n in range(3) if n != r]
            sign = 1.0 if (r + c) % 2 == 0 else -1.0
            row.append(F.lit(sign) * (m(a, d) * m(b, e) - m(a, e) * m(b, d)) / det)
        rows.append(row)
    cells = []
    for row in rows:
        shift = -(row[0] * m(0, 3) + row[1] * m(1, 3) + row[2] * m(2, 3))
        cells += [*row, shift]
    return F.array(*cells, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def apply_affine(points: DataFrame, affine: Column, source=("x", "y", "z"), target=("x", "y", "z")) -> DataFrame:
    moved = transform_point(affine, *[F.col(c) for c in source])
    return points.withColumns(dict(zip(target, moved)))


def spacing_um(affine: Column, unit: Column) -> list[Column]:
    return [s * unit_to_um(unit) for s in spacing(affine)]


def flat_index(i: Column, j: Column, k: Column, ny: Column, nz: Column) -> Column:
    """Row-major rank of a voxel."""
    return ((i.cast("long") * ny + j) * nz + k).cast("long")


def from_flat_index(flat: Column, ny: Column, nz: Column) -> list[Column]:
    return [F.floor(flat / (ny * nz)).cast("long"), F.pmod(F.floor(flat / nz), ny).cast("long"), F.pmod(flat, nz).cast("long")]


def _scaled_axes(affine: Column, factors: Sequence[Column]) -> list[list[Column]]:
    return [[element(affine, r, c) * factors[c] for c in range(3)] for r in range(3)]


def _assemble(linear: list[list[Column]], origin: list[Column]) -> Column:
    cells = []
    for r in range(3):
        cells += [*linear[r], origin[r]]
    return F.array(*[c.cast("double") for c in cells], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def target_grid(grids: DataFrame, new_spacing: Sequence[float]) -> DataFrame:
    """New spacing over the same outer edge: the first voxel starts where the old first voxel starts."""
    affine = F.col("affine")
    old = spacing(affine)
    factors = [F.lit(float(t)) / s for t, s in zip(new_spacing, old)]
    linear = _scaled_axes(affine, factors)
    edge = transform_point(affine, F.lit(-0.5), F.lit(-0.5), F.lit(-0.5))
    origin = [edge[r] + (linear[r][0] + linear[r][1] + linear[r][2]) * 0.5 for r in range(3)]
    sizes = {f"n{a}": F.greatest(half_even(F.col(f"n{a}") * s / F.lit(float(t))), F.lit(1)).cast("long")
             for a, s, t in zip(AXES, old, new_spacing)}
    return grids.withColumns({**sizes, "affine": _assemble(linear, origin)})


def upsampled_grid(grids: DataFrame, factor: int) -> DataFrame:
    """In-plane refinement by an integer factor, keeping the outer edge."""
    affine = F.col("affine")
    fine = F.lit(1.0 / factor)
    linear = _scaled_axes(affine, [fine, fine, F.lit(1.0)])
    shift = F.lit(0.5 * (1.0 - 1.0 / factor))
    origin = [element(affine, r, 3) - shift * element(affine, r, 0) - shift * element(affine, r, 1) for r in range(3)]
    return grids.withColumns({"nx": F.col("nx") * factor, "ny": F.col("ny") * factor, "affine": _assemble(linear, origin)})


def upsampled_index(c: Column, factor: int) -> Column:
    return (c + F.lit(0.5)) * F.lit(float(factor)) - F.lit(0.5)


def native_spacing_grid(fixed: DataFrame, native_spacing: Sequence[float]) -> DataFrame:
    """Fixed image extent ``(n-1)·s`` sampled at another spacing; origin and direction stay."""
    affine = F.col("affine")
    old = spacing(affine)
    factors = [F.lit(float(t)) / s for t, s in zip(native_spacing, old)]
    sizes = {f"n{a}": F.greatest(half_even((F.col(f"n{a}") - 1) * s / F.lit(float(t))) + 1, F.lit(1)).cast("long")
             for a, s, t in zip(AXES, old, native_spacing)}
    origin = [element(affine, r, 3) for r in range(3)]
    return fixed.withColumns({**sizes, "affine": _assemble(_scaled_axes(affine, factors), origin)})


def lowres_grid(fixed: DataFrame, shape: Sequence[int]) -> DataFrame:
    """A coarse grid whose first and last samples coincide with those of the fixed grid."""
    affine = F.col("affine")
    factors = [(F.col(f"n{a}") - 1).cast("double") / F.lit(float(max(n - 1, 1))) for a, n in zip(AXES, shape)]
    factors = [F.when(F.lit(n > 1) & (f > 0), f).otherwise(F.lit(1.0)) for f, n in zip(factors, shape)]
    origin = [element(affine, r, 3) for r in range(3)]
    sizes = {f"n{a}": F.lit(int(n)).cast("long") for a, n in zip(AXES, shape)}
    return fixed.withColumns({**sizes, "affine": _assemble(_scaled_axes(affine, factors), origin)})


def rebuild_mask_grid(image_grids: DataFrame, mask_grids: DataFrame) -> DataFrame:
    """Mask grid in image orientation and origin, spacing scaled by the ratio of the shapes."""
    mask = mask_grids.select("volume_id", *[F.col(f"n{a}").alias(f"m{a}") for a in AXES])
    joined = image_grids.join(mask, "volume_id")
    affine = F.col("affine")
    factors = [F.col(f"n{a}").cast("double") / F.col(f"m{a}") for a in AXES]
    origin = [element(affine, r, 3) for r in range(3)]
    return (joined.withColumn("affine", _assemble(_scaled_axes(affine, factors), origin))
            .withColumns({f"n{a}": F.col(f"m{a}") for a in AXES}).drop("mx", "my", "mz"))


def patch_grids(patches: DataFrame, grids: DataFrame) -> DataFrame:
    """Grid row of every patch: its origin is the world position of its first voxel."""
    affine = F.col("affine")
    joined = patches.join(grids.drop("nx", "ny", "nz"), "volume_id")
    origin = transform_point(affine, F.col("x0"), F.col("y0"), F.col("z0"))
    linear = [[element(affine, r, c) for c in range(3)] for r in range(3)]
    return joined.withColumns({"affine": _assemble(linear, origin), "nx": F.col("x1") - F.col("x0"),
                               "ny": F.col("y1") - F.col("y0"), "nz": F.col("z1") - F.col("z0")})


# --- orientation -----------------------------------------------------------------------------

_POSITIVE, _NEGATIVE = ("R", "A", "S"), ("L", "P", "I")


def dominant_world_axis(affine: Column, axis: int) -> Column:
    """World axis (0, 1, 2) along which array axis ``axis`` mainly runs."""
    size = [F.abs(element(affine, r, axis)) for r in range(3)]
    return (F.when((size[0] >= size[1]) & (size[0] >= size[2]), F.lit(0))
            .when(size[1] >= size[2], F.lit(1)).otherwise(F.lit(2)))


def axis_code(affine: Column, axis: int) -> Column:
    world = dominant_world_axis(affine, axis)
    result = F.when(F.lit(False), F.lit(""))
    for w in range(3):
        result = result.when((world == w) & (element(affine, w, axis) >= 0), F.lit(_POSITIVE[w]))
        result = result.when((world == w) & (element(affine, w, axis) < 0), F.lit(_NEGATIVE[w]))
    return result


def orientation_codes(affine: Column) -> Column:
    return F.concat(*[axis_code(affine, axis) for axis in range(3)])


def _pick(options: Sequence[Column], index: Column) -> Column:
    return F.when(index == 0, options[0]).when(index == 1, options[1]).otherwise(options[2])


def _source_axes(affine: Column) -> list[Column]:
    """For each world axis the array axis that runs along it."""
    dominant = [dominant_world_axis(affine, axis) for axis in range(3)]
    return [F.when(dominant[0] == w, F.lit(0)).when(dominant[1] == w, F.lit(1)).otherwise(F.lit(2)) for w in range(3)]


def reorient(voxels: DataFrame, grids: DataFrame, codes: str = "LAS") -> tuple[DataFrame, DataFrame]:
    """Permute and flip axes so that output axis ``w`` runs along world axis ``w`` in the asked direction."""
    affine = F.col("affine")
    sources = _source_axes(affine)
    sizes = [F.col(f"n{a}") for a in AXES]

    def flipped(world: int) -> Column:
        wanted = F.lit(codes[world] in _POSITIVE)
        return (_pick([element(affine, world, c) for c in range(3)], sources[world]) >= 0) != wanted

    joined = voxels.join(grids.select("volume_id", "nx", "ny", "nz", "affine"), "volume_id")
    index = {}
    for world, name in enumerate(("i", "j", "k")):
        position = _pick([F.col("i"), F.col("j"), F.col("k")], sources[world])
        length = _pick(sizes, sources[world])
        index[name] = F.when(flipped(world), length - 1 - position).otherwise(position).cast("long")
    moved = joined.withColumns(index).drop("nx", "ny", "nz", "affine")

    linear = [[None] * 3 for _ in range(3)]
    offsets = [F.lit(0.0)] * 3
    for world in range(3):
        for r in range(3):
            column = _pick([element(affine, r, c) for c in range(3)], sources[world])
            last = _pick(sizes, sources[world]) - 1
            linear[r][world] = F.when(flipped(world), -column).otherwise(column)
            offsets[r] = offsets[r] + F.when(flipped(world), column * last).otherwise(F.lit(0.0))
    origin = [element(affine, r, 3) + offsets[r] for r in range(3)]
    new_sizes = {f"n{a}": _pick(sizes, sources[w]).cast("long") for w, a in enumerate(AXES)}
    return moved, grids.withColumns({**new_sizes, "affine": _assemble(linear, origin)})


def rotate_map(points: DataFrame, rows: int, order: str = "point_id", row: str = "j", column: str = "i") -> DataFrame:
    """Quarter turn clockwise of a point table drawn as a map; later rows overwrite earlier ones."""
    turned = points.withColumns({"out_row": F.col(column).cast("long"),
                                 "out_column": (F.lit(rows - 1) - F.col(row)).cast("long")})
    return turned.groupBy("volume_id", "out_row", "out_column").agg(F.max_by("value", order).alias("value"))


# --- checks ------------------------------------------------------------------------------------

def check_geometry(left: DataFrame, right: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """One row per volume pair: shape, affine and field-of-view agreement."""
    a = left.select("volume_id", *[F.col(c).alias("a_" + c) for c in ("nx", "ny", "nz", "affine", "unit")])
    b = right.select("volume_id", *[F.col(c).alias("b_" + c) for c in ("nx", "ny", "nz", "affine", "unit")])
    joined = a.join(b, "volume_id")
    shape_ok = F.lit(True)
    for axis in AXES:
        shape_ok = shape_ok & (F.col(f"a_n{axis}") == F.col(f"b_n{axis}"))
    drift = F.greatest(*[F.abs(F.col("a_affine")[n] - F.col("b_affine")[n]) for n in range(16)])
    sa, sb = spacing_um(F.col("a_affine"), F.col("a_unit")), spacing_um(F.col("b_affine"), F.col("b_unit"))
    fov = [F.abs(F.col(f"a_n{x}") * p - F.col(f"b_n{x}") * q) for x, p, q in zip(AXES, sa, sb)]
    fov_ok = F.lit(True)
    for difference, p, q in zip(fov, sa, sb):
        fov_ok = fov_ok & (difference <= F.greatest(p, q))
    return joined.select("volume_id", shape_ok.alias("same_shape"), (drift <= tolerance).alias("same_affine"),
                         drift.alias("max_affine_difference"), F.greatest(*fov).alias("max_fov_difference_um"),
                         fov_ok.alias("fov_within_voxel"))


def audit_geometry(grids: DataFrame) -> DataFrame:
    """Extent, codes, volume and the fallback-affine flag of every grid."""
    affine = F.col("affine")
    scale = spacing_um(affine, F.col("unit"))
    extents = [((F.col(f"n{a}") - 1) * s).alias(f"extent_{a}_um") for a, s in zip(AXES, scale)]
    return grids.select(
        "volume_id", "unit", *[s.alias(f"spacing_{a}_um") for a, s in zip(AXES, scale)], *extents,
        orientation_codes(affine).alias("orientation"), voxel_volume(affine).alias("voxel_volume"),
        ((F.col("qform_code") == 0) & (F.col("sform_code") == 0)).alias("uses_fallback_affine"))
