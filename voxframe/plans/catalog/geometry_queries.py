"""Geometry, projection, point-to-grid and fibre queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ...functions.rounding import half_even
from ...functions.units import guess_unit, unit_to_um
from ...grid import Grid, attach_grid
from ...operators import aggregate, cells, fibre, filters, geometry, ranking
from ..adapters import FIBRE_GRID, FIBRE_RADIUS, IMAGE_GRID, PTS_GRID, VOX_GRID, Tables
from ..oracle_sql import compose
from .registry import query, rounded

MATRIX = [f"m{r}{c}" for r in range(3) for c in range(4)]


def with_matrix(df):
    """Replace the affine array by twelve columns."""
    columns = [F.col("affine")[4 * r + c].alias(f"m{r}{c}") for r in range(3) for c in range(4)]
    return df.select(*[c for c in df.columns if c != "affine"], *columns)


def diagonal_sql(sx, sy, sz, ox, oy, oz) -> str:
    """The twelve columns for a diagonal matrix."""
    values = [sx, "0", "0", ox, "0", sy, "0", oy, "0", "0", sz, oz]
    return ", ".join(f"round(cast({v} as double), 6) + 0.0 as {m}" for v, m in zip(values, MATRIX))


@query("unit_to_um", compose("varied_grids", """
    select volume_id, um as factor, case when abs(sx) < 4 and sy < 4 then 'mm' else 'um' end as guessed from varied_grids"""))
def _(t: Tables):
    """Micrometres per unit; the guess shown uses a quarter of the spacing."""
    sx, sy, _ = geometry.spacing(F.col("affine"))
    return t.varied_grids().select("volume_id", unit_to_um(F.col("unit")).alias("factor"),
                                   guess_unit(sx / 4, sy / 4).alias("guessed"))


@query("grid_spacing", compose("varied_grids", """
    select volume_id, round(abs(sx), 6) as sx, round(sy, 6) as sy, round(sz, 6) as sz,
           round(abs(sx * sy * sz), 6) as volume from varied_grids"""))
def _(t: Tables):
    sx, sy, sz = geometry.spacing(F.col("affine"))
    return rounded(t.varied_grids().select("volume_id", sx.alias("sx"), sy.alias("sy"), sz.alias("sz"),
                                           geometry.voxel_volume(F.col("affine")).alias("volume")))


@query("apply_affine", compose("pts varied_grids", """
    select point_id, round(sx * x + ox, 6) + 0.0 as x, round(sy * y + oy, 6) + 0.0 as y, round(sz * z + oz, 6) + 0.0 as z
    from pts join varied_grids using (volume_id)"""))
def _(t: Tables):
    """Voxel to world coordinates with the grid of each volume."""
    joined = attach_grid(t.pts(), t.varied_grids(), "g_")
    return rounded(geometry.apply_affine(joined, F.col("g_affine")).select("point_id", "x", "y", "z"))


@query("world_to_voxel", compose("pts varied_grids", """
    select point_id, round((x - ox) / sx, 6) + 0.0 as x, round((y - oy) / sy, 6) + 0.0 as y, round((z - oz) / sz, 6) + 0.0 as z
    from pts join varied_grids using (volume_id)"""))
def _(t: Tables):
    """World to voxel coordinates through the inverse affine."""
    joined = attach_grid(t.pts(), t.varied_grids(), "g_")
    return rounded(geometry.apply_affine(joined, geometry.inverse_affine(F.col("g_affine"))).select("point_id", "x", "y", "z"))


@query("points_to_cells", compose("cells", "select volume_id, point_id, i, j, k from cells"))
def _(t: Tables):
    return cells.points_to_cells(t.pts(), PTS_GRID, VOX_GRID).select("volume_id", "point_id", "i", "j", "k")


@query("points_to_cells_counters", compose("pts cells", """
    select volume_id, count(*) filter (where s) as n_in_source, count(*) filter (where not s) as n_out_source,
           count(*) filter (where s and c) as n_valid, count(*) filter (where s and not c) as n_out_target
    from (select p.volume_id, x >= -0.5 and x < 149.5 and y >= -0.5 and y < 99.5 and z >= -0.5 and z < 23.5 as s,
                 c.point_id is not null as c
          from pts p left join cells c using (point_id)) group by 1"""))
def _(t: Tables):
    assigned = cells.points_to_cells(t.pts(), PTS_GRID, VOX_GRID, keep_all=True)
    return cells.assignment_counters(assigned)


@query("points_to_cells_rint", compose("pts", """
    select point_id, cast(round_even(x / (cast(149 as double) / 49), 0) as bigint) as i,
           10 - cast(round_even(y / (cast(99 as double) / 10), 0) as bigint) as j,
           cast(round_even(z / (cast(23 as double) / 8), 0) as bigint) as k
    from pts where round_even(x / (cast(149 as double) / 49), 0) between 0 and 49
      and round_even(y / (cast(99 as double) / 10), 0) between 0 and 10
      and round_even(z / (cast(23 as double) / 8), 0) between 0 and 8"""))
def _(t: Tables):
    """End-aligned assignment with the y axis flipped."""
    return cells.points_to_cells_rint(t.pts(), PTS_GRID.shape, VOX_GRID.shape, flip_y=True).select("point_id", "i", "j", "k")


@query("alignment_ab", compose("pts", """
    select flipped, i, j, k, count(*) as n_points from (
      select f.flipped, cast(round_even(x / (cast(149 as double) / 49), 0) as bigint) as i,
           case when f.flipped then 10 - cast(round_even(y / (cast(99 as double) / 10), 0) as bigint)
                else cast(round_even(y / (cast(99 as double) / 10), 0) as bigint) end as j,
           cast(round_even(z / (cast(23 as double) / 8), 0) as bigint) as k
      from pts, (values (true), (false)) f(flipped))
    where i between 0 and 49 and j between 0 and 10 and k between 0 and 8 group by 1, 2, 3, 4"""))
def _(t: Tables):
    """Count maps with and without the y flip, over all volumes together."""
    maps = []
    for flip in (False, True):
        mapped = cells.points_to_cells_rint(t.pts(), PTS_GRID.shape, VOX_GRID.shape, flip_y=flip)
        maps.append(mapped.groupBy("i", "j", "k").agg(F.count("*").alias("n_points")).withColumn("flipped", F.lit(flip)))
    return maps[0].unionByName(maps[1])


TARGET = ("select volume_id, {n}, " + diagonal_sql("{sx}", "{sy}", "{sz}", "{ox}", "{oy}", "{oz}") + " from varied_grids")


@query("target_grid", compose("varied_grids", TARGET.format(
    n=", ".join(f"cast(greatest(round_even(n{a} * abs(s{a}) / {t}, 0), 1) as bigint) as n{a}" for a, t in zip("xyz", (3.6, 20, 44.79))),
    sx="sign(sx) * 3.6", sy="20", sz="44.79", ox="ox - sx / 2 + sign(sx) * 1.8", oy="oy - sy / 2 + 10", oz="oz - sz / 2 + 44.79 / 2")))
def _(t: Tables):
    """Grids of new spacing over the same outer edge."""
    out = geometry.target_grid(t.varied_grids(), (3.6, 20.0, 44.79))
    return rounded(with_matrix(out).select("volume_id", "nx", "ny", "nz", *MATRIX))


@query("upsampled_grid", compose("varied_grids", TARGET.format(
    n="nx * 8 as nx, ny * 8 as ny, nz", sx="sx / 8", sy="sy / 8", sz="sz",
    ox="ox - 0.4375 * sx", oy="oy - 0.4375 * sy", oz="oz")))
def _(t: Tables):
    out = geometry.upsampled_grid(t.varied_grids(), 8)
    return rounded(with_matrix(out).select("volume_id", "nx", "ny", "nz", *MATRIX))


@query("native_spacing_grid", compose("varied_grids", TARGET.format(
    n=", ".join(f"cast(greatest(round_even((n{a} - 1) * abs(s{a}) / {t}, 0) + 1, 1) as bigint) as n{a}" for a, t in zip("xyz", (1.5, 4, 7))),
    sx="sign(sx) * 1.5", sy="4", sz="7", ox="ox", oy="oy", oz="oz")))
def _(t: Tables):
    out = geometry.native_spacing_grid(t.varied_grids(), (1.5, 4.0, 7.0))
    return rounded(with_matrix(out).select("volume_id", "nx", "ny", "nz", *MATRIX))


@query("lowres_grid", compose("varied_grids", TARGET.format(
    n="cast(16 as bigint) as nx, cast(8 as bigint) as ny, cast(4 as bigint) as nz",
    sx="sx * (nx - 1) / 15", sy="sy * (ny - 1) / 7", sz="sz * (nz - 1) / 3", ox="ox", oy="oy", oz="oz")))
def _(t: Tables):
    out = geometry.lowres_grid(t.varied_grids(), (16, 8, 4))
    return rounded(with_matrix(out).select("volume_id", "nx", "ny", "nz", *MATRIX))


@query("rebuild_mask_grid", compose("varied_grids", TARGET.format(
    n="nx * 2 as nx, ny * 3 as ny, nz", sx="sx / 2", sy="sy / 3", sz="sz", ox="ox", oy="oy", oz="oz")))
def _(t: Tables):
    """Geometry of a mask that has 2 and 3 times the pixels of its image."""
    image = t.varied_grids()
    mask = image.withColumns({"nx": F.col("nx") * 2, "ny": F.col("ny") * 3})
    return rounded(with_matrix(geometry.rebuild_mask_grid(image, mask)).select("volume_id", "nx", "ny", "nz", *MATRIX))


@query("write_patches", compose("patches", """
    select volume_id, patch_index, x1 - x0 as nx, y1 - y0 as ny, z1 - z0 as nz,
           round(cast(3 as double) * x0 + 1, 6) as origin_x, round(cast(9 as double) * y0 + 2, 6) as origin_y,
           round(cast(2 as double) * z0 + 3, 6) as origin_z from patches"""))
def _(t: Tables):
    """Grid rows of patches, the origin moved to the patch start."""
    grids = t.grids(t.patches(), Grid.regular((128, 96, 1), (3.0, 9.0, 2.0), (1.0, 2.0, 3.0)))
    out = geometry.patch_grids(t.patches(), grids)
    origin = [F.col("affine")[4 * r + 3].alias(f"origin_{a}") for r, a in enumerate("xyz")]
    return rounded(out.select("volume_id", "patch_index", "nx", "ny", "nz", *origin))


@query("flat_index", compose("vox", """
    select volume_id, (i * 11 + j) * 9 + k as flat, i, j, k from vox"""))
def _(t: Tables):
    """Rank of each voxel and the index recovered from it."""
    ny, nz = F.lit(11), F.lit(9)
    flat = t.vox().select("volume_id", geometry.flat_index(F.col("i"), F.col("j"), F.col("k"), ny, nz).alias("flat"))
    i, j, k = geometry.from_flat_index(F.col("flat"), ny, nz)
    return flat.select("volume_id", "flat", i.alias("i"), j.alias("j"), k.alias("k"))


@query("densify", compose("counts", """
    select v.volume_id, cast(x.range as bigint) as i, cast(y.range as bigint) as j, cast(z.range as bigint) as k,
           coalesce(n_points, 0) as n_points
    from (select distinct volume_id from counts) v, range(50) x, range(11) y, range(9) z
    left join counts c on c.volume_id = v.volume_id and c.i = x.range and c.j = y.range and c.k = z.range"""))
def _(t: Tables):
    """Count maps with their empty cells."""
    mapped = cells.count_points(cells.points_to_cells(t.pts(), PTS_GRID, VOX_GRID))
    return cells.densify(mapped, VOX_GRID, ["n_points"])


@query("reorient", compose("vox varied_grids", """
    select v.volume_id, case when sx > 0 then nx - 1 - i else i end as i, j, k, round(value_a, 6) as value,
           round(-abs(sx), 6) as m00, round(case when sx > 0 then ox + sx * (nx - 1) else ox end, 6) + 0.0 as origin_x
    from vox v join varied_grids using (volume_id)"""))
def _(t: Tables):
    """Volumes brought to left-anterior-superior order."""
    moved, grids = geometry.reorient(t.vox_a(), t.varied_grids(), "LAS")
    geo = grids.select("volume_id", F.col("affine")[0].alias("m00"), F.col("affine")[3].alias("origin_x"))
    return rounded(moved.join(geo, "volume_id").select("volume_id", "i", "j", "k", "value", "m00", "origin_x"))


@query("rotate_map", compose("pts", """
    select volume_id, out_row, out_column, round(arg_max(y, point_id), 6) as value
    from (select volume_id, point_id, y, cast(floor(x) as bigint) as out_row, 99 - cast(floor(y) as bigint) as out_column from pts)
    group by 1, 2, 3"""))
def _(t: Tables):
    """Point table as a map turned clockwise, the last point of a cell winning."""
    points = t.pts().select("volume_id", "point_id", F.floor("x").alias("i"), F.floor("y").alias("j"), F.col("y").alias("value"))
    return rounded(geometry.rotate_map(points, 100))


@query("check_geometry", compose("varied_grids", """
    select volume_id, volume_id % 2 = 0 as same_shape, volume_id % 3 = 0 as same_affine,
           round(cast(case when volume_id % 3 = 0 then 0 else 0.25 end as double), 6) as max_affine_difference,
           round(greatest(case when volume_id % 2 = 0 then 0 else abs(sx) * um end,
                 case when volume_id % 3 = 0 then 0 else 0.25 * ny * um end), 6) as max_fov_difference_um,
           (case when volume_id % 2 = 0 then 0 else abs(sx) end <= abs(sx))
             and (case when volume_id % 3 = 0 then 0 else 0.25 * ny end <= 9.25) as fov_within_voxel
    from varied_grids"""))
def _(t: Tables):
    """Grids against a copy with one more plane in odd volumes and a wider y spacing in two of three."""
    v = F.col("volume_id")
    left = t.varied_grids()
    step = F.when(v % 3 == 0, F.lit(0.0)).otherwise(F.lit(0.25))
    cellsize = F.transform(F.col("affine"), lambda m, n: F.when(n == 5, m + step).otherwise(m))
    right = left.withColumn("nx", F.col("nx") + v % 2).withColumn("affine", cellsize)
    return rounded(geometry.check_geometry(left, right))


@query("audit_geometry", compose("varied_grids", """
    select volume_id, unit, round(abs(sx) * um, 6) as spacing_x_um, round(sy * um, 6) as spacing_y_um, round(sz * um, 6) as spacing_z_um,
           round((nx - 1) * abs(sx) * um, 6) as extent_x_um, round((ny - 1) * sy * um, 6) as extent_y_um,
           round((nz - 1) * sz * um, 6) as extent_z_um, case when sx > 0 then 'RAS' else 'LAS' end as orientation,
           round(abs(sx * sy * sz), 6) as voxel_volume, code = 0 as uses_fallback_affine
    from varied_grids"""))
def _(t: Tables):
    return rounded(geometry.audit_geometry(t.varied_grids()))


@query("count_points", compose("counts", "select * from counts"))
def _(t: Tables):
    return cells.count_points(cells.points_to_cells(t.pts(), PTS_GRID, VOX_GRID))


@query("count_conservation", compose("counts cells", """
    select c.volume_id, cast(c.total as bigint) as map_total, p.n as n_mapped, c.total = p.n as preserved
    from (select volume_id, sum(n_points) as total from counts group by 1) c
    join (select volume_id, count(*) as n from cells group by 1) p using (volume_id)"""))
def _(t: Tables):
    mapped = cells.points_to_cells(t.pts(), PTS_GRID, VOX_GRID)
    return cells.conservation(cells.count_points(mapped), mapped)


@query("density", compose("counts", """
    select volume_id, i, j, k, round(n_points / (cast(3 as double) * 9 * (cast(24 as double) / 9)) * 8000, 6) as density from counts"""))
def _(t: Tables):
    mapped = cells.count_points(cells.points_to_cells(t.pts(), PTS_GRID, VOX_GRID))
    value = cells.density(F.col("n_points"), VOX_GRID.voxel_volume)
    return rounded(mapped.select("volume_id", "i", "j", "k", value.alias("density")))


@query("unique_density", compose("counts", """
    select distinct round(n_points / (cast(3 as double) * 9 * (cast(24 as double) / 9)) * 8000, 6) as density
    from counts order by 1 limit 20"""))
def _(t: Tables):
    mapped = cells.count_points(cells.points_to_cells(t.pts(), PTS_GRID, VOX_GRID))
    value = cells.density(F.col("n_points"), VOX_GRID.voxel_volume)
    return rounded(cells.unique_density(mapped.select(value.alias("density"))))


@query("block_of_voxel", compose("labels2", """
    select volume_id, i, j, label, block_i, block_j from labels2
    join (select cast(b.range as bigint) as block_i, cast(p.range as bigint) as i from range(9) b, range(48) p
          where p.range >= floor(b.range * cast(5.3 as double)) and p.range < floor((b.range + 1) * cast(5.3 as double))) using (i)
    join (select cast(b.range as bigint) as block_j, cast(p.range as bigint) as j from range(13) b, range(48) p
          where p.range >= floor(b.range * cast(3.6 as double)) and p.range < floor((b.range + 1) * cast(3.6 as double))) using (j)"""))
def _(t: Tables):
    """Blocks of 5.3 × 3.6 pixels; pixels of the trailing partial block are dropped."""
    blocked = cells.block_of_voxel(t.labels2(), (5.3, 3.6), (9, 13))
    return blocked.select("volume_id", "i", "j", "label", "block_i", "block_j")


@query("block_label_count", compose("labels2", """
    select volume_id, cast(floor(i / cast(8 as double)) as bigint) as block_i, cast(floor(j / cast(8 as double)) as bigint) as block_j,
           count(distinct label) as n_labels, round(count(distinct label) * 2 * pi() * 12.5, 6) as surface,
           round(count(distinct label) * 2 * pi() * 12.5 / 2500, 6) as s_over_v
    from labels2 group by 1, 2, 3"""))
def _(t: Tables):
    blocked = cells.block_of_voxel(t.labels2(), (8.0, 8.0), (6, 6))
    return rounded(cells.block_label_count(blocked, 12.5, 2500.0))


# --- fibres ------------------------------------------------------------------------------------

_QUADRANT_AREA = """(case when {a} * {a} + {b} * {b} < 1 then ({sa} + {sb}) / 2 + {a} * {b} - pi() / 4
    when {a} >= 0 and {b} >= 0 then {sa} + {sb} - pi() when {a} < 0 and {b} >= 0 then {sa} when {a} >= 0 then {sb} else 0 end)"""
_QUADRANT_ARC = """(case when {a} * {a} + {b} * {b} < 1 then ({ca} + {cb}) / 2 - pi() / 2
    when {a} >= 0 and {b} >= 0 then {ca} + {cb} - 2 * pi() when {a} < 0 and {b} >= 0 then {ca} when {a} >= 0 then {cb} else 0 end)"""


def _quadrant(template: str, a: str, b: str) -> str:
    strip = lambda v: f"(asin({v}) + {v} * sqrt(greatest(1 - {v} * {v}, 0)) + pi() / 2)"
    arc = lambda v: f"(2 * asin({v}) + pi())"
    return template.format(a=a, b=b, sa=strip(a), sb=strip(b), ca=arc(a), cb=arc(b))


def _rectangle(template: str) -> str:
    q = lambda a, b: _quadrant(template, a, b)
    return f"greatest({q('u1', 'v1')} - {q('u0', 'v1')} - {q('u1', 'v0')} + {q('u0', 'v0')}, 0)"


OVERLAP = {
    "boxed": """
        select c.volume_id, point_id, cast(gx.range as bigint) as i, cast(gy.range as bigint) as j,
               greatest(least((gx.range * cast(50 as double) - x * 50) / 12.5, 1), -1) as u0,
               greatest(least(((gx.range + 1) * cast(50 as double) - x * 50) / 12.5, 1), -1) as u1,
               greatest(least((gy.range * cast(50 as double) - y * 50) / 12.5, 1), -1) as v0,
               greatest(least(((gy.range + 1) * cast(50 as double) - y * 50) / 12.5, 1), -1) as v1,
               ((x - floor(x)) * 50 < 12.5 or 50 - (x - floor(x)) * 50 < 12.5)
                 and ((y - floor(y)) * 50 < 12.5 or 50 - (y - floor(y)) * 50 < 12.5) as corner_case
        from circles c join range(150) gx on gx.range between floor((x * 50 - 12.5) / 50) and floor((x * 50 + 12.5) / 50)
        join range(100) gy on gy.range between floor((y * 50 - 12.5) / 50) and floor((y * 50 + 12.5) / 50)
        where floor(x) between 0 and 149 and floor(y) between 0 and 99""",
    "raw_pairs": f"""
        select volume_id, point_id, i, j, cast(0 as bigint) as k, corner_case,
               {_rectangle(_QUADRANT_AREA)} * 12.5 * 12.5 as a0, {_rectangle(_QUADRANT_ARC)} * 12.5 as l0 from boxed""",
    "disc_cells": """
        select volume_id, point_id, i, j, k, corner_case, cast(case when a0 > 1e-10 then a0 else 0 end as double) as area,
               cast(case when l0 > 1e-10 then l0 else 0 end as double) as arc
        from raw_pairs where a0 > 1e-10 or l0 > 1e-10""",
    "cell_sums": "select volume_id, i, j, k, sum(area) as area, sum(arc) as arc from disc_cells group by 1, 2, 3, 4",
    "assigned": """
        select c.volume_id, c.point_id, c.x, c.y, o.n_cells is not null as inside, coalesce(o.corner_case, false) as corner_case,
               coalesce(n_cells, 0) as n_cells, coalesce(area, 0) as area, coalesce(arc, 0) as arc,
               coalesce(area, 0) / (pi() * 12.5 * 12.5) as area_fraction, coalesce(arc, 0) / (2 * pi() * 12.5) as arc_fraction
        from circles c left join (select volume_id, point_id, count(*) as n_cells, sum(area) as area, sum(arc) as arc,
               bool_or(corner_case) as corner_case from disc_cells group by 1, 2) o using (volume_id, point_id)""",
}


def _overlaps(t: Tables):
    return fibre.circle_cell_overlap(t.circles(), FIBRE_GRID, FIBRE_RADIUS)


@query("circle_cell_overlap", compose("circles", """
    select volume_id, point_id, i, j, k, round(area, 5) as area, round(arc, 5) as arc, corner_case from disc_cells""", OVERLAP))
def _(t: Tables):
    """Exact overlap per circle and cell."""
    return rounded(_overlaps(t), 5)


@query("sum_overlap", compose("circles", """
    select volume_id, i, j, k, round(area, 5) as area, round(arc, 5) as arc from cell_sums""", OVERLAP))
def _(t: Tables):
    return rounded(fibre.sum_overlap(_overlaps(t)), 5)


SV_SQL = """
    select volume_id, i, j, k, round(area / (pi() * 12.5 * 12.5), 5) as area_weighted_count, round(area, 5) as fibre_area,
           round(arc, 5) as s, round(2500 - area, 5) as v,
           round(case when area > 1e-10 and 2500 - area > 1e-10 then arc / (2500 - area) else 0 end, 5) as s_over_v,
           area > 1e-10 and 2500 - area <= 1e-10 as volume_exhausted
    from cell_sums"""


@query("sv_map", compose("circles", SV_SQL, OVERLAP))
def _(t: Tables):
    """Surface, free volume and their ratio per cell."""
    return rounded(fibre.sv_map(fibre.sum_overlap(_overlaps(t)), FIBRE_GRID, FIBRE_RADIUS), 5)


@query("sv_from_s", compose("circles", """
    select volume_id, i, j, k, round_even(arc, 4) as s, cast(2500 as double) as v, round_even(arc / 2500, 6) as s_over_v
    from cell_sums""", OVERLAP))
def _(t: Tables):
    return fibre.sv_from_s(fibre.sum_overlap(_overlaps(t)).withColumnRenamed("arc", "s"), FIBRE_GRID)


SINGLE_SV_SQL = compose("circles", """
    select volume_id, i, j, k, round(case when area > 1e-10 and 2500 - area > 1e-10 then arc / (2500 - area) else 0 end / (2 * pi() * 12.5 / 2500), 5)
           as ratio_to_single, area > 1e-10 and 2500 - area <= 1e-10 as volume_exhausted
    from cell_sums""", OVERLAP)


@query("expected_single_sv_all", SINGLE_SV_SQL)
@query("expected_single_sv", SINGLE_SV_SQL)
def _(t: Tables):
    """S/V of every cell relative to that of one whole fibre in an empty cell; 0 and a flag where fibres fill the cell."""
    single = fibre.expected_single_sv(FIBRE_RADIUS, 2500.0)
    maps = fibre.sv_map(fibre.sum_overlap(_overlaps(t)), FIBRE_GRID, FIBRE_RADIUS)
    return rounded(maps.select("volume_id", "i", "j", "k", (F.col("s_over_v") / F.lit(single)).alias("ratio_to_single"), "volume_exhausted"), 5)


@query("fibre_assignments", compose("circles", """
    select volume_id, point_id, round(x, 5) as x, round(y, 5) as y, inside, corner_case, n_cells, round(area, 5) as area,
           round(arc, 5) as arc, round(area_fraction, 5) as area_fraction, round(arc_fraction, 5) as arc_fraction
    from assigned order by volume_id, point_id limit 20""", OVERLAP))
def _(t: Tables):
    """Details of the first 20 circles in file order."""
    circles = t.circles()
    return rounded(fibre.debug_rows(fibre.circle_assignments(circles, _overlaps(t), FIBRE_RADIUS)), 5)


@query("assignment_summary", compose("circles", """
    select volume_id, count(*) as n_circles, count(*) filter (where inside) as n_inside, count(*) filter (where not inside) as n_outside,
           count(*) filter (where corner_case) as n_corner, round(avg(area_fraction) filter (where inside), 6) as mean_area_fraction,
           round(avg(arc_fraction) filter (where inside), 6) as mean_arc_fraction
    from assigned group by 1""", OVERLAP))
def _(t: Tables):
    circles = t.circles()
    return rounded(fibre.assignment_summary(fibre.circle_assignments(circles, _overlaps(t), FIBRE_RADIUS)))


# --- filters and masks -------------------------------------------------------------------------

@query("slab", compose("vox varied_grids", """
    select volume_id, i, j, k from vox join varied_grids using (volume_id)
    where (i + 0.5) * abs(sx) * um / 1000 between 0.03 and 60"""))
def _(t: Tables):
    """Voxels of a sagittal slab, the axis found from the orientation."""
    return filters.slab(t.vox(), t.varied_grids(), "sagittal", (0.03, 60.0)).select("volume_id", "i", "j", "k")


@query("normalize_minmax", compose("image", """
    select volume_id, i, j, k, round((value - min(value) over (partition by volume_id))
        / (max(value) over (partition by volume_id) - min(value) over (partition by volume_id) + 1e-8), 6) as value from image"""))
def _(t: Tables):
    return rounded(aggregate.normalize_minmax(t.image()))


@query("invert_dark", compose("image", """
    select volume_id, i, j, k, round(case when value > 1200 then 1 - (value - low) / (high - low + 1e-8) else 0 end, 6) as value
    from (select *, min(value) over (partition by volume_id) as low, max(value) over (partition by volume_id) as high from image)"""))
def _(t: Tables):
    """Normalised images inverted inside a mask."""
    return rounded(aggregate.invert_dark(aggregate.normalize_minmax(t.image()), t.image().where("value > 1200")))


@query("threshold", compose("vox", "select volume_id, i, j, k from vox where value_a > 40000"))
def _(t: Tables):
    return filters.threshold(t.vox_a(), 40000.0)


@query("apply_mask", compose("vox", """
    select volume_id, i, j, k, round(case when value_a > 40000 then value_b else 0 end, 6) as value from vox"""))
def _(t: Tables):
    """The second map masked by a threshold of the first."""
    return rounded(filters.apply_mask(t.vox_b(), filters.threshold(t.vox_a(), 40000.0)))


def _mask_batch(t: Tables):
    """Masks whose grid has another shape, another origin or no row for some volumes, and no voxels for one."""
    grids = t.varied_grids()
    third = F.col("volume_id") % 5
    moved = F.transform("affine", lambda v, n: F.when((n == 3) & (third == 2), v + 1).otherwise(v))
    other = grids.where(third != 3).withColumns({"nx": F.when(third == 1, F.col("nx") + 1).otherwise(F.col("nx")), "affine": moved})
    mask = filters.threshold(t.vox_a(), 40000.0).where(third != 4)
    return filters.apply_mask_batch(t.vox_b(), mask, grids, other)


@query("apply_mask_batch", compose("vox", """
    select volume_id, i, j, k, round(case when value_a > 40000 then value_b else 0 end, 6) as value from vox where volume_id % 5 = 0"""))
def _(t: Tables):
    """A batch of masked maps without those whose mask does not fit."""
    return rounded(_mask_batch(t)[0])


@query("mask_violations", compose("vox", """
    select distinct volume_id, case volume_id % 5 when 1 then 'shape' when 2 then 'affine' when 3 then 'no grid' else 'empty mask' end as reason from vox where volume_id % 5 <> 0"""))
def _(t: Tables):
    """One row per map whose mask does not fit."""
    return _mask_batch(t)[1]


@query("apply_mask_check", compose("vox", """
    select volume_id, cast(0 as double) as max_change_inside, cast(0 as double) as max_left_outside from vox group by 1"""))
def _(t: Tables):
    """Post-check of masking: unchanged inside, zero outside."""
    mask = filters.threshold(t.vox_a(), 40000.0)
    return filters.mask_check(t.vox_b(), filters.apply_mask(t.vox_b(), mask), mask)


@query("mask_algebra", compose("vox", """
    select op, volume_id, count(*) as n from (
        select 'and' as op, volume_id from vox where value_a > 40000 and value_b > 36000
        union all select 'or', volume_id from vox where value_a > 40000 or value_b > 36000
        union all select 'and_not', volume_id from vox where value_a > 40000 and not value_b > 36000) group by 1, 2"""))
def _(t: Tables):
    a, b = filters.threshold(t.vox_a(), 40000.0), filters.threshold(t.vox_b(), 36000.0)
    parts = [("and", filters.mask_and(a, b)), ("or", filters.mask_or(a, b)), ("and_not", filters.mask_and_not(a, b))]
    out = None
    for name, mask in parts:
        counted = mask.groupBy("volume_id").agg(F.count("*").alias("n")).withColumn("op", F.lit(name))
        out = counted if out is None else out.unionByName(counted)
    return out


@query("area_between", compose("labels2", """
    select volume_id, i, j, k, label from labels2 join
      (select volume_id, label from labels2 group by 1, 2 having count(*) between 12 and 20) using (volume_id, label)"""))
def _(t: Tables):
    return filters.area_between(t.labels2(), 12, 20)


@query("dense_relabel", compose("labels2", """
    select volume_id, i, j, k, d as label from
      (select *, dense_rank() over (partition by volume_id order by label) as d from labels2 where label % 7 <> 0)"""))
def _(t: Tables):
    """Labels renumbered without gaps after every seventh label went missing."""
    return ranking.dense_relabel(t.labels2().where("label % 7 <> 0")).select("volume_id", "i", "j", "k", "label")


@query("last_wins", compose("pts", """
    select volume_id, cast(floor(x) as bigint) as i, cast(floor(y) as bigint) as j, max(point_id) as point_id,
           arg_max(event_type, point_id) as event_type from pts group by 1, 2, 3"""))
def _(t: Tables):
    points = t.pts().withColumns({"i": F.floor("x"), "j": F.floor("y")})
    return ranking.last_wins(points, ["volume_id", "i", "j"], "point_id", ["point_id", "event_type"])


@query("invert_density", compose("pairs", """
    select volume_id, i, j, k, round(case when not m then 0 when high = low then 1 else (high - density) / (high - low) end, 6) + 0.0 as inverted
    from (select *, max(d) over (partition by volume_id) as high, min(d) over (partition by volume_id) as low from (select *, value > 40000 as m, case when value > 40000 then density end as d from pairs where metric = 'a'))"""))
def _(t: Tables):
    """Density inverted inside a mask; 1 where all densities of the mask are the same."""
    from ..workflows import density_on_grid

    mask = filters.threshold(t.vox_a(), 40000.0)
    return rounded(aggregate.invert_density(density_on_grid(t.pts(), PTS_GRID, VOX_GRID, t.vox_a()), mask)
                   .select("volume_id", "i", "j", "k", "inverted"))


@query("low_density", compose("pairs", """
    select volume_id, i, j, k, round(case when density between 0 and 120 then (cast(120 as double) - density) / 120 else 0 end, 6) as inverted
    from pairs where metric = 'a' and value <> 0"""))
def _(t: Tables):
    """Fixed-range inversion of low densities over valid reference voxels."""
    from ..workflows import density_on_grid

    reference = filters.valid_metric(t.vox_a())
    out = aggregate.invert_low_density(density_on_grid(t.pts(), PTS_GRID, VOX_GRID, reference), (0.0, 120.0))
    return rounded(out.select("volume_id", "i", "j", "k", "inverted"))


@query("low_density_mask", compose("pairs", """
    select volume_id, i, j, k from pairs where metric = 'a' and density between 100 and 250"""))
def _(t: Tables):
    from ..workflows import density_on_grid

    out = density_on_grid(t.pts(), PTS_GRID, VOX_GRID, t.vox_a())
    return filters.low_density_mask(out, (100.0, 250.0)).select("volume_id", "i", "j", "k")


@query("pixel_to_um", compose("labels2", """
    select volume_id, label, round(avg(i) / 4, 6) as i_original, round(avg(j) / 4, 6) as j_original,
           round(avg(i) / 4 * 8, 6) as i_um, round(avg(j) / 4 * 8, 6) as j_um from labels2 group by 1, 2"""))
def _(t: Tables):
    props = aggregate.region_props(t.labels2()).select("volume_id", "label", F.col("centroid_i").alias("i"), F.col("centroid_j").alias("j"))
    return rounded(aggregate.pixel_to_um(props, 4, 8.0).drop("i", "j"))
