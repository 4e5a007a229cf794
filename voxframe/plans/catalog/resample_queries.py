"""Resampling and transform queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...grid import Grid
from ...operators import aggregate, filters, geometry, resample as rs, similarity, transforms
from ..adapters import IMAGE_GRID, VOX_GRID, Tables
from ..oracle_sql import compose
from .registry import query, rounded

# the voxel map grid and two analysis grids in its world
FINE = Grid.regular((60, 17, 13), (2.37, 5.53, 1.79), (0.31, 1.7, 0.43))
ROTATED = Grid((20, 10, 9), (2.9, -1.3, 0.2, 12.0, 1.1, 7.7, 0.1, 5.0, 0.05, 0.3, 2.4, 1.0, 0.0, 0.0, 0.0, 1.0))


def coordinates_sql(target: Grid, source: Grid, edge: str, volumes: str = "vox") -> str:
    """Output cells with their source coordinates, the edge rule applied."""
    import numpy as np

    m = (np.linalg.inv(source.matrix) @ target.matrix)[:3].tolist()
    number = lambda v: f"cast({v!r} as double)"
    exprs = []
    for r, name in enumerate(("cx", "cy", "cz")):
        terms = [f"{axis}.range * {number(m[r][c])}" for c, axis in enumerate("xyz")]
        exprs.append(" + ".join([*terms, number(m[r][3])]) + f" as {name}")
    body = f"""select v.volume_id, cast(x.range as bigint) as i, cast(y.range as bigint) as j, cast(z.range as bigint) as k, {', '.join(exprs)}
        from (select distinct volume_id from {volumes}) v, range({target.shape[0]}) x, range({target.shape[1]}) y, range({target.shape[2]}) z"""
    snap = ", ".join(f"case when abs({c} - round_even({c}, 0)) < 1e-9 then round_even({c}, 0) else {c} end as {c}" for c in ("cx", "cy", "cz"))
    n = source.shape
    body = f"select volume_id, i, j, k, {snap} from ({body})"
    if edge == "array":
        return f"select * from ({body}) where cx between 0 and {n[0] - 1} and cy between 0 and {n[1] - 1} and cz between 0 and {n[2] - 1}"
    clamp = ", ".join(f"least(greatest({c}, 0), {m_ - 1}) as {c}" for c, m_ in zip(("cx", "cy", "cz"), n))
    return f"""select volume_id, i, j, k, {clamp} from ({body}) where cx >= -0.5 and cx < {n[0] - 0.5} and cy >= -0.5 and cy < {n[1] - 0.5}
               and cz >= -0.5 and cz < {n[2] - 0.5}"""


TRILINEAR = """
    select c.volume_id, c.i, c.j, c.k, sum(w * value) as value, sum(w) as weight from (
        select *, (case dx when 0 then 1 - (cx - floor(cx)) else cx - floor(cx) end) * (case dy when 0 then 1 - (cy - floor(cy)) else cy - floor(cy) end)
               * (case dz when 0 then 1 - (cz - floor(cz)) else cz - floor(cz) end) as w
        from coords, (values (0), (1)) a(dx), (values (0), (1)) b(dy), (values (0), (1)) e(dz)) c
    join {source} v on v.volume_id = c.volume_id and v.i = floor(cx) + dx and v.j = floor(cy) + dy and v.k = floor(cz) + dz
    where w > 0 group by 1, 2, 3, 4"""
NEAREST = """
    select c.volume_id, c.i, c.j, c.k, value from coords c join {source} v
    on v.volume_id = c.volume_id and v.i = floor(cx + 0.5) and v.j = floor(cy + 0.5) and v.k = floor(cz + 0.5)"""
LINEAR_OUT = "select volume_id, i, j, k, round(value * cast(0.7310585786300049 as double), 4) as value from lin"


def scaled(df):
    """Times an odd factor, so that no value lies on a rounding tie."""
    return rounded(df.withColumn("value", F.col("value") * 0.7310585786300049), 4)


@query("resample_linear", compose("vox_a", LINEAR_OUT, {"coords": coordinates_sql(ROTATED, VOX_GRID, "array"), "lin": TRILINEAR.format(source="vox_a")}))
def _(t: Tables):
    """Trilinear values on a rotated grid, array edge rule."""
    return scaled(rs.resample(t.vox_a(), VOX_GRID, ROTATED))


@query("resample_nearest", compose("vox_a", "select volume_id, i, j, k, round(value, 4) as value from n",
                                   {"coords": coordinates_sql(ROTATED, VOX_GRID, "half_voxel"), "n": NEAREST.format(source="vox_a")}))
def _(t: Tables):
    """Nearest values on a rotated grid, half-voxel edge rule."""
    return rounded(rs.resample(t.vox_a(), VOX_GRID, ROTATED, "nearest", "half_voxel"), 4)


@query("resample_diagonal", compose("vox_a", LINEAR_OUT, {"coords": coordinates_sql(FINE, VOX_GRID, "half_voxel"), "lin": TRILINEAR.format(source="vox_a")}))
def _(t: Tables):
    """Trilinear values through axis maps."""
    return scaled(rs.resample_diagonal(t.vox_a(), VOX_GRID, FINE, "linear", "half_voxel"))


@query("resample_weighted", compose("vox_a", """
    select volume_id, i, j, k, round(value / weight * cast(0.7310585786300049 as double), 4) as value from lin semi join n using (volume_id, i, j, k) where weight > 1e-6""",
    {"holed": "select * from vox_a where (i + j + k) % 4 <> 0", "coords": coordinates_sql(FINE, VOX_GRID, "array"),
     "lin": TRILINEAR.format(source="holed"), "n": NEAREST.format(source="holed")}, stored=("holed", "coords", "lin", "n")))
def _(t: Tables):
    """Resampling of a map whose every fourth diagonal has no data."""
    hole = (F.col("i") + F.col("j") + F.col("k")) % 4 == 0
    return scaled(rs.resample_weighted(t.vox_a().withColumn("value", F.when(hole, 0.0).otherwise(F.col("value"))), VOX_GRID, FINE))


ZOOM_GRID = Grid.regular((75, 22, 9), (49 / 74, 10 / 21, 1.0))


@query("zoom", compose("vox_a", LINEAR_OUT, {
    "coords": coordinates_sql(ZOOM_GRID, Grid.regular((50, 11, 9)), "array"), "lin": TRILINEAR.format(source="vox_a")}))
def _(t: Tables):
    """End-aligned enlargement by 1.5 and 2."""
    return scaled(rs.zoom(t.vox_a(), VOX_GRID.shape, (1.5, 2.0, 1.0)))


@query("mask_to_native", compose("vox_a", "select volume_id, i, j, k from n", {
    "mm": "select volume_id, i, j, k, 1 as value from vox_a where value > 40000",
    "coords": coordinates_sql(FINE, VOX_GRID, "array"), "n": NEAREST.format(source="mm")}))
def _(t: Tables):
    return rs.mask_to_native(filters.threshold(t.vox_a(), 40000.0), VOX_GRID, FINE)


@query("apply_low_density", compose("vox", """
    select volume_id, i, j, k, round(case when value_a > 40000 then -1 else value_b end, 6) as value from vox"""))
def _(t: Tables):
    """Values under the mask replaced by a fill value."""
    return rounded(rs.apply_low_density(t.vox_b(), filters.threshold(t.vox_a(), 40000.0), -1.0))


# --- transforms --------------------------------------------------------------------------------

MATRIX = [f"m{r}{c}" for r in range(3) for c in range(4)]


def with_matrix(df, digits: int = 6):
    columns = [F.col("matrix")[4 * r + c].alias(f"m{r}{c}") for r in range(3) for c in range(4)]
    return rounded(df.select(*[c for c in df.columns if c != "matrix"], *columns), digits)


def _poses(t: Tables, step: int = 30):
    """Poses around the mean of every point cloud, with a fixed axis per cloud."""
    v = F.col("volume_id")
    centres = aggregate.pca_moments(t.cloud()).select(
        "volume_id", F.col("mean_x").alias("center_x"), F.col("mean_y").alias("center_y"), F.col("mean_z").alias("center_z"),
        (v + 1.0).alias("axis_x"), F.lit(2.0).alias("axis_y"), (3.0 - v).alias("axis_z"))
    return transforms.pose_table(centres, step)


POSES = {
    "poses": """
        select volume_id, cx, cy, cz, ax / len as x, ay / len as y, az / len as z, f.flip, cast(f.n * 12 + r.range as bigint) as candidate,
               cast(r.range * 30 as double) as roll_deg, cos(radians(r.range * 30)) as c, sin(radians(r.range * 30)) as s
        from (select volume_id, avg(x) as cx, avg(y) as cy, avg(z) as cz, volume_id + 1 as ax, 2 as ay, 3 - volume_id as az,
                     sqrt((volume_id + 1) * (volume_id + 1) + 4 + (3 - volume_id) * (3 - volume_id)) + 1e-12 as len from cloud group by 1) v,
             (values (0, false), (1, true)) f(n, flip), range(12) r""",
    "rot": """
        select *, c + x * x * (1 - c) as r00, x * y * (1 - c) - z * s as r01, x * z * (1 - c) + y * s as r02,
               y * x * (1 - c) + z * s as r10, c + y * y * (1 - c) as r11, y * z * (1 - c) - x * s as r12,
               z * x * (1 - c) - y * s as r20, z * y * (1 - c) + x * s as r21, c + z * z * (1 - c) as r22,
               case when flip then 1 else 0 end as f from poses""",
    "lin3": "select *, " + ", ".join(
        f"r{r}{c} - 2 * f * (r{r}0 * x + r{r}1 * y + r{r}2 * z) * {'xyz'[c]} as l{r}{c}" for r in range(3) for c in range(3)) + " from rot",
}


@query("roll_flip_matrices", compose("cloud", "select volume_id, candidate, flip, roll_deg, " + ", ".join(
    [f"round(l{r}{c}, 5) + 0.0 as m{r}{c}" for r in range(3) for c in range(3)]
    + [f"round(c{'xyz'[r]} - l{r}0 * cx - l{r}1 * cy - l{r}2 * cz, 5) + 0.0 as m{r}3" for r in range(3)]) + " from lin3", POSES))
def _(t: Tables):
    """The 24 candidate poses of every point cloud."""
    out = transforms.roll_flip_matrices(_poses(t))
    return with_matrix(out.select("volume_id", "candidate", "flip", "roll_deg", "matrix"), 5)


def _euler(t: Tables):
    v = F.col("volume_id")
    base = aggregate.pca_moments(t.cloud()).select(
        "volume_id", F.col("mean_x").alias("center_x"), F.col("mean_y").alias("center_y"), F.col("mean_z").alias("center_z"),
        (v * 7.0 - 20).alias("rot_x"), (v * 3.0 + 5).alias("rot_y"), (31.0 - v * 6).alias("rot_z"),
        (v % 2 == 0).alias("flip_x"), (v % 3 == 0).alias("flip_y"), F.lit(False).alias("flip_z"),
        (v * 0.5).alias("shift_x"), F.lit(-1.0).alias("shift_y"), (v * 0.25).alias("shift_z"))
    return transforms.euler_matrices(base)


EULER = {
    "e0": """select volume_id, avg(x) as c0, avg(y) as c1, avg(z) as c2, radians(volume_id * 7.0 - 20) as a, radians(volume_id * 3.0 + 5) as b,
              radians(31.0 - volume_id * 6) as g, case when volume_id % 2 = 0 then -1 else 1 end as f0, case when volume_id % 3 = 0 then -1 else 1 end as f1,
              1 as f2, volume_id * 0.5 as t0, -1 as t1, volume_id * 0.25 as t2 from cloud group by 1""",
    "e1": """select *, cos(g) * cos(b) * f0 as l00, (cos(g) * sin(b) * sin(a) - sin(g) * cos(a)) * f1 as l01, (cos(g) * sin(b) * cos(a) + sin(g) * sin(a)) * f2 as l02,
              sin(g) * cos(b) * f0 as l10, (sin(g) * sin(b) * sin(a) + cos(g) * cos(a)) * f1 as l11, (sin(g) * sin(b) * cos(a) - cos(g) * sin(a)) * f2 as l12,
              -sin(b) * f0 as l20, cos(b) * sin(a) * f1 as l21, cos(b) * cos(a) * f2 as l22 from e0""",
    "e2": "select *, " + ", ".join(f"c{r} - l{r}0 * c0 - l{r}1 * c1 - l{r}2 * c2 + t{r} as l{r}3" for r in range(3)) + " from e1",
}


@query("euler_matrices", compose("cloud", "select volume_id, " + ", ".join(
    f"round(l{r}{c}, 5) + 0.0 as m{r}{c}" for r in range(3) for c in range(4)) + " from e2", EULER))
def _(t: Tables):
    return with_matrix(_euler(t).select("volume_id", "matrix"), 5)


@query("compose_chains", compose("cloud", """
    select volume_id, point_id, round(l00 * p + l01 * q + l02 * r + l03, 5) + 0.0 as x, round(l10 * p + l11 * q + l12 * r + l13, 5) + 0.0 as y,
           round(l20 * p + l21 * q + l22 * r + l23, 5) + 0.0 as z
    from (select volume_id, point_id, 2 * x + 1 as p, 3 * y as q, z - 1 as r from cloud) join e2 using (volume_id)""", EULER))
def _(t: Tables):
    """Points moved by a chain of two steps composed into one matrix."""
    first = F.array(*[F.lit(v) for v in (2.0, 0.0, 0.0, 1.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0, 1.0, -1.0, 0.0, 0.0, 0.0, 1.0)])
    base = _euler(t).select("volume_id", F.lit(2).alias("step"), "matrix")
    steps = base.unionByName(base.select("volume_id", F.lit(1).alias("step"), first.alias("matrix")))
    chains = transforms.compose_chains(steps, ["volume_id"])
    return rounded(transforms.transform_points(t.cloud(), chains).select("volume_id", "point_id", "x", "y", "z"), 5)


SHIFTED = Grid.regular((50, 11, 9), (3.0, 9.0, 24.0 / 9.0), (3.7, -4.1, 1.3))


@query("apply_chain", compose("vox_a", LINEAR_OUT, {
    "coords": coordinates_sql(SHIFTED, VOX_GRID, "half_voxel"), "lin": TRILINEAR.format(source="vox_a")}))
def _(t: Tables):
    """Every volume resampled once through a composed chain of two shifts."""
    ids = t.vox_a().select("volume_id").distinct()
    steps = F.array(*[F.struct(F.lit(n).alias("step"), F.array(*[F.lit(float(v)) for v in (
        1, 0, 0, a, 0, 1, 0, b, 0, 0, 1, c, 0, 0, 0, 1)]).alias("matrix")) for n, (a, b, c) in enumerate(((3.0, -4.0, 1.0), (0.7, -0.1, 0.3)))])
    rows = ids.select("volume_id", F.explode(steps).alias("s")).select("volume_id", "s.step", "s.matrix")
    chains = transforms.compose_chains(rows, ["volume_id"])
    return scaled(transforms.apply_chain(t.vox_a(), chains, VOX_GRID, VOX_GRID))


@query("affine_jacobian", compose("cloud", "select volume_id, cast(f0 * f1 * f2 as double) as determinant from e2", EULER))
def _(t: Tables):
    return rounded(transforms.affine_jacobian(_euler(t).select("volume_id", "matrix")))


@query("apply_bspline", compose("pts vox", """
    select point_id, round(p.x + coalesce(dx, 0), 5) as x, round(p.y + coalesce(dy, 0), 5) as y, round(p.z + coalesce(dz, 0), 5) as z
    from pts p left join moved using (volume_id, point_id)""", {
    "ctrl": """select volume_id, i as ci, j as cj, k as ck, sum(value_a) / 100000 as dx, sum(value_b) / 100000 as dy, sum(value_a - value_b) / 10000 as dz
               from vox group by 1, 2, 3, 4""",
    "moved": """
        select p.volume_id, point_id, sum(wx * wy * wz * dx) as dx, sum(wx * wy * wz * dy) as dy, sum(wx * wy * wz * dz) as dz
        from (select *, case a when 0 then (1 - tx) * (1 - tx) * (1 - tx) when 1 then 3 * tx * tx * tx - 6 * tx * tx + 4
                       when 2 then -3 * tx * tx * tx + 3 * tx * tx + 3 * tx + 1 else tx * tx * tx end / 6 as wx,
                     case b when 0 then (1 - ty) * (1 - ty) * (1 - ty) when 1 then 3 * ty * ty * ty - 6 * ty * ty + 4
                       when 2 then -3 * ty * ty * ty + 3 * ty * ty + 3 * ty + 1 else ty * ty * ty end / 6 as wy,
                     case c when 0 then (1 - tz) * (1 - tz) * (1 - tz) when 1 then 3 * tz * tz * tz - 6 * tz * tz + 4
                       when 2 then -3 * tz * tz * tz + 3 * tz * tz + 3 * tz + 1 else tz * tz * tz end / 6 as wz
              from (select volume_id, point_id, ux, uy, uz, ux - floor(ux) as tx, uy - floor(uy) as ty, uz - floor(uz) as tz
                    from (select volume_id, point_id, x / 4 as ux, y / 10 as uy, z / 3 as uz from pts)),
                   (values (0), (1), (2), (3)) g(a), (values (0), (1), (2), (3)) h(b), (values (0), (1), (2), (3)) l(c)) p
        join ctrl on ctrl.volume_id = p.volume_id and ci = floor(ux) - 1 + a and cj = floor(uy) - 1 + b and ck = floor(uz) - 1 + c
        group by 1, 2"""}))
def _(t: Tables):
    """Points moved by a spline whose control points come from the voxel maps."""
    control = t.vox().select("volume_id", F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("k").alias("ck"),
                             (F.col("value_a") / 100000).alias("dx"), (F.col("value_b") / 100000).alias("dy"),
                             ((F.col("value_a") - F.col("value_b")) / 10000).alias("dz"))
    moved = transforms.apply_bspline(t.pts(), control, (4.0, 10.0, 3.0), (0.0, 0.0, 0.0))
    return rounded(moved.select("point_id", "x", "y", "z"), 5)


@query("jacobian_map", compose("vox", """
    select f.volume_id, f.i, f.j, f.k, round((1 + xx) * ((1 + yy) * (1 + zz) - yz * zy) - xy * (yx * (1 + zz) - yz * zx) + xz * (yx * zy - (1 + yy) * zx), 5) as value
    from (select volume_id, i, j, k, """ + ", ".join(
        f"(lead(d{d}) over {a} - lag(d{d}) over {a}) / {w} as {d}{x}" for d in "xyz" for x, a, w in (("x", "wi", 6), ("y", "wj", 18), ("z", "wk", 5))) + """,
        lead(i) over wi - lag(i) over wi as gi, lead(j) over wj - lag(j) over wj as gj, lead(k) over wk - lag(k) over wk as gk
        from fld window wi as (partition by volume_id, j, k order by i), wj as (partition by volume_id, i, k order by j),
             wk as (partition by volume_id, i, j order by k)) f
    where gi = 2 and gj = 2 and gk = 2""",
    {"fld": "select volume_id, i, j, k, value_a / 10000 as dx, value_b / 20000 as dy, (value_a - value_b) / 3000 as dz from vox"}))
def _(t: Tables):
    """Determinant map of a displacement field made from the voxel maps."""
    field = t.vox().select("volume_id", "i", "j", "k", (F.col("value_a") / 10000).alias("dx"), (F.col("value_b") / 20000).alias("dy"),
                           ((F.col("value_a") - F.col("value_b")) / 3000).alias("dz"))
    return rounded(transforms.jacobian_map(field, (3.0, 9.0, 2.5)), 5)


@query("augment_volumes")
def _(t: Tables):
    """Random rotated, shifted and flipped copies of every volume."""
    box = aggregate.foreground_bbox(t.vox_a(), VOX_GRID.spacing).select(
        "volume_id", *[F.col(f"extent_{c}").alias(f"extent_{a}") for c, a in zip("ijk", "xyz")])
    centre = aggregate.foreground_centroid(t.vox_a(), VOX_GRID.spacing)
    parameters = transforms.augmentation_parameters(box.join(centre, "volume_id"))
    return rounded(transforms.augment_volumes(t.vox_a(), parameters, VOX_GRID, intensity=True))
