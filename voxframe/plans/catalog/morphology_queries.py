"""Morphology, distance, segmentation and raster queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ...operators import aggregate, distance, filters, morphology as mo, raster, regions
from ...grid import Grid
from ..adapters import FIBRE_GRID, IMAGE_GRID, MASK2_GRID, MASK3_GRID, Tables
from ..oracle_sql import compose
from ..workflows import erode_and_mask, fibre_segmentation, grid_overlay
from .patch_queries import NEAR4, NEAR8, component_sql
from .registry import query, rounded

IN2 = "i between 0 and 47 and j between 0 and 47"
IN3 = "i between 0 and 15 and j between 0 and 15 and k between 0 and 7"


def shifted_sql(mask: str, condition: str, reach: int, dims: int, alias: str = "") -> str:
    """Mask voxels moved by every offset that satisfies the condition."""
    third = f"range({-reach}, {reach + 1}) c(dk)" if dims == 3 else "(values (0)) c(dk)"
    return f"""select volume_id, cast(i + di as bigint) as i, cast(j + dj as bigint) as j, cast(k + dk as bigint) as k
               from {mask}, range({-reach}, {reach + 1}) a(di), range({-reach}, {reach + 1}) b(dj), {third} where {condition}"""


def dilate_sql(mask: str, condition: str, reach: int, dims: int) -> str:
    return f"select distinct * from ({shifted_sql(mask, condition, reach, dims)}) where {IN3 if dims == 3 else IN2}"


def erode_sql(mask: str, condition: str, reach: int, dims: int, count: int) -> str:
    return f"""select volume_id, i, j, k from ({shifted_sql(mask, condition, reach, dims)}) group by 1, 2, 3, 4 having count(*) = {count}"""


@query("dilate_box", compose("mask2", dilate_sql("mask2", "di between -2 and 1 and dj between -2 and 1", 3, 2)))
def _(t: Tables):
    """Dilation by 4×4 ones (off centre, towards lower indices)."""
    return mo.dilate_box(t.mask2(), MASK2_GRID, (4, 4, 1))


DENSE2 = {"dense2": "select volume_id, i, j, k from field2 where value > 5"}


@query("erode_box", compose("field2", erode_sql("dense2", "di between 0 and 1 and dj between -1 and 1", 1, 2, 6), DENSE2))
def _(t: Tables):
    """Erosion by 2×3 ones."""
    return mo.erode_box(t.field2().where("value > 5"), (2, 3, 1))


@query("erode_iter", compose("mask3", erode_sql("mask3", "true", 1, 3, 27)))
def _(t: Tables):
    """One erosion by 3×3×3 ones."""
    return mo.erode_iter(t.mask3(), 1)


@query("dilate_ball", compose("field3", dilate_sql("bright", "di * di + dj * dj + dk * dk <= 4", 2, 3),
                              {"bright": "select volume_id, i, j, k from field3 where value > 49"}))
def _(t: Tables):
    return mo.dilate_ball(t.field3().where("value > 49"), MASK3_GRID, 2)


@query("erode_ball", compose("mask3", erode_sql("mask3", "di * di + dj * dj + dk * dk <= 1", 1, 3, 7)))
def _(t: Tables):
    return mo.erode_ball(t.mask3(), 1)


def cells_sql(mask: str, shape: tuple[int, int, int]) -> str:
    """All grid cells of the volumes that the mask touches."""
    axes = ", ".join(f"range({n}) {c}r({c})" for n, c in zip(shape, "ijk"))
    return f"select volume_id, cast(i as bigint) as i, cast(j as bigint) as j, cast(k as bigint) as k from (select distinct volume_id from {mask}), {axes}"


def unset_sql(mask: str, shape: tuple[int, int, int]) -> str:
    return f"select * from ({cells_sql(mask, shape)}) anti join {mask} using (volume_id, i, j, k)"


@query("closing", compose("mask2", f"select * from ({cells_sql('mask2', (48, 48, 1))}) anti join eaten using (volume_id, i, j, k)", {
    "wide": dilate_sql("mask2", "di * di + dj * dj <= 4", 2, 2), "gaps": unset_sql("wide", (48, 48, 1)),
    "eaten": dilate_sql("gaps", "di * di + dj * dj <= 4", 2, 2)}))
def _(t: Tables):
    """Closing by a disc of radius 2; outside the grid counts as set, so the mask is contained in it."""
    return mo.closing(t.mask2(), MASK2_GRID, 2, 2)


@query("closing3", compose("mask3", f"select * from ({cells_sql('mask3', (16, 16, 8))}) anti join eaten using (volume_id, i, j, k)", {
    "wide": dilate_sql("mask3", "di * di + dj * dj + dk * dk <= 1", 1, 3), "gaps": unset_sql("wide", (16, 16, 8)),
    "eaten": dilate_sql("gaps", "di * di + dj * dj + dk * dk <= 1", 1, 3)}))
def _(t: Tables):
    """Closing of volumes by a ball of radius 1."""
    return mo.closing(t.mask3(), MASK3_GRID, 1, 3)


@query("boundary", compose("mask3", "select * from mask3 semi join eaten using (volume_id, i, j, k)", {
    "gaps": unset_sql("mask3", (16, 16, 8)), "eaten": dilate_sql("gaps", "di * di + dj * dj + dk * dk <= 1", 1, 3)}))
def _(t: Tables):
    """Mask voxels beside unset voxels; the grid edge is no boundary."""
    return mo.boundary(t.mask3(), MASK3_GRID, 1)


EDGES = {
    "edges": """
        select distinct a.volume_id, a.i, a.j, a.k from labels2 a, (values (1, 0), (-1, 0), (0, 1), (0, -1)) o(di, dj)
        where a.i + di between 0 and 47 and a.j + dj between 0 and 47 and not exists (
            select 1 from labels2 b where b.volume_id = a.volume_id and b.i = a.i + di and b.j = a.j + dj and b.label = a.label)""",
    "thick": f"select e.* from ({dilate_sql('edges', 'di between -1 and 0 and dj between -1 and 0', 1, 2)}) e semi join labels2 using (volume_id, i, j)",
}


@query("label_edges", compose("labels2", "select * from thick", EDGES))
def _(t: Tables):
    """Borders between labels."""
    return mo.label_edges(t.labels2(), MASK2_GRID)


@query("median3", compose("image", """
    select volume_id, x as i, y as j, cast(0 as bigint) as k, round(median(value), 6) as value from (
      select p.volume_id, p.x, p.y, coalesce(m.value, 0) as value, m.value is not null as present
      from (select volume_id, cast(x.range as bigint) as x, cast(y.range as bigint) as y,
                   cast(least(greatest(x.range + di, 0), 63) as bigint) as i, cast(least(greatest(y.range + dj, 0), 63) as bigint) as j
            from (select distinct volume_id from image), range(64) x, range(64) y, range(-1, 2) a(di), range(-1, 2) b(dj)) p
      left join image m using (volume_id, i, j)) group by 1, 2, 3 having bool_or(present)"""))
def _(t: Tables):
    return rounded(mo.median3(t.image(), IMAGE_GRID))


def gauss_sql(source: str, sigma: float, axis: str, n: int = 64) -> str:
    kernel = mo.gaussian_kernel(sigma)
    radius = len(kernel) // 2
    values = ", ".join(f"({o}, cast({w!r} as double))" for o, w in kernel)
    return f"""select volume_id, {', '.join('x as ' + c if c == axis else c for c in 'ijk')}, sum(w * value) as value from (
        select s.volume_id, x.range as x, s.i, s.j, s.k, w, value from range({n}) x, (values {values}) t(o, w)
        join {source} s on s.{axis} = least((x.range + o + {2 * n * radius}) % {2 * n}, {2 * n - 1} - (x.range + o + {2 * n * radius}) % {2 * n}))
        group by 1, 2, 3, 4"""


@query("gaussian", compose("image", "select volume_id, i, j, k, round(value, 4) as value from g2", {
    "g1": gauss_sql("image", 1.5, "i"), "g2": gauss_sql("g1", 1.5, "j")}))
def _(t: Tables):
    """Gaussian smoothing, σ 1.5, mirrored border."""
    return rounded(mo.gaussian(t.image(), IMAGE_GRID, 1.5), 4)


THIN = "select volume_id, i, j, k % 3 as k, max(value) as value from field3 group by 1, 2, 3, 4"


@query("gaussian_thin", compose("field3", "select volume_id, i, j, k, round(value, 4) as value from g1", {
    "thin": THIN, "g1": gauss_sql("thin", 2.0, "k", 3)}))
def _(t: Tables):
    """Smoothing, σ 2, along an axis of three cells: the border is mirrored several times."""
    thin = t.field3().groupBy("volume_id", "i", "j", (F.col("k") % 3).alias("k")).agg(F.max("value").alias("value"))
    return rounded(mo.gaussian(thin, Grid.regular((16, 16, 3)), 2.0, "k"), 4)


# --- distances -----------------------------------------------------------------------------------

@query("distance_within", compose("seeds2", f"""
    select volume_id, i, j, k, round(sqrt(min(d2)), 6) as distance from (
      select volume_id, cast(i + di as bigint) as i, cast(j + dj as bigint) as j, k, di * di * 4 + dj * dj * 2.25 as d2
      from seeds2, range(-3, 4) a(di), range(-4, 5) b(dj) where di * di * 4 + dj * dj * 2.25 <= 36) where {IN2} group by 1, 2, 3, 4"""))
def _(t: Tables):
    """Pixels within 6 units of a seed on 2 × 1.5 pixels."""
    return rounded(distance.distance_within(t.seeds2(), MASK2_GRID, 6.0, (2.0, 1.5, 1.0)))


@query("expand_mask", compose("mask2", f"""
    select distinct volume_id, i, j, k from (
      select volume_id, cast(i + di as bigint) as i, cast(j + dj as bigint) as j, k
      from mask2 join (select volume_id, greatest(max(i) - min(i) + 1, (max(j) - min(j) + 1) * 2) * 0.08 / 2 as r from mask2 group by 1) using (volume_id),
           range(-4, 5) a(di), range(-2, 3) b(dj) where di * di + 4 * dj * dj <= r * r) where {IN2}"""))
def _(t: Tables):
    """Masks grown by 8 % of their largest side."""
    return distance.expand_mask(t.mask2(), MASK2_GRID, (1.0, 2.0, 1.0), 0.08)


BRUTE = """
    select p.volume_id, p.i, p.j, p.k, sqrt(min((p.i - q.i) * (p.i - q.i) + (p.j - q.j) * (p.j - q.j))) as distance
    from dense2 p join back q using (volume_id) group by 1, 2, 3, 4"""
BACK = """select v.volume_id, cast(x.range as bigint) as i, cast(y.range as bigint) as j from (select distinct volume_id from dense2) v, range(48) x, range(48) y
          anti join dense2 m on m.volume_id = v.volume_id and m.i = x.range and m.j = y.range"""


@query("distance_transform", compose("field2", "select volume_id, i, j, k, round(distance, 6) as distance from d", {**DENSE2, "back": BACK, "d": BRUTE}))
def _(t: Tables):
    """Exact distance to the background."""
    return rounded(distance.distance_transform(t.field2().where("value > 5"), MASK2_GRID))


@query("object_depth", compose("labels2", """
    select volume_id, i, j, k, label, round(least(greatest((0.35 + 1.0 * d / m) * case when e then 0.12 else 1 end, 0), 1), 6) as value
    from (select *, max(d) over (partition by volume_id, label) as m from depth)
    left join (select volume_id, i, j, k, true as e from thick) using (volume_id, i, j, k)""", {**EDGES,
    "every": "select volume_id, cast(x.range as bigint) as i, cast(y.range as bigint) as j from (select distinct volume_id from labels2), range(48) x, range(48) y",
    "depth": """select a.volume_id, a.i, a.j, a.k, a.label, sqrt(min((a.i - e.i) * (a.i - e.i) + (a.j - e.j) * (a.j - e.j))) as d
                from labels2 a join every e on e.volume_id = a.volume_id and e.i between a.i - 12 and a.i + 12 and e.j between a.j - 12 and a.j + 12
                left join labels2 b on b.volume_id = e.volume_id and b.i = e.i and b.j = e.j
                where b.label is null or b.label <> a.label group by 1, 2, 3, 4, 5"""}))
def _(t: Tables):
    """Depth shading of every label."""
    return rounded(distance.object_depth(t.labels2(), MASK2_GRID))


@query("mask_change", compose("mask3", """
    select volume_id, n as n_before, coalesce(m, 0) as n_after, n - coalesce(m, 0) as n_removed, round(100 * cast(coalesce(m, 0) as double) / n, 6) as remaining_percent
    from (select volume_id, count(*) as n from mask3 group by 1) left join (select volume_id, count(*) as m from core group by 1) using (volume_id)""",
    {"core": erode_sql("mask3", "true", 1, 3, 27)}))
def _(t: Tables):
    return rounded(aggregate.mask_change(t.mask3(), mo.erode_iter(t.mask3(), 1)))


@query("erode_and_mask", compose("field3 mask3", """
    select volume_id, i, j, k, case when c.i is null then cast(0 as double) else value end as value, c.i is null and m.i is not null as outline
    from field3 left join (select *, i as ci from core) c using (volume_id, i, j, k) left join (select *, i as mi from mask3) m using (volume_id, i, j, k)""".replace(
    "c.i is null", "ci is null").replace("m.i is not null", "mi is not null"), {"core": erode_sql("mask3", "true", 1, 3, 27)}))
def _(t: Tables):
    """Images masked by an eroded mask, with the removed outline flagged."""
    return rounded(erode_and_mask(t.field3(), t.mask3(), 1))


# --- segmentation --------------------------------------------------------------------------------

@query("seeds_in_mask", compose("seeds2 mask2", "select volume_id, i, j, k, label from seeds2 semi join mask2 using (volume_id, i, j, k) where i > 0"))
def _(t: Tables):
    return regions.seeds_in_mask(t.seeds2().where("i > 0"), t.mask2())


@query("prepare_markers", compose("seeds2 field2", """
    select volume_id, i, j, k, dense_rank() over (partition by volume_id order by label) as label from (
      select volume_id, i, j, k, label from seeds2 where volume_id % 2 = 1
      union all select volume_id, i, j, k, label from comp)""", {
    "even": "select volume_id, i, j, k from seeds2 where volume_id % 2 = 0",
    **component_sql("even", 48, 1, "abs(p.i - q.i) <= 1 and abs(p.j - q.j) <= 1")}, recursive=True))
def _(t: Tables):
    """Binary markers of even volumes labelled by component, the others renumbered."""
    binary = F.when(F.col("volume_id") % 2 == 0, F.lit(1)).otherwise(F.col("label")).cast("long")
    return regions.prepare_markers(t.seeds2().withColumn("label", binary), t.mask2(), MASK2_GRID)


def otsu_sql(source: str, tag: str, bins: int = 256) -> dict[str, str]:
    """Threshold ``t`` per volume in ``thr_<tag>``."""
    slot = f"least(cast(floor((value - lo) / w) as bigint), {bins - 1})"
    return {
        f"lim_{tag}": f"select volume_id, min(value) as lo, (max(value) - min(value)) / cast({bins} as double) as w from {source} group by 1",
        f"bars_{tag}": f"""select volume_id, {slot} as bin, lo + {slot} * w + w / 2 as c, count(*) as n
                           from {source} join lim_{tag} using (volume_id) group by volume_id, bin, c""",
        f"cum_{tag}": f"""select volume_id, bin, c, sum(n) over w as n1, sum(n * c) over w as m1, sum(n) over (partition by volume_id) as nall,
                          sum(n * c) over (partition by volume_id) as mall from bars_{tag} window w as (partition by volume_id order by bin rows unbounded preceding)""",
        f"thr_{tag}": f"""select volume_id, arg_max(c, (n1 * (nall - n1) * (m1 / n1 - (mall - m1) / (nall - n1)) * (m1 / n1 - (mall - m1) / (nall - n1)), -bin)) as t
                          from cum_{tag} where n1 > 0 and nall > n1 group by 1"""}


def parts_sql(mask: str, tag: str, n: int, near: str) -> dict[str, str]:
    """Components of a flat mask with their sizes in ``parts_<tag>``; the label is the smallest flat index."""
    own = lambda text: re.sub(r"\b(from|join) (px|links|reach|roots|comp)\b", rf"\1 \2_{tag}", text)
    out = {f"{name}_{tag}": own(text) for name, text in component_sql(mask, n, 1, near).items()}
    out[f"parts_{tag}"] = f"select *, count(*) over (partition by volume_id, label) as size from comp_{tag}"
    return out


def largest_sql(tag: str) -> str:
    return f"""select p.volume_id, i, j, k from parts_{tag} p join (select volume_id, arg_max(label, (size, -label)) as best from parts_{tag} group by 1) b
               on b.volume_id = p.volume_id and b.best = p.label"""


def fill_sql(mask: str, tag: str, n: int) -> dict[str, str]:
    """The mask and the gaps that no face path joins to the border, in ``full_<tag>``."""
    return {
        f"gap_{tag}": unset_sql(mask, (n, n, 1)),
        f"sea_{tag}": f"""select * from gap_{tag} where i in (0, {n - 1}) or j in (0, {n - 1})
            union select g.* from sea_{tag} s join gap_{tag} g on g.volume_id = s.volume_id and abs(g.i - s.i) + abs(g.j - s.j) = 1""",
        f"full_{tag}": f"select * from ({cells_sql(mask, (n, n, 1))}) anti join sea_{tag} using (volume_id, i, j, k)"}


BOX15 = "di between -7 and 7 and dj between -7 and 7"
DISK = {
    **otsu_sql("image", "a"), "bright": "select volume_id, i, j, k from image join thr_a using (volume_id) where value > t",
    **parts_sql("bright", "a", 64, NEAR8), "big": largest_sql("a"), **fill_sql("big", "a", 64),
    "broad": f"select * from ({shifted_sql('full_a', BOX15, 7, 2)}) where i between 0 and 63 and j between 0 and 63 group by all",
    **fill_sql("broad", "b", 64), "disk": erode_sql("full_b", BOX15, 7, 2, 225)}
DOTS = {
    **DISK, "inside": "select image.* from image semi join disk using (volume_id, i, j, k)", **otsu_sql("inside", "b"),
    "dark": "select volume_id, i, j, k from inside join thr_b using (volume_id) where value < t", **parts_sql("dark", "b", 64, NEAR4)}


@query("disk_mask", compose("image", "select * from disk", DISK, recursive=True))
def _(t: Tables):
    """Large disc of every image tile."""
    return regions.disk_mask(t.image(), IMAGE_GRID)


@query("dot_mask", compose("image", "select volume_id, i, j, k from parts_b where size >= 2", DOTS, recursive=True))
def _(t: Tables):
    """Dark dots inside the disc of every image tile."""
    return regions.dot_mask(t.image(), regions.disk_mask(t.image(), IMAGE_GRID), IMAGE_GRID)


@query("label_foreground_fallback", compose("image", """
    select volume_id, i, j, k from image join thr using (volume_id) where value > t""", {
    "lim": "select volume_id, min(value) as lo, (max(value) - min(value)) / cast(128 as double) as w from image group by 1",
    "bars": """select volume_id, least(cast(floor((value - lo) / w) as bigint), 127) as bin,
                 lo + least(cast(floor((value - lo) / w) as bigint), 127) * w + w / 2 as c, count(*) as n
               from image join lim using (volume_id) group by volume_id, bin, c""",
    "cum": """select volume_id, bin, c, sum(n) over w as n1, sum(n * c) over w as m1, sum(n) over (partition by volume_id) as nall,
                 sum(n * c) over (partition by volume_id) as mall from bars window w as (partition by volume_id order by bin rows unbounded preceding)""",
    "thr": """select volume_id, arg_max(c, (n1 * (nall - n1) * (m1 / n1 - (mall - m1) / (nall - n1)) * (m1 / n1 - (mall - m1) / (nall - n1)), -bin)) as t
              from cum where n1 > 0 and nall > n1 group by 1"""}))
def _(t: Tables):
    """Bright pixels, with the positive pixels as the way out."""
    return regions.label_foreground_fallback(t.image())


@query("segment_foreground", compose("image", f"select * from ({largest_sql('t')})", {
    "unit": "select volume_id, i, j, k, (value - lo) / (hi - lo) as value from image join (select volume_id, min(value) as lo, max(value) as hi from image group by 1) using (volume_id)",
    "s1": gauss_sql("unit", 1.0, "i"), "smooth": gauss_sql("s1", 1.0, "j"), **otsu_sql("smooth", "s"),
    "lit": "select volume_id, i, j, k from smooth join thr_s using (volume_id) where value > t", **parts_sql("lit", "s", 64, NEAR4),
    "kept": "select volume_id, i, j, k from parts_s where size >= 8",
    "broad": f"select * from ({shifted_sql('kept', 'di * di + dj * dj <= 1', 1, 2)}) where i between 0 and 63 and j between 0 and 63 group by all",
    "holes": unset_sql("broad", (64, 64, 1)), "eaten": f"select * from ({shifted_sql('holes', 'di * di + dj * dj <= 1', 1, 2)}) group by all",
    "shut": f"select * from ({cells_sql('broad', (64, 64, 1))}) anti join eaten using (volume_id, i, j, k)",
    **fill_sql("shut", "s", 64), **parts_sql("full_s", "t", 64, NEAR4)}, recursive=True))
def _(t: Tables):
    """Whole foreground chain on every image tile."""
    return regions.segment_foreground(t.image(), IMAGE_GRID)


@query("seeded_watershed")
def _(t: Tables):
    """Watershed of the negative distance within 3 pixels of the markers."""
    mask = t.field2().where("value > 20").select("volume_id", "i", "j", "k")
    return regions.seeded_watershed(regions.limited_relief(mask, t.seeds2(), MASK2_GRID, 3.0), t.seeds2())


@query("region_grow")
def _(t: Tables):
    """Markers grown over similar pixels, measured against the mean of the growing region."""
    mask = t.field2().where("value > 20").select("volume_id", "i", "j", "k")
    return regions.region_grow(t.field2(), t.seeds2(), mask, MASK2_GRID, 12.0, 3)


@query("region_grow_fixed", compose("field2 seeds2", """
    select distinct volume_id, node // 48 as i, node % 48 as j, cast(0 as bigint) as k, label
    from (select volume_id, place, unnest(reach) as node from walk) join turns using (volume_id, place)""", {
    "turns": "select volume_id, label, i, j, i * 48 + j as own, row_number() over (partition by volume_id order by label) as place from seeds2",
    "alike": """select s.volume_id, s.place, f.i, f.j, f.i * 48 + f.j as node
        from turns s join field2 f on f.volume_id = s.volume_id and f.i between s.i - 3 and s.i + 3 and f.j between s.j - 3 and s.j + 3
        left join seeds2 o on o.volume_id = f.volume_id and o.i = f.i and o.j = f.j
        join field2 c on c.volume_id = s.volume_id and c.i = s.i and c.j = s.j
        where f.value > 20 and (f.i - s.i) ** 2 + (f.j - s.j) ** 2 <= 9 and abs(f.value - c.value) <= 1.5 and (o.label is null or o.label = s.label)""",
    "beside": """select p.volume_id, p.place, p.node, list(q.node) as near from alike p join alike q on q.volume_id = p.volume_id and q.place = p.place
        and abs(p.i - q.i) <= 1 and abs(p.j - q.j) <= 1 group by 1, 2, 3""",
    # one ring of one marker in each step; a marker that gains nothing leaves its pixels to ``held``, and the next one starts
    "walk": """select volume_id, place, cast([] as bigint[]) as held, [own] as reach from turns where place = 1
        union all
        select r.volume_id, case when ring is null then r.place + 1 else r.place end, case when ring is null then list_concat(held, reach) else held end,
               case when ring is null then [n.own] else list_concat(reach, ring) end
        from (select w.volume_id, w.place, any_value(w.held) as held, any_value(w.reach) as reach, list(b.node) filter (
                where list_has_any(b.near, w.reach) and not list_contains(w.reach, b.node) and not list_contains(w.held, b.node)) as ring
              from walk w join beside b on b.volume_id = w.volume_id and b.place = w.place group by 1, 2) r
        left join turns n on n.volume_id = r.volume_id and n.place = r.place + 1"""}, recursive=True))
def _(t: Tables):
    """Markers grown in ascending label order over pixels close to the marker's own value that no other marker holds."""
    mask = t.field2().where("value > 20").select("volume_id", "i", "j", "k")
    return regions.region_grow(t.field2(), t.seeds2(), mask, MASK2_GRID, 1.5, 3, running_mean=False)


BLOB_SIGMAS = regions.blob_sigmas(25.0, 8.0)


def log_sql(axis: str, source: str, columns: str) -> str:
    """One axis of both kernels of every scale ``s``, with mirrored border."""
    taps = [(n, o, flat, curved) for n, sigma in enumerate(BLOB_SIGMAS)
            for (o, flat), (_, curved) in zip(mo.gaussian_kernel(sigma), mo.gaussian_kernel(sigma, 2))]
    values = ", ".join(f"({n}, {o}, cast({f!r} as double), cast({c!r} as double))" for n, o, f, c in taps)
    return f"""select m.volume_id, t.s, {', '.join('x.range as ' + c if c == axis else 'm.' + c for c in 'ij')}, {columns}
        from range(64) x, (values {values}) t(s, o, flat, curved) join {source} m on m.{axis} = least((x.range + o + 1280) % 128, 127 - (x.range + o + 1280) % 128)
        {'' if axis == 'i' else 'and m.s = t.s'} group by 1, 2, 3, 4"""


SIGMA_OF = "list_value(" + ", ".join(f"cast({s!r} as double)" for s in BLOB_SIGMAS) + ")[cast(s as int) + 1]"
BLOBS = {
    "unit": "select volume_id, i, j, (value - min(value) over v) / (max(value) over v - min(value) over v) as value from image window v as (partition by volume_id)",
    "flat1": log_sql("i", "unit", "sum(t.flat * m.value) as a, sum(t.curved * m.value) as b"),
    "flat2": log_sql("j", "flat1", "sum(t.curved * m.a + t.flat * m.b) as value"),
    "cube": f"select volume_id, s, i, j, -value * {SIGMA_OF} * {SIGMA_OF} as value from flat2",
    "peaks": """select volume_id, s, i, j, value from cube c where value > 0.02 and value >= (
        select max(value) from cube d where d.volume_id = c.volume_id and d.s between c.s - 1 and c.s + 1 and d.i between c.i - 1 and c.i + 1 and d.j between c.j - 1 and c.j + 1)""",
    "found": f"select *, row_number() over (partition by volume_id order by sigma desc, i, j) as place from (select *, {SIGMA_OF} as sigma from peaks)",
    "near": """select a.volume_id, a.place, b.place as other, sqrt((a.i - b.i) ** 2 + (a.j - b.j) ** 2) as d, a.sigma * sqrt(2) as r1, b.sigma * sqrt(2) as r2
        from found a join found b on a.volume_id = b.volume_id and b.place < a.place and abs(a.i - b.i) <= 5 and abs(a.j - b.j) <= 5""",
    "shared": """select volume_id, place, list(other) as rivals from near where case when d >= r1 + r2 then 0 when d <= r2 - r1 then 1 else (
        r1 * r1 * acos(greatest(least((d * d + r1 * r1 - r2 * r2) / (2 * d * r1), 1), -1)) + r2 * r2 * acos(greatest(least((d * d + r2 * r2 - r1 * r1) / (2 * d * r2), 1), -1))
        - 0.5 * sqrt(abs((-d + r2 + r1) * (d - r2 + r1) * (d + r2 - r1) * (d + r2 + r1)))) / (pi() * r1 * r1) end > 0.5 group by 1, 2""",
    "walk": """select volume_id, cast(0 as bigint) as place, cast([] as bigint[]) as kept from (select distinct volume_id from found)
        union all
        select w.volume_id, f.place, case when list_has_any(w.kept, coalesce(s.rivals, [])) then w.kept else list_append(w.kept, f.place) end
        from walk w join found f on f.volume_id = w.volume_id and f.place = w.place + 1 left join shared s on s.volume_id = f.volume_id and s.place = f.place"""}


@query("log_blobs", compose("image", """
    select f.volume_id, f.i, f.j, round(f.sigma, 4) as sigma, round(f.value, 4) as value from found f
    join (select volume_id, max_by(kept, place) as kept from walk group by 1) w on w.volume_id = f.volume_id and list_contains(w.kept, f.place)""", BLOBS, recursive=True))
def _(t: Tables):
    """Blobs of the normalised images at all scales."""
    image = aggregate.normalize_minmax(t.image())
    return rounded(regions.log_blobs(image, IMAGE_GRID, BLOB_SIGMAS, 0.02), 4)


@query("fibre_segmentation")
def _(t: Tables):
    """Disc, dots, blobs, watershed, area filter and region table in one workflow."""
    return rounded(fibre_segmentation(t.image(), IMAGE_GRID, 25.0, 8.0))


# --- raster --------------------------------------------------------------------------------------

RINGS = """
    select volume_id, i, j, cast(0 as bigint) as k, {pick}(point_id) as label from (
      select volume_id, point_id, cast(floor(x) + di as bigint) as i, cast(floor(y) + dj as bigint) as j, x, y
      from pts, range(-6, 8) a(di), range(-6, 8) b(dj))
    where i between 0 and 149 and j between 0 and 99
      and sqrt((i - x) * (i - x) * 4 + (j - y) * (j - y) * 2.25) between 3.5 and 4.5 group by 1, 2, 3"""


@query("rasterize_rings", compose("pts", RINGS.format(pick="max")))
def _(t: Tables):
    """Rings of radius 4 and width 1 on 2 × 1.5 pixels, the last label on top."""
    return raster.rasterize_rings(t.pts().withColumnRenamed("point_id", "label"), FIBRE_GRID, 4.0, 1.0, (2.0, 1.5))


@query("rasterize_rings_first", compose("pts", RINGS.format(pick="min")))
def _(t: Tables):
    """The same rings with the first label on top."""
    return raster.rasterize_rings(t.pts().withColumnRenamed("point_id", "label"), FIBRE_GRID, 4.0, 1.0, (2.0, 1.5), "first")


LINES = """
    select v.volume_id, cast(x.range as bigint) as i, cast(y.range as bigint) as j, cast(0 as bigint) as k
    from (select distinct volume_id from labels2) v, range(48) x, range(48) y
    where x.range in (select cast(round_even(m.range * 6.25, 0) as bigint) from range(8) m) or y.range in (select cast(round_even(m.range * 5.5, 0) as bigint) from range(9) m)"""


@query("grid_lines", compose("labels2", "select * from lines", {"lines": LINES}))
def _(t: Tables):
    return raster.grid_lines(t.labels2(), MASK2_GRID, (6.25, 5.5))


@query("overlay_labels", compose("labels2 seeds2", """
    select volume_id, i, j, k, cast(case when c is not null and g is not null then 4 when c is not null then 3 when g is not null then 2 else 1 end as bigint) as label
    from (select *, 1 as s from labels2) full join (select *, 1 as g from lines) using (volume_id, i, j, k) full join (select *, 1 as c from seeds2) using (volume_id, i, j, k)""",
    {"lines": LINES}))
def _(t: Tables):
    lines = raster.grid_lines(t.labels2(), MASK2_GRID, (6.25, 5.5))
    return raster.overlay_labels(t.labels2(), lines, t.seeds2())


@query("instance_overlay", compose("labels2", """
    select volume_id, i, j, k, label from labels2 anti join lines using (volume_id, i, j, k)
    union all select volume_id, i, j, k, top as label from lines join (select volume_id, max(label) + 1 as top from labels2 group by 1) using (volume_id)""",
    {"lines": LINES}))
def _(t: Tables):
    return raster.instance_overlay(t.labels2(), raster.grid_lines(t.labels2(), MASK2_GRID, (6.25, 5.5)))


@query("grid_overlay", compose("labels2 seeds2", """
    select volume_id, label, count(*) as n from (
      select volume_id, case when c is not null and g is not null then 4 when c is not null then 3 when g is not null then 2 else 1 end as label
      from (select *, 1 as s from labels2) full join (select *, 1 as g from lines) using (volume_id, i, j, k) full join (select *, 1 as c from seeds2) using (volume_id, i, j, k))
    group by 1, 2""".replace("case when c is", "cast(case when c is").replace("else 1 end", "else 1 end as bigint)"), {"lines": LINES}))
def _(t: Tables):
    """Pixels per overlay code."""
    return grid_overlay(t.labels2(), t.seeds2(), MASK2_GRID, (6.25, 5.5))
