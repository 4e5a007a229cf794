"""Patch queries: cutting, matching, merging; connected components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...grid import Grid
from ...operators import aggregate, components, filters, patches
from ...session import cut_lineage
from ..adapters import MASK2_GRID, MASK3_GRID, PLANE_GRID, VOX_GRID, Tables
from ..oracle_sql import compose
from ..workflows import merge_patches
from .registry import query, rounded

MATCHES = {
    "inter": """
        select a.volume_id, a.patch_index as patch_a, b.patch_index as patch_b, a.local_label as label_a, b.local_label as label_b,
               count(*) as intersection
        from patch_labels a join patch_labels b using (volume_id, i, j, k) where a.patch_index > b.patch_index group by 1, 2, 3, 4, 5""",
    "sizes": """
        select l.volume_id, l.patch_index as own, q.patch_index as other, local_label, count(*) as size
        from patch_labels l join patches q on l.volume_id = q.volume_id and i >= x0 and i < x1 and j >= y0 and j < y1
        where l.patch_index <> q.patch_index group by 1, 2, 3, 4""",
    "candidates": """
        select n.volume_id, patch_a, patch_b, label_a, label_b, intersection, intersection / cast(least(a.size, b.size) as double) as iomin
        from inter n join sizes a on a.volume_id = n.volume_id and a.own = patch_a and a.other = patch_b and a.local_label = label_a
        join sizes b on b.volume_id = n.volume_id and b.own = patch_b and b.other = patch_a and b.local_label = label_b
        where intersection >= 10 and intersection / cast(least(a.size, b.size) as double) >= 0.3""",
}


def greedy_rounds(rounds: int = 8) -> dict[str, str]:
    """The mutual-best rounds written out; the last remainder is empty on the given tables."""
    parts = {"rest0": "select * from candidates"}
    for n in range(rounds):
        parts[f"best{n}"] = f"""
            select * exclude (ra, rb) from (select *,
                row_number() over (partition by volume_id, patch_a, patch_b, label_a order by iomin desc, intersection desc, label_a desc, label_b desc) as ra,
                row_number() over (partition by volume_id, patch_a, patch_b, label_b order by iomin desc, intersection desc, label_a desc, label_b desc) as rb
                from rest{n}) where ra = 1 and rb = 1"""
        parts[f"rest{n + 1}"] = f"""
            select r.* from rest{n} r anti join best{n} a using (volume_id, patch_a, patch_b, label_a)
            anti join best{n} b using (volume_id, patch_a, patch_b, label_b)"""
    parts["matches"] = " union all ".join(f"select * from best{n}" for n in range(rounds))
    return {name: f"{text}" for name, text in parts.items()}


MERGE = {
    **MATCHES, **greedy_rounds(),
    "nodes": "select distinct volume_id, patch_index, local_label, patch_index * 4294967296 + local_label as node from patch_labels",
    "links": """
        select volume_id, patch_a * 4294967296 + label_a as u, patch_b * 4294967296 + label_b as v from matches
        union all select volume_id, patch_b * 4294967296 + label_b, patch_a * 4294967296 + label_a from matches""",
    "reach": """
        select volume_id, node, node as root from nodes
        union select l.volume_id, l.v, r.root from reach r join links l on l.volume_id = r.volume_id and l.u = r.node where r.root < l.v""",
    "roots": "select volume_id, node, min(root) as root from reach group by 1, 2",
    "component_map": """
        select volume_id, patch_index, local_label, dense_rank() over (partition by volume_id order by root) as global_component_id
        from nodes join roots using (volume_id, node)""",
    "own_x": "select * from (values (0, 0, 42), (36, 42, 78), (72, 78, 100), (80, 100, 128)) t(x0, ox0, ox1)",
    "own_y": "select * from (values (0, 0, 42), (36, 42, 66), (48, 66, 96)) t(y0, oy0, oy1)",
    "merged": """
        select l.volume_id, i, j, k, global_component_id as label
        from patch_labels l join patches using (volume_id, patch_index) join own_x using (x0) join own_y using (y0)
        join component_map using (volume_id, patch_index, local_label)
        where i >= ox0 and i < ox1 and j >= oy0 and j < oy1""",
}


def _sizes(t: Tables):
    return t.grids(t.patches(), PLANE_GRID)


@query("patch_grid", compose("plane", """
    select volume_id, (zi * 3 + yi) * 4 + xi as patch_index, cast(z0 as bigint) as z0, cast(least(z0 + 48, 1) as bigint) as z1,
           cast(y0 as bigint) as y0, cast(y0 + 40 as bigint) as y1, cast(x0 as bigint) as x0, cast(x0 + 40 as bigint) as x1
    from (select distinct volume_id from plane), (values (cast(0 as bigint), 0)) z(zi, z0),
         (values (cast(0 as bigint), 0), (1, 28), (2, 56)) y(yi, y0), (values (cast(0 as bigint), 0), (1, 36), (2, 72), (3, 88)) x(xi, x0)"""))
def _(t: Tables):
    """40×40 patches with 10 % and 30 % overlap over each plane."""
    return patches.patch_grid(t.grids(t.plane(), PLANE_GRID), (40, 40, 48), (0.1, 0.3, 0.3))


@query("cut_patches", compose("plane patches", """
    select p.volume_id, patch_index, i, j, k from plane p join patches q
      on p.volume_id = q.volume_id and i >= x0 and i < x1 and j >= y0 and j < y1"""))
def _(t: Tables):
    return patches.cut_patches(t.plane(), t.patches()).select("volume_id", "patch_index", "i", "j", "k")


@query("normalize_percentile", compose("plane patches", """
    select volume_id, patch_index, i, j, k, round(least(greatest((value - lo) / (hi - lo), 0), 1), 6) as value
    from c join (select volume_id, patch_index, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from c group by 1, 2)
    using (volume_id, patch_index)""", {"c": """
        select p.volume_id, patch_index, i, j, k, value + (i * 7 + j) / cast(3 as double) as value from plane p join patches q
        on p.volume_id = q.volume_id and i >= x0 and i < x1 and j >= y0 and j < y1"""}))
def _(t: Tables):
    """Percentile scaling per patch of a tilted image."""
    tilted = t.plane().withColumn("value", F.col("value") + (F.col("i") * 7 + F.col("j")) / 3.0)
    cut = patches.cut_patches(tilted, t.patches())
    return rounded(patches.normalize_percentile(cut).select("volume_id", "patch_index", "i", "j", "k", "value"))


@query("normalize_percentile_masked", compose("plane patches", """
    select c.volume_id, c.patch_index, i, j, k, round(case when value > 30 and hi > lo then least(greatest((value + (i * 7 + j) / cast(3 as double) - lo) / (hi - lo), 0), 1) else 0 end, 6) as value
    from c left join (select volume_id, patch_index, quantile_cont(value + (i * 7 + j) / cast(3 as double), 0.01) as lo, quantile_cont(value + (i * 7 + j) / cast(3 as double), 0.99) as hi
          from c where value > 30 group by 1, 2) q on q.volume_id = c.volume_id and q.patch_index = c.patch_index""", {"c": """
        select p.volume_id, patch_index, i, j, k, value from plane p join patches q
        on p.volume_id = q.volume_id and i >= x0 and i < x1 and j >= y0 and j < y1"""}))
def _(t: Tables):
    """The same scaling under a mask of the bright pixels."""
    tilted = t.plane().withColumn("value", F.col("value") + (F.col("i") * 7 + F.col("j")) / 3.0)
    cut = patches.normalize_percentile(patches.cut_patches(tilted, t.patches()), mask=t.plane().where("value > 30"))
    return rounded(cut.select("volume_id", "patch_index", "i", "j", "k", "value"))


@query("patch_status", compose("plane patches", """
    select volume_id, patch_index, case when (volume_id + patch_index) % 5 = 0 then 'existing' when m is null then 'outside'
           when s is null then 'zero_input' else 'predicted' end as status
    from patches q
    left join (select distinct p.volume_id, patch_index, true as m from plane p join patches q on p.volume_id = q.volume_id and i >= x0 and i < x1 and j >= y0 and j < y1
               where value > 49.5 and i >= 40) using (volume_id, patch_index)
    left join (select distinct p.volume_id, patch_index, true as s from plane p join patches q on p.volume_id = q.volume_id and i >= x0 and i < x1 and j >= y0 and j < y1
               where value - 49 > 0 and j < 60) using (volume_id, patch_index)"""))
def _(t: Tables):
    """Status of every patch given a mask, an input that is zero in places and finished patches."""
    boxes = t.patches()
    signal = patches.cut_patches(t.plane(), boxes).withColumn("value", F.when(F.col("j") < 60, F.greatest(F.col("value") - 49, F.lit(0.0))).otherwise(0.0))
    done = boxes.where((F.col("volume_id") + F.col("patch_index")) % 5 == 0)
    return patches.patch_status(boxes, t.plane().where("value > 49.5 and i >= 40"), signal, done)


@query("patch_status_counts", compose("plane patches", """
    select volume_id, case when m is null then 'outside' else 'predicted' end as status, count(*) as n
    from patches q left join (select distinct p.volume_id, patch_index, true as m from plane p join patches q
       on p.volume_id = q.volume_id and i >= x0 and i < x1 and j >= y0 and j < y1 where i >= 60) using (volume_id, patch_index) group by 1, 2"""))
def _(t: Tables):
    boxes = t.patches()
    signal = patches.cut_patches(t.plane(), boxes)
    return patches.patch_status_counts(patches.patch_status(boxes, t.plane().where("i >= 60"), signal))


@query("pending_patches", compose("patches patch_labels", """
    select volume_id, patch_index from patches anti join (select distinct volume_id, patch_index from patch_labels where local_label = 72) using (volume_id, patch_index)"""))
def _(t: Tables):
    """Patches still to do when those that hold label 72 are finished."""
    return patches.pending_patches(t.patches(), t.patch_labels().where("local_label = 72")).select("volume_id", "patch_index")


@query("low_point_patches", compose("patches patch_labels", """
    select volume_id, patch_index, coalesce(n, 0) as point_count from patches left join
      (select volume_id, patch_index, count(distinct local_label) as n from patch_labels where (volume_id + patch_index) % 6 <> 0 group by 1, 2)
      using (volume_id, patch_index) where coalesce(n, 0) < 70"""))
def _(t: Tables):
    """Patches with few labels; every sixth patch has none."""
    kept = t.patch_labels().where((F.col("volume_id") + F.col("patch_index")) % 6 != 0)
    return patches.low_point_patches(t.patches(), kept, 70)


@query("overlap_pairs", compose("patch_labels", """
    select a.volume_id, i, j, k, a.patch_index as patch_a, a.local_label as label_a, b.patch_index as patch_b, b.local_label as label_b
    from patch_labels a join patch_labels b using (volume_id, i, j, k) where a.patch_index > b.patch_index"""))
def _(t: Tables):
    return patches.overlap_pairs(t.patch_labels())


@query("label_overlap", compose("patch_labels", "select volume_id, patch_a, patch_b, label_a, label_b, intersection, round(iomin, 6) as iomin from candidates", MATCHES))
def _(t: Tables):
    return rounded(patches.label_overlap(t.patch_labels(), t.patches()))


@query("greedy_match", compose("patch_labels", "select volume_id, patch_a, patch_b, label_a, label_b, intersection, round(iomin, 6) as iomin from matches",
                               {**MATCHES, **greedy_rounds()}))
def _(t: Tables):
    return rounded(patches.greedy_match(patches.label_overlap(t.patch_labels(), t.patches())))


def _merge(t: Tables):
    return merge_patches(t.patch_labels(), t.patches(), _sizes(t))


@query("merge_patch_components", compose("patch_labels", "select * from component_map", MERGE, recursive=True))
def _(t: Tables):
    labels = cut_lineage(t.patch_labels())
    return patches.merge_patch_components(labels, patches.greedy_match(patches.label_overlap(labels, t.patches())))


@query("owner_patch", compose("patches", """
    select volume_id, patch_index, greatest(ox0, x0) as own_x0, least(ox1, x1) as own_x1, greatest(oy0, y0) as own_y0,
           least(oy1, y1) as own_y1, z0 as own_z0, z1 as own_z1
    from patches join (select * from (values (0, 0, 42), (36, 42, 78), (72, 78, 100), (80, 100, 128)) t(x0, ox0, ox1)) using (x0)
    join (select * from (values (0, 0, 42), (36, 42, 66), (48, 66, 96)) t(y0, oy0, oy1)) using (y0)"""))
def _(t: Tables):
    """Box of voxels that each patch owns."""
    owned = patches.owned_boxes(t.patches(), _sizes(t))
    return owned.select("volume_id", "patch_index", *[f"own_{a}{n}" for a in "xyz" for n in (0, 1)])


@query("merge_patches", compose("patch_labels", "select * from merged", MERGE, recursive=True))
def _(t: Tables):
    """Global label volume."""
    return _merge(t)["labels"]


@query("low_point_mask", compose("patches patch_labels", """
    select v.volume_id, cast(x.range as bigint) as i, cast(y.range as bigint) as j, cast(0 as bigint) as k
    from (select volume_id, greatest(ox0, x0) as a0, least(ox1, x1) as a1, greatest(oy0, y0) as b0, least(oy1, y1) as b1
          from patches join own_x using (x0) join own_y using (y0) left join
            (select volume_id, patch_index, count(distinct local_label) as n from patch_labels group by 1, 2) using (volume_id, patch_index)
          where coalesce(n, 0) < 72) v, range(128) x, range(96) y
    where x.range >= a0 and x.range < a1 and y.range >= b0 and y.range < b1""", {n: MERGE[n] for n in ("own_x", "own_y")}))
def _(t: Tables):
    """Region of the merged volume that belongs to patches with few labels."""
    return patches.low_point_region(t.patches(), t.patch_labels(), _sizes(t), 72)


@query("merged_centroids", compose("patch_labels", """
    select volume_id, label, count(*) as voxel_count, round(avg(i), 6) as center_x, round(avg(j), 6) as center_y,
           cast(0 as double) as center_z, cast(round_even(avg(i), 0) as bigint) as rounded_x,
           cast(round_even(avg(j), 0) as bigint) as rounded_y, cast(0 as bigint) as rounded_z
    from merged group by 1, 2""", MERGE, recursive=True))
def _(t: Tables):
    """Component centres of the merged volume."""
    return rounded(aggregate.component_centroids(_merge(t)["labels"], PLANE_GRID.shape))


# --- components --------------------------------------------------------------------------------

def component_sql(mask: str, ny: int, nz: int, near: str) -> dict[str, str]:
    """Component label = 1 + smallest flat index; ``near`` is the neighbour condition between p and q."""
    return {
        "px": f"select volume_id, i, j, k, (i * {ny} + j) * {nz} + k as node from {mask}",
        "links": f"select p.volume_id, p.node as u, q.node as v from px p join px q on p.volume_id = q.volume_id and p.node <> q.node and {near}",
        "reach": """
            select volume_id, node, node as root from px
            union select l.volume_id, l.v, r.root from reach r join links l on l.volume_id = r.volume_id and l.u = r.node where r.root < l.v""",
        "roots": "select volume_id, node, min(root) as root from reach group by 1, 2",
        "comp": "select p.volume_id, i, j, k, root + 1 as label from px p join roots using (volume_id, node)",
    }


NEAR8 = "abs(p.i - q.i) <= 1 and abs(p.j - q.j) <= 1"
NEAR4 = "abs(p.i - q.i) + abs(p.j - q.j) = 1"
NEAR6 = "abs(p.i - q.i) + abs(p.j - q.j) + abs(p.k - q.k) = 1"
NEAR26 = "abs(p.i - q.i) <= 1 and abs(p.j - q.j) <= 1 and abs(p.k - q.k) <= 1"


@query("connected_components", compose("mask2", "select * from comp", component_sql("mask2", 48, 1, NEAR8), recursive=True))
def _(t: Tables):
    """8-neighbour components of every mask."""
    return components.connected_components(t.mask2(), MASK2_GRID, 2, True)


@query("connected_components_4", compose("mask2", "select * from comp", component_sql("mask2", 48, 1, NEAR4), recursive=True))
def _(t: Tables):
    """4-neighbour components of every mask."""
    return components.connected_components(t.mask2(), MASK2_GRID, 2, False)


THIN3 = {"thin3": "select volume_id, i, j, k from field3 where value < 40"}


@query("connected_components_3d", compose("field3", "select * from comp", {**THIN3, **component_sql("thin3", 16, 8, NEAR6)}, recursive=True))
def _(t: Tables):
    """6-neighbour components of the dark voxels of every 3-D field."""
    return components.connected_components(t.field3().where("value < 40"), MASK3_GRID, 3, False)


@query("largest_component", compose("mask2", """
    select volume_id, i, j, k from comp join (select volume_id, arg_max(label, (n, -label)) as label from
      (select volume_id, label, count(*) as n from comp group by 1, 2) group by 1) using (volume_id, label)""",
    component_sql("mask2", 48, 1, NEAR8), recursive=True))
def _(t: Tables):
    return components.largest_component(t.mask2(), MASK2_GRID)


@query("remove_small", compose("mask2", """
    select volume_id, i, j, k from comp join (select volume_id, label from comp group by 1, 2 having count(*) >= 4) using (volume_id, label)""",
    component_sql("mask2", 48, 1, NEAR4), recursive=True))
def _(t: Tables):
    return components.remove_small(t.mask2(), MASK2_GRID, 4)


FULL2 = """select v.volume_id, cast(x.range as bigint) as i, cast(y.range as bigint) as j, cast(0 as bigint) as k
           from (select distinct volume_id from {mask}) v, range(48) x, range(48) y anti join {mask} m
           on m.volume_id = v.volume_id and m.i = x.range and m.j = y.range"""


@query("fill_holes", compose("field2", """
    select volume_id, i, j, k from dense2 union all select volume_id, i, j, k from comp anti join
      (select distinct volume_id, label from comp where i in (0, 47) or j in (0, 47)) using (volume_id, label)""",
    {"dense2": "select volume_id, i, j, k from field2 where value > 8",
     "back": FULL2.format(mask="dense2"), **component_sql("back", 48, 1, NEAR4)}, recursive=True))
def _(t: Tables):
    """Holes of dense masks filled."""
    return components.fill_holes(t.field2().where("value > 8").select("volume_id", "i", "j", "k"), MASK2_GRID)
