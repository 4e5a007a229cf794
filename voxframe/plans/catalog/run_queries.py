"""Sources, sinks, run tables, registration and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...grid import Grid
from ...operators import aggregate, cells, registration, similarity, transforms
from ...session import cut_lineage, keep_table, scratch_path
from ...sources import points as ps, runs, summary, volumes
from ...streaming.patch_stream import stored_counts, stream_patch_results
from ..adapters import PTS_GRID, VOX_GRID, Tables
from ..oracle_sql import compose
from ..workflows import evaluate_registration, regrid_counts, slab_correlation
from .registry import query, rounded
from .resample_queries import MATRIX, NEAREST, TRILINEAR, coordinates_sql
from .statistics_queries import FIT, MI, RANKED

WORLD = Grid.regular((150, 100, 24), (2.0, 3.0, 0.5), (10.0, -5.0, 1.0))


def _holed(column: str, every: int):
    """Text of a number, with a word instead of it in some rows."""
    return F.when(F.col("point_id") % every == 3, F.lit("missing")).otherwise(F.format_string("%.6f", F.col(column)))


@query("read_points", compose("pts", """
    select cast(point_id as varchar) as point_id, round((round(x, 6) - 10) / 2, 5) as x, round((round(y, 6) + 5) / 3, 5) as y,
           round((round(z, 6) - 1) / 0.5, 5) + 0.0 as z from pts where point_id % 11 <> 3"""))
def _(t: Tables):
    """World centres written as CSV, every eleventh row spoilt, read back as voxel coordinates."""
    path = scratch_path(t.spark, "points")
    t.pts().select("point_id", _holed("x", 11).alias("world_x"), F.format_string("%.6f", "y").alias("world_y"),
                   F.format_string("%.6f", "z").alias("world_z")).write.option("header", True).csv(path)
    from ...grid import matrix_columns

    return rounded(ps.read_points(t.spark, path, matrix_columns(WORLD.affine), ["point_id"]), 5)


@query("read_fibre_centroids", compose("pts", "select point_id + 1 as label, round(y, 6) as x, round(x, 6) as y from pts"))
def _(t: Tables):
    """Centroid CSV without labels, axes swapped on reading."""
    path = scratch_path(t.spark, "fibres")
    ps.write_table(t.pts().select("point_id", F.col("x").alias("centroid_x"), F.col("y").alias("centroid_y")), path,
                   {"centroid_x": "%.6f", "centroid_y": "%.6f"})
    return rounded(ps.read_fibre_centroids(t.spark, path, ("y", "x"), order="point_id"))


@query("read_components", compose("labels2", """
    select cast(volume_id as varchar) as volume_id, voxel_count, round(x, 6) as x, round(y, 6) as y, cast(0 as double) as z
    from (select volume_id, label, count(*) as voxel_count, avg(i) as x, avg(j) as y from labels2 group by 1, 2)
    where voxel_count >= 10 and label % 9 <> 4"""))
def _(t: Tables):
    """Component CSV with gaps; small components and incomplete rows dropped."""
    path = scratch_path(t.spark, "components")
    centres = aggregate.component_centroids(t.labels2(), (48, 48, 1))
    centres.select("volume_id", "voxel_count", F.when(F.col("label") % 9 != 4, F.format_string("%.9f", "center_x")).alias("voxel_center_x"),
                   F.format_string("%.9f", "center_y").alias("voxel_center_y"), F.format_string("%.9f", "center_z").alias("voxel_center_z")
                   ).write.option("header", True).csv(path)
    return rounded(ps.read_components(t.spark, path, 10, ["volume_id"]))


@query("write_table", compose("vox", "select cast(volume_id as varchar) as volume_id, cast(i as varchar) as i, cast(j as varchar) as j, cast(k as varchar) as k, printf('%.6f', value_a * cast(0.7310585786300049 as double)) as value from vox"))
def _(t: Tables):
    """Fixed float format in CSV."""
    path = scratch_path(t.spark, "table")
    ps.write_table(t.vox_a().withColumn("value", F.col("value") * 0.7310585786300049), path, {"value": "%.6f"})
    return ps.read_text_table(t.spark, path)


PATCH_FILES = """
    select q.volume_id, q.patch_index, p.i - q.x0 as i, p.j - q.y0 as j, p.k - q.z0 as k, round(p.value, 6) as value
    from plane p join patches q on p.volume_id = q.volume_id and i >= x0 and i < x1 and j >= y0 and j < y1"""
PATCH_WORLD = Grid.regular((128, 96, 1), (3.0, 9.0, 2.0), (1.0, 2.0, 3.0))


def _patch_files(t: Tables, compress: bool) -> str:
    folder = scratch_path(t.spark, "patches")
    volumes.write_patches(t.plane(), t.patches(), PATCH_WORLD, folder, compress).write.format("noop").mode("overwrite").save()
    return f"{folder}/*/*"


def _file_keys():
    return [F.regexp_extract("path", r"/volume_(\d+)/", 1).cast("long").alias("volume_id"), F.regexp_extract("path", r"/patch_0*(\d+)_", 1).cast("long").alias("patch_index")]


@query("read_volumes", compose("plane patches", PATCH_FILES))
def _(t: Tables):
    """Patches written as uncompressed image files and read back in ranges of 500 voxels."""
    voxels = volumes.read_volumes(t.spark, _patch_files(t, False), range_voxels=500)
    return rounded(voxels.select(*_file_keys(), "i", "j", "k", "value"))


@query("read_volumes_gz", compose("plane patches", PATCH_FILES))
def _(t: Tables):
    """The same patches as compressed files."""
    return rounded(volumes.read_volumes(t.spark, _patch_files(t, True)).select(*_file_keys(), "i", "j", "k", "value"))


@query("image_grids", compose("patches", """
    select volume_id, patch_index, x1 - x0 as nx, y1 - y0 as ny, z1 - z0 as nz, 'um' as unit, cast(3 as double) as spacing_x, cast(9 as double) as spacing_y,
           round(cast(3 as double) * x0 + 1, 4) as origin_x, round(cast(9 as double) * y0 + 2, 4) as origin_y, round(cast(2 as double) * z0 + 3, 4) as origin_z, cast(1 as bigint) as sform_code
    from patches"""))
def _(t: Tables):
    """Grid rows read from the headers of the patch files."""
    origin = [F.col("affine")[4 * r + 3].alias(f"origin_{a}") for r, a in enumerate("xyz")]
    spacing = [F.col("affine")[5 * r].alias(f"spacing_{a}") for r, a in enumerate("xy")]
    return rounded(volumes.image_grids(t.spark, _patch_files(t, False)).select(*_file_keys(), "nx", "ny", "nz", "unit", *spacing, *origin, "sform_code"), 4)


@query("write_patches_manifest", compose("plane patches", """
    select q.volume_id, q.patch_index, count(p.i) as n_voxels from patches q left join plane p on p.volume_id = q.volume_id and i >= x0 and i < x1 and j >= y0 and j < y1 group by 1, 2"""))
def _(t: Tables):
    """One file per patch, those without any voxel included."""
    return volumes.write_patches(t.plane(), t.patches(), PATCH_WORLD, scratch_path(t.spark, "patches")).select("volume_id", "patch_index", "n_voxels")


@query("write_voxels", compose("vox", "select volume_id, i, j, k, round(value_a, 6) as value, cast(50 as bigint) as nx from vox"))
def _(t: Tables):
    """Partitioned voxel store with grid rows, read back."""
    path = scratch_path(t.spark, "voxels")
    volumes.write_voxels(t.vox_a(), t.grids(t.vox_a(), VOX_GRID), path)
    voxels, grids = volumes.read_voxels(t.spark, path)
    return rounded(voxels.join(grids.select("volume_id", "nx"), "volume_id").select("volume_id", "i", "j", "k", "value", "nx"))


@query("list_patches", compose("patches", "select * from patches where patch_index % 5 <> 1"))
def _(t: Tables):
    """Boxes parsed from file names; names with another form are skipped."""
    named = runs.patch_file_name(t.patches()).select("volume_id", F.when(F.col("patch_index") % 5 == 1, F.concat(F.lit("old_"), F.regexp_replace("name", "_z", "_q")))
                                                     .otherwise(F.upper("name")).alias("name"))
    return runs.list_patches(named).drop("name")


@query("read_transform_params", compose("patches", """
    select volume_id, cast(x0 as varchar) || ' ' || cast(y0 as varchar) as translation, '"Linear"' as kind, patch_index as step
    from patches"""))
def _(t: Tables):
    """Parameter files, one per patch: a repeated key, a comment and a broken line each."""
    path = scratch_path(t.spark, "parameters")
    text = F.concat_ws("\n", F.lit("// comment"), F.lit("(Size 1 1)"), F.lit("(Broken"), F.lit('(Kind "Linear")'), F.lit("(Translation 0 0)"),
                       F.format_string("(Translation %d %d)", "x0", "y0"), F.format_string("(Volume %d)", "volume_id"), F.format_string("(Index %d)", "patch_index"))
    # spread by number, for few bytes would be merged to one task; one folder, listed once
    spread = t.patches().repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "volume_id", "patch_index")
    spread.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    read = runs.read_transform_params(t.spark, path)
    p = lambda k: F.col("params")[k]
    return read.select(p("Volume").cast("long").alias("volume_id"), p("Translation").alias("translation"), p("Kind").alias("kind"), p("Index").cast("long").alias("step"))


@query("read_manifests", compose("patches", """
    select distinct volume_id, case when volume_id % 2 = 0 then 'relative' else 'absolute' end as kind, 'final_' || volume_id || '.txt' as file from patches"""))
def _(t: Tables):
    """JSON manifests, one per volume, with relative and absolute paths."""
    path = scratch_path(t.spark, "manifests")
    rows = t.patches().select("volume_id").distinct()
    name = F.concat(F.lit("final_"), F.col("volume_id"), F.lit(".txt"))
    rows.select("volume_id", F.when(F.col("volume_id") % 2 == 0, name).otherwise(F.concat(F.lit("/runs/"), name)).alias("transform"),
                F.col("volume_id").alias("run")).repartition("run").write.partitionBy("run").json(path)
    read = runs.read_manifests(t.spark, f"{path}/*/*.json", "transform", "volume_id long, transform string")
    absolute = F.col("transform_resolved").startswith("/runs/")
    return read.select("volume_id", F.when(absolute, "absolute").otherwise(
        F.when(F.col("transform_resolved").contains("/manifests-"), "relative").otherwise("unresolved")).alias("kind"),
        F.regexp_extract("transform_resolved", r"([^/]+)$", 1).alias("file"))


# --- run tables ----------------------------------------------------------------------------------

RUNS = {
    "p": """select l_returnflag as flag, l_linestatus as status, s.scope, a, b from (
              select l_returnflag, l_linestatus, l_orderkey // 3000 as volume_id, cast(l_quantity as bigint) - 1 as i, cast(round(l_discount * 100) as bigint) as j,
                cast(round(l_tax * 100) as bigint) as k, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / (count(*) * 100) as a,
                cast(sum(cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint))) as double) / (count(*) * 10000) as b
              from lineitem group by 1, 2, 3, 4, 5, 6), (values ('global'), ('mask')) s(scope) where s.scope = 'global' or a > 40000""",
    **{n: s.format(keys="flag, status, scope") for n, s in MI.items()},
    "m": "select flag, status, scope, n, round(ncc, 6) as ncc, round(mi, 6) as mi from ncc join mi using (flag, status, scope)",
}


def _run_metrics(t: Tables):
    """Similarity of the two maps per run, a run being one flag and status."""
    maps = t.vox("l_returnflag", "l_linestatus").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("value_a").alias("a"), F.col("value_b").alias("b"))
    scopes = F.when(F.col("a") > 40000, F.array(F.lit("global"), F.lit("mask"))).otherwise(F.array(F.lit("global")))
    return rounded(similarity.similarity(maps.withColumn("scope", F.explode(scopes)), ["flag", "status", "scope"]))


@query("run_metrics", compose("vox", "select * from m", RUNS))
def _(t: Tables):
    return _run_metrics(t)


WIDE = "select flag, status, " + ", ".join(
    f"max({m}) filter (where scope = '{s}') as {m}_{s}_B9" for s in ("global", "mask") for m in ("mi", "ncc")) + " from m group by 1, 2"


@query("metrics_wide", compose("vox", WIDE, RUNS))
def _(t: Tables):
    """One wide row per run."""
    return registration.metrics_wide(_run_metrics(t).withColumn("image", F.lit("B9")), ["flag", "status"], ["B9"])


@query("scan_run_metrics", compose("vox", "select 'run_' || flag || '_' || status as experiment, scope, n, mi, ncc from m where flag <> 'R'", RUNS))
def _(t: Tables):
    """Metric files of the runs found by their folder; the runs of one flag have no file."""
    root = scratch_path(t.spark, "runs")
    table = cut_lineage(_run_metrics(t))
    for flag, status in (("A", "F"), ("A", "O"), ("N", "F"), ("N", "O")):
        table.where((F.col("flag") == flag) & (F.col("status") == status)).select("scope", "n", "mi", "ncc").write.option("header", True).csv(
            f"{root}/run_{flag}_{status}/QC/metrics.csv")
    found = runs.scan_run_metrics(t.spark, root, "metrics.csv", "scope string, n long, mi double, ncc double")
    return found.select("experiment", "scope", "n", "mi", "ncc").orderBy("experiment")


@query("upsert_summary", compose("vox", """
    select flag, status, case when flag = 'A' then -1 else mi_global_B9 end as mi, place as row_order from (
      select *, row_number() over (order by flag, status) - 1 as place from w where flag <> 'N')
    union all select flag, status, cast(-1 as double), 4 from w where flag = 'N' and status = 'F'""", {**RUNS, "w": WIDE}))
def _(t: Tables):
    """Two rows replaced in place, one appended."""
    wide = registration.metrics_wide(_run_metrics(t).withColumn("image", F.lit("B9")), ["flag", "status"], ["B9"])
    place = F.when(F.col("flag") == "A", 0).otherwise(2) + F.when(F.col("status") == "F", 0).otherwise(1)
    old = wide.where("flag <> 'N'").select("flag", "status", F.col("mi_global_B9").alias("mi"), place.cast("long").alias("row_order"))
    new = wide.where("flag = 'A' or (flag = 'N' and status = 'F')").select("flag", "status", F.lit(-1.0).alias("mi"), F.lit(0).cast("long").alias("row_order"))
    return registration.upsert_summary(old, new, ["flag", "status"])


@query("normalize_weights", compose("vox", "select flag, status, scope, round(n / cast(sum(n) over (partition by flag) as double), 6) as weight from m", RUNS))
def _(t: Tables):
    return rounded(registration.normalize_weights(_run_metrics(t).withColumn("weight", F.col("n").cast("double")), ["flag"]).select("flag", "status", "scope", "weight"))


@query("upsert_stored", compose("vox", """
    select flag, status, case when flag = 'A' then -1 else mi_global_B9 end as mi, place as row_order from (
      select *, row_number() over (order by flag, status) - 1 as place from w where flag <> 'N')
    union all select flag, status, cast(-1 as double), 4 from w where flag = 'N' and status = 'F'""", {**RUNS, "w": WIDE}))
def _(t: Tables):
    """The same through a stored table: two committed versions, and a staged one that nobody committed."""
    root = scratch_path(t.spark, "summary")
    wide = registration.metrics_wide(_run_metrics(t).withColumn("image", F.lit("B9")), ["flag", "status"], ["B9"])
    place = F.when(F.col("flag") == "A", 0).otherwise(2) + F.when(F.col("status") == "F", 0).otherwise(1)
    old = wide.where("flag <> 'N'").select("flag", "status", F.col("mi_global_B9").alias("mi"), place.cast("long").alias("row_order"))
    new = wide.where("flag = 'A' or (flag = 'N' and status = 'F')").select("flag", "status", F.lit(-1.0).alias("mi"), F.lit(0).cast("long").alias("row_order"))
    summary.upsert_stored(t.spark, root, old, ["flag", "status"])
    summary.upsert_stored(t.spark, root, new, ["flag", "status"])
    summary.stage(old.withColumn("mi", F.lit(7.0)), root)
    return summary.read_summary(t.spark, root)


# --- registration --------------------------------------------------------------------------------

def _poses(fixed, step: int = 30):
    centres = aggregate.foreground_centroid(fixed, VOX_GRID.spacing).select(
        "volume_id", "center_x", "center_y", "center_z", F.lit(1.0).alias("axis_x"), F.lit(0.2).alias("axis_y"), F.lit(0.1).alias("axis_z"))
    return transforms.roll_flip_matrices(transforms.pose_table(centres, step))


def _pose_sql(step: int = 30) -> dict[str, str]:
    """Resampling of ``vox_b`` by every pose: rotation about the axis (1, 0.2, 0.1) through the centroid, after a flip along it."""
    length = (1.0 + 0.04 + 0.01) ** 0.5 + 1e-12
    axis = [v / length for v in (1.0, 0.2, 0.1)]
    number = lambda v: f"cast({v!r} as double)"
    cross = [[None, -axis[2], axis[1]], [axis[2], None, -axis[0]], [-axis[1], axis[0], None]]
    cells = [f"c * {number(float(r == q))} + {number(axis[r] * axis[q])} * (f - c)" + ("" if r == q else f" + s * {number(cross[r][q])}") + f" as m{r}{q}" for r in range(3) for q in range(3)]
    spacing = VOX_GRID.spacing
    world = ["i * " + number(spacing[0]) + " - ox", "j * " + number(spacing[1]) + " - oy", "k * " + number(spacing[2]) + " - oz"]
    source = [f"(m{r}0 * ({world[0]}) + m{r}1 * ({world[1]}) + m{r}2 * ({world[2]}) + o{'xyz'[r]}) / {number(spacing[r])} as c{'xyz'[r]}" for r in range(3)]
    snap = ", ".join(f"case when abs({c} - round_even({c}, 0)) < 1e-9 then round_even({c}, 0) else {c} end as {c}" for c in ("cx", "cy", "cz"))
    n = VOX_GRID.shape
    inside = " and ".join(f"c{x} >= -0.5 and c{x} < {m - 0.5}" for x, m in zip("xyz", n))
    clamp = ", ".join(f"least(greatest(c{x}, 0), {m - 1}) as c{x}" for x, m in zip("xyz", n))
    return {
        "centre": "select volume_id, " + ", ".join(f"avg({q} * {number(v)}) as o{x}" for q, x, v in zip("ijk", "xyz", spacing)) + " from vox_a group by 1",
        "pose": f"""select candidate, {', '.join(cells)} from (select cast(f.n * {360 // step} + r.range as bigint) as candidate, f.f, cos(radians(r.range * {step})) as c, sin(radians(r.range * {step})) as s
            from (values (0, 1.0::double), (1, -1.0::double)) f(n, f), range({360 // step}) r)""",
        "full_grid": f"select volume_id, cast(x.range as bigint) as i, cast(y.range as bigint) as j, cast(z.range as bigint) as k from centre, range({n[0]}) x, range({n[1]}) y, range({n[2]}) z",
        "placed": f"select volume_id, candidate, i, j, k, {', '.join(source)} from full_grid join centre using (volume_id), pose",
        "coords": f"select volume_id, candidate, i, j, k, {clamp} from (select volume_id, candidate, i, j, k, {snap} from placed) where {inside}",
        "moved": """select c.volume_id, c.candidate, c.i, c.j, c.k, sum(w * value) as value from (
            select *, (case dx when 0 then 1 - (cx - floor(cx)) else cx - floor(cx) end) * (case dy when 0 then 1 - (cy - floor(cy)) else cy - floor(cy) end)
                   * (case dz when 0 then 1 - (cz - floor(cz)) else cz - floor(cz) end) as w
            from coords, (values (0), (1)) a(dx), (values (0), (1)) b(dy), (values (0), (1)) e(dz)) c
            join vox_b v on v.volume_id = c.volume_id and v.i = floor(cx) + dx and v.j = floor(cy) + dy and v.k = floor(cz) + dz where w > 0 group by 1, 2, 3, 4, 5""",
        "p": """select g.volume_id, q.candidate, coalesce(a.value, 0) as a, coalesce(b.value, 0) as b from full_grid g cross join (select candidate from pose) q
            left join vox_a a on a.volume_id = g.volume_id and a.i = g.i and a.j = g.j and a.k = g.k
            left join moved b on b.volume_id = g.volume_id and b.i = g.i and b.j = g.j and b.k = g.k and b.candidate = q.candidate""",
        **{name: sql.format(keys="volume_id, candidate") for name, sql in MI.items()}}


@query("score_candidates", compose("vox vox_a vox_b", """
    select volume_id, candidate, n, round(ncc, 5) as ncc, round(mi, 5) as mi, case when mi is null or ncc is null then 'failed' else 'success' end as status
    from ncc left join mi using (volume_id, candidate)""", _pose_sql()))
def _(t: Tables):
    """All 24 poses per volume scored against the fixed map."""
    maps = keep_table(t.vox(), "vox")
    fixed, moving = (maps.select("volume_id", "i", "j", "k", F.col(c).alias("value")) for c in ("value_a", "value_b"))
    return rounded(registration.score_candidates(fixed, moving, _poses(fixed), VOX_GRID), 5)


@query("rank_candidates", compose("vox", """
    select flag, candidate, mi, row_number() over (partition by flag order by mi desc, candidate) as rank from (
      select flag, mi, cast(case when status = 'F' then 0 else 1 end + case when scope = 'global' then 0 else 2 end as bigint) as candidate from m)""", RUNS))
def _(t: Tables):
    """The runs of one flag ranked as candidates."""
    number = (F.when(F.col("status") == "F", 0).otherwise(1) + F.when(F.col("scope") == "global", 0).otherwise(2)).cast("long")
    scores = _run_metrics(t).select(F.col("flag").alias("volume_id"), number.alias("candidate"), "mi", F.lit("success").alias("status"))
    return rounded(registration.rank_candidates(scores).select(F.col("volume_id").alias("flag"), "candidate", "mi", "rank"))


@query("select_candidate", compose("vox", """
    select flag, arg_max(candidate, (mi, -candidate)) as candidate, max(mi) as combined_score from (
      select flag, mi, cast(case when status = 'F' then 0 else 1 end + case when scope = 'global' then 0 else 2 end as bigint) as candidate from m) group by 1""", RUNS))
def _(t: Tables):
    number = (F.when(F.col("status") == "F", 0).otherwise(1) + F.when(F.col("scope") == "global", 0).otherwise(2)).cast("long")
    scores = _run_metrics(t).select(F.col("flag").alias("volume_id"), number.alias("candidate"), "mi", F.lit("success").alias("status"))
    return registration.select_candidate(scores).select(F.col("volume_id").alias("flag"), "candidate", "combined_score")


SHIFT = (3.7, -4.1, 1.3)
MOVED = {
    "coords": coordinates_sql(Grid.regular((50, 11, 9), (3.0, 9.0, 24.0 / 9.0), SHIFT), VOX_GRID, "half_voxel"),
    "lin_a": TRILINEAR.format(source="vox_a"), "lin_b": TRILINEAR.format(source="vox_b"),
    "hit": "select c.volume_id, c.i, c.j, c.k from coords c join vox_a v on v.volume_id = c.volume_id and v.i = floor(cx + 0.5) and v.j = floor(cy + 0.5) and v.k = floor(cz + 0.5) where value > 40000",
}


def _images(t: Tables):
    return t.metrics().withColumnRenamed("metric", "image")


def _shift(t: Tables):
    values = (1, 0, 0, SHIFT[0], 0, 1, 0, SHIFT[1], 0, 0, 1, SHIFT[2], 0, 0, 0, 1)
    return t.vox_a().select("volume_id").distinct().select("volume_id", F.array(*[F.lit(float(v)) for v in values]).alias("matrix"))


@query("apply_transforms", compose("vox_a vox_b", """
    select volume_id, image, i, j, k, round(value * cast(0.7310585786300049 as double), 3) as value from (
      select *, 'a' as image from lin_a union all select *, 'b' from lin_b) semi join hit using (volume_id, i, j, k)""", MOVED))
def _(t: Tables):
    """Both maps and the mask moved by a chain, the maps masked."""
    mask = t.vox_a().where("value > 40000")
    moved = registration.apply_transforms(_images(t), mask, _shift(t), VOX_GRID, VOX_GRID)
    return rounded(moved.withColumn("value", F.col("value") * 0.7310585786300049), 3)


EVALUATED = {
    **MOVED,
    "full_grid": "select volume_id, cast(x.range as bigint) as i, cast(y.range as bigint) as j, cast(z.range as bigint) as k from (select distinct volume_id from vox), range(50) x, range(11) y, range(9) z",
    "moved": "select *, 'a' as image from lin_a union all select *, 'b' from lin_b",
    "p": """select g.volume_id, n.image, s.scope, coalesce(v.value, 0) as a, coalesce(m.value, 0) as b
            from full_grid g cross join (values ('a'), ('b')) n(image) cross join (values ('global'), ('mask')) s(scope)
            left join vox_a v on v.volume_id = g.volume_id and v.i = g.i and v.j = g.j and v.k = g.k
            left join moved m on m.volume_id = g.volume_id and m.i = g.i and m.j = g.j and m.k = g.k and m.image = n.image
            where s.scope = 'global' or v.value > 40000""",
    **{n: sql.format(keys="volume_id, image, scope") for n, sql in MI.items()},
}


EVALUATED_SQL = compose("vox vox_a vox_b", """
    select volume_id, image, scope, n, round(ncc, 5) as ncc, round(mi, 5) as mi from ncc left join mi using (volume_id, image, scope)""", EVALUATED)


@query("evaluate_transforms_mi", EVALUATED_SQL)
@query("evaluate_transforms", EVALUATED_SQL)
def _(t: Tables):
    """MI and NCC of the moved maps against the fixed map in both scopes."""
    t.keep_vox()
    out = registration.evaluate_transforms(t.vox_a(), t.vox_a().where("value > 40000"), _images(t), _shift(t), VOX_GRID, VOX_GRID)
    return rounded(out.select("volume_id", "image", "scope", "n", "ncc", "mi"), 5)


NATIVE = (5.0, 9.0, 24.0 / 9.0)
FIGURES = [f"{m}_{scope}_{image}" for image in "ab" for scope in ("global", "mask") for m in ("mi", "ncc")]
ON_NATIVE = {
    "bright": "select volume_id, i, j, k, 1 as value from vox_a where value > 40000",
    "coords": coordinates_sql(Grid.regular((30, 11, 9), NATIVE), VOX_GRID, "half_voxel"),
    "fixed_native": TRILINEAR.format(source="vox_a"), "mask_native": NEAREST.format(source="bright"),
    "shifted": coordinates_sql(Grid.regular((30, 11, 9), NATIVE, SHIFT), VOX_GRID, "half_voxel"),
    "moved": "select *, 'a' as image from (" + TRILINEAR.format(source="vox_a").replace("coords", "shifted") + ") union all select *, 'b' from (" + TRILINEAR.format(source="vox_b").replace("coords", "shifted") + ")",
    "native_cells": "select volume_id, cast(x.range as bigint) as i, cast(y.range as bigint) as j, cast(z.range as bigint) as k from (select distinct volume_id from vox), range(30) x, range(11) y, range(9) z",
    "p": """select g.volume_id, n.image, s.scope, coalesce(v.value, 0) as a, coalesce(m.value, 0) as b
            from native_cells g cross join (values ('a'), ('b')) n(image) cross join (values ('global'), ('mask')) s(scope)
            left join fixed_native v on v.volume_id = g.volume_id and v.i = g.i and v.j = g.j and v.k = g.k
            left join moved m on m.volume_id = g.volume_id and m.i = g.i and m.j = g.j and m.k = g.k and m.image = n.image
            left join mask_native q on q.volume_id = g.volume_id and q.i = g.i and q.j = g.j and q.k = g.k
            where s.scope = 'global' or q.value is not null""",
    **{n: sql.format(keys="volume_id, image, scope") for n, sql in MI.items()},
}


@query("evaluate_registration", compose("vox vox_a vox_b", """
    select 'volume ' || volume_id as input_image, 'shift' as registration, cast(case when volume_id = 0 then 0 else 2 + volume_id end as bigint) as row_order, """ + ", ".join(
        f"round(max({f.split('_')[0]}) filter (scope = '{f.split('_')[1]}' and image = '{f.split('_')[2]}'), 5) as {f}" for f in FIGURES) + """
    from ncc left join mi using (volume_id, image, scope) group by volume_id
    union all select 'volume 0', 'other', 1, """ + ", ".join("cast(0 as double)" for _ in FIGURES), ON_NATIVE))
def _(t: Tables):
    """The summary of an evaluation on the native grid: one run replaced, one left, the others appended."""
    volume = t.vox_a().select("volume_id").distinct()
    named = lambda df, registration, place: df.select(F.concat(F.lit("volume "), F.col("volume_id").cast("string")).alias("input_image"), F.lit(registration).alias("registration"), place.cast("long").alias("row_order"), *df.columns)
    first = volume.where("volume_id = 0")
    existing = named(first, "shift", F.lit(0)).unionByName(named(first, "other", F.lit(1))).drop("volume_id").select("*", *[F.lit(0.0).alias(f) for f in FIGURES])
    out = evaluate_registration(existing, named(volume, "shift", F.col("volume_id")), t.vox_a(), t.vox_a().where("value > 40000"), _images(t), _shift(t), VOX_GRID, VOX_GRID, NATIVE, ["a", "b"])
    return rounded(out, 5)


@query("sample_rows", compose("cloud", "select volume_id, point_id, x, y, z from cloud order by md5('1234|' || cast(point_id as varchar)), point_id limit 300"))
def _(t: Tables):
    """300 points of the cloud in hash order."""
    return registration.sample_rows(t.cloud(), "point_id", 300, 1234)


# --- workflows -----------------------------------------------------------------------------------

REGRID = " union all ".join(f"""
    select volume_id, cast(floor((x + 0.5) / cast({s} as double)) as bigint) as i, cast(floor((y + 0.5) / cast({s} as double)) as bigint) as j,
           cast(floor((z + 0.5) / cast({s} as double)) as bigint) as k, cast({s} as double) as spacing
    from pts where x >= -0.5 and x < 149.5 and y >= -0.5 and y < 99.5 and z >= -0.5 and z < 23.5
      and floor((x + 0.5) / {s}) < greatest(round_even(150 / {s}, 0), 1) and floor((y + 0.5) / {s}) < greatest(round_even(100 / {s}, 0), 1)
      and floor((z + 0.5) / {s}) < greatest(round_even(24 / {s}, 0), 1)""" for s in ("3.6", "20.0", "44.79"))


@query("regrid_counts", compose("pts", f"select volume_id, i, j, k, spacing, count(*) as n_points from ({REGRID}) group by 1, 2, 3, 4, 5"))
def _(t: Tables):
    """Counts on grids of 3.6, 20 and 44.79 µm."""
    return regrid_counts(t.pts(), PTS_GRID, (3.6, 20.0, 44.79))


@query("slab_correlation", compose("pairs", "select metric, count(*) as n, round(corr(density, value), 6) as pearson_r, round(corr(rx, ry), 6) as spearman_r from r group by 1",
                                   {"cut": "select * from pairs where (i + 0.5) * 3 / 1000 between 0.03 and 0.11",
                                    "r": RANKED.format(key="metric", x="density", y="value", source="cut")}))
def _(t: Tables):
    """The density correlation inside a sagittal slab."""
    grids = t.grids(t.vox_a(), VOX_GRID)
    out = slab_correlation(t.pts(), PTS_GRID, VOX_GRID, t.metrics(), grids, "sagittal", (0.03, 0.11))
    return rounded(out.select("metric", "n", "pearson_r", "spearman_r"))


@query("block_sv", compose("labels2", """
    select volume_id, cast(36 as bigint) as n_blocks, round(sum(s) / 36, 6) as mean, round(max(s), 6) as max from (
      select volume_id, i // 8 as bi, j // 8 as bj, count(distinct label) * 2 * pi() * 12.5 / 2500 as s from labels2 group by 1, 2, 3) group by 1"""))
def _(t: Tables):
    """Summary of surface-to-volume per block."""
    blocked = cells.block_label_count(cells.block_of_voxel(t.labels2(), (8.0, 8.0), (6, 6)), 12.5, 2500.0)
    return rounded(cells.block_summary(blocked, (6, 6)))


@query("block_sv3", compose("field3", """
    select volume_id, cast(32 as bigint) as n_blocks, round(sum(s) / 32, 6) as mean, round(max(s), 6) as max from (
      select volume_id, i // 4 as bi, j // 8 as bj, k // 2 as bk, count(distinct (i + j + k) % 7 + 1) * 2 * pi() * 12.5 / 2500 as s
      from field3 group by 1, 2, 3, 4) group by 1"""))
def _(t: Tables):
    """The same over blocks in three axes."""
    labels = t.field3().select("volume_id", "i", "j", "k", ((F.col("i") + F.col("j") + F.col("k")) % 7 + 1).alias("label"))
    blocked = cells.block_label_count(cells.block_of_voxel(labels, (4.0, 8.0, 2.0), (4, 2, 4)), 12.5, 2500.0)
    return rounded(cells.block_summary(blocked, (4, 2, 4)))


@query("stream_patch_results", compose("patch_labels", "select volume_id, patch_index, local_label, count(*) as voxels from patch_labels group by 1, 2, 3"))
def _(t: Tables):
    """Patch labels delivered in two rounds: some patches twice in one round, some in both, and one in two parts."""
    incoming, store, mark = (scratch_path(t.spark, n) for n in ("incoming", "store", "progress"))
    labels = cut_lineage(t.patch_labels())
    early = labels.where("patch_index < 6 and (patch_index <> 4 or i % 2 = 0)")
    early.unionByName(labels.where("patch_index = 1")).write.mode("append").parquet(incoming)
    stream_patch_results(t.spark, incoming, store, mark).awaitTermination()
    labels.where("patch_index >= 3").write.mode("append").parquet(incoming)
    stream_patch_results(t.spark, incoming, store, mark).awaitTermination()
    return stored_counts(t.spark, store)
