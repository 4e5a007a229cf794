"""Results that only larger or odder tables than the smallest scale show."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.grid import Grid
from voxframe.operators import ranking, similarity as sim, stats, transforms
from voxframe.sources import points as ps, volumes


def test_limits_of_weighted_pairs_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(a), float(b), int(w)) for g in range(3) for a, b, w in zip(
        rng.normal(size=700), np.where(rng.random(700) < 0.5, 0.0, rng.normal(size=700) * 10.0 ** rng.integers(-300, 300, 700)), rng.integers(1, 9, 700))]
    rows += [(3, 2.0, -1e308, 4), (3, 2.0, 1e308, 3)]
    df = spark.createDataFrame(rows, "g long, a double, b double, weight long")
    for r in sim.robust_limits(df, ["g"]).collect():
        for side in "ab":
            every = np.sort(np.repeat([x["ab".index(side) + 1] for x in rows if x[0] == r.g], [x[3] for x in rows if x[0] == r.g]))
            for name, p in (("lo", 0.01), ("hi", 0.99)):
                at = p * (len(every) - 1)
                low, high = every[int(np.floor(at))], every[int(np.ceil(at))]
                assert r[f"{name}_{side}"] == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12)


def test_limits_count_only_the_cells_of_their_ranks(spark, monkeypatch):
    """All values used to be ranked, each as a row of its own."""
    ranked, plain = [], sim.prefix_sums
    monkeypatch.setattr(sim, "prefix_sums", lambda df, *rest, **more: ranked.append(df.count()) or plain(df, *rest, **more))
    df = spark.range(20000).select(F.col("id").cast("double").alias("a"), (F.col("id") * 3.0).alias("b"))
    pairs = sim.with_empty(df.selectExpr("0L as g", "a", "b"), ["g"], None)
    sim.robust_limits(pairs, ["g"]).collect()
    assert ranked and ranked[0] < 1000


def test_fixed_formats_round_the_binary_value(spark, tmp_path):
    values = [0.0000005, 0.0000015, 2.5e-6, 1234.5678905, -0.0000005, None]
    ps.write_table(spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n long, value double"), str(tmp_path / "t"), {"value": "%.6f"})
    found = {int(r.n): r.value for r in ps.read_text_table(spark, str(tmp_path / "t")).collect()}
    assert found == {n: None if v is None else "%.6f" % v for n, v in enumerate(values)}


def test_flat_density_inside_the_mask(spark, tmp_path):
    """A volume without points: the query says 1, its SQL used to divide by zero."""
    import compare
    import duckdb
    from voxframe.plans.catalog import REGISTRY

    for table in compare.TABLES:
        kept = "where event_id < 200" if table == "events" else ""
        shift = "select * replace (l_orderkey + n * 6000 as l_orderkey) from (select * from t, range(2) r(n))" if table == "lineitem" else "select * from t"
        shift = shift.replace("* replace (l_orderkey + n * 6000 as l_orderkey)", "* exclude (n) replace (l_orderkey + n * 6000 as l_orderkey)")
        duckdb.execute(f"copy (with t as (select * from '/root/testdata/sf0.001/{table}.parquet' {kept}) {shift}) to '{tmp_path}/{table}.parquet' (format parquet)")
    status, _, _, note = compare.compare(spark, str(tmp_path), "invert_density", REGISTRY["invert_density"])
    assert status == "ok", note


def test_parameter_files_lie_in_one_folder(spark, tmp_path, monkeypatch):
    """A folder per file was made and listed one by one."""
    from voxframe.plans.catalog import REGISTRY, run_queries

    monkeypatch.setattr(run_queries, "scratch_path", lambda session, name: str(tmp_path / name))
    rows = REGISTRY["read_transform_params"].run(spark, "/root/testdata/sf0.001").count()
    folder = tmp_path / "parameters"
    assert not any(p.is_dir() for p in folder.iterdir())
    assert len([p for p in folder.iterdir() if p.name.endswith(".txt") and p.stat().st_size]) == rows > 0


@pytest.fixture()
def no_small_tables(spark):
    """Spark neither sends small tables to all tasks by itself nor merges partitions, as with tables of any size."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("few", [10_000, 0])
def test_groups_of_many_rows_are_shared_by_the_tasks(spark, monkeypatch, no_small_tables, few):
    """All rows of a metric used to meet in one task to get the limits of its terciles."""
    monkeypatch.setattr(ranking, "FEW_GROUPS", few)
    pairs = spark.range(0, 8000, 1, 8).selectExpr("if(id % 8 = 0, 'a', 'b') as metric", "double(id % 40) as x", "double(id % 977) as y")
    out = stats.tercile_groups(pairs, ["metric"], "x", ["y"])
    assert out.count() == 8000
    assert most_in_a_task(out) < 3000


@pytest.mark.parametrize("few", [10_000, 0])
def test_joined_groups_are_those_of_a_join(spark, monkeypatch, few):
    monkeypatch.setattr(ranking, "FEW_GROUPS", few)
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("a", 2, None), ("b", 3, 2.0), (None, 4, 3.0)], "g string, n long, v double")
    groups = spark.createDataFrame([("a", 7), ("c", 8), (None, 9)], "g string, m long")
    for by in ([], ["v"], ["n", "v"]):
        found = ranking.join_groups(rows, groups, ["g"], by)
        assert sorted(map(tuple, found.fillna(-1.0).collect())) == [("a", 1, 1.0, 7), ("a", 1, 1.0, 7), ("a", 2, -1.0, 7)]


def test_key_sets_of_many_pairs_are_not_shuffled(spark, no_small_tables):
    """The pairs used to be sorted by key set, in as many tasks as there were key sets, for their ends, cells and limits."""
    pairs = spark.range(0, 4000, 1, 8).selectExpr("id % 2 as g", "double(id % 101) as a", "double(id % 97) as b")
    plan = sim.mutual_information(pairs, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0 and "BroadcastHashJoin" in plan


def test_fixed_growth_and_its_sql_stop_at_pixels_of_lower_markers(spark, tmp_path):
    """The SQL let the marker at (10, 14) grow to (12, 13) through pixels that the one at (10, 10) holds."""
    import duckdb

    from voxframe.plans.catalog import REGISTRY

    values = {(10, 10): 50.0, (10, 14): 50.0, **{p: 49.0 for p in ((10, 11), (10, 12), (10, 13), (11, 12), (12, 13))}}
    rows = [(volume * 500, i, j, 0, v) for volume in range(2) for (i, j), v in values.items()]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    query = REGISTRY["region_grow_fixed"]
    found = {tuple(r) for r in query.run(spark, str(tmp_path)).collect()}
    held = {(10, 10), (10, 11), (10, 12), (10, 13), (11, 12)}
    assert found == {(v, i, j, 0, 491 if (i, j) in held else 495) for v in range(2) for i, j in held | {(10, 14)}}
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert set(con.execute(query.sql).fetchall()) == found


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_jacobian_makes_no_rows_for_neighbours(spark):
    """Every voxel used to be sent to six places."""
    field = spark.range(125).selectExpr("0L as volume_id", "id div 25 as i", "id div 5 % 5 as j", "id % 5 as k").selectExpr("*", "0.5 * i as dx", "0.1 * i as dy", "double(-0.2 * k) as dz")
    out = transforms.jacobian_map(field.where("NOT (i = 2 AND j = 2 AND k = 0)"))
    assert "Generate" not in plan_of(out)
    assert {(r.i, r.j, r.k): round(r.value, 9) for r in out.collect()} == {(i, j, k): 1.2 for i in (1, 2, 3) for j in (1, 2, 3) for k in (1, 2, 3) if (i, j, k) != (2, 2, 1)}


def test_voxels_of_patches_do_not_carry_their_box(spark, tmp_path):
    """Name, matrix and box of a patch used to be joined to each of its voxels."""
    voxels = spark.createDataFrame([(0, 1, 2, 0, 5.0)], "volume_id long, i long, j long, k long, value double")
    boxes = spark.createDataFrame([(0, n, 0, 1, 0, 4, 4 * n, 4 * n + 4) for n in range(2)], "volume_id long, patch_index long, z0 long, z1 long, y0 long, y1 long, x0 long, x1 long")
    out = volumes.write_patches(voxels, boxes, Grid.regular((8, 4, 1)), str(tmp_path))
    assert not [line for line in plan_of(out).splitlines() if "Join" in line and re.search(r"\(patch_index#\d+L? = patch_index#", line)]
    assert sorted((r.patch_index, r.n_voxels) for r in out.collect()) == [(0, 1), (1, 0)]


def test_labels_of_patches_are_computed_once(spark):
    """The merged volume used to cut the patches again for each of its inputs."""
    from voxframe.plans.workflows import merge_patches

    labels = spark.range(2 * 6 * 6).selectExpr("0L as volume_id", "id div 36 as patch_index", "id div 6 % 6 + 4 * (id div 36) as i", "id % 6 as j", "0L as k", "1L as local_label")
    boxes = spark.createDataFrame([(0, n, 0, 1, 0, 6, 4 * n, 4 * n + 6) for n in range(2)], "volume_id long, patch_index long, z0 long, z1 long, y0 long, y1 long, x0 long, x1 long")
    sizes = spark.createDataFrame([(0, 10, 6, 1)], "volume_id long, nx long, ny long, nz long")
    merged = merge_patches(labels, boxes, sizes)["labels"]
    assert "Range (" not in plan_of(merged)
    assert {(r.i, r.j): r.label for r in merged.collect()} == {(i, j): 1 for i in range(10) for j in range(6)}
