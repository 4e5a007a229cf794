"""Queries that return every cell and every copy."""

from voxframe.plans.adapters import Tables
from voxframe.plans.catalog import REGISTRY

FOLDER = "/root/testdata/sf0.001"


def test_full_cells_are_kept(spark):
    rows = REGISTRY["expected_single_sv_all"].run(spark, FOLDER)
    assert rows.count() == REGISTRY["sv_map"].run(spark, FOLDER).count()
    full = rows.where("volume_exhausted").collect()
    assert full and {r.ratio_to_single for r in full} == {0.0}


def test_four_copies_of_every_volume(spark):
    copies = REGISTRY["augment_volumes"].run(spark, FOLDER).select("volume_id", "copy").distinct().groupBy("volume_id").count().collect()
    volumes = Tables(spark, FOLDER).vox_a().select("volume_id").distinct().count()
    assert len(copies) == volumes and {r["count"] for r in copies} == {4}
