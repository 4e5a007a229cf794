"""Every catalog query against its SQL at the smallest scale."""

import pytest
from compare import compare

from voxframe.plans.catalog import REGISTRY

FOLDER = "/root/testdata/sf0.001"

# Queries that SQL does not express, and what checks them instead.
WITHOUT_SQL = {
    "augment_volumes": "random by design; its ranges are checked here by running it",
    "seeded_watershed": "arrival order over paths; test_watershed floods in sequence",
    "region_grow": "the mean moves while a region grows; test_region_grow grows in rings",
    "fibre_segmentation": "composed of blobs and the watershed",
}


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, name):
    status, count, _, note = compare(spark, FOLDER, name, REGISTRY[name])
    assert status == ("rows" if name in WITHOUT_SQL else "ok"), note
