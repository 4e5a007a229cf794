import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from voxframe.session import build_session

    return build_session("local[8]", 8)


@pytest.fixture()
def voxels(spark):
    """Build a (volume_id, i, j, k, extra…) table from tuples ``(i, j[, k], extra…)``."""

    def build(rows, columns="value double", volume=0, dims=2):
        fixed = [(volume, r[0], r[1], *((r[2], *r[3:]) if dims == 3 else (0, *r[2:]))) for r in rows]
        extra = f", {columns}" if columns else ""
        return spark.createDataFrame(fixed, f"volume_id long, i long, j long, k long{extra}")

    return build
