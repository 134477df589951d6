import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import compare  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return compare.session()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    return compare.connect(SF)


@pytest.fixture(scope="session")
def points(spark):
    from checks import base

    return base.points(spark, SF).persist()


def matrix(df, vector="x", key="vec_id"):
    """(ids, rows) on the driver, in id order; for small fixtures only."""
    import numpy as np

    rows = sorted(df.select(key, vector).collect())
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
