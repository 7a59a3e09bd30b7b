import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import duck, spark_session

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return spark_session()


@pytest.fixture(scope="session")
def con():
    return duck(ROOT)


@pytest.fixture(scope="session")
def root():
    return ROOT


@pytest.fixture
def split(spark):
    """Force the plans meant for groups too large for one task."""
    spark.conf.set("spark.tidemark.maxGroupRows", "20")
    spark.conf.set("spark.tidemark.smallInputBytes", "0")
    yield
    spark.conf.unset("spark.tidemark.maxGroupRows")
    spark.conf.unset("spark.tidemark.smallInputBytes")
