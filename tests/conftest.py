import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from larder.session import build_session
    session = build_session(master="local[*]", shuffle_partitions=8,
                            extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="larder-test-")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_catalog(spark):
    from larder.sources import Catalog
    return Catalog.derived(spark, SF_SMALL)


@pytest.fixture(scope="session")
def table(spark, small_catalog):
    """Build a small hand-made domain table with the real table's schema."""
    def make(name, rows):
        return spark.createDataFrame(rows, small_catalog[name].schema)
    return make


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, ddl): a small DataFrame in two partitions."""
    def make(rows, ddl):
        return spark.createDataFrame(rows, ddl).repartition(2) if rows else spark.createDataFrame([], ddl)
    return make
