import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from __spark_entry__ import local_session

    session = local_session(cpus=4, partitions=4)
    # Small tables would end up in one slice, and borders between slices would go untested.
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return session


@pytest.fixture
def rows(spark):
    """DataFrame from tuples and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)
