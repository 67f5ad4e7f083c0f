from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from farmspark.session import get_session
    s = get_session("local[*]", shuffle_partitions=8,
                    extra={"spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


@pytest.fixture()
def tables(spark):
    """Build a Tables object from small in-test frames; unnamed business
    tables are empty with their declared schema."""
    from farmspark.sources import schemas
    from farmspark.sources.tables import Tables

    def make(**frames):
        full = {}
        for name, schema in schemas.BUSINESS.items():
            rows = frames.get(name, [])
            full[name] = rows if not isinstance(rows, list) else spark.createDataFrame(rows, schema)
        return Tables(spark, full, None)
    return make
