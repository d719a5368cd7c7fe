import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from meterframe.session import build_session

    warehouse = tempfile.mkdtemp(prefix="meterframe-warehouse-")
    s = build_session("local[4]", app="meterframe-tests", conf={"spark.sql.shuffle.partitions": "8", "spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    if not os.path.isdir(SF_SMALL):
        pytest.skip("test data not present")
    return SF_SMALL


def rows(df, *cols):
    """Collected rows as tuples, in the frame's order."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
