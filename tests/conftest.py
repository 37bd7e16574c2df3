import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest

from loomgraph.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": "/tmp/loomgraph-warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    return s
