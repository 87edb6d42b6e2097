import os

import pytest

from quadrat.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", os.environ.get("TEST_MASTER", "local[8]"),
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": "/tmp/quadrat-warehouse",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
