"""Queries whose rows change with the row number agree with their SQL on numbers far above those of the given tables."""

import datetime as dt

import pytest

from quadrat_queries import load_all
from quadrat_queries.registry import ORACLES, QUERIES
from tests.compare import connect, mismatch

load_all()
# Points with equal axes or close to (0, 0), and northings above 10,000,000.
KEYS = {
    "own_point_redacted_in_text": [750432, 604632, 766154, 699276, 88622, 303254, 12, 24, 36, 50],
    "coordinate_projected_pair": [5, 2_999_999, 3_000_001, 4_700_000, 8_999_999],
}


@pytest.mark.parametrize("name", KEYS)
def test_far_keys(spark, tmp_path, name):
    rows = [(k, "1-URGENT", dt.datetime(2020, 1, 2)) for k in KEYS[name]]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_orderdate timestamp")
    orders.coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "orders.parquet")
    assert mismatch(spark, QUERIES[name], ORACLES[name], str(tmp_path), connect(str(tmp_path))) is None
