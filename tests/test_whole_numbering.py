"""Numbering inside groups over the whole table, each group cut into slices."""

import pytest
from pyspark.sql import functions as F

from quadrat.operators import numbering
from quadrat_queries import load_all
from quadrat_queries.occ import table
from quadrat_queries.registry import ORACLES, QUERIES
from tests.compare import connect, mismatch

load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ["rows_numbered_within_group", "rows_numbered_whole_table"])
def test_agrees_with_sql(spark, con, name):
    assert mismatch(spark, QUERIES[name], ORACLES[name], SF, con) is None


@pytest.mark.parametrize("name", ["rows_numbered_within_group", "rows_numbered_whole_table"])
def test_all_groups_are_sliced(spark, monkeypatch, name):
    seen, real = [], numbering.number_within

    def watched(df, keys, *args, hot_rows, **more):
        seen.append(df.groupBy(*keys).count().filter(F.col("count") <= hot_rows).count())
        return real(df, keys, *args, hot_rows=hot_rows, **more)

    monkeypatch.setattr(numbering, "number_within", watched)
    rows = QUERIES[name](spark, SF).count()
    assert seen == [0]
    if name.endswith("table"):
        assert rows == table(spark, SF, "lineitem").count()
