"""The profile of columns: one aggregate over cells, read once by the header rules."""

from quadrat.operators.stats import column_profile
from quadrat_queries import headers


def test_shares_of_odd_cells(spark):
    rows = [("1,5", None), (" 91 ", ""), ("x", " "), (None, None), ("-180", "")]
    got = {r["column"]: r for r in column_profile(spark.createDataFrame(rows, "a string, `b.c` string"), ["a", "b.c"]).collect()}
    a, b = got["a"], got["b.c"]
    assert (a["filled"], a["completeness"], a["numeric"], a["latitude"], a["longitude"], a["count"]) == (4, 0.8, 0.75, 0.25, 0.75, 0.25)
    assert (b["filled"], b["completeness"], b["numeric"], b["basis"]) == (0, 0.0, 0.0, 0.0)


def test_a_table_without_rows_has_its_columns(spark):
    got = column_profile(spark.createDataFrame([], "a string, b string"), ["a", "b"]).collect()
    assert sorted((r["column"], r["filled"], r["completeness"], r["name"]) for r in got) == [("a", 0, 0.0, 0.0), ("b", 0, 0.0, 0.0)]


def test_decisions_do_not_read_the_table_again(spark):
    plan = headers.decisions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan
