"""Dates, coordinates and problem cells are worked out once per distinct text."""

from pyspark.sql import functions as F

from quadrat.functions import coords as C
from quadrat.functions import dates as D
from quadrat.operators.ids import resolve_ids
from quadrat.operators.quality import detect_problems

DATES = ["25/06/2020", "03/04/2021", " 03/04/2021", "2020-01-02", "", None, "sem data", "1990-1995", "01/02/2003 a 05/06/2003", "1 maio 2001 08:30"]


def test_dates_are_looked_up_and_equal_those_read_row_by_row(spark):
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(DATES * 3)], "row_id long, __v string, d string").withColumn("d", F.col("__v"))
    got = D.dates_to_iso(df, ["__v", "d"], 2026, ambiguous_suffix="_amb")
    assert got.columns == ["row_id", "__v", "d", "__v_iso", "d_iso", "__v_amb", "d_amb"]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    want = D._read_dates(df, ["__v", "d"], 2026, {"__v": F.lit(True), "d": F.lit(True)}, "_iso", "_amb")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_coordinates_that_are_no_plain_number_are_looked_up(spark):
    cells = ["-10.5", "10,25", "", None, "10° 30' S", "-10.5, -50.25", "abc", " 7 "]
    df = spark.createDataFrame([(i, c, "-50.25") for i, c in enumerate(cells)], "row_id long, lat string, lon string")
    got = C.convert_coordinates(df, {"lat": "lat", "lon": "lon"})
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert {r["row_id"]: r["lat"] for r in got.collect()} == {
        0: "-10.5", 1: "10,25", 2: "", 3: None, 4: "-10.5", 5: "-10.5", 6: "abc", 7: " 7 "}


def test_uncertainties_are_judged_by_the_decimals_of_their_column(spark):
    """The column's habit is a subquery, which may not stand inside the functions that read an uncertainty."""
    for other, kinds in (("2.55", []), ("30", ["uncertainty_invalid"])):
        df = spark.createDataFrame([(1, "1.000"), (2, other)], "row_id long, coordinateUncertaintyInMeters string")
        assert [r["type"] for r in detect_problems(df, 2026).collect()] == kinds


def test_only_rows_without_identifier_are_joined(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, "", "x"), (3, None, "x")], "row_id long, occurrenceID string, v string")
    got = {r["row_id"]: (r["occurrenceID"], r["id_origin"]) for r in resolve_ids(df).collect()}
    assert got[1] == ("A", "supplied") and got[2][1] == got[3][1] == "generated" and got[2][0] != got[3][0]
