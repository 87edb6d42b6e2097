"""Cells with known answers."""

import pytest
from pyspark.sql import functions as F

from quadrat.functions import coords as C
from quadrat.functions import dates as D
from quadrat.functions import jsontext as J
from quadrat.functions import numbers as M
from quadrat.functions.names import with_parts
from quadrat.functions.redaction import redact_cell

DATES = {
    "25/12/2019": "2019-12-25", "12/25/2019": "2019-12-25", "2019/1/5": "2019-01-05", "2019.01.05": "2019-01-05", "5/2019": "2019-05",
    "2019-05": "2019-05", "20190105": "2019-01-05", "18500101": "1850-01-01", "99990101": None, "12 de janeiro de 2020": "2020-01-12",
    "3 jan. 2020": "2020-01-03", "12-VI-1998": "1998-06-12", "março 2001": "2001-03", "1998-2001": "1998/2001", "2001-1998": None,
    "01/01/2020 - 20/01/2020": "2020-01-01/2020-01-20", "25/12/19": "2019-12-25", "25/12/99": "1999-12-25", "25-12-19": None,
    "25/12/2019 08:30 PM": "2019-12-25T20:30", "2019-12-25T8:05Z": "2019-12-25T08:05Z", "31/02/2019": None, "sem data": None, "": None,
    "2019-01-05 a 2019-02-06": "2019-01-05/2019-02-06", "abc - 2019-01-01": None,
}


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "d string")
    got = {r["d"]: r["d_iso"] for r in D.dates_to_iso(df, ["d"], 2026).collect()}
    assert got == DATES


def test_ambiguous_dates_wait_for_a_vote(spark):
    df = spark.createDataFrame([("05/06/2020",), ("07/08/2020",)], "d string")
    rows = D.dates_to_iso(df, ["d"], 2026, ambiguous_suffix="_amb").collect()
    assert [r["d_iso"] for r in rows] == [None, None] and all(r["d_amb"] for r in rows)
    voted = D.dates_to_iso(df.union(spark.createDataFrame([("25/06/2020",)], "d string")), ["d"], 2026).collect()
    assert {r["d_iso"] for r in voted} == {"2020-06-05", "2020-08-07", "2020-06-25"}


PAIRS = {
    "23°30'S 46°37'W": (-23.5, -46.616667), "-23.55, -46.63": (-23.55, -46.63), "46.63W; 23.55S": (-23.55, -46.63),
    "-46 -23": None, "23°30'S": None, "lat": None,
}


def test_coordinate_pairs(spark):
    df = spark.createDataFrame([(k,) for k in PAIRS], "c string")
    got = {r["c"]: r["c_pair"] and (r["c_pair"]["lat"], r["c_pair"]["lon"]) for r in C.with_coordinate_pairs(df, ["c"]).collect()}
    assert got == PAIRS


@pytest.mark.parametrize(("text", "axis", "want"), [
    ("10°30'S", "lat", -10.5), ("10 30 S", "lat", None), ("45° 15' 30\" O", "lon", -45.258333), ("91°N", "lat", None), ("12.5", "lat", None),
    ("−12,5", "lat", -12.5), ("S 12,5", "lat", -12.5), ("12°61'N", "lat", None), ("10°30'E", "lat", None),
])
def test_degrees(spark, text, axis, want):
    df = spark.createDataFrame([(text,)], "c string")
    assert C.with_degrees(df, {"c": axis}).first()["c_deg"] == want


def test_utm_known_points(spark):
    # Meridian and equator, and a point computed by the closed formula of the central meridian.
    row = spark.range(1).select(
        C.utm_to_degrees(F.lit(500000.0), F.lit(10_000_000.0), 23).alias("a"),
        C.utm_to_degrees(F.lit(333287.0), F.lit(7394588.0), 23, "S", "WGS84").alias("b"),
    ).first()
    assert row["a"]["lat"] == pytest.approx(0.0, abs=1e-9) and row["a"]["lon"] == pytest.approx(-45.0, abs=1e-9)
    assert row["b"]["lat"] == pytest.approx(-23.5505, abs=2e-3) and row["b"]["lon"] == pytest.approx(-46.6333, abs=2e-3)


NAMES = {
    "Puma concolor (Linnaeus, 1771)": ("Puma concolor", "species", "(Linnaeus, 1771)", None),
    "Inga edulis Mart. var. minor Ducke": ("Inga edulis var. minor", "variety", "Ducke", None),
    "Aus bus de Souza": ("Aus bus", "species", "de Souza", None), "Aus bus indet": (None, "species", None, "extra_text"),
    "Panthera sp.": ("Panthera", "genus", None, None), "Cebus x nigritus": (None, None, None, "hybrid"), "P. onca": (None, None, None, "abbreviated"),
    "Aus (Bus) cus Author, 1900": ("Aus cus", "species", "Author, 1900", None), "Felidae": ("Felidae", "family", None, None),
    "PANTHERA ONCA LINNAEUS": ("Panthera onca", "species", "Linnaeus", None), "": (None, None, None, None),
}


def test_names(spark):
    rows = with_parts(spark.createDataFrame([(n,) for n in NAMES], "name string"), "name").collect()
    got = {r["name"]: tuple(r["parts"][f] for f in ("canonicalName", "taxonRank", "scientificNameAuthorship", "nameIssue")) for r in rows}
    assert got == NAMES


def test_uncertainty_and_counts(spark):
    rows = spark.createDataFrame([("ca. 2 km",), ("1.500",), ("30 m",), ("-5",), ("1,5 km",)], "v string")
    got = [r[0] for r in rows.select(M.suggest_uncertainty("v")).collect()]
    assert got == ["2000", "1500", "30", None, "1500"]
    counts = spark.createDataFrame([("cerca de 10",), ("2 ou 3",), ("3,0",)], "v string").select(M.suggest_count("v")).collect()
    assert [r[0] for r in counts] == ["10", None, "3"]


def test_json_key_order_and_first_wins(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"c": [1]}}', "x", " ")], "p string, a string, n string")
    row = df.select(J.json_from_columns(["p", "a", "n"]).alias("j"), J.merge_property("p", "b", F.lit("z")).alias("m")).first()
    assert row["j"] == '{"b":1,"a":{"c":[1]}}' and row["m"] == '{"b":"z","a":{"c":[1]}}'


@pytest.mark.parametrize(("text", "want"), [
    ("at -23.5505, -46.6333.", "at -23.6, -46.6."), ("23°33'02\"S", "23.6 S"), ("23,5505", "23,6"), ("plot 12.5", "plot 12.5"), ("-23.6", "-23.6"),
    ("2.35505e1", "23.6"), ("about 23", "about 23"),
])
def test_own_point_copies(text, want):
    assert redact_cell(text, -23.5505, -46.6333, 0.1, "-23.6", "-46.6") == want
