"""Operators against brute force, and properties that must hold at any partitioning."""

import random

from pyspark.sql import functions as F

from quadrat.operators import generalise as G
from quadrat.operators import numbering as W
from quadrat.operators import spatial as S
from quadrat.operators.fuzzy import fuzzy_pairs
from quadrat.operators.ids import generate_ids
from quadrat.plans import publish as X
from quadrat.sources import delimited as D
from quadrat.sources import lists as L
from quadrat.streaming.records import clean_records, status_sink
from quadrat_queries.fixtures import levels_for_tests, mapped, threatened

SF = "/root/testdata/sf0.001"


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_join_finds_every_pair(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 14))) for _ in range(120)})
    queries = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 14))) for _ in range(80)})
    q, r = spark.createDataFrame([(w,) for w in queries], "q string"), spark.createDataFrame([(w,) for w in words], "r string")
    got = {(x["q"], x["r"]) for x in fuzzy_pairs(q, r, "q", "r", lambda n: max(1, n // 4), lambda n: F.greatest(F.lit(1), F.floor(n / 4))).collect()}
    want = {(a, b) for a in queries for b in words if _distance(a, b) <= max(1, len(a) // 4)}
    assert got == want


def test_hot_groups_number_like_small_ones(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    plain = {r["row_id"]: r["number"] for r in W.number_within(df, ["k"]).collect()}
    sliced = {r["row_id"]: r["number"] for r in W.number_within(df.repartition(7), ["k"], hot_rows=20).collect()}
    assert plain == sliced


def test_polygon_with_hole_and_diagonal(spark):
    rings = {0: [(0, 0), (10, 0), (10, 10), (0, 10)], 1: [(3, 3), (6, 3), (6, 6), (3, 6)]}
    rows = [(0, "AAA", "A", ring, i, float(x), float(y)) for ring, pts in rings.items() for i, (x, y) in enumerate(pts)]
    rows += [(1, "BBB", "B", 0, i, float(x), float(y)) for i, (x, y) in enumerate([(20, 0), (30, 0), (20, 10)])]
    vertices = spark.createDataFrame(rows, "poly int, iso3 string, admin string, ring int, seq int, lon double, lat double")
    rng = random.Random(5)
    points = [(i, rng.uniform(-1, 31), rng.uniform(-1, 11)) for i in range(600)]

    def inside(x, y):
        if 0 < x < 10 and 0 < y < 10 and not (3 < x < 6 and 3 < y < 6):
            return "AAA"
        return "BBB" if x > 20 and y > 0 and (x - 20) + y < 10 else None

    df = spark.createDataFrame(points, "row_id int, lon double, lat double")
    for cell in (1.0, 4.0):
        index = S.cell_index(S.polygon_edges(vertices), cell)
        got = {r["row_id"]: r["iso"] for r in S.locate(df, index, cell=cell).select("row_id", F.col("place.iso3").alias("iso")).collect()}
        assert got == {i: inside(x, y) for i, x, y in points}


def test_point_copies_need_both_axes(spark):
    points = spark.createDataFrame([(-23.5505, -46.6333, 0.1, "-23.6", "-46.6")], "lat double, lon double, grid double, pub_lat string, pub_lon string")
    texts = {1: "at 23.5505 S and 46.6333 W", 2: "only 23.5505", 3: "23.55 / 46.63", 4: "46.6333 then 11.0", 5: "23°33'02\" 46°38'00\""}
    rows = [(k, v, None, None) for k, v in texts.items()] + [(6, "-23.5505 -46.6333", -23.5505, -46.6333)]
    cells = spark.createDataFrame(rows, "cell_id int, text string, own_lat double, own_lon double")
    assert {r["cell_id"] for r in G.find_point_copies(cells, points).select("cell_id").distinct().collect()} == {1, 3, 5}


def test_masked_output_holds_no_protected_point(spark):
    df = mapped(spark, SF).withColumn("occurrenceRemarks", F.concat_ws(" ", F.lit("pt"), "decimalLatitude", "decimalLongitude"))
    plan = G.generalisation_plan(df, levels_for_tests(spark), threatened(spark))
    public, private = G.mask_locations(plan)
    joined = public.join(private.select("row_id", F.col("decimalLatitude").alias("real")), "row_id")
    coarse = joined.filter((F.col("coordinatePrecision").try_cast("double") >= 0.1) & F.col("real").rlike(r"[0-9]\.[0-9][1-9]$"))
    leaks = coarse.filter(F.col("occurrenceRemarks").contains(F.regexp_replace("real", "^-", "")))
    assert public.count() == df.count() and private.count() > 0 and leaks.count() == 0


def test_csv_round_trip_and_code_pages(spark, tmp_path):
    text = 'especie;local;n\n"Aus ""b"" cus";"São\nPaulo";NA\nBus;;2\n'
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    df, report = D.read_delimited(spark, str(tmp_path / "a.csv"))
    rows = {r["especie"]: (r["local"], r["n"]) for r in df.collect()}
    assert report.delimiter == ";" and rows == {'Aus "b" cus': ("São\nPaulo", "NA"), "Bus": (None, "2")}
    for page in ("cp1252", "cp850"):
        (tmp_path / f"{page}.csv").write_bytes("a,b\nSão João,açaí\n".encode(page))
        got, report = D.read_delimited(spark, str(tmp_path / f"{page}.csv"))
        assert [tuple(r)[1:] for r in got.collect()] == [("São João", "açaí")], page
    assert D.repair_headers(["a", "a", "", " b "]) == ["a", "a_1", "col_3", "b"]
    assert D.header_is_data(["12,5", "2020-01-01", "x"]) and not D.header_is_data(["species", "date"])


def test_archive_round_trip(spark, tmp_path):
    core = spark.createDataFrame([(1, "A", "Aus bus", "2020-01-01", 1.5, 2.5, "HumanObservation", "CC0")],
                                 "row_id long, occurrenceID string, scientificName string, eventDate string, decimalLatitude double, decimalLongitude double, basisOfRecord string, license string")
    product = X.ExportProduct(core, None, None, core.select("row_id"))
    X.write_archive(product, str(tmp_path / "out"), "T", one_file=True)
    descriptor = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out/meta.xml")).collect())
    assert [r[0] for r in L.archive_ids(spark, str(tmp_path / "out"), descriptor).collect()] == ["A"]
    blocked = X.ExportProduct(core.withColumn("scientificName", F.lit("=1+1")), None, None, core)
    assert [r[0] for r in X.blockers(blocked).collect()] == ["formula_cell"]


def test_stream_cleaning_and_status(spark, tmp_path):
    source = tmp_path / "in"
    mapped(spark, SF).select("row_id", "eventDate", "decimalLatitude", "occurrenceStatus").coalesce(1).write.parquet(str(source))
    stream = clean_records(spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source)), True, 2026)
    query = stream.writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    batch = clean_records(spark.read.parquet(str(source)), True, 2026)
    assert sorted(map(tuple, spark.table("cleaned").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    sink = status_sink(str(tmp_path / "state"))
    schema = "query_name string, validation_status string, provider string, display_order long"
    sink(spark.createDataFrame([("a", "accepted", "p", 1), ("b", "not_found", "p", 2)], schema), 0)
    sink(spark.createDataFrame([("a", "ambiguous", "q", 3), ("b", "synonym", "q", 4)], schema), 1)
    got = {r["query_name"]: (r["validation_status"], r["display_order"]) for r in spark.read.parquet(str(tmp_path / "state/version=1")).collect()}
    assert got == {"a": ("accepted", 3), "b": ("synonym", 4)}
    again = status_sink(str(tmp_path / "later"), str(tmp_path / "state/version=1"))  # a new checkpoint
    again(spark.createDataFrame([("c", "accepted", "p", 5), ("a", "synonym", "p", 6)], schema), 0)
    got = {r["query_name"]: (r["validation_status"], r["display_order"]) for r in spark.read.parquet(str(tmp_path / "later/version=0")).collect()}
    assert got == {"a": ("accepted", 6), "b": ("synonym", 4), "c": ("accepted", 5)}


def test_places_are_near_across_the_180th_meridian(spark):
    places = spark.createDataFrame([(0.0, 179.9, 150_000.0), (10.0, -179.95, 150_000.0)], "lat double, lon double, radius_m double")
    points = spark.createDataFrame([(1, 0.0, -179.95), (2, 10.0, 179.99), (3, 10.0, 180.0), (4, 0.0, 0.1), (5, 0.0, -178.0)], "id int, lat double, lon double")
    found = S.near_place(points, S.place_index(places), "lon", "lat")
    assert {r.id for r in found.filter("near_place").collect()} == {1, 2, 3}


def test_justification_loses_protected_points(spark):
    points = spark.createDataFrame([(-23.5505, -46.6333, 0.1, "-23.6", "-46.6")], "lat double, lon double, grid double, pub_lat string, pub_lon string")
    clean = G.clean_justification(" nest at -23.5505, seen in 2019 ", points)
    assert "23.5505" not in clean and clean.startswith("nest at") and clean.endswith("seen in 2019")
    assert G.clean_justification("  ", points) == ""


def test_ids_pass_over_many_taken_numbers(spark):
    kinds = "row_id long, a string"
    taken = generate_ids(spark.createDataFrame([(i, "same") for i in range(23)], kinds), ["a"]).select(F.col("occurrenceID").alias("id")).collect()
    gaps = spark.createDataFrame([(100, "same")], kinds)
    made = generate_ids(gaps, ["a"], spark.createDataFrame(taken, "id string")).collect()
    assert len(made) == 1 and made[0].occurrenceID not in {r.id for r in taken}
