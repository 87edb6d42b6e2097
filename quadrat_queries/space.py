"""Points, polygons and coordinate corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import coords as C
from quadrat.operators import coordinate_checks as K
from quadrat.operators import payloads as P
from quadrat.operators import spatial as S
from quadrat_queries.fixtures import (
    BOX_CTE, CELL, COUNTRY_SQL, LAT_SQL, LON_SQL, PLACES, POINTS_CTE, mapped, places, points, polygon_index, with_mapped,
)
from quadrat_queries.occ import table
from quadrat_queries.registry import query

IN_BOX = "{x} BETWEEN b.w AND b.e AND {y} BETWEEN b.s AND b.n"


def in_box(x: str = "p.lon", y: str = "p.lat") -> str:
    return IN_BOX.format(x=x, y=y)


LOCATED_CTE = (
    BOX_CTE + POINTS_CTE + f", located AS (SELECT p.*, (SELECT min(b.iso3) FROM boxes b WHERE {in_box()}) AS iso3 FROM points p)"
)


@query("point_in_country", with_mapped(LOCATED_CTE + " SELECT row_id, iso3, iso3 IS NULL AS outside FROM located"))
def point_in_country(spark, sf):
    found = S.locate(points(spark, sf), polygon_index(spark), "lon", "lat", "place", CELL)
    return found.select("row_id", F.col("place.iso3").alias("iso3"), F.col("place").isNull().alias("outside"))


@query(
    "country_filled_from_point",
    with_mapped(LOCATED_CTE + " SELECT l.row_id, b.admin AS country FROM located l JOIN boxes b USING (iso3) WHERE trim(l.country) = ''"),
)
def country_filled_from_point(spark, sf):
    return S.fill_country(points(spark, sf), polygon_index(spark), "lat", "lon", cell=CELL)


@query(
    "point_swapped_and_filled",
    with_mapped(
        LOCATED_CTE + f", tried AS (SELECT p.row_id, p.lon AS lat_new, p.lat AS lon_new, (SELECT min(b.admin) FROM boxes b WHERE {in_box('p.lat', 'p.lon')}) AS country "
        "FROM located p WHERE trim(p.country) = '' AND p.iso3 IS NULL AND abs(p.lon) <= 90) SELECT * FROM tried WHERE country IS NOT NULL"
    ),
)
def point_swapped_and_filled(spark, sf):
    return S.swap_and_fill(points(spark, sf), polygon_index(spark), "lat", "lon", cell=CELL)


# Distance from a point to a box on a local plane, and the seven repairs in order.
GAP_SQL = (
    "sqrt(power(greatest(b.w - x, 0, x - b.e) * cos(radians(y)), 2) + power(greatest(b.s - y, 0, y - b.n), 2)) * 111319.5 <= 0.2 * 111319.5"
)
REPAIR_SQL = (
    BOX_CTE + POINTS_CTE + f", coded AS (SELECT row_id, lat, lon, {COUNTRY_SQL.format('country')} AS iso3 FROM points), "
    f"known AS (SELECT c.*, b.w, b.s, b.e, b.n FROM coded c JOIN boxes b USING (iso3)), "
    f"outside AS (SELECT b.* FROM (SELECT *, lon AS x, lat AS y FROM known) b WHERE NOT ({GAP_SQL})), "
    "tries AS (SELECT row_id, w, s, e, n, unnest([{'p': 0, 't': 'swap', 'la': lon, 'lo': lat}, {'p': 1, 't': 'neg_lon', 'la': lat, 'lo': -lon}, "
    "{'p': 2, 't': 'neg_lat', 'la': -lat, 'lo': lon}, {'p': 3, 't': 'neg_both', 'la': -lat, 'lo': -lon}, {'p': 4, 't': 'swap_neg_lon', 'la': lon, 'lo': -lat}, "
    "{'p': 5, 't': 'swap_neg_lat', 'la': -lon, 'lo': lat}, {'p': 6, 't': 'swap_neg_both', 'la': -lon, 'lo': -lat}]) AS c FROM outside), "
    f"good AS (SELECT b.row_id, b.c FROM (SELECT *, c.lo AS x, c.la AS y FROM tries) b WHERE abs(y) <= 90 AND abs(x) <= 180 AND {GAP_SQL}), "
    "best AS (SELECT row_id, arg_min(c, c.p) AS c FROM good GROUP BY row_id) "
    "SELECT o.row_id, best.c.la AS lat_new, best.c.lo AS lon_new, best.c.t AS transform FROM outside o LEFT JOIN best USING (row_id)"
)


@query("point_transposed_repaired", with_mapped(REPAIR_SQL))
def point_transposed_repaired(spark, sf):
    from quadrat.operators.countries import with_country_codes

    coded = with_country_codes(points(spark, sf), {"country": "iso3"})
    # The pad must reach the buffer in degrees of longitude at the highest latitude of the layer.
    return S.repair_transposed(coded, polygon_index(spark, 0.5), cell=CELL)


@query("point_on_land_with_coast")
def point_on_land_with_coast(spark, sf):
    near = S.near_land(points(spark, sf), polygon_index(spark), "lon", "lat", 10_000.0, "on_land", CELL)
    return near.select("row_id", "on_land")


NEAR_SQL = " OR ".join(
    f"2 * 6371008.8 * asin(least(1.0, sqrt(power(sin(radians(lat - ({la})) / 2), 2) + cos(radians({la})) * cos(radians(lat)) * "
    f"power(sin(radians(lon - ({lo})) / 2), 2)))) <= {r}" for la, lo, r in PLACES
)


@query("point_near_place", with_mapped(POINTS_CTE + f" SELECT row_id, {NEAR_SQL} AS near_place FROM points"))
def point_near_place(spark, sf):
    return S.near_place(points(spark, sf), places(spark), "lon", "lat").select("row_id", "near_place")


@query(
    "utm_zone_ranking",
)
def utm_zone_ranking(spark, sf):
    pairs = mapped(spark, sf).select(
        (F.lit(200000.0) + F.col("row_id") % 500000).alias("easting"), (F.lit(7_000_000.0) + F.col("row_id") % 2_000_000).alias("northing")
    )
    return S.utm_zone_ranking(pairs, polygon_index(spark), "BRA", range(17, 26), cell=CELL)


@query(
    "utm_hemisphere_mix",
    "SELECT min(o_orderkey * 10000 % 9000000) < 1000000 AND max(o_orderkey * 10000 % 9000000) >= 5000000 AS mixed FROM orders",
)
def utm_hemisphere_mix(spark, sf):
    northing = F.col("o_orderkey") * 10000 % 9000000
    return table(spark, sf, "orders").agg(C.hemispheres_mixed(northing).alias("mixed"))


# ---- diagnostics -------------------------------------------------------------------------------

DIAG_CTE = (
    LOCATED_CTE + f", d AS (SELECT row_id, lat, lon, {COUNTRY_SQL.format('country')} AS iso3, lat = 0 OR lon = 0 OR sqrt(lat * lat + lon * lon) <= 0.5 OR "
    f"abs(lat) = abs(lon) AS ze, {NEAR_SQL} AS near FROM located), "
    "diag AS (SELECT row_id, lat, lon, iso3, ze AS flag_zero_equal, near AS flag_reference, CASE WHEN ze THEN 'zero_equal' WHEN near THEN 'reference' "
    "ELSE 'sea_unchecked' END AS diagnostic FROM d)"
)


def checked(spark, sf):
    layers = K.ReferenceLayers(places=places(spark))
    return K.validate_coordinates(mapped(spark, sf), layers=layers)


@query(
    "coordinates_validated",
    with_mapped(
        DIAG_CTE + " SELECT row_id, lat, lon, iso3, flag_zero_equal, flag_reference, diagnostic, CASE diagnostic WHEN 'zero_equal' THEN 'zero_equal' "
        "WHEN 'reference' THEN 'reference' ELSE 'unchecked' END AS family, diagnostic = 'sea_unchecked' AS valid FROM diag"
    ),
)
def coordinates_validated(spark, sf):
    return checked(spark, sf).select("row_id", "lat", "lon", "iso3", "flag_zero_equal", "flag_reference", "diagnostic", "family", "valid")


@query("coordinates_validated_on_land")
def coordinates_validated_on_land(spark, sf):
    layers = K.ReferenceLayers(land=polygon_index(spark), land_cell=CELL, places=places(spark))
    result = K.validate_coordinates(mapped(spark, sf), layers=layers)
    return result.groupBy("diagnostic").agg(F.count("*").alias("n"))


@query(
    "coordinate_family_counts",
    with_mapped(
        DIAG_CTE + " SELECT count(*) AS total, count(*) AS problems, 0 AS missing, 0 AS n_ok, 0 AS n_validity, 0 AS n_sea, "
        "count(*) FILTER (diagnostic = 'zero_equal') AS n_zero_equal, count(*) FILTER (diagnostic = 'reference') AS n_reference, "
        "count(*) FILTER (diagnostic = 'sea_unchecked') AS n_unchecked, 0 AS n_corrected FROM diag"
    ),
)
def coordinate_family_counts(spark, sf):
    return K.diagnostic_counts(checked(spark, sf))


@query(
    "coordinate_step_counts",
    with_mapped(
        DIAG_CTE + " SELECT 'validity' AS step, 0 AS n FROM (SELECT 1) UNION ALL SELECT 'sea', 0 UNION ALL SELECT 'zero_equal', count(*) FILTER (flag_zero_equal) FROM diag "
        "UNION ALL SELECT 'reference', count(*) FILTER (flag_reference) FROM diag"
    ),
)
def coordinate_step_counts(spark, sf):
    return K.step_counts(checked(spark, sf))


@query(
    "coordinate_simple_issues",
    with_mapped(
        POINTS_CTE + ", q AS (SELECT row_id, CASE WHEN row_id % 50 = 1 THEN lon ELSE lat END AS lat, CASE WHEN row_id % 50 = 1 THEN lat ELSE lon * 1.1 END AS lon FROM points) "
        "SELECT row_id, lat, lon, CASE WHEN abs(lon) > 180 THEN 'lon_range' WHEN abs(lat) > 90 AND abs(lon) <= 90 THEN 'swapped' WHEN abs(lat) > 90 THEN 'lat_range' "
        "WHEN lat = 0 AND lon = 0 THEN 'zero_zero' ELSE 'ok' END AS issue, NOT (abs(lon) > 180) AS valid FROM q"
    ),
)
def coordinate_simple_issues(spark, sf):
    swap = F.col("row_id") % 50 == 1
    moved = points(spark, sf).select(
        "row_id", F.when(swap, F.col("lon")).otherwise(F.col("lat")).cast("decimal(20,10)").cast("string").alias("la"),
        F.when(swap, F.col("lat")).otherwise(F.col("lon") * 1.1).cast("decimal(20,10)").cast("string").alias("lo"),
    )
    return K.coordinate_issues(moved, "la", "lo")


@query("coordinates_all_identical", with_mapped(f"SELECT count(DISTINCT ({LAT_SQL}, {LON_SQL})) = 1 AND count(*) >= 2 AS same FROM mapped"))
def coordinates_all_identical(spark, sf):
    return points(spark, sf).groupBy().agg(
        ((F.min("lat") == F.max("lat")) & (F.min("lon") == F.max("lon")) & (F.count("*") >= 2)).alias("same")
    )


@query(
    "coordinate_conversion_failures",
    with_mapped(
        "SELECT count(*) FILTER (trim(coordinateUncertaintyInMeters) <> '' AND TRY_CAST(coordinateUncertaintyInMeters AS DOUBLE) IS NULL) AS lat_failed, "
        "0 AS lon_failed, count(*) FILTER (trim(coordinateUncertaintyInMeters) <> '' AND TRY_CAST(coordinateUncertaintyInMeters AS DOUBLE) IS NULL) AS total_failed FROM mapped"
    ),
)
def coordinate_conversion_failures(spark, sf):
    return K.conversion_failures(mapped(spark, sf), "coordinateUncertaintyInMeters", "decimalLongitude")


# ---- corrections -------------------------------------------------------------------------------


def _corrections(spark, sf):
    """Two corrections for every twentieth record, the later one counts; identifiers are unique here."""
    base = mapped(spark, sf).filter("row_id % 20 = 1").select(
        F.concat(F.lit("R-"), F.col("row_id").cast("string")).alias("occurrenceID"), "row_id", "decimalLatitude", "decimalLongitude"
    )
    both = base.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    return both.select(
        "occurrenceID", (-F.col("v") * 10).cast("string").alias("decimalLatitude"), F.lit("-50.5").alias("decimalLongitude"),
        (F.col("row_id") * 2 + F.col("v")).alias("seq"),
        F.when(F.col("row_id") % 40 == 1, "stale").otherwise(F.col("decimalLatitude")).alias("from_decimalLatitude"),
        F.col("decimalLongitude").alias("from_decimalLongitude"),
    )


def _records(spark, sf):
    return mapped(spark, sf).select(
        "row_id", F.concat(F.lit("R-"), F.col("row_id").cast("string")).alias("occurrenceID"), "decimalLatitude", "decimalLongitude",
        F.when(F.col("row_id") % 3 == 0, "kept").otherwise("").alias("verbatimLatitude"), "country",
    )


@query(
    "corrections_applied",
    with_mapped(
        "SELECT row_id, CASE WHEN row_id % 20 = 1 THEN '-20' ELSE decimalLatitude END AS decimalLatitude, CASE WHEN row_id % 20 = 1 THEN '-50.5' ELSE decimalLongitude END AS decimalLongitude, "
        "CASE WHEN row_id % 3 = 0 THEN 'kept' WHEN row_id % 20 = 1 THEN decimalLatitude ELSE '' END AS verbatimLatitude FROM mapped"
    ),
)
def corrections_applied(spark, sf):
    fixed = P.apply_coordinate_corrections(_records(spark, sf), _corrections(spark, sf))
    return fixed.select("row_id", "decimalLatitude", "decimalLongitude", "verbatimLatitude")


@query(
    "corrections_stale",
    with_mapped("SELECT concat('R-', row_id) AS occurrenceID, v AS version, row_id % 40 = 1 AS stale FROM mapped, (VALUES (1), (2)) t(v) WHERE row_id % 20 = 1"),
)
def corrections_stale(spark, sf):
    flagged = P.with_stale_flag(_corrections(spark, sf), _records(spark, sf))
    return flagged.select("occurrenceID", (-F.col("decimalLatitude").cast("int") / 10).cast("int").alias("version"), "stale")


@query(
    "country_fills_applied",
    with_mapped("SELECT row_id, CASE WHEN trim(country) = '' AND row_id % 16 = 0 THEN 'Brazil' ELSE country END AS country FROM mapped"),
)
def country_fills_applied(spark, sf):
    fills = _records(spark, sf).filter("row_id % 16 IN (0, 1)").select("occurrenceID", F.lit("Brazil").alias("country"), F.col("row_id").alias("seq"))
    return P.apply_country_fills(_records(spark, sf), fills).select("row_id", "country")


@query(
    "corrections_manual_merged",
    with_mapped(
        "SELECT concat('R-', row_id) AS occurrenceID, CASE WHEN row_id % 30 = 1 THEN '1.5' ELSE '-20' END AS decimalLatitude, "
        "CASE WHEN row_id % 30 = 1 THEN '2.5' ELSE '-50.5' END AS decimalLongitude, CASE WHEN row_id % 30 = 1 THEN 'manual' ELSE 'automatic' END AS origin "
        "FROM mapped WHERE row_id % 20 = 1 OR row_id % 30 = 1"
    ),
)
def corrections_manual_merged(spark, sf):
    manual = _records(spark, sf).filter("row_id % 30 = 1").select(
        "occurrenceID", F.lit("1.5").alias("decimalLatitude"), F.lit("2.5").alias("decimalLongitude"), F.col("row_id").alias("seq")
    )
    return P.merge_manual_edits(_corrections(spark, sf), manual)


@query("corrections_editable_ids", with_mapped("SELECT occurrenceID FROM mapped WHERE occurrenceID <> '' GROUP BY occurrenceID HAVING count(*) = 1"))
def corrections_editable_ids(spark, sf):
    return P.editable_ids(mapped(spark, sf))


@query(
    "corrections_orphans_dropped",
    with_mapped("SELECT concat('R-', row_id) AS occurrenceID FROM mapped WHERE row_id % 20 = 1 AND row_id % 3 = 0"),
)
def corrections_orphans_dropped(spark, sf):
    edits = _corrections(spark, sf).select("occurrenceID").distinct()
    return P.drop_orphan_edits(edits, _records(spark, sf).filter("row_id % 3 = 0"))


@query(
    "corrections_edit_values",
    with_mapped(
        "SELECT row_id, CASE WHEN trim(area) = '' THEN 'edit_empty' WHEN area = '12 ha' THEN 'edit_number' END AS error, "
        "CASE WHEN area <> '12 ha' THEN TRY_CAST(replace(area, ',', '.') AS DOUBLE) END AS value FROM (SELECT row_id, \"measurementValue [area_ha]\" AS area FROM mapped)"
    ),
)
def corrections_edit_values(spark, sf):
    typed = mapped(spark, sf).select("row_id", F.lit("lat").alias("axis"), F.col("measurementValue [area_ha]").alias("to"))
    return P.check_coordinate_edits(typed).select("row_id", "error", "value")


@query(
    "corrections_overlaid",
    with_mapped(
        DIAG_CTE + " SELECT row_id, CASE WHEN row_id % 20 = 1 THEN 'corrected' ELSE diagnostic END AS diagnostic, CASE WHEN row_id % 20 = 1 THEN -20.0 ELSE lat END AS lat, "
        "row_id % 20 = 1 OR diagnostic = 'sea_unchecked' AS valid FROM diag"
    ),
)
def corrections_overlaid(spark, sf):
    result = checked(spark, sf).withColumn("occurrenceID", F.concat(F.lit("R-"), F.col("row_id").cast("string")))
    return P.overlay_corrections(result, _corrections(spark, sf)).select("row_id", "diagnostic", "lat", "valid")


@query(
    "manual_edits_overlaid",
    with_mapped(
        DIAG_CTE + " SELECT row_id, CASE row_id % 25 WHEN 1 THEN 'corrected' WHEN 2 THEN 'sea' ELSE diagnostic END AS diagnostic, "
        "CASE row_id % 25 WHEN 1 THEN true WHEN 2 THEN false ELSE diagnostic = 'sea_unchecked' END AS valid, row_id % 25 IN (1, 2) AS edited FROM diag"
    ),
)
def manual_edits_overlaid(spark, sf):
    result = checked(spark, sf)
    edits = result.filter("row_id % 25 IN (1, 2)").select(
        "row_id", F.lit(-10.0).alias("lat"), F.lit(-50.0).alias("lon"),
        F.when(F.col("row_id") % 25 == 1, "ok").otherwise("sea").alias("diagnostic"),
        F.when(F.col("row_id") % 25 == 1, "ok").otherwise("sea").alias("family"), (F.col("row_id") % 25 == 1).alias("valid"),
    )
    return P.overlay_manual_edits(result, edits).select("row_id", "diagnostic", "valid", "edited")


@query(
    "coordinate_export_issues",
    with_mapped(
        DIAG_CTE + " SELECT row_id, 'flagged' AS problem FROM diag WHERE row_id % 20 <> 1"
    ),
)
def coordinate_export_issues(spark, sf):
    base = mapped(spark, sf).withColumn("occurrenceID", F.concat(F.lit("R-"), F.col("row_id").cast("string")))
    result = K.validate_coordinates(base, layers=K.ReferenceLayers(places=places(spark)))
    return K.export_issues(base, result, _corrections(spark, sf))


@query(
    "payloads_applied_in_order",
    with_mapped(
        "SELECT row_id, CASE WHEN row_id % 20 = 1 AND row_id % 40 <> 1 THEN '-20' ELSE decimalLatitude END AS decimalLatitude, "
        "CASE WHEN trim(country) = '' AND row_id % 16 = 0 THEN 'Brazil' ELSE country END AS country FROM mapped"
    ),
)
def payloads_applied_in_order(spark, sf):
    records = _records(spark, sf)
    fills = records.filter("row_id % 16 = 0").select("occurrenceID", F.lit("Brazil").alias("country"), F.col("row_id").alias("seq"))
    done = P.apply_payloads(records, corrections=_corrections(spark, sf), fills=fills)
    return done.select("row_id", "decimalLatitude", "country")
