"""Tables derived from the given ones that several queries share, in both SQL dialects."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.lookups import local_table
from quadrat.operators.spatial import cell_index, place_index, polygon_edges
from quadrat_queries.occ import OCC_BODY, occ

# The occurrence view under target term names.
MAPPED_BODY = """
SELECT row_id, tombo AS occurrenceID, especie AS scientificName, data_registro AS eventDate,
       latitude AS decimalLatitude, longitude AS decimalLongitude, pais AS country,
       CASE row_id % 5 WHEN 0 THEN 'BRA' WHEN 1 THEN 'AR' WHEN 2 THEN '' WHEN 3 THEN 'br' ELSE 'ESP' END AS countryCode,
       numero_individuos AS individualCount, incerteza_m AS coordinateUncertaintyInMeters, sexo AS sex,
       status AS occurrenceStatus, area_ha AS `measurementValue [area_ha]`, coletor AS recordedBy,
       CASE WHEN row_id % 17 = 0 THEN '' ELSE 'HumanObservation' END AS basisOfRecord
FROM {occ}
"""
MAPPED_CTE = (
    "WITH occ AS (" + OCC_BODY.replace("{orders}", "orders") + "), mapped AS ("
    + MAPPED_BODY.replace("{occ}", "occ").replace("`", '"') + ")"
)

# Name texts of the view with the parts a parser must find: key, canonical name, rank, authorship, qualifier.
NAME_PARTS = {
    "Panthera onca": ("panthera onca", "Panthera onca", "species", None, None),
    "panthera  ONCA": ("panthera onca", "Panthera onca", "species", None, None),
    "Puma concolor (Linnaeus, 1771)": ("puma concolor", "Puma concolor", "species", "(Linnaeus, 1771)", None),
    "Panthera cf. onca": ("panthera onca", "Panthera onca", "species", None, "cf."),
    "Felidae": ("felidae", "Felidae", "family", None, None),
    "Panthera sp.": (None, "Panthera", "genus", None, "sp."),
    "Euterpe edulis Mart.": ("euterpe edulis", "Euterpe edulis", "species", "Mart.", None),
    "Inga nobilis Willd. subsp. nobilis": (
        "inga nobilis subsp nobilis", "Inga nobilis subsp. nobilis", "subspecies", "Willd.", None),
}


def _sql(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


NAMES_CTE = ", names(name, taxon_key, canonical, taxon_rank, author, qualifier) AS (VALUES " + ", ".join(
    "(" + ", ".join(_sql(v) for v in (name, *parts)) + ")" for name, parts in NAME_PARTS.items()
) + ")"

THREATENED = {"Panthera onca": "VU", "Puma concolor": "EN", "Euterpe edulis": "CR", "Inga nobilis subsp. nobilis": "VU"}
THREATENED_CTE = ", threatened(match_key, category, source) AS (VALUES " + ", ".join(
    f"({_sql(next(p[0] for p in NAME_PARTS.values() if p[1] == n))}, '{c}', 'national list')" for n, c in THREATENED.items()
) + ")"

INVASIVE = {
    "Puma concolor": ("alien", "pets", "Americas"),
    "Euterpe edulis": ("translocated_native", "plantas ornamentais", "Atlantic forest"),
    "Panthera onca": ("translocated_native", "Espécies marinhas", "Americas"),
}

COUNTRY_SQL = (
    "CASE {0} WHEN 'Brasil' THEN 'BRA' WHEN 'BRAZIL' THEN 'BRA' WHEN 'Brazl' THEN 'BRA' WHEN 'BR' THEN 'BRA' "
    "WHEN 'Argentina' THEN 'ARG' WHEN 'ESP' THEN 'ESP' WHEN 'VU' THEN 'VUT' END"
)
LAT_SQL = "TRY_CAST(replace(decimalLatitude, ',', '.') AS DOUBLE)"
LON_SQL = "TRY_CAST(replace(decimalLongitude, ',', '.') AS DOUBLE)"

# Coarse boxes that stand in for country polygons: iso3, name, west, south, east, north.
BOXES = [
    ("BRA", "Brazil", -73.985, -33.745, -34.795, 5.265),
    ("ARG", "Argentina", -73.555, -55.055, -53.635, -33.755),
    ("ESP", "Spain", -9.305, 35.945, 3.335, 43.795),
    ("VUT", "Vanuatu", 166.515, -20.255, 170.235, -13.075),
]
BOX_CTE = ", boxes(iso3, admin, w, s, e, n) AS (VALUES " + ", ".join(
    f"('{i}', '{a}', {w}, {s}, {e}, {n})" for i, a, w, s, e, n in BOXES
) + ")"
CELL = 5.0

# Reference places: latitude, longitude, radius in metres.
PLACES = [(-15.8, -47.9, 300_000.0), (40.4, -3.7, 250_000.0), (0.0, 179.9, 150_000.0)]


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MAPPED_BODY, occ=occ(spark, sf_dir))


def with_mapped(body: str) -> str:
    return MAPPED_CTE + (body if body.lstrip().startswith(",") else "\n" + body)


def threatened(spark: SparkSession) -> DataFrame:
    """The threatened list as a lookup table; its keys come from the same parser as the records'."""
    from quadrat.operators.taxa import listed_taxa

    names = local_table(
        spark, {"scientificName": list(THREATENED), "category": list(THREATENED.values()),
                "source": ["national list"] * len(THREATENED)},
    )
    return listed_taxa(names)


def invasive(spark: SparkSession) -> DataFrame:
    from quadrat.operators.taxa import listed_taxa

    origin, reason, area = zip(*INVASIVE.values(), strict=True)
    names = local_table(
        spark, {"scientificName": list(INVASIVE), "origin_class": origin, "introduction_reason": reason, "native_range": area}
    )
    return listed_taxa(names)


def polygon_index(spark: SparkSession, pad: float = 0.0) -> DataFrame:
    rows = [
        (i, iso, admin, seq, lon, lat)
        for i, (iso, admin, w, s, e, n) in enumerate(BOXES)
        for seq, (lon, lat) in enumerate(((w, s), (e, s), (e, n), (w, n)))
    ]
    poly, iso3, admin, seq, lon, lat = zip(*rows, strict=True)
    vertices = local_table(
        spark,
        {"poly": poly, "iso3": iso3, "admin": admin, "ring": [0] * len(poly), "seq": seq, "lon": lon, "lat": lat},
        {"poly": pa.int32(), "ring": pa.int32(), "seq": pa.int32(), "lon": pa.float64(), "lat": pa.float64()},
    )
    return cell_index(polygon_edges(vertices), CELL, pad)


def places(spark: SparkSession) -> DataFrame:
    lat, lon, radius = zip(*PLACES, strict=True)
    table = local_table(
        spark, {"lat": lat, "lon": lon, "radius_m": radius},
        {"lat": pa.float64(), "lon": pa.float64(), "radius_m": pa.float64()},
    )
    return place_index(table)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.functions.coords import coord_number

    return mapped(spark, sf_dir).select(
        "row_id", coord_number("decimalLatitude").alias("lat"), coord_number("decimalLongitude").alias("lon"), "country"
    )


POINTS_CTE = f", points AS (SELECT row_id, {LAT_SQL} AS lat, {LON_SQL} AS lon, country FROM mapped)"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name reviews that grow with the data: one per thousand orders plus the ones that matter."""
    base = mapped(spark, sf_dir).filter("row_id % 1000 = 10").select(
        F.concat(F.lit("Aus bus"), F.col("row_id").cast("string")).alias("query_name"), F.lit("confirm").alias("review_type"),
        F.lit("").alias("original_name"), F.lit("").alias("corrected_name"), F.col("row_id").alias("seq"),
        F.lit("2026-01-01").alias("reviewed_at"),
    )
    fixed = local_table(
        spark,
        {
            "query_name": ["Euterpe edulis", "Euterpe edulis", "Puma concolor"], "review_type": ["correct", "correct", "confirm"],
            "original_name": ["", "", ""], "corrected_name": ["Euterpe oleracea Mart.", "Euterpe precatoria Mart.", ""],
            "seq": [1, 2, 3], "reviewed_at": ["2026-02-01", "2026-03-01", "2026-02-01"],
        },
        {"seq": pa.int64()},
    )
    return base.unionByName(fixed)


def levels_for_tests(spark: SparkSession) -> DataFrame:
    """One tier for every spelling of the listed names."""
    tiers = {"Panthera onca": "high", "panthera  ONCA": "high", "Puma concolor (Linnaeus, 1771)": "extreme", "Euterpe edulis Mart.": "extreme"}
    return local_table(spark, {"scientificName": list(tiers), "tier": list(tiers.values())})
