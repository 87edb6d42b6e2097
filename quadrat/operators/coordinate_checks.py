"""Coordinate diagnostics: one verdict per record, with the flags behind it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import coords as C
from quadrat.functions.fence import fence
from quadrat.functions.text import lookup, text
from quadrat.operators.countries import with_country_codes
from quadrat.operators.spatial import near_land, near_place

ZERO_BUFFER_DEG = 0.5
FAMILIES = {
    "ok": "ok", "validity_missing": "validity", "validity_bounds": "validity", "swapped": "validity", "sea": "sea",
    "zero_equal": "zero_equal", "identical_all": "zero_equal", "reference": "reference", "sea_unchecked": "unchecked",
}
FAMILY_ORDER = ("ok", "validity", "sea", "zero_equal", "reference", "unchecked", "corrected")
# Coastal tolerance in metres for the three scales of land polygons.
COAST_TOLERANCE_M = {10: 1000.0, 50: 5000.0, 110: 10000.0}
STEPS = {
    "validity": ("flag_missing", "flag_bounds", "flag_swapped"), "sea": ("flag_sea",), "zero_equal": ("flag_zero_equal",),
    "reference": ("flag_reference",),
}


@dataclass
class ReferenceLayers:
    """Spatial layers of a check; a missing land layer leaves points unchecked."""

    land: DataFrame | None = None
    land_cell: float = 1.0
    land_scale: int = 10
    places: DataFrame | None = None
    countries: DataFrame | None = None


def zero_or_equal(lat: Column, lon: Column) -> Column:
    """On an axis, within half a degree of (0, 0), or both axes equal in size."""
    near = F.sqrt(lat * lat + lon * lon) <= ZERO_BUFFER_DEG
    return F.coalesce((lat == 0) | (lon == 0) | near | (F.abs(lat) == F.abs(lon)), F.lit(False))


def is_swapped(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) > 90) & (F.abs(lat) <= 180) & (F.abs(lon) <= 90), F.lit(False))


def all_identical(points: DataFrame, lat: Column, lon: Column, counted: Column) -> Column:
    """Scalar: two or more counted points, all at one place. Min and max replace a distinct count, and
    conditional aggregates replace a filter that Catalyst would inline through every stage below."""
    y, x = F.when(counted, lat), F.when(counted, lon)
    return points.agg(
        ((F.count_if(counted) >= 2) & (F.min(y) == F.max(y)) & (F.min(x) == F.max(x))).alias("same")
    ).scalar()


def validate_coordinates(
    df: DataFrame, lat: str = "decimalLatitude", lon: str = "decimalLongitude", country: str = "country",
    layers: ReferenceLayers | None = None, complete: bool = True, row_id: str = "row_id",
) -> DataFrame:
    """One row per record: numbers, ISO3, flags, diagnostic, family, valid.

    Later checks override earlier ones: ok < reference < sea < zero_equal < out of bounds < swapped <
    missing; then `ok` may become identical_all or sea_unchecked."""
    layers = layers or ReferenceLayers()
    keep = [c for c in (row_id, "occurrenceID") if c in df.columns]
    base = df.select(
        *keep, C.coord_number(f"`{lat}`").alias("lat"), C.coord_number(f"`{lon}`").alias("lon"),
        (C.coord_parse_failed(f"`{lat}`").cast("int") + C.coord_parse_failed(f"`{lon}`").cast("int")).alias("n_failed"),
        text(f"`{country}`").alias("country"),
    )
    base = with_country_codes(base, {"country": "iso3"}, layers.countries)
    y, x = F.col("lat"), F.col("lon")
    base = base.withColumn("flag_missing", y.isNull() | x.isNull()).withColumn("flag_swapped", is_swapped(y, x))
    outside = F.coalesce((F.abs(y) > 90) | (F.abs(x) > 180), F.lit(False))
    base = base.withColumn("flag_bounds", ~F.col("flag_missing") & ~F.col("flag_swapped") & outside)
    clean = ~F.col("flag_missing") & ~F.col("flag_swapped") & ~F.col("flag_bounds")
    base = base.withColumn("__clean", clean)
    base = base.withColumn("flag_zero_equal", F.col("__clean") & zero_or_equal(y, x))
    if layers.land is None:
        base = base.withColumn("flag_sea", F.lit(False)).withColumn("flag_unchecked", F.col("__clean"))
    else:
        metres = COAST_TOLERANCE_M.get(layers.land_scale, COAST_TOLERANCE_M[10])
        base = near_land(base, layers.land, "lon", "lat", metres, "__land", layers.land_cell)
        base = base.withColumn("flag_sea", F.col("__clean") & ~F.col("__land")).withColumn(
            "flag_unchecked", F.lit(False)
        ).drop("__land")
    if layers.places is None or not complete:
        base = base.withColumn("flag_reference", F.lit(False))
    else:
        base = near_place(base, layers.places, "lon", "lat", "__near")
        base = base.withColumn("flag_reference", F.col("__clean") & F.col("__near")).drop("__near")
    numbers = df.select(C.coord_number(f"`{lat}`").alias("a"), C.coord_number(f"`{lon}`").alias("b"))
    same = all_identical(numbers, F.col("a"), F.col("b"), C.plottable(F.col("a"), F.col("b")))
    first = (
        F.when(F.col("flag_missing"), "validity_missing")
        .when(F.col("flag_swapped"), "swapped")
        .when(F.col("flag_bounds"), "validity_bounds")
        .when(F.col("flag_zero_equal"), "zero_equal")
        .when(F.col("flag_sea"), "sea")
        .when(F.col("flag_reference"), "reference")
        .when(same, "identical_all")
        .when(F.col("flag_unchecked"), "sea_unchecked")
        .otherwise("ok")
    )
    out = base.withColumn("diagnostic", first).drop("__clean")
    done = out.withColumn("family", lookup(FAMILIES, F.col("diagnostic"))).withColumn(
        "valid", F.col("diagnostic").isin("ok", "sea_unchecked")
    )
    return fence(done, ["diagnostic", "family", "valid", *[c for c in done.columns if c.startswith("flag_")]])


def coordinate_issues(df: DataFrame, lat: str, lon: str, row_id: str = "row_id") -> DataFrame:
    """Simple issue per record: missing, lon_range, lat_range, swapped, zero_zero, identical_all or ok."""
    base = df.select(row_id, C.coord_number(lat).alias("lat"), C.coord_number(lon).alias("lon"))
    y, x = F.col("lat"), F.col("lon")
    swapped = is_swapped(y, x)
    issue = (
        F.when(y.isNull() | x.isNull(), "missing")
        .when((F.abs(x) > 180) & ~((F.abs(y) > 90) & ~swapped), "lon_range")
        .when((F.abs(y) > 90) & ~swapped, "lat_range")
        .when(swapped, "swapped")
        .when((y == 0) & (x == 0), "zero_zero")
        .otherwise("ok")
    )
    staged = base.withColumn("__issue", issue)
    same = all_identical(staged, F.col("lat"), F.col("lon"), F.col("__issue") == "ok")
    out = F.when((F.col("__issue") == "ok") & same, "identical_all").otherwise(F.col("__issue"))
    return staged.withColumn("issue", out).drop("__issue").withColumn(
        "valid", F.col("issue").isin("ok", "zero_zero", "swapped", "identical_all")
    )


def diagnostic_counts(result: DataFrame) -> DataFrame:
    """One row: total, ok, problems, missing and one count per family."""
    family = F.coalesce(F.nullif("family", F.lit("")), F.lit("validity"))
    counts = [F.count_if(family == f).alias(f"n_{f}") for f in FAMILY_ORDER]
    return result.agg(
        F.count("*").alias("total"), F.count_if(~family.isin("ok", "corrected")).alias("problems"),
        F.count_if(F.col("diagnostic") == "validity_missing").alias("missing"), *counts,
    )


def conversion_failures(df: DataFrame, lat: str, lon: str) -> DataFrame:
    a, b = F.count_if(C.coord_parse_failed(lat)), F.count_if(C.coord_parse_failed(lon))
    return df.agg(a.alias("lat_failed"), b.alias("lon_failed"), (a + b).alias("total_failed"))


def step_counts(result: DataFrame) -> DataFrame:
    """(step, n): records each check flagged."""
    rows = [
        F.struct(F.lit(step).alias("step"), sum_flags(flags).alias("hit")) for step, flags in STEPS.items()
    ]
    return result.select(F.explode(F.array(*rows)).alias("s")).groupBy("s.step").agg(F.count_if("s.hit").alias("n"))


def sum_flags(flags: tuple[str, ...]) -> Column:
    out = F.col(flags[0])
    for f in flags[1:]:
        out = out | F.col(f)
    return out


def export_issues(df: DataFrame, result: DataFrame, corrections: DataFrame | None = None, row_id: str = "row_id") -> DataFrame:
    """(row_id, problem): unreadable points block an export; flagged, uncorrected ones are shown."""
    bad = ((text("decimalLatitude") != "") & ~C.coord_ok("decimalLatitude", 90)) | (
        (text("decimalLongitude") != "") & ~C.coord_ok("decimalLongitude", 180)
    )
    from quadrat.operators.payloads import apply_coordinate_corrections

    fixed = df if corrections is None else apply_coordinate_corrections(df, corrections)
    invalid = fixed.filter(bad).select(row_id, F.lit("invalid").alias("problem"))
    flagged = result.filter(F.col("family").isin("sea", "zero_equal", "reference", "unchecked"))
    if corrections is not None:
        flagged = flagged.join(corrections.select("occurrenceID").distinct(), "occurrenceID", "left_anti")
    flagged = flagged.join(invalid.select(row_id), row_id, "left_anti")
    return invalid.unionByName(flagged.select(row_id, F.lit("flagged").alias("problem")))
