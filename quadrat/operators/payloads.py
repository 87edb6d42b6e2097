"""Accepted corrections, fills and manual edits, keyed by occurrence identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.coords import coord_number
from quadrat.functions.text import blank_to_null, is_blank, text
from quadrat.operators.numbering import last_per_key
from quadrat.operators.taxa import apply_name_ranks, apply_name_reviews

KEY = "occurrenceID"
FROM_COLUMNS = ("from_decimalLatitude", "from_decimalLongitude")
VERBATIM = {"verbatimLatitude": "decimalLatitude", "verbatimLongitude": "decimalLongitude"}
SUPPLIED = (*VERBATIM, "verbatimCoordinateSystem", "verbatimSRS")


def _latest(payload: DataFrame) -> DataFrame:
    """Last row (by seq) per identifier."""
    return last_per_key(payload.filter(~is_blank(KEY)), [KEY], [F.col("seq")])


def apply_coordinate_corrections(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected points win; the originals move to blank verbatim cells unless the correction brings its own.

    corrections: occurrenceID, decimalLatitude, decimalLongitude, seq and optional verbatim columns."""
    given = [c for c in SUPPLIED if c in corrections.columns]
    side = _latest(corrections).select(
        F.col(KEY).alias("__id"), F.lit(True).alias("__hit"),
        F.col("decimalLatitude").cast("string").alias("__lat"), F.col("decimalLongitude").cast("string").alias("__lon"),
        *[F.col(c).cast("string").alias(f"__{c}") for c in given],
    )
    joined = df.join(side, F.col(KEY) == F.col("__id"), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    out: dict[str, Column] = {}
    for c in SUPPLIED:
        if c not in df.columns and c not in given:
            continue
        current = F.col(c) if c in df.columns else F.lit(None).cast("string")
        supplied = F.col(f"__{c}") if c in given else F.lit(None).cast("string")
        if c in VERBATIM and c in df.columns:
            kept = F.when(is_blank(current), F.col(VERBATIM[c]).cast("string")).otherwise(current)
        else:
            kept = current
        out[c] = F.when(hit, F.coalesce(supplied, kept)).otherwise(current)
    out["decimalLatitude"] = F.when(hit, F.col("__lat")).otherwise(F.col("decimalLatitude"))
    out["decimalLongitude"] = F.when(hit, F.col("__lon")).otherwise(F.col("decimalLongitude"))
    return joined.withColumns(out).drop("__id", "__hit", "__lat", "__lon", *[f"__{c}" for c in given])


def with_stale_flag(payload: DataFrame, df: DataFrame) -> DataFrame:
    """Adds `stale`: the recorded source point is no longer the one in the data (or the record is gone)."""
    now = df.select(
        F.col(KEY).alias("__id"), text("decimalLatitude").alias("__lat"), text("decimalLongitude").alias("__lon"),
    )
    firsts = now.groupBy("__id").agg(F.min(F.struct("__lat", "__lon")).alias("__p"), F.lit(True).alias("__found"))
    joined = payload.join(firsts, F.col(KEY) == F.col("__id"), "left")
    recorded = F.col(FROM_COLUMNS[0]).isNotNull() & F.col(FROM_COLUMNS[1]).isNotNull()
    moved = (F.col("__p.__lat") != F.col(FROM_COLUMNS[0])) | (F.col("__p.__lon") != F.col(FROM_COLUMNS[1]))
    stale = recorded & (F.col("__found").isNull() | F.coalesce(moved, F.lit(True)))
    return joined.withColumn("stale", stale).drop("__id", "__p", "__found")


def drop_stale(payload: DataFrame, df: DataFrame) -> DataFrame:
    return with_stale_flag(payload, df).filter("NOT stale").drop("stale", *FROM_COLUMNS)


def apply_country_fills(df: DataFrame, fills: DataFrame) -> DataFrame:
    """Fill the country only where it is still blank."""
    side = _latest(fills).select(F.col(KEY).alias("__id"), F.col("country").alias("__country"))
    joined = df.join(side, F.col(KEY) == F.col("__id"), "left")
    return joined.withColumn("country", F.coalesce(blank_to_null("country"), F.col("__country"), F.col("country"))).drop(
        "__id", "__country"
    )


def check_coordinate_edits(edits: DataFrame) -> DataFrame:
    """Adds `value` and `error` (NULL when fine) to hand-typed axis values (axis, to)."""
    num = coord_number("to")
    limit = F.when(F.col("axis") == "lat", 90.0).otherwise(180.0)
    error = (
        F.when(is_blank("to"), "edit_empty")
        .when(num.isNull(), "edit_number")
        .when(F.abs(num) > limit, F.concat(F.lit("edit_range_"), F.col("axis")))
    )
    return edits.withColumn("error", error).withColumn("value", F.when(F.col("error").isNull(), num))


def editable_ids(df: DataFrame) -> DataFrame:
    """Identifiers that point at exactly one record; only these may be edited."""
    return df.filter(~is_blank(KEY)).groupBy(KEY).agg(F.count("*").alias("n")).filter("n = 1").select(KEY)


def merge_manual_edits(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual edits replace automatic corrections of the same record and add new ones."""
    columns = [KEY, "decimalLatitude", "decimalLongitude"]
    auto = _latest(automatic).select(KEY, F.struct(*columns[1:]).alias("__a"))
    hand = _latest(manual).select(KEY, F.struct(*columns[1:]).alias("__m"))
    merged = auto.join(hand, KEY, "full_outer").withColumn("__p", F.coalesce("__m", "__a"))
    origin = F.when(F.col("__m").isNotNull(), "manual").otherwise("automatic")
    return merged.select(KEY, "__p.*", origin.alias("origin"))


def drop_orphan_edits(edits: DataFrame, df: DataFrame) -> DataFrame:
    return edits.join(df.select(KEY).distinct(), KEY, "left_semi")


def overlay_corrections(result: DataFrame, corrections: DataFrame, fills: DataFrame | None = None) -> DataFrame:
    """Show accepted corrections on a validation result: new point, diagnostic `corrected`, valid."""
    side = _latest(corrections).select(
        F.col(KEY).alias("__id"), F.lit(True).alias("__hit"), coord_number("decimalLatitude").alias("__lat"),
        coord_number("decimalLongitude").alias("__lon"),
    )
    joined = result.join(side, F.col(KEY) == F.col("__id"), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    out = joined.withColumns(
        {
            "lat": F.when(hit, F.col("__lat")).otherwise(F.col("lat")),
            "lon": F.when(hit, F.col("__lon")).otherwise(F.col("lon")),
            "diagnostic": F.when(hit, "corrected").otherwise(F.col("diagnostic")),
            "family": F.when(hit, "corrected").otherwise(F.col("family")),
            "valid": hit | F.col("valid"),
        }
    ).drop("__id", "__hit", "__lat", "__lon")
    if fills is None:
        return out
    names = _latest(fills).select(F.col(KEY).alias("__id"), F.col("country").alias("__country"))
    filled = out.join(names, F.col(KEY) == F.col("__id"), "left")
    return filled.withColumn("country", F.coalesce("__country", "country")).drop("__id", "__country")


def overlay_manual_edits(result: DataFrame, edits: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Show validated manual edits (row_id, lat, lon, diagnostic, family, valid); a passing one reads `corrected`."""
    side = edits.select(
        F.col(row_id).alias("__row"), F.lit(True).alias("__hit"),
        *[F.col(c).alias(f"__{c}") for c in ("lat", "lon", "diagnostic", "family", "valid")],
    )
    joined = result.join(side, F.col(row_id) == F.col("__row"), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    passes = F.coalesce(F.col("__family") == "ok", F.lit(False))
    out = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("lat", "lon")}
    out |= {
        c: F.when(hit & passes, "corrected").when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("diagnostic", "family")
    }
    out["valid"] = F.when(hit, passes | F.coalesce("__valid", F.lit(False))).otherwise(F.col("valid"))
    out["edited"] = hit
    return joined.withColumns(out).drop("__row", "__hit", "__lat", "__lon", "__diagnostic", "__family", "__valid")


def apply_payloads(
    df: DataFrame, reviews: DataFrame | None = None, ranks: DataFrame | None = None,
    corrections: DataFrame | None = None, fills: DataFrame | None = None,
) -> DataFrame:
    """Names, ranks, coordinates, country, in this order. Stale corrections and fills are judged on
    the data as it came in."""
    fresh = {
        k: p if p is None or FROM_COLUMNS[0] not in p.columns else drop_stale(p, df)
        for k, p in (("corrections", corrections), ("fills", fills))
    }
    out = df if reviews is None else apply_name_reviews(df, reviews)
    out = out if ranks is None else apply_name_ranks(out, ranks)
    out = out if fresh["corrections"] is None else apply_coordinate_corrections(out, fresh["corrections"])
    return out if fresh["fills"] is None else apply_country_fills(out, fresh["fills"])
