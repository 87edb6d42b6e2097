"""Mapping to target terms, exports, measurements, edits and diffs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from quadrat.lookups import core_terms, local_table
from quadrat.operators import mapping as M
from quadrat_queries.fixtures import COUNTRY_SQL, LAT_SQL, LON_SQL, NAMES_CTE, mapped, with_mapped
from quadrat_queries.occ import AS_OF_YEAR, occ, table, with_occ
from quadrat_queries.registry import query
from quadrat_queries.scalars import DATE_PARTS_SQL

SPEC = M.MappingSpec(
    columns={
        "occurrenceID": ["tombo"], "scientificName": ["especie"], "eventDate": ["data_registro"],
        "decimalLatitude": ["latitude"], "decimalLongitude": ["longitude"], "country": ["pais"],
        "sex": ["sexo"], "occurrenceStatus": ["status"], "locality": ["pais", "coletor"], "dynamicProperties": ["area_ha", "sexo"],
    },
    constants={"license": "CC0", "country": ""},
)


@query(
    "mapped_terms",
    with_occ(
        DATE_PARTS_SQL + NAMES_CTE + " SELECT o.row_id, coalesce(n.canonical, nullif(trim(o.especie), '')) AS scientificName, coalesce(i.iso, nullif(trim(o.data_registro), '')) AS eventDate, "
        "o.latitude AS decimalLatitude, CASE o.sexo WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' WHEN '' THEN NULL ELSE o.sexo END AS sex, "
        "CASE o.status WHEN '' THEN NULL ELSE 'present' END AS occurrenceStatus, 'CC0' AS license, "
        "nullif(concat_ws(' | ', nullif(trim(o.pais), ''), nullif(trim(o.coletor), '')), '') AS locality, n.taxon_rank AS taxonRank, n.author AS scientificNameAuthorship "
        "FROM occ o JOIN iso i USING (row_id) LEFT JOIN names n ON o.especie = n.name"
    ),
)
def mapped_terms(spark, sf):
    return M.map_terms(occ(spark, sf), SPEC, AS_OF_YEAR).select(
        "row_id", "scientificName", "eventDate", "decimalLatitude", "sex", "occurrenceStatus", "license", "locality", "taxonRank",
        "scientificNameAuthorship",
    )


@query(
    "mapped_composed_date_failures",
    "SELECT count(*) FILTER (o_orderkey % 10 = 0) AS failed FROM orders",
)
def mapped_composed_date_failures(spark, sf):
    parts = table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("string").alias("ano"),
        F.when(F.col("o_orderkey") % 10 == 0, "99").otherwise(F.month("o_orderdate").cast("string")).alias("mes"),
        F.dayofmonth("o_orderdate").cast("string").alias("dia"),
    )
    return parts.agg(F.count_if(M.composed_date_failed(["ano", "mes", "dia"])).alias("failed"))


@query(
    "unmapped_columns_appended",
    with_occ(
        "SELECT row_id, especie AS scientificName, latitude, coletor AS coletor_original, 'x' AS coletor FROM occ"
    ),
)
def unmapped_columns_appended(spark, sf):
    source = occ(spark, sf).select("row_id", "especie", "latitude", "coletor")
    spec = M.MappingSpec(columns={"scientificName": ["especie"]})
    extras = M.unmapped_columns(source, spec)
    mapped_rows = source.select(
        "row_id", F.col("especie").alias("scientificName"), F.lit("x").alias("coletor"),
        *[F.col(c).alias(f"__src_{c}") for c in ("especie", "latitude", "coletor")],
    )
    return M.append_unmapped(mapped_rows, extras)


@query(
    "unmapped_coordinates_blanked",
    with_occ(
        ", p AS (SELECT row_id, TRY_CAST(replace(latitude, ',', '.') AS DOUBLE) AS lat FROM occ) "
        "SELECT row_id, CASE WHEN row_id % 2 = 0 THEN NULL ELSE latitude END AS gps_lat, CASE WHEN row_id % 2 = 0 THEN NULL ELSE latitude END AS note, "
        "coletor FROM occ"
    ),
)
def unmapped_coordinates_blanked(spark, sf):
    from quadrat.functions.coords import coord_number

    extras = occ(spark, sf).select(
        "row_id", F.col("latitude").alias("gps_lat"), F.col("latitude").alias("note"), "coletor",
        coord_number("latitude").alias("la"), coord_number("longitude").alias("lo"),
    )
    blanked = M.blank_coordinate_cells(
        extras, ["gps_lat", "note", "coletor"], F.col("row_id") % 2 == 0, F.col("la"), F.col("lo"), F.lit(0.1)
    )
    return blanked.select("row_id", "gps_lat", "note", "coletor")


@query(
    "columns_in_canonical_order",
    with_mapped(
        "SELECT * FROM (VALUES (0, 'row_id'), (1, 'occurrenceID'), (2, 'recordedBy'), (3, 'individualCount'), (4, 'occurrenceStatus'), (5, 'sex'), "
        "(6, 'basisOfRecord'), (7, 'eventDate'), (8, 'country'), (9, 'countryCode'), (10, 'decimalLatitude'), (11, 'decimalLongitude'), "
        "(12, 'coordinateUncertaintyInMeters'), (13, 'scientificName'), (14, 'measurementValue [area_ha]')) t(place, name) "
        "WHERE (SELECT count(*) FROM mapped) > 0"
    ),
)
def columns_in_canonical_order(spark, sf):
    ordered = M.order_columns(mapped(spark, sf))
    first = ordered.orderBy("row_id").limit(1)
    names = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("name")) for i, c in enumerate(ordered.columns)])
    return first.select(F.explode(names).alias("n")).select("n.*")


@query(
    "geodetic_datum_default",
    with_mapped(
        f"SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'SAD69' WHEN abs({LAT_SQL}) <= 90 AND abs({LON_SQL}) <= 180 AND instr(decimalLatitude, ',') = 0 "
        "THEN 'EPSG:4326' ELSE '' END AS geodeticDatum FROM mapped"
    ),
)
def geodetic_datum_default(spark, sf):
    with_datum = mapped(spark, sf).withColumn("geodeticDatum", F.when(F.col("row_id") % 3 == 0, "SAD69").otherwise(""))
    return M.geodetic_datum(with_datum).select("row_id", "geodeticDatum")


@query(
    "export_normalised",
    with_mapped(
        DATE_PARTS_SQL.replace("data_registro", "eventDate").replace("FROM occ", "FROM mapped")
        + f" SELECT m.row_id, {LAT_SQL} AS decimalLatitude, coalesce(i.iso, nullif(i.raw, '')) AS eventDate, "
        f"CASE m.countryCode WHEN 'BRA' THEN 'BR' WHEN 'ESP' THEN 'ES' WHEN '' THEN CASE {COUNTRY_SQL.format('m.country')} WHEN 'BRA' THEN 'BR' WHEN 'ARG' THEN 'AR' "
        "WHEN 'ESP' THEN 'ES' WHEN 'VUT' THEN 'VU' END ELSE m.countryCode END AS countryCode, 'EPSG:4326' AS geodeticDatum, 'CC BY 4.0' AS license "
        "FROM mapped m JOIN iso i USING (row_id)"
    ),
)
def export_normalised(spark, sf):
    out = M.normalise_for_export(mapped(spark, sf).withColumn("license", F.lit("cc-by-4.0")), AS_OF_YEAR)
    return out.select("row_id", "decimalLatitude", "eventDate", "countryCode", "geodeticDatum", "license")


@query(
    "coordinate_separators_cleaned",
    with_mapped(f"SELECT row_id, {LAT_SQL} AS decimalLatitude, {LON_SQL} AS decimalLongitude FROM mapped"),
)
def coordinate_separators_cleaned(spark, sf):
    return M.clean_separators(mapped(spark, sf)).select("row_id", "decimalLatitude", "decimalLongitude")


@query(
    "measurements_unpivoted",
    "SELECT concat('L', l_orderkey, '-', l_linenumber) AS occurrenceID, concat('L', l_orderkey, '-', l_linenumber, ':qty') AS measurementID, "
    "'qty' AS measurementType, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS measurementValue, 'pcs' AS measurementUnit FROM lineitem "
    "UNION ALL SELECT concat('L', l_orderkey, '-', l_linenumber), concat('L', l_orderkey, '-', l_linenumber, ':disc'), 'discount', "
    "CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), '' FROM lineitem WHERE l_discount > 0",
)
def measurements_unpivoted(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        F.concat(F.lit("L"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("occurrenceID"),
        F.col("l_quantity").cast("long").cast("string").alias("measurementValue [qty]"),
        F.when(F.col("l_discount") > 0, F.round(F.col("l_discount") * 100).cast("long").cast("string")).alias("measurementValue [disc]"),
        F.col("l_returnflag").alias("flag"),
    )
    _, long = M.split_measurements(wide, specs={"qty": {"measurementUnit": "pcs"}, "disc": {"measurementType": "discount"}})
    return long


@query(
    "measurement_columns_suggested",
    with_occ("SELECT 'area_ha' AS \"column\", 'ha' AS unit, count(*) > 0 AS used FROM occ UNION ALL SELECT 'incerteza_m', 'm', true"),
)
def measurement_columns_suggested(spark, sf):
    found = M.suggest_measurements(occ(spark, sf), ["row_id"])
    used = occ(spark, sf).agg((F.count("*") > 0).alias("used"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(u).alias("unit")) for c, u in found.items()])
    return used.select(F.explode(pairs).alias("p"), "used").select("p.column", "p.unit", "used")


@query(
    "cell_edits_applied",
    with_mapped(
        NAMES_CTE + " SELECT row_id, CASE WHEN sex = 'M' AND row_id % 100 = 6 THEN 'indeterminate' WHEN sex = 'M' THEN 'male' WHEN sex = '?' THEN NULL ELSE nullif(sex, '') END AS sex, "
        "CASE WHEN scientificName = 'P. onca' THEN 'Panthera onca' ELSE nullif(scientificName, '') END AS scientificName, "
        "CASE WHEN scientificName = 'P. onca' THEN 'Panthera' END AS genus FROM mapped"
    ),
)
def cell_edits_applied(spark, sf):
    single = mapped(spark, sf).filter("row_id % 100 = 6").select(
        "row_id", F.lit("sex").alias("term"), F.lit("M").alias("from"), F.lit("indeterminate").alias("to"), F.col("row_id").alias("seq")
    )
    wide = local_table(
        spark,
        {"row_id": [None] * 4, "term": ["sex", "sex", "sex", "scientificName"], "from": ["M", "M", "?", "P. onca"],
         "to": ["female", "male", "", "Panthera onca (Linnaeus, 1758)"], "seq": [-4, -3, -2, -1]},
        {"row_id": pa.int64(), "seq": pa.int64()},
    )
    done = M.apply_edits(mapped(spark, sf).select("row_id", "sex", "scientificName"), single.unionByName(wide), ["sex", "scientificName"])
    return done.select("row_id", "sex", "scientificName", "genus")


EDIT_TERMS = ["sex", "eventDate", "coordinateUncertaintyInMeters", "individualCount", "decimalLatitude", "scientificName"]


@query(
    "edit_values_checked",
    with_mapped(
        ", cells AS (SELECT row_id, 'sex' AS term, sex AS \"to\" FROM mapped UNION ALL SELECT row_id, 'eventDate', eventDate FROM mapped "
        "UNION ALL SELECT row_id, 'coordinateUncertaintyInMeters', coordinateUncertaintyInMeters FROM mapped UNION ALL SELECT row_id, 'individualCount', individualCount FROM mapped "
        "UNION ALL SELECT row_id, 'decimalLatitude', decimalLatitude FROM mapped UNION ALL SELECT row_id, 'scientificName', scientificName FROM mapped), "
        "v AS (SELECT row_id, term, \"to\", CASE "
        "WHEN term = 'sex' AND lower(\"to\") NOT IN ('', 'male', 'female') THEN 'err_vocabulary' "
        "WHEN \"to\" = '' AND term = 'scientificName' THEN 'err_blank' WHEN \"to\" = '' THEN NULL "
        "WHEN term = 'eventDate' AND regexp_matches(\"to\", '^\\d{2}[/.]\\d{2}[/.]\\d{4}$') AND substr(\"to\", 1, 2) <= '12' AND substr(\"to\", 4, 2) <= '12' AND substr(\"to\", 1, 2) <> substr(\"to\", 4, 2) THEN 'err_date_ambiguous' "
        "WHEN term = 'eventDate' AND regexp_matches(\"to\", '^\\d{2}/\\d{2}/\\d{4} 08:30$') AND substr(\"to\", 1, 2) <= '12' AND substr(\"to\", 4, 2) <= '12' AND substr(\"to\", 1, 2) <> substr(\"to\", 4, 2) THEN 'err_date' "
        "WHEN term = 'eventDate' AND \"to\" = 'sem data' THEN 'err_date' "
        "WHEN term = 'coordinateUncertaintyInMeters' AND \"to\" = '-5' THEN 'err_uncertainty' "
        "WHEN term = 'individualCount' AND NOT regexp_matches(\"to\", '^\\d+$') THEN 'err_count' END AS error FROM cells) "
        "SELECT row_id, term, error FROM v"
    ),
)
def edit_values_checked(spark, sf):
    cells = mapped(spark, sf).select("row_id", *EDIT_TERMS).unpivot("row_id", EDIT_TERMS, "term", "to")
    return M.check_edit_values(cells, AS_OF_YEAR).select("row_id", "term", "error")


@query(
    "duplicate_source_columns",
    "SELECT s_suppkey AS dataset, 'data' AS \"column\", ['eventDate', 'modified'] AS terms FROM supplier "
    "UNION ALL SELECT s_suppkey, 'coord', ['decimalLatitude', 'decimalLongitude'] FROM supplier WHERE false",
)
def duplicate_source_columns(spark, sf):
    return M.duplicate_sources(_pairs(spark, sf).withColumn("dataset", F.col("dataset")), ["coord"])


def _pairs(spark, sf):
    """A saved mapping per supplier: pairs of term and source column."""
    entry = [("eventDate", "data", 0), ("modified", "data", 0), ("verbatimEventDate", "data", 0), ("decimalLatitude", "coord", 0),
             ("decimalLongitude", "coord", 0), ("locality", "loc", 0), ("locality", "area", 1)]
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(c).alias("column"), F.lit(p).alias("position")) for t, c, p in entry])
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("dataset"), F.explode(rows).alias("e")).select("dataset", "e.*")


@query(
    "mapping_restore_plan",
    "SELECT s_suppkey AS dataset, 'locality' AS term, CASE WHEN s_suppkey % 2 = 0 THEN ['loc'] ELSE [] END AS matched, "
    "CASE WHEN s_suppkey % 2 = 0 THEN ['area'] ELSE ['loc', 'area'] END AS missing, CASE WHEN s_suppkey % 2 = 0 THEN 'applied' ELSE 'skipped' END AS state FROM supplier",
)
def mapping_restore_plan(spark, sf):
    pairs = _pairs(spark, sf).withColumns({"kind": F.lit("column"), "constant": F.lit(None).cast("string")})
    columns = table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("dataset"), F.lit("loc").alias("column"))
    plan = M.restore_plan(pairs.filter("term = 'locality'"), columns)
    return plan.select("dataset", "term", "matched", "missing", "state")


@query(
    "dataset_card_values",
    "SELECT 'CC BY-NC 4.0' AS license, 'pt' AS language FROM region LIMIT 1",
)
def dataset_card_values(spark, sf):
    records = occ(spark, sf).select("row_id", F.lit(" CC BY-NC 4.0").alias("Licença"), F.lit("Português (Brasil)").alias("dc:language"))
    return M.card_values(records)


@query("sample_of_rows", with_mapped("SELECT row_id, scientificName FROM mapped ORDER BY row_id LIMIT 100"))
def sample_of_rows(spark, sf):
    return M.sample_rows(mapped(spark, sf)).select("row_id", "scientificName")


# ---- diffs -------------------------------------------------------------------------------------


def _edited(spark, sf):
    base = mapped(spark, sf).select("row_id", "occurrenceID", "scientificName", "decimalLatitude", "decimalLongitude", "country")
    after = base.withColumns(
        {"country": F.when(F.col("country") == "Brazl", "Brazil").otherwise(F.col("country")),
         "decimalLatitude": F.when(F.col("row_id") % 9 == 0, "1.0").otherwise(F.col("decimalLatitude"))}
    )
    return base, after


CHANGES_CTE = (
    ", changes AS (SELECT row_id, 'country' AS term, country AS \"from\", 'Brazil' AS \"to\" FROM mapped WHERE country = 'Brazl' "
    "UNION ALL SELECT row_id, 'decimalLatitude', decimalLatitude, '1.0' FROM mapped WHERE row_id % 9 = 0 AND decimalLatitude <> '1.0')"
)


@query("cell_changes", with_mapped(CHANGES_CTE + " SELECT * FROM changes"))
def cell_changes(spark, sf):
    before, after = _edited(spark, sf)
    return M.cell_changes(before, after, ["scientificName", "decimalLatitude", "decimalLongitude", "country"])


LOG_CTE = CHANGES_CTE + (
    ", log AS (SELECT c.row_id, m.occurrenceID, CASE term WHEN 'country' THEN 'country' ELSE 'coordinates' END AS kind, term, "
    "CASE WHEN c.row_id % 2 = 0 AND term <> 'country' THEN '' ELSE \"from\" END AS \"from\", CASE WHEN c.row_id % 2 = 0 AND term <> 'country' THEN '' ELSE \"to\" END AS \"to\", "
    "c.row_id % 2 = 0 AS generalized FROM changes c JOIN mapped m USING (row_id) WHERE c.row_id % 7 <> 0)"
)


def _log(spark, sf):
    before, after = _edited(spark, sf)
    return M.change_log(before, after, hidden=before.filter("row_id % 2 = 0"), dropped=before.filter("row_id % 7 = 0"))


@query("change_log", with_mapped(LOG_CTE + " SELECT * FROM log"))
def change_log(spark, sf):
    return _log(spark, sf)


@query(
    "change_log_examples",
    with_mapped(
        LOG_CTE + " SELECT kind, count(DISTINCT row_id) AS records, min(row_id) FILTER (NOT generalized OR term = 'country') AS example_row FROM log GROUP BY kind"
    ),
)
def change_log_examples(spark, sf):
    return M.change_examples(_log(spark, sf))


@query(
    "change_log_formula_safe",
    with_mapped("SELECT row_id, CASE WHEN recordedBy = '=1+1' THEN '''=1+1' ELSE recordedBy END AS \"from\", 'x' AS \"to\" FROM mapped"),
)
def change_log_formula_safe(spark, sf):
    return M.log_for_file(mapped(spark, sf).select("row_id", F.col("recordedBy").alias("from"), F.lit("x").alias("to")))


@query("terms_of_core", with_mapped("SELECT count(*) AS n_rows, 66 AS n_terms FROM mapped"))
def terms_of_core(spark, sf):
    return mapped(spark, sf).agg(F.count("*").alias("n_rows")).withColumn("n_terms", F.lit(len(core_terms())))
