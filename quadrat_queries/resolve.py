"""Name catalogues, the cascade, statistics and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.lookups import local_table
from quadrat.operators import cascade as Q
from quadrat.operators import stats as S
from quadrat_queries.fixtures import LAT_SQL, LON_SQL, NAMES_CTE, mapped, with_mapped
from quadrat_queries.occ import occ, table, with_occ
from quadrat_queries.registry import query
from quadrat_queries.scalars import DATE_PARTS_SQL

QUERY_SQL = (
    "CASE WHEN n.qualifier = 'sp.' THEN NULL WHEN n.name = 'Inga nobilis Willd. subsp. nobilis' THEN 'Inga nobilis subsp. nobilis' ELSE n.canonical END"
)
PREPARED_CTE = (
    NAMES_CTE + f", prepared AS (SELECT m.row_id, m.scientificName AS input_name, {QUERY_SQL} AS query_name, CASE WHEN trim(m.scientificName) = '' THEN 'blank' "
    f"WHEN {QUERY_SQL} IS NULL THEN 'ignored' END AS skip_reason FROM mapped m LEFT JOIN names n ON m.scientificName = n.name)"
)


@query("names_prepared", with_mapped(PREPARED_CTE + " SELECT * FROM prepared"))
def names_prepared(spark, sf):
    return Q.prepare_names(mapped(spark, sf))


@query("names_pending", with_mapped(PREPARED_CTE + " SELECT DISTINCT query_name FROM prepared WHERE query_name IS NOT NULL AND query_name <> 'Felidae'"))
def names_pending(spark, sf):
    done = mapped(spark, sf).filter("scientificName = 'Felidae'").select(F.col("scientificName").alias("query_name"))
    return Q.pending_names(names_prepared(spark, sf), done)


CATALOGUE = {
    "canonicalName": ["Panthera onca", "Puma concolor", "Euterpe edulix", "Inga nobilis subsp. nobilis"],
    "taxonomicStatus": ["Accepted", "Synonym", "Accepted", "Accepted"], "acceptedName": [None, "Felis concolor", None, None],
    "family": ["Felidae", "Felidae", "Arecaceae", "Fabaceae"],
}


def catalogue(spark):
    return local_table(spark, CATALOGUE)


CATALOGUE_SQL = (
    " CASE query_name WHEN 'Panthera onca' THEN 'accepted' WHEN 'Puma concolor' THEN 'synonym' WHEN 'Euterpe edulis' THEN 'ambiguous' "
    "WHEN 'Inga nobilis subsp. nobilis' THEN 'accepted' END"
)


@query(
    "names_in_catalogue",
    with_mapped(
        PREPARED_CTE + f", q AS (SELECT DISTINCT query_name FROM prepared WHERE query_name IS NOT NULL) SELECT query_name, {CATALOGUE_SQL} AS validation_status, "
        "CASE query_name WHEN 'Euterpe edulis' THEN 'Euterpe edulix' END AS suggestedName, CASE query_name WHEN 'Puma concolor' THEN 'Felis concolor' END AS acceptedNameUsage "
        f"FROM q WHERE {CATALOGUE_SQL} IS NOT NULL"
    ),
)
def names_in_catalogue(spark, sf):
    found = Q.query_catalogue(Q.pending_names(names_prepared(spark, sf)), catalogue(spark), "flora")
    return found.select("query_name", "validation_status", "suggestedName", "acceptedNameUsage")


def general(spark, sf):
    """Saved answers, one per pending name, as the match service returns them."""
    names = Q.pending_names(names_prepared(spark, sf))
    body = F.concat(
        F.lit('{"usage":{"key":"K1","canonicalName":"'), F.col("query_name"), F.lit('","rank":"SPECIES","status":"'),
        F.when(F.col("query_name") == "Puma concolor", "SYNONYM").otherwise("ACCEPTED"),
        F.lit('"},"acceptedUsage":{"key":"K2","canonicalName":"Panthera onca"},"classification":[{"rank":"FAMILY","name":"Felidae"}],"diagnostics":{"matchType":"'),
        F.when(F.col("query_name") == "Felidae", "NONE").otherwise("EXACT"), F.lit('"},"additionalStatus":[{"datasetAlias":"IUCN","statusCode":"'),
        F.when(F.col("query_name") == "Panthera onca", "NT").otherwise(""), F.lit('"}]}'),
    )
    return Q.parse_answers(names.select("query_name", body.alias("body")))


ANSWERS_CTE = PREPARED_CTE + (
    ", answers AS (SELECT DISTINCT query_name, CASE query_name WHEN 'Felidae' THEN 'not_found' WHEN 'Puma concolor' THEN 'synonym' ELSE 'accepted' END AS validation_status "
    "FROM prepared WHERE query_name IS NOT NULL)"
)


@query(
    "match_answers_parsed",
    with_mapped(
        ANSWERS_CTE + " SELECT query_name, validation_status, CASE WHEN validation_status <> 'not_found' THEN 'Felidae' END AS family, "
        "CASE WHEN query_name = 'Panthera onca' THEN 'NT' END AS iucnRedListCategory, CASE WHEN validation_status <> 'not_found' THEN 1 END AS match_count FROM answers"
    ),
)
def match_answers_parsed(spark, sf):
    return general(spark, sf).select("query_name", "validation_status", "family", "iucnRedListCategory", "match_count")


@query(
    "red_list_with_synonyms",
    with_mapped(ANSWERS_CTE + " SELECT query_name, CASE WHEN query_name IN ('Panthera onca', 'Puma concolor') THEN 'NT' END AS code FROM answers"),
)
def red_list_with_synonyms(spark, sf):
    return Q.red_list_categories(general(spark, sf))


REPORT_SQL = ANSWERS_CTE + (
    f", best AS (SELECT query_name, CASE WHEN {CATALOGUE_SQL} = 'accepted' THEN 'accepted' ELSE validation_status END AS status, "
    f"CASE WHEN {CATALOGUE_SQL} = 'accepted' THEN 'FLORA' ELSE 'GBIF' END AS source FROM answers), "
    "report AS (SELECT p.row_id, p.query_name, CASE p.skip_reason WHEN 'blank' THEN 'invalid' WHEN 'ignored' THEN 'ignored' ELSE coalesce(b.status, 'not_found') END AS validation_status, "
    "b.source AS nameAccordingTo FROM prepared p LEFT JOIN best b USING (query_name))"
)


def report(spark, sf):
    prepared = names_prepared(spark, sf)
    best = Q.resolve_cascade(Q.pending_names(prepared), [("flora", catalogue(spark))], general(spark, sf))
    return Q.validation_report(prepared, best)


@query("names_cascade_report", with_mapped(REPORT_SQL + " SELECT * FROM report"))
def names_cascade_report(spark, sf):
    return report(spark, sf).select("row_id", "query_name", "validation_status", "nameAccordingTo")


@query("names_status_counts", with_mapped(REPORT_SQL + " SELECT validation_status AS status, count(*) AS n FROM report GROUP BY 1"))
def names_status_counts(spark, sf):
    return Q.status_counts(report(spark, sf))


@query(
    "names_report_filtered",
    with_mapped(REPORT_SQL + " SELECT row_id, query_name FROM report WHERE validation_status IN ('synonym', 'accepted') AND query_name <> 'Panthera onca'"),
)
def names_report_filtered(spark, sf):
    reviewed = mapped(spark, sf).select(F.lit("Panthera onca").alias("query_name"))
    return Q.filter_report(report(spark, sf), ["synonym", "accepted"], reviewed).select("row_id", "query_name")


EVENT_STATUS = "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'click' THEN 'synonym' WHEN 'view' THEN 'ambiguous' ELSE 'not_found' END"


def _status(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "accepted").when(kind == "click", "synonym").when(kind == "view", "ambiguous").otherwise("not_found")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("query_name"), status.alias("validation_status"), F.col("event_id").alias("seq"), F.lit("p").alias("provider")
    )


@query(
    "best_answer_per_name",
    f"SELECT CAST(user_id AS VARCHAR) AS query_name, {EVENT_STATUS} AS validation_status, event_id AS seq FROM events QUALIFY row_number() OVER "
    f"(PARTITION BY user_id ORDER BY CASE {EVENT_STATUS} WHEN 'accepted' THEN 4 WHEN 'synonym' THEN 3 WHEN 'ambiguous' THEN 2 ELSE 1 END DESC, event_id DESC) = 1",
)
def best_answer_per_name(spark, sf):
    return Q.best_results(_status(spark, sf)).select("query_name", "validation_status", "seq")


@query(
    "status_upserted",
    f"WITH s AS (SELECT CAST(user_id AS VARCHAR) AS q, {EVENT_STATUS} AS st, event_id, event_id % 2 AS half FROM events), "
    "l AS (SELECT q, half, arg_max(st, event_id) AS st, max(event_id) AS at FROM s GROUP BY q, half), "
    "r AS (SELECT *, CASE st WHEN 'accepted' THEN 4 WHEN 'synonym' THEN 3 WHEN 'ambiguous' THEN 2 ELSE 1 END AS k FROM l) "
    "SELECT coalesce(a.q, b.q) AS query_name, CASE WHEN a.q IS NULL OR b.k >= a.k THEN b.st ELSE a.st END AS validation_status, coalesce(b.at, a.at) AS display_order "
    "FROM (SELECT * FROM r WHERE half = 0) a FULL OUTER JOIN (SELECT * FROM r WHERE half = 1) b ON a.q = b.q",
)
def status_upserted(spark, sf):
    rows = _status(spark, sf).withColumnRenamed("seq", "display_order")
    state = Q.last_per_key(rows.filter("display_order % 2 = 0"), ["query_name"], [F.col("display_order")])
    return Q.upsert_status(state, rows.filter("display_order % 2 = 1")).select("query_name", "validation_status", "display_order")


@query("status_latest_window", "SELECT CAST(user_id AS VARCHAR) AS query_name, event_id AS display_order FROM events ORDER BY event_id DESC LIMIT 25")
def status_latest_window(spark, sf):
    rows = _status(spark, sf).withColumnRenamed("seq", "display_order")
    return Q.latest_window(rows, 25).select("query_name", "display_order")


# ---- statistics --------------------------------------------------------------------------------


@query(
    "column_profile",
    with_occ(
        "SELECT 'latitude' AS \"column\", count(*) AS filled, 1.0 AS completeness, 1.0 AS numeric, 1.0 AS latitude FROM occ UNION ALL "
        "SELECT 'area_ha', count(*) FILTER (area_ha <> ''), count(*) FILTER (area_ha <> '') / count(*), "
        "count(*) FILTER (area_ha NOT IN ('', '12 ha')) / count(*) FILTER (area_ha <> ''), count(*) FILTER (area_ha NOT IN ('', '12 ha')) / count(*) FILTER (area_ha <> '') FROM occ"
    ),
)
def column_profile(spark, sf):
    return S.column_profile(occ(spark, sf), ["latitude", "area_ha"]).select("column", "filled", "completeness", "numeric", "latitude")


@query(
    "values_sampled_by_tier",
    with_occ(
        ", v AS (SELECT 'especie' AS \"column\", 1000 AS t, row_id, trim(especie) AS value FROM occ UNION ALL SELECT 'pais', 500, row_id, trim(pais) FROM occ "
        "UNION ALL SELECT 'sexo', 200, row_id, trim(sexo) FROM occ), "
        "f AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY row_id) AS i, count(*) OVER (PARTITION BY \"column\") AS n FROM v WHERE value <> ''), "
        "k AS (SELECT DISTINCT \"column\", n, t, unnest(range(0, t)) AS k FROM f WHERE n > t), "
        "p AS (SELECT \"column\", round_even(1 + k * ((n - 1)::DOUBLE / (t - 1)), 0)::BIGINT AS i FROM k) "
        "SELECT \"column\", row_id, value FROM f WHERE n <= t UNION ALL SELECT f.\"column\", row_id, value FROM f JOIN p USING (\"column\", i)"
    ),
)
def values_sampled_by_tier(spark, sf):
    scores = spark.createDataFrame([("especie", 0.95), ("pais", 0.8), ("sexo", 0.5)], "column string, name_score double")
    return S.sample_values(occ(spark, sf).select("row_id", "especie", "pais", "sexo"), scores, hot_rows=700)


@query(
    "dataset_extents",
    with_mapped(
        DATE_PARTS_SQL.replace("data_registro", "eventDate").replace("FROM occ", "FROM mapped")
        + f", pts AS (SELECT {LAT_SQL} AS lat, {LON_SQL} AS lon FROM mapped), good AS (SELECT * FROM pts WHERE NOT (abs(lat) < 0.5 AND abs(lon) < 0.5) AND lat <> lon), "
        "days AS (SELECT CASE WHEN length(iso) = 7 THEN CAST(concat(iso, '-01') AS DATE) ELSE CAST(substr(iso, 1, 10) AS DATE) END AS a, "
        "CASE WHEN length(iso) = 7 THEN last_day(CAST(concat(iso, '-01') AS DATE)) ELSE CAST(substr(iso, 1, 10) AS DATE) END AS b FROM iso) "
        "SELECT (SELECT min(lat) FROM good) AS south, (SELECT max(lat) FROM good) AS north, (SELECT min(lon) FROM good) AS west, (SELECT max(lon) FROM good) AS east, "
        "min(a) FILTER (a <= DATE '2000-06-30') AS first_day, max(least(b, DATE '2000-06-30')) FILTER (a <= DATE '2000-06-30') AS last_day FROM days"
    ),
)
def dataset_extents(spark, sf):
    from quadrat.functions.dates import fix_dates
    from quadrat_queries.occ import AS_OF_YEAR

    return S.dataset_extents(fix_dates(mapped(spark, sf), ["eventDate"], AS_OF_YEAR), "2000-06-30")


@query("most_common_value", with_occ("SELECT coletor AS title FROM occ GROUP BY coletor ORDER BY count(*) DESC, coletor LIMIT 1"))
def most_common_value(spark, sf):
    return S.most_common(occ(spark, sf), "coletor", "title")


@query(
    "publication_readiness",
    with_mapped(
        "SELECT 83 AS readiness_pct, ['license'] AS missing, true AS occurrence_id_present, count(*) FILTER (basisOfRecord = '') AS basis_blank, "
        "count(*) FILTER (scientificName = '') AS name_blank, true AS blocked FROM mapped"
    ),
)
def publication_readiness(spark, sf):
    return S.readiness(mapped(spark, sf))


@query(
    "export_summary",
    with_mapped(
        "SELECT 83 AS readiness_pct, true AS occurrence_id_present, count(*) FILTER (basisOfRecord = '') AS basis_blank, count(*) FILTER (scientificName = '') AS name_blank, true AS blocked, "
        "count(*) AS records, 14 AS terms, 0 AS changed_names, 0 AS changed_coordinates, count(*) FILTER (country = 'Brazl') AS changed_country, 0 AS changed_preview, "
        "count(*) FILTER (recordedBy = '=1+1') AS formula_cells, count(*) AS n_masked, 0 AS n_withheld FROM mapped"
    ),
)
def export_summary(spark, sf):
    from quadrat.operators.mapping import change_log

    before = mapped(spark, sf)
    after = before.withColumn("country", F.when(F.col("country") == "Brazl", "Brazil").otherwise(F.col("country")))
    counts = before.agg(F.count("*").alias("n_masked"), F.lit(0).alias("n_withheld"))
    return S.export_summary(before, change_log(before, after), counts)


COLOR_SQL = "CASE WHEN row_id % 10 = 0 THEN '#D00000' ELSE '#00A86B' END"
MARKERS_CTE = f", m AS (SELECT {LAT_SQL} AS lat, {LON_SQL} AS lon, {COLOR_SQL} AS color, min(row_id) AS row_id, count(*) AS n FROM mapped GROUP BY 1, 2, 3)"


def _colored(spark, sf):
    from quadrat_queries.fixtures import points

    color = F.when(F.col("row_id") % 10 == 0, "#D00000").otherwise("#00A86B")
    return points(spark, sf).withColumn("color", color)


@query("map_markers", with_mapped(MARKERS_CTE + " SELECT * FROM m"))
def map_markers(spark, sf):
    return S.map_markers(_colored(spark, sf))


@query(
    "map_marker_sample",
    with_mapped(
        MARKERS_CTE + " SELECT * FROM m WHERE color = '#D00000' UNION ALL (SELECT * FROM m WHERE color = '#00A86B' AND lat BETWEEN -75 AND 75 AND lon BETWEEN -150 AND 150 "
        "ORDER BY row_id * 0.6180339887::DOUBLE - floor(row_id * 0.6180339887::DOUBLE), row_id LIMIT 200)"
    ),
)
def map_marker_sample(spark, sf):
    bounds = {"north": 50.0, "south": -50.0, "east": 100.0, "west": -100.0}
    return S.map_sample(S.map_markers(_colored(spark, sf)), "#00a86b", 200, bounds)


@query(
    "map_view_trimmed",
    with_mapped(
        f", p AS (SELECT greatest(least({LAT_SQL}, 85.0), -85.0) AS lat, {LON_SQL} AS lon FROM mapped), k AS (SELECT CAST(floor(count(*) * 0.02) AS BIGINT) AS cut, count(*) AS n FROM p), "
        "y AS (SELECT lat, row_number() OVER (ORDER BY lat) AS r FROM p), x AS (SELECT lon, row_number() OVER (ORDER BY lon) AS r FROM p) "
        "SELECT (SELECT lat FROM y, k WHERE r = cut + 1) AS lat1, (SELECT lat FROM y, k WHERE r = n - cut) AS lat2, (SELECT lon FROM x, k WHERE r = cut + 1) AS lng1, "
        "(SELECT lon FROM x, k WHERE r = n - cut) AS lng2, 'bounds' AS type"
    ),
)
def map_view_trimmed(spark, sf):
    from quadrat_queries.fixtures import points

    return S.map_view(points(spark, sf), 0.02)
