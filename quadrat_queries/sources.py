"""Sources, package tables and the export product on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadrat.plans import publish as X
from quadrat.session import ensure_checkpoint_dir
from quadrat.sources import camtrap as C
from quadrat.sources import delimited as D
from quadrat.sources import lists as L
from quadrat_queries.fixtures import mapped, threatened, with_mapped
from quadrat_queries.occ import AS_OF_YEAR, occ, table, with_occ
from quadrat_queries.registry import query
from quadrat_queries.sensitive import PLAN_CTE, levels


@query(
    "text_na_cleared",
    with_occ("SELECT row_id, nullif(especie, 'NA') AS especie, CASE WHEN row_id % 5 = 0 THEN NULL ELSE tombo END AS tombo FROM occ"),
)
def text_na_cleared(spark, sf):
    cells = occ(spark, sf).select("row_id", "especie", F.when(F.col("row_id") % 5 == 0, "NA").otherwise(F.col("tombo")).alias("tombo"))
    return D.clear_na_text(cells)


@query("text_na_codes_emptied", with_occ("SELECT count(*) FILTER (row_id % 5 = 0) AS lost FROM occ"))
def text_na_codes_emptied(spark, sf):
    cells = occ(spark, sf).select("row_id", "especie", F.when(F.col("row_id") % 5 == 0, "NA").otherwise(F.col("tombo")).alias("tombo"))
    return D.emptied_codes(cells)


@query(
    "text_records_read_back",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '') AS text FROM documents",
)
def text_records_read_back(spark, sf):
    """Whole documents, line breaks and quotes among them, written as quoted text and read record by record."""
    folder = f"{ensure_checkpoint_dir(spark)}/delimited-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.csv(folder, **options)
    return D.read_delimited(spark, folder)[0].select("doc_id", "text")


@query("text_lines_decoded", "SELECT doc_id, text AS value, 'UTF-8' AS encoding FROM documents")
def text_lines_decoded(spark, sf):
    """Whole documents through the line decoder."""
    return D.decode_lines(table(spark, sf, "documents").select("doc_id", F.col("text").alias("value")))


@query(
    "text_dos_accents_repaired",
    with_occ("SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'São Paulo' ELSE coletor END AS place FROM occ"),
)
def text_dos_accents_repaired(spark, sf):
    place = F.when(F.col("row_id") % 2 == 0, "SÆo Paulo").otherwise(F.col("coletor"))
    return D.repair_dos_accents(occ(spark, sf).select("row_id", place.alias("place")), ["place"])


@query("text_dos_accent_counts", with_occ("SELECT 'place' AS \"column\", count(*) FILTER (row_id % 2 = 0) AS repaired, 0 AS unsure FROM occ"))
def text_dos_accent_counts(spark, sf):
    place = F.when(F.col("row_id") % 2 == 0, "SÆo Paulo").otherwise(F.col("coletor"))
    return D.dos_accent_counts(occ(spark, sf).select(place.alias("place")), ["place"])


@query(
    "rows_read_report",
    with_occ(
        "SELECT count(*) AS \"rows\", 0 AS empty_rows, count(*) FILTER (CAST(tombo <> '' AS INTEGER) + CAST(especie <> '' AS INTEGER) + CAST(pais <> '' AS INTEGER) + CAST(sexo <> '' AS INTEGER) = 1) AS footer_rows FROM occ "
        "WHERE tombo <> '' OR especie <> '' OR pais <> '' OR sexo <> ''"
    ),
)
def rows_read_report(spark, sf):
    cells = D.drop_empty_rows(occ(spark, sf).select("row_id", "tombo", "especie", "pais", "sexo"))
    return D.row_report(cells)


# ---- camera traps: orders are deployments, lineitem are images -----------------------------------


def _export(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    dep = orders.select(
        F.col("o_orderkey").cast("string").alias("deployment_id"), F.lit("-10.5").alias("latitude"), F.lit("-50.25").alias("longitude"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end_date"),
        F.when(F.col("o_orderkey") % 2 == 0, "Road paved").otherwise("Roof").alias("feature_type"),
    )
    key = (F.col("l_orderkey") * 100000000000 + F.col("l_partkey") * 10000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long"))
    images = lines.select(
        key.alias("seq"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("image_id"),
        F.col("l_orderkey").cast("string").alias("deployment_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(F.col("l_returnflag") == "A", "1").otherwise("0").alias("is_blank"),
        F.when(F.col("l_returnflag") == "N", "Panthera").otherwise("").alias("genus"), F.when(F.col("l_linestatus") == "O", "onca").otherwise("").alias("species"),
        F.lit("Felidae").alias("family"), F.col("l_quantity").cast("int").cast("string").alias("number_of_objects"),
        F.lit("95").alias("cv_confidence"), F.lit("Computer Vision").alias("identified_by"), F.lit("Adult").alias("age"),
    )
    return dep, images


TYPE_SQL = "CASE WHEN l_returnflag = 'A' THEN 'blank' ELSE 'animal' END"
NAME_SQL = "CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'Panthera onca' WHEN l_returnflag = 'N' THEN 'Panthera' ELSE 'Felidae' END"


@query(
    "camera_deployments",
    "SELECT CAST(o_orderkey AS VARCHAR) AS deploymentID, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS deploymentStart, strftime(o_orderdate, '%Y-%m-%dT23:59:59Z') AS deploymentEnd, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'roadPaved' END AS featureType, -10.5 AS latitude FROM orders",
)
def camera_deployments(spark, sf):
    dep, _, _ = C.normalise_export(*_export(spark, sf))
    return dep.select("deploymentID", "deploymentStart", "deploymentEnd", "featureType", "latitude")


@query(
    "camera_observations",
    f"SELECT {TYPE_SQL} AS observationType, {NAME_SQL} AS scientificName, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS individuals, count(DISTINCT (l_orderkey, l_linenumber)) AS images, "
    "0.95 AS probability, 'adult' AS lifeStage FROM lineitem GROUP BY 1, 2",
)
def camera_observations(spark, sf):
    _, _, obs = C.normalise_export(*_export(spark, sf))
    return obs.groupBy("observationType", "scientificName").agg(
        F.count("*").alias("n"), F.sum("count").alias("individuals"), F.countDistinct("eventID").alias("images"),
        F.max("classificationProbability").alias("probability"), F.max("lifeStage").alias("lifeStage"),
    )


@query("camera_media", "SELECT concat(l_orderkey, '-', l_linenumber) AS mediaID, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1")
def camera_media(spark, sf):
    _, media, _ = C.normalise_export(*_export(spark, sf))
    return media.groupBy("mediaID").agg(F.count("*").alias("n"))


@query(
    "camera_occurrences",
    f"SELECT {NAME_SQL} AS scientificName, count(*) AS n, min(strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ')) AS first_seen, '-10.5' AS lat FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'A' GROUP BY 1",
)
def camera_occurrences(spark, sf):
    dep, media, obs = C.normalise_export(*_export(spark, sf))
    full = dep.withColumns({c: F.lit(None).cast("string") for c in ("locationID", "habitat")}).withColumn("coordinateUncertainty", F.lit(None).cast("double"))
    wide = obs.withColumns({c: F.lit(None).cast("string") for c in ("behavior", "individualID", "observationComments")})
    flat = C.occurrences(full, media, wide)
    return flat.groupBy("scientificName").agg(F.count("*").alias("n"), F.min("eventDate").alias("first_seen"), F.max("decimalLatitude").alias("lat"))


@query(
    "camera_timestamps",
    "SELECT event_id, CASE event_id % 5 WHEN 3 THEN strftime(ts, '%Y-%m-%dT00:00:00Z') WHEN 4 THEN NULL WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:00Z') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM events",
)
def camera_timestamps(spark, sf):
    k = F.col("event_id") % 5
    raw = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(k == 3, F.date_format("ts", "yyyy-MM-dd")).otherwise("2024-02-30 10:00:00")
    )
    return table(spark, sf, "events").select("event_id", C.parse_timestamp(raw).alias("iso"))


@query("camera_timestamps_lost", "SELECT count(*) FILTER (event_id % 5 = 4) AS lost FROM events")
def camera_timestamps_lost(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 4, "24:00").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf, "events").agg(C.lost_timestamps(raw, C.parse_timestamp(raw)).alias("lost"))


# ---- lists and archives ------------------------------------------------------------------------


@query(
    "archive_ids_reconciled",
    with_occ(
        "SELECT tombo AS occurrenceID, 'missing' AS state FROM occ WHERE row_id % 6 = 1 AND tombo NOT IN ('', 'OCC-SHARED') UNION ALL SELECT concat('P-', row_id), 'unexpected' FROM occ WHERE row_id % 50 = 0"
    ),
)
def archive_ids_reconciled(spark, sf):
    sent = occ(spark, sf).filter("tombo <> 'OCC-SHARED'").select(F.col("tombo").alias("occurrenceID"))
    kept = occ(spark, sf).filter("row_id % 6 <> 1 AND tombo NOT IN ('', 'OCC-SHARED')").select(F.col("tombo").alias("occurrenceID"))
    extra = occ(spark, sf).filter("row_id % 50 = 0").select(F.concat(F.lit("P-"), F.col("row_id").cast("string")).alias("occurrenceID"))
    return L.reconcile_ids(sent, kept.unionByName(extra))


@query(
    "archive_shared_ids_reconciled",
    with_occ(
        "SELECT DISTINCT tombo AS occurrenceID, 'missing' AS state FROM occ WHERE tombo <> '' AND tombo NOT IN (SELECT tombo FROM occ WHERE row_id % 6 <> 1) "
        "UNION ALL SELECT concat('P-', row_id), 'unexpected' FROM occ WHERE row_id % 50 = 0"
    ),
)
def archive_shared_ids_reconciled(spark, sf):
    """All identifiers, the repeated one included: it is published if any of its rows is."""
    sent = occ(spark, sf).select("row_id", F.col("tombo").alias("occurrenceID"))
    kept = sent.filter("row_id % 6 <> 1 AND occurrenceID <> ''")
    extra = sent.filter("row_id % 50 = 0").select(F.concat(F.lit("P-"), F.col("row_id").cast("string")).alias("occurrenceID"))
    return L.reconcile_ids(sent.select("occurrenceID"), kept.select("occurrenceID").unionByName(extra))


@query(
    "threatened_list_from_markdown",
    "SELECT p_name AS scientificName, CASE p_size % 3 WHEN 0 THEN 'VU' WHEN 1 THEN 'EN' ELSE 'CR' END AS category, CASE WHEN p_partkey * 10 > 500 THEN 'ANEXO 2' ELSE 'ANEXO 1' END AS source "
    "FROM part WHERE p_size % 7 <> 0",
)
def threatened_list_from_markdown(spark, sf):
    part = table(spark, sf, "part")
    category = F.when(F.col("p_size") % 7 == 0, "EX").when(F.col("p_size") % 3 == 0, "VU").when(F.col("p_size") % 3 == 1, "EN").otherwise("CR")
    rows = part.select(
        (F.col("p_partkey") * 10).alias("line"),
        F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | | Family | "), F.col("p_name"), F.lit(" | "), category, F.lit(" |")).alias("value"),
    )
    heads = spark.sql("SELECT * FROM VALUES (CAST(-1 AS BIGINT), '| ANEXO 1. Flora |'), (CAST(501 AS BIGINT), '| ANEXO 2. Fauna |') t(line, value)")
    return L.threatened_from_markdown(rows.unionByName(heads))


@query(
    "threatened_most_restrictive",
    "SELECT p_brand AS match_key, max(CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS rank FROM part GROUP BY p_brand",
)
def threatened_most_restrictive(spark, sf):
    part = table(spark, sf, "part")
    category = F.when(F.col("p_size") % 3 == 0, "VU").when(F.col("p_size") % 3 == 1, "EN").otherwise("CR")
    listed = part.select(F.col("p_brand").alias("match_key"), F.col("p_name").alias("scientificName"), category.alias("category"))
    return L.most_restrictive(listed).select("match_key", L.category_rank(F.col("category")).alias("rank"))


@query(
    "invasive_list_joined",
    "SELECT s_name AS scientificName, CASE WHEN s_suppkey % 2 = 0 THEN 'translocated_native' ELSE 'alien' END AS origin_class, CAST(s_nationkey AS VARCHAR) AS native_range FROM supplier",
)
def invasive_list_joined(spark, sf):
    supplier = table(spark, sf, "supplier")
    listed = supplier.select(F.concat("s_name", F.lit(" Author")).alias("scientificName"))
    details = supplier.select(
        F.concat("s_name", F.lit(" Author")).alias("scientificName"), F.col("s_name").alias("canonicalName"),
        F.when(F.col("s_suppkey") % 2 == 0, "Translocada").otherwise("Exótica").alias("origin"),
        F.col("s_nationkey").cast("string").alias("native_range"), F.lit("pets").alias("introduction_reason"),
    )
    return L.invasive_from_tables(listed, details).select("scientificName", "origin_class", "native_range")


# ---- export product ------------------------------------------------------------------------------


@query(
    "conservation_status_keys",
    with_mapped(
        PLAN_CTE.split(", levels(")[0] + " SELECT m.row_id, CASE WHEN t.category IS NOT NULL AND coalesce(CASE m.countryCode WHEN 'BRA' THEN 'BRA' WHEN 'br' THEN 'BRA' WHEN 'AR' THEN 'ARG' WHEN 'ESP' THEN 'ESP' END, "
        "CASE m.country WHEN 'Brasil' THEN 'BRA' WHEN 'BRAZIL' THEN 'BRA' WHEN 'Brazl' THEN 'BRA' WHEN 'BR' THEN 'BRA' END, '') = 'BRA' "
        "THEN concat('{\"mmaThreatStatus\":\"', t.category, '\",\"mmaSource\":\"national list\"}') ELSE '' END AS dynamicProperties "
        "FROM mapped m LEFT JOIN names n ON m.scientificName = n.name LEFT JOIN threatened t ON n.taxon_key = t.match_key"
    ),
)
def conservation_status_keys(spark, sf):
    return X.conservation_status(mapped(spark, sf), threatened(spark)).select("row_id", "dynamicProperties")


def product(spark, sf):
    dropped = mapped(spark, sf).filter("row_id % 7 = 0").select("row_id")
    return X.build_product(X.ExportInputs(
        records=mapped(spark, sf), levels=levels(spark), threatened=threatened(spark), dropped=dropped, as_of_year=AS_OF_YEAR))


@query(
    "export_private_records",
    with_mapped(PLAN_CTE + " SELECT row_id, replace(decimalLatitude, ',', '.') AS decimalLatitude FROM plan WHERE (target OR withheld) AND row_id % 7 <> 0"),
)
def export_private_records(spark, sf):
    return product(spark, sf).private.select("row_id", "decimalLatitude")


def _reviewed(spark, sf):
    """Every second record has no point, every record a note with one in a column no term uses."""
    records = mapped(spark, sf).withColumn("decimalLatitude", F.when(F.col("row_id") % 2 == 0, "").otherwise(F.col("decimalLatitude")))
    notes = records.select("row_id", F.concat(F.lit("ponto -23.5505, -46.6333 n"), F.col("row_id").cast("string")).alias("nota de campo"))
    dropped = records.filter("row_id % 7 = 0").select("row_id")
    return X.build_product(X.ExportInputs(
        records=records, levels=levels(spark), threatened=threatened(spark), dropped=dropped, as_of_year=AS_OF_YEAR, extras=notes))


@query(
    "export_rows_under_review",
    with_mapped(PLAN_CTE + " SELECT row_id, 'point_text' AS problem FROM ok WHERE sens AND row_id % 2 = 0 AND row_id % 7 <> 0"),
)
def export_rows_under_review(spark, sf):
    return X.rows_under_review(_reviewed(spark, sf))


@query(
    "export_unmapped_columns",
    with_mapped("SELECT row_id, 'ponto -23.5505, -46.6333 n' || row_id AS nota FROM mapped WHERE row_id % 7 <> 0 AND scientificName NOT LIKE 'Panthera%' "
                "AND scientificName NOT LIKE 'Puma%' AND scientificName NOT LIKE 'Euterpe%'"),
)
def export_unmapped_columns(spark, sf):
    """The unmapped column of records of species without a level: published as it is."""
    core = _reviewed(spark, sf).core.select("row_id", "scientificName", F.col("`nota de campo`").alias("nota"))
    free = ~F.col("scientificName").rlike("^(Panthera|Puma|Euterpe)")
    return core.filter(free).select("row_id", "nota")


@query(
    "export_core_points",
    with_mapped(
        PLAN_CTE + " SELECT row_id, CASE WHEN target THEN pub_lat WHEN withheld THEN NULL ELSE lat END AS decimalLatitude FROM pub WHERE row_id % 7 <> 0"
    ),
)
def export_core_points(spark, sf):
    return product(spark, sf).core.select("row_id", "decimalLatitude")


