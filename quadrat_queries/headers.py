"""Column auto-mapping on the profile of the data."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from quadrat.lookups import local_table
from quadrat.operators.stats import column_profile
from quadrat.plans import automap as A
from quadrat.session import ensure_checkpoint_dir
from quadrat_queries.fixtures import mapped, with_mapped
from quadrat_queries.occ import occ, table
from quadrat_queries.registry import query


def synonyms(spark):
    return local_table(
        spark, {"term": ["scientificName", "country", "decimalLatitude", "decimalLongitude"], "synonym": ["especie", "pais", "latitude", "longitude"],
                "score": [0.95, 0.95, 0.97, 0.97]}, {"score": pa.float64()},
    )


def profile(spark, sf):
    """The profile, a row per header, worked out once: what follows reads it several times."""
    ensure_checkpoint_dir(spark)
    df = occ(spark, sf)
    return column_profile(df, [c for c in df.columns if c != "row_id"]).withColumn("dataset", F.lit("data")).checkpoint()


def decisions(spark, sf):
    return A.decide(A.candidates(profile(spark, sf), synonyms(spark)))


@query(
    "headers_exact_names_mapped",
    with_mapped(
        "SELECT 'country' AS term, 'country' AS \"column\", 'AUTO' AS status FROM (SELECT count(*) FROM mapped) UNION ALL SELECT 'decimalLatitude', 'decimalLatitude', 'AUTO' "
        "UNION ALL SELECT 'decimalLongitude', 'decimalLongitude', 'AUTO'"
    ),
)
def headers_exact_names_mapped(spark, sf):
    exact = A.auto_map(mapped(spark, sf).select("row_id", "country", "decimalLatitude", "decimalLongitude"))
    return exact.filter("applied").select("term", "column", "status")


@query("headers_scored")
def headers_scored(spark, sf):
    return A.candidates(profile(spark, sf), synonyms(spark))


@query("headers_decided")
def headers_decided(spark, sf):
    return decisions(spark, sf)


@query("headers_alias_override")
def headers_alias_override(spark, sf):
    aliases = local_table(
        spark, {"alias_id": [1, 2], "scope": ["user", "global"], "owner": ["me", ""], "column": ["coletor", "coletor"], "term": ["recordedBy", "identifiedBy"],
                "confidence": [0.9, 0.99], "reviewed": [True, True], "updated_at": ["2026-01-01", "2026-01-02"], "active": [True, True]},
        {"alias_id": pa.int64(), "confidence": pa.float64(), "reviewed": pa.bool_(), "active": pa.bool_()},
    )
    heads = profile(spark, sf)
    return A.override_with_aliases(A.decide(A.candidates(heads, synonyms(spark))), heads, A.visible_aliases(aliases, "me", "inst"))


@query("headers_verbatim_fallback")
def headers_verbatim_fallback(spark, sf):
    return A.verbatim_fallback(decisions(spark, sf))


@query("headers_composition_ratio", with_mapped("SELECT count(*) AS input_n, count(*) FILTER (row_id % 4 <> 0) AS valid_n, count(*) FILTER (row_id % 4 <> 0) / count(*) AS ratio FROM mapped"))
def headers_composition_ratio(spark, sf):
    from quadrat.functions.dates import compose_date

    parts = mapped(spark, sf).select(F.lit("2001").alias("y"), F.when(F.col("row_id") % 4 == 0, "13").otherwise("5").alias("m"))
    return A.compose_ratio(parts, compose_date("y", "m", None)["value"], F.lit(True))


_LOG_SQL = "SELECT o_orderkey AS run, 'user' AS scope, CAST(o_custkey AS VARCHAR) AS owner, o_orderpriority AS \"column\", o_orderstatus AS term FROM orders"
_STEPS_SQL = (
    "SELECT scope, owner, \"column\", term, least(1.0, 0.80 + 0.05 * (row_number() OVER (PARTITION BY owner, \"column\", term ORDER BY run) - 1)) AS confidence, "
    "run AS from_run, lead(run) OVER (PARTITION BY owner, \"column\" ORDER BY run) AS to_run FROM log"
)


def _alias_log(spark, sf):
    """What users accepted: each order is a run of its customer, a priority is the header, a status the term."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run"), F.lit("user").alias("scope"), F.col("o_custkey").cast("string").alias("owner"),
        F.col("o_orderpriority").alias("column"), F.col("o_orderstatus").alias("term"))


@query("headers_alias_history", f"WITH log AS ({_LOG_SQL}) {_STEPS_SQL}")
def headers_alias_history(spark, sf):
    return A.alias_intervals(_alias_log(spark, sf))


@query(
    "headers_aliases_after_undo",
    f"WITH log AS (SELECT * FROM ({_LOG_SQL}) WHERE run % 3 <> 0), steps AS ({_STEPS_SQL}), last AS (SELECT max(o_orderkey) // 2 AS run FROM orders) "
    "SELECT steps.* FROM steps, last WHERE from_run <= last.run AND (to_run IS NULL OR to_run > last.run)",
)
def headers_aliases_after_undo(spark, sf):
    """Every third run taken back: what holds half way through."""
    log = _alias_log(spark, sf)
    half = log.agg(F.max("run")).first()[0] // 2
    return A.aliases_at(A.alias_intervals(log, log.filter("run % 3 = 0").select("run")), half)


def _catalogue(spark, sf):
    """Headers of one dataset per supplier: a latitude header that the locality claims too, a date under the
    target name or an odd one, and a numeric column in a share of the datasets."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("dataset"), F.col("s_nationkey").alias("k"))
    zero = {"latitude": 0.0, "longitude": 0.0, "name": 0.0, "count": 0.0, "status": 0.0, "basis": 0.0, "numeric": 0.0, "date_share": 0.0}
    head = lambda name, when=None, **shares: F.when(F.lit(True) if when is None else when, F.struct(
        F.lit(name).alias("column"), F.lit(10).cast("long").alias("filled"), F.lit(1.0).alias("completeness"),
        *[F.lit(float(v)).alias(k) for k, v in (zero | shares).items()]))
    k = F.col("k")
    heads = F.array(
        head("lat local", numeric=1, latitude=1), head("eventDate", k % 2 == 0, date_share=1), head("quando", k % 3 == 0),
        head("decimalLongitude", k % 5 == 0, numeric=1, longitude=1))
    return rows.select("dataset", F.explode(F.filter(heads, lambda h: h.isNotNull())).alias("h")).select("dataset", "h.*")


@query(
    "headers_catalogue_mapped",
    "WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS dataset, s_nationkey AS k FROM supplier) "
    "SELECT dataset, 'decimalLatitude' AS term, 'lat local' AS \"column\", 'AUTO' AS status, 'known_synonym' AS reason FROM s "
    "UNION ALL SELECT dataset, 'verbatimLatitude', 'lat local', 'SUGGESTED', 'fallback_verbatim_from_primary' FROM s "
    "UNION ALL SELECT dataset, 'eventDate', 'quando', 'TEMPLATE', 'template' FROM s WHERE k % 3 = 0 "
    "UNION ALL SELECT dataset, 'eventDate', 'eventDate', 'AUTO', 'exact_match' FROM s WHERE k % 2 = 0 AND k % 3 <> 0 "
    "UNION ALL SELECT dataset, 'verbatimEventDate', CASE WHEN k % 3 = 0 THEN 'quando' ELSE 'eventDate' END, 'SUGGESTED', 'fallback_verbatim_from_primary' "
    "FROM s WHERE k % 3 = 0 OR k % 2 = 0 "
    "UNION ALL SELECT dataset, 'decimalLongitude', 'decimalLongitude', 'AUTO', 'exact_match' FROM s WHERE k % 5 = 0 "
    "UNION ALL SELECT dataset, 'verbatimLongitude', 'decimalLongitude', 'SUGGESTED', 'fallback_verbatim_from_primary' FROM s WHERE k % 5 = 0",
)
def headers_catalogue_mapped(spark, sf):
    words = local_table(
        spark, {"term": ["decimalLatitude", "locality"], "synonym": ["lat local", "lat local"], "score": [0.97, 0.90]}, {"score": pa.float64()})
    template = spark.createDataFrame([("eventDate", 1, ["quando", "data"])], "term string, priority int, columns array<string>")
    found = A.map_catalogue(_catalogue(spark, sf), words, template=template)
    return found.select("dataset", "term", "column", "status", "reason")
