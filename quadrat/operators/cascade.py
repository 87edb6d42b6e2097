"""Name resolution: catalogues, saved match answers, the cascade and its report."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quadrat.functions.names import query_name, taxonomic_status
from quadrat.functions.text import blank_to_null, is_blank, lookup
from quadrat.operators.fuzzy import fuzzy_pairs
from quadrat.operators.numbering import first_per_key, last_per_key
from quadrat.operators.taxa import with_name_parts

STATUS_RANK = {"accepted": 4, "synonym": 3, "ambiguous": 2, "not_found": 1}
FUZZY_SHARE = 0.1
REPORT_COLUMNS = (
    "query_name", "input_name", "scientificName", "suggestedName", "taxonomicStatus", "acceptedNameUsageID",
    "acceptedNameUsage", "taxonID", "taxonRank", "kingdom", "phylum", "class", "order", "family", "genus",
    "specificEpithet", "infraspecificEpithet", "vernacularName", "nameAccordingTo", "validation_status", "match_count",
)


def _text_fields(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


USAGE = _text_fields("key", "canonicalName", "rank", "status", "specificEpithet", "infraspecificEpithet")
ANSWER_SCHEMA = StructType(
    [
        StructField("usage", USAGE), StructField("acceptedUsage", USAGE),
        StructField("classification", ArrayType(_text_fields("rank", "name"))),
        StructField("diagnostics", StructType([
            StructField("matchType", StringType()), StructField("processingFlags", ArrayType(StringType()))])),
        StructField("additionalStatus", ArrayType(_text_fields("datasetAlias", "statusCode"))),
    ]
)


def prepare_names(df: DataFrame, column: str = "scientificName", with_authors: bool = False, keep_qualifiers: bool = False) -> DataFrame:
    """(row_id, input_name, query_name, skip_reason): what each record asks the catalogues."""
    parsed = with_name_parts(df.select("row_id", column), column, "__parts")
    query = blank_to_null(query_name(F.col("__parts"), with_authors, keep_qualifiers))
    staged = parsed.select("row_id", F.col(column).alias("input_name"), query.alias("query_name"))
    skip = F.when(is_blank("input_name"), "blank").when(F.col("query_name").isNull(), "ignored")
    return staged.withColumn("skip_reason", skip)


def pending_names(prepared: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Distinct query names that have no answer yet."""
    names = prepared.filter(F.col("query_name").isNotNull()).select("query_name").distinct()
    return names if resolved is None else names.join(resolved.select("query_name"), "query_name", "left_anti")


def name_budget(length: int) -> int:
    return max(1, math.ceil(FUZZY_SHARE * length))


def _name_budget(length: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(length * FUZZY_SHARE))


def query_catalogue(names: DataFrame, catalogue: DataFrame, provider: str) -> DataFrame:
    """Exact match on the canonical name, else the closest name within a tenth of the letters as a suggestion.

    catalogue: canonicalName, taxonomicStatus, acceptedName, family. Ties prefer a name that is no synonym."""
    synonym = F.coalesce(F.lower("taxonomicStatus").contains("synonym"), F.lit(False))
    listed = first_per_key(
        catalogue.filter(~is_blank("canonicalName")).withColumn("__syn", synonym), ["canonicalName"],
        [F.col("__syn"), F.col("acceptedName")],
    )
    exact = names.join(listed.withColumnRenamed("canonicalName", "query_name"), "query_name").select(
        "query_name", F.col("query_name").alias("scientificName"), F.lit(None).cast("string").alias("suggestedName"),
        F.when(F.col("__syn"), blank_to_null("acceptedName")).alias("acceptedNameUsage"),
        F.lower("taxonomicStatus").alias("taxonomicStatus"), "family", F.lit(provider).alias("provider"),
        F.when(F.col("__syn"), "synonym").otherwise("accepted").alias("validation_status"), F.lit(1).alias("match_count"),
    )
    missed = names.join(exact.select("query_name"), "query_name", "left_anti")
    near = fuzzy_pairs(missed, listed.select("canonicalName"), "query_name", "canonicalName", name_budget, _name_budget)
    ranked = near.join(listed, "canonicalName")
    best = first_per_key(
        ranked.select("query_name", "canonicalName", "distance", "__syn", "taxonomicStatus", "family"), ["query_name"],
        [F.col("distance"), F.col("__syn"), F.col("canonicalName")],
    )
    suggested = best.select(
        "query_name", F.col("query_name").alias("scientificName"), F.col("canonicalName").alias("suggestedName"),
        F.lit(None).cast("string").alias("acceptedNameUsage"), F.lower("taxonomicStatus").alias("taxonomicStatus"), "family",
        F.lit(provider).alias("provider"), F.lit("ambiguous").alias("validation_status"), F.lit(1).alias("match_count"),
    )
    return exact.unionByName(suggested)


def parse_answers(answers: DataFrame) -> DataFrame:
    """Saved match answers (query_name, body JSON) as result rows; fields of unfound names are cleared."""
    parsed = answers.select("query_name", F.from_json("body", ANSWER_SCHEMA).alias("b"))
    kind, status = F.col("b.diagnostics.matchType"), F.col("b.usage.status")
    many = F.coalesce(F.array_contains("b.diagnostics.processingFlags", "MULTIPLE_MATCHES_SAME_CONFIDENCE"), F.lit(False))
    verdict = (
        F.when(kind.isin("EXACT", "VARIANT") & F.col("b.usage").isNotNull(),
               F.when(status.isin("ACCEPTED", "PROVISIONALLY_ACCEPTED"), "accepted")
               .when(status.isin("SYNONYM", "MISAPPLIED"), "synonym").otherwise("ambiguous"))
        .when(many, "ambiguous").otherwise("not_found")
    )
    staged = parsed.withColumn("validation_status", verdict)
    found = F.col("validation_status").isin("accepted", "synonym")

    def rank(name: str) -> Column:
        hits = F.filter("b.classification", lambda e: e["rank"] == name)
        return F.get(hits, F.lit(0))["name"]

    red = F.get(F.filter("b.additionalStatus", lambda e: e["datasetAlias"] == "IUCN"), F.lit(0))["statusCode"]
    fields = {
        "taxonID": F.col("b.usage.key"), "taxonRank": F.lower("b.usage.rank"), "acceptedNameUsageID": F.col("b.acceptedUsage.key"),
        "acceptedNameUsage": F.col("b.acceptedUsage.canonicalName"), "taxonomicStatus": F.replace(F.lower(status), F.lit("_"), F.lit(" ")),
        **{r: rank(r.upper()) for r in ("kingdom", "phylum", "class", "order", "family", "genus")},
        "specificEpithet": F.col("b.usage.specificEpithet"), "infraspecificEpithet": F.col("b.usage.infraspecificEpithet"),
        "iucnRedListCategory": red,
    }
    return staged.select(
        "query_name", F.when(found, F.col("b.usage.canonicalName")).otherwise(F.col("query_name")).alias("scientificName"),
        *[F.when(found, blank_to_null(v)).alias(k) for k, v in fields.items()], F.lit("gbif").alias("provider"),
        "validation_status", F.when(found, 1).alias("match_count"),
    )


def red_list_categories(results: DataFrame) -> DataFrame:
    """(query_name, code): own category, for synonyms without one that of the accepted name."""
    own = results.select("query_name", "validation_status", "acceptedNameUsage", F.col("iucnRedListCategory").alias("code"))
    accepted = own.select(F.col("query_name").alias("acceptedNameUsage"), F.col("code").alias("__accepted"))
    accepted = accepted.groupBy("acceptedNameUsage").agg(F.min("__accepted").alias("__accepted"))
    joined = own.join(accepted, "acceptedNameUsage", "left")
    fallback = F.when(F.col("validation_status") == "synonym", F.col("__accepted"))
    return joined.select("query_name", F.coalesce("code", fallback).alias("code"))


def status_key(status: Column, taxonomic: Column) -> Column:
    own = F.lower(blank_to_null(status))
    key = F.coalesce(own, taxonomic_status(taxonomic))
    return F.when(key == "unresolved", "ambiguous").when(key.isin(*STATUS_RANK), key).otherwise("not_found")


def status_rank(status: Column, taxonomic: Column | None = None) -> Column:
    taxonomic = F.lit(None).cast("string") if taxonomic is None else taxonomic
    return lookup({k: str(v) for k, v in STATUS_RANK.items()}, status_key(status, taxonomic)).cast("int")


def best_results(results: DataFrame) -> DataFrame:
    """Best row per name: highest status, the last answer among equals (`seq`)."""
    taxonomic = F.col("taxonomicStatus") if "taxonomicStatus" in results.columns else None
    return last_per_key(results, ["query_name"], [status_rank(F.col("validation_status"), taxonomic), F.col("seq")])


def resolve_cascade(queries: DataFrame, catalogues: list[tuple[str, DataFrame]], general: DataFrame | None = None) -> DataFrame:
    """Ask the catalogues in turn, then a general answer table; an accepted name is not asked again."""
    pending, parts = queries, []
    for seq, (provider, catalogue) in enumerate(catalogues):
        answer = query_catalogue(pending, catalogue, provider).withColumn("seq", F.lit(seq))
        parts.append(answer)
        done = answer.filter("validation_status = 'accepted'").select("query_name")
        pending = pending.join(done, "query_name", "left_anti")
    if general is not None:
        parts.append(general.join(pending, "query_name", "left_semi").withColumn("seq", F.lit(len(catalogues))))
    return best_results(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def validation_report(prepared: DataFrame, results: DataFrame, failed: list[str] = ()) -> DataFrame:
    """One row per record in the report's column contract; skipped names read invalid or ignored."""
    joined = prepared.join(results.drop("input_name", "skip_reason"), "query_name", "left")
    has = set(joined.columns)
    taxonomic = F.col("taxonomicStatus") if "taxonomicStatus" in has else F.lit(None).cast("string")
    status = F.coalesce(blank_to_null("validation_status"), F.when(~is_blank(taxonomic), taxonomic_status(taxonomic)), F.lit("not_found"))
    status = F.when(F.col("skip_reason") == "blank", "invalid").when(F.col("skip_reason").isNotNull(), "ignored").otherwise(status)
    name = F.coalesce(blank_to_null("scientificName"), blank_to_null("query_name"), F.col("input_name"))
    fixed = {
        "validation_status": status, "scientificName": name, "nameAccordingTo": F.upper(blank_to_null("provider")),
        "match_count": F.coalesce("match_count", F.lit(0)) if "match_count" in has else F.lit(0),
    }
    columns = [
        (fixed[c] if c in fixed else F.col(f"`{c}`") if c in has else F.lit(None).cast("string")).alias(c) for c in REPORT_COLUMNS
    ]
    return joined.select("row_id", *columns)


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy(F.coalesce(F.lower("validation_status"), F.lit("not_found")).alias("status")).agg(F.count("*").alias("n"))


def upsert_status(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Latest status per name; a lower-ranked answer does not replace a better one, every answer moves
    the name to the end of the display (`display_order`)."""
    latest = last_per_key(batch.filter(~is_blank("query_name")), ["query_name"], [F.col("display_order")])
    old = state.select("query_name", F.struct("validation_status", "provider").alias("__old"), F.col("display_order").alias("__at"))
    new = latest.select("query_name", F.struct(F.coalesce(blank_to_null("validation_status"), F.lit("not_found")).alias("validation_status"),
                                               F.coalesce("provider", F.lit("")).alias("provider")).alias("__new"),
                        F.col("display_order").alias("__now"))
    joined = old.join(new, "query_name", "full_outer")
    better = status_rank(F.col("__new.validation_status")) >= status_rank(F.col("__old.validation_status"))
    picked = F.when(F.col("__old").isNull() | F.coalesce(better, F.lit(False)), F.col("__new")).otherwise(F.col("__old"))
    return joined.select("query_name", picked.alias("p"), F.coalesce("__now", "__at").alias("display_order")).select(
        "query_name", "p.validation_status", "p.provider", "display_order")


def latest_window(state: DataFrame, n: int) -> DataFrame:
    return state.orderBy(F.desc("display_order")).limit(n)


def filter_report(report: DataFrame, statuses: list[str], reviewed: DataFrame | None = None) -> DataFrame:
    """Rows of the wanted statuses, reviewed names left out."""
    kept = report.filter(F.col("validation_status").isin(*statuses))
    return kept if reviewed is None else kept.join(reviewed.select("query_name").distinct(), "query_name", "left_anti")
