"""Species lists, mapping templates and archives as tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.functions.text import blank_to_null, is_blank, text
from quadrat.operators.numbering import first_per_key, last_per_key

CATEGORY_RANK = {"VU": 1, "EN": 2, "CR": 3, "CR (PEX)": 4}


def threatened_from_markdown(lines: DataFrame) -> DataFrame:
    """(scientificName, category, source) from table lines (line, value): annex headings name the source.

    The heading of a row is the last one above it. Headings are few, so each line joins the heading
    interval it falls in; extinct entries are left out."""
    heads = lines.filter(F.col("value").rlike(r"^\|\s*ANEXO")).select("line", F.regexp_extract("value", r"(ANEXO \d+)", 1).alias("source"))
    heads = heads.filter("source <> ''")
    spans = heads.withColumn("next", F.lead("line").over(Window.orderBy("line")))
    cells = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    rows = lines.filter(F.col("value").rlike(r"^\|\s*\d+\s*\|")).select("line", cells.alias("c"))
    named = rows.select("line", F.element_at("c", -3).alias("scientificName"), F.element_at("c", -2).alias("category"))
    live = named.filter(F.col("category").rlike(r"^(VU|EN|CR)") & ~F.col("category").rlike("^(EX|EW)"))
    inside = (F.col("line") > F.col("h.at")) & (F.col("h.next").isNull() | (F.col("line") < F.col("h.next")))
    marks = F.broadcast(spans.select(F.col("line").alias("at"), "next", "source")).alias("h")
    return live.join(marks, inside).select("scientificName", "category", "source")


def category_rank(category: Column) -> Column:
    ranks = F.create_map(*[x for k, v in CATEGORY_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(ranks, category), F.lit(0))


def most_restrictive(listed: DataFrame, key: str = "match_key") -> DataFrame:
    """One row per taxon: the strictest category, then the first name."""
    order = [(-category_rank(F.col("category"))).alias("rank"), F.col("scientificName")]
    return first_per_key(listed, [key], order)


def invasive_from_tables(listed: DataFrame, details: DataFrame) -> DataFrame:
    """(scientificName, origin_class, introduction_reason, native_range): details by name, canonical name
    as fallback, first row per name."""
    side = details.select(F.col("scientificName").alias("__n"), "canonicalName", "origin", "native_range", "introduction_reason")
    joined = listed.join(side, listed["scientificName"] == F.col("__n"), "left")
    name = F.coalesce(blank_to_null("canonicalName"), F.col("scientificName"))
    origin = F.when(F.lower(text("origin")).contains("transloc"), "translocated_native").otherwise("alien")
    flat = joined.select(name.alias("scientificName"), origin.alias("origin_class"), "introduction_reason", "native_range")
    return first_per_key(flat, ["scientificName"], [F.col("origin_class"), F.col("native_range")])


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Template items of JSON files: (template_id, term, columns, priority, ...)."""
    schema = (
        "template_id string, institution string, use_case string, version string, valid_from string, valid_to string, "
        "items array<struct<term:string,source_columns:array<string>,priority:int>>"
    )
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select("template_id", "institution", "use_case", "version", "valid_from", "valid_to", F.explode("items").alias("i")).select(
        "template_id", "institution", "use_case", "version", "valid_from", "valid_to", F.col("i.term").alias("term"),
        F.filter(F.transform("i.source_columns", lambda c: F.trim(c)), lambda c: c != "").alias("columns"),
        F.coalesce("i.priority", F.lit(100)).alias("priority"),
    )


def template_errors(items: DataFrame) -> DataFrame:
    """(template_id, term, error) of items that cannot be used."""
    error = (
        F.when(is_blank("term"), "blank_term").when(F.size("columns") == 0, "no_columns").when(F.col("priority") < 0, "bad_priority")
        .when(F.col("valid_from") > F.col("valid_to"), "bad_window")
    )
    return items.withColumn("error", error).filter(F.col("error").isNotNull()).select("template_id", "term", "error")


def template_json(items: DataFrame) -> DataFrame:
    """(template_id, json): items back to one document per template (a template holds at most one item per term)."""
    item = F.struct("priority", "term", F.col("columns").alias("source_columns"))
    last = last_per_key(items, ["template_id", "term"], [F.col("priority")])
    grouped = last.groupBy("template_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select("template_id", F.to_json(F.struct("template_id", "items")).alias("json"))


def archive_layout(descriptor: str) -> dict:
    """Layout of the core file from the archive descriptor."""
    root = ET.fromstring(descriptor)

    def local(e: ET.Element) -> str:
        return e.tag.rsplit("}", 1)[-1]

    core = next(e for e in root.iter() if local(e) == "core")
    location = next(e.text for e in core.iter() if local(e) == "location")
    fields = {e.get("term", "").rsplit("/", 1)[-1]: int(e.get("index")) for e in core if local(e) == "field" and e.get("index")}
    ident = next((int(e.get("index")) for e in core if local(e) == "id"), None)
    index = fields.get("occurrenceID", ident)
    if location is None or index is None:
        raise ValueError("the descriptor declares no occurrenceID column")

    def plain(v: str | None) -> str:
        return (v or "").replace("\\t", "\t").replace("\\n", "\n")

    return {
        "location": location.strip(), "index": index, "sep": plain(core.get("fieldsTerminatedBy")) or ",",
        "quote": plain(core.get("fieldsEnclosedBy")), "skip": int(core.get("ignoreHeaderLines") or 0), "encoding": core.get("encoding") or "UTF-8",
    }


def archive_ids(spark: SparkSession, folder: str, descriptor: str) -> DataFrame:
    """(occurrenceID) of an unpacked archive, read the way its descriptor says."""
    layout = archive_layout(descriptor)
    raw = spark.read.csv(
        f"{folder}/{layout['location']}", sep=layout["sep"], quote=layout["quote"] or "\u0000", header=layout["skip"] > 0,
        encoding=layout["encoding"], multiLine=bool(layout["quote"]), escape='"',
    )
    return raw.select(F.trim(F.col(f"`{raw.columns[layout['index']]}`")).alias("occurrenceID"))


def reconcile_ids(sent: DataFrame, published: DataFrame) -> DataFrame:
    """(occurrenceID, state): sent but not published (`missing`), published but not sent (`unexpected`)."""
    ours = sent.filter(~is_blank("occurrenceID")).select("occurrenceID").distinct()
    theirs = published.select("occurrenceID").distinct()
    missing = ours.join(theirs, "occurrenceID", "left_anti").withColumn("state", F.lit("missing"))
    extra = theirs.join(ours, "occurrenceID", "left_anti").withColumn("state", F.lit("unexpected"))
    return missing.unionByName(extra)
