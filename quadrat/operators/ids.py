"""Occurrence identifiers: kept, generated from content, replaced when repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.fence import fence
from quadrat.functions.identifiers import content_text, persistent_id
from quadrat.functions.text import is_blank, text
from quadrat.operators.numbering import HOT_ROWS, number_within, repeated_flag
from quadrat.session import ensure_checkpoint_dir


#: How many numbers are searched next for each one that is taken or still wanted, and how many one row is expanded to.
GROWTH, SLICE = 8, 10_000


def _minted(groups: DataFrame) -> DataFrame:
    """(__key, __number, occurrenceID) of the numbers above `__from` up to `__upto` of each content.

    The numbers are made slice by slice, so that no task expands a long range alone: a stated number of partitions
    keeps adaptive execution from putting the few rows that expand to many into one."""
    first, last = F.floor(F.col("__from") / SLICE), F.floor((F.col("__upto") - 1) / SLICE)
    slices = groups.filter(F.col("__upto") > F.col("__from")).withColumn("__slice", F.explode(F.sequence(first, last)))
    slices = slices.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__key", "__slice")
    low = F.greatest(F.col("__from"), F.col("__slice") * SLICE) + 1
    high = F.least(F.col("__upto"), (F.col("__slice") + 1) * SLICE)
    numbers = slices.select("__key", "__text", F.explode(F.sequence(low, high)).alias("__number"))
    return numbers.select("__key", "__number", persistent_id(F.col("__text"), F.col("__number")).alias("occurrenceID"))


def _shifts(numbered: DataFrame, taken: DataFrame, hot_rows: int) -> DataFrame:
    """(__key, __islands): for contents with taken numbers, by how much the numbers of their rows move up.

    The r-th free number is r plus the taken numbers below it. With the i-th taken number t, those are the i with
    t - i < r; numbers in a row share t - i, so one entry (t - i, i) for each island of taken numbers tells all.
    Numbers are searched up to a bound until a content has as many free ones as rows. The bound moves up by GROWTH times
    the numbers taken so far or still wanted, so what is searched grows with the taken numbers and not with the rows."""
    groups = numbered.groupBy("__key").agg(F.first("__text").alias("__text"), F.max("__number").alias("__rows"))
    fresh = numbered.select("__key", "__number", persistent_id(F.col("__text"), F.col("__number")).alias("occurrenceID"))
    ensure_checkpoint_dir(numbered.sparkSession)
    found = fresh.join(taken, "occurrenceID", "left_semi").select("__key", "__number").checkpoint()
    counts = found.groupBy("__key").agg(F.count("*").alias("__taken"))
    open_ = groups.join(counts, "__key").withColumn("__upto", F.col("__rows")).checkpoint()
    while not open_.isEmpty():
        wanted = F.col("__rows") - (F.col("__upto") - F.col("__taken"))
        reach = F.col("__upto") + F.greatest("__taken", wanted) * GROWTH
        wider = open_.withColumn("__from", F.col("__upto")).withColumn("__upto", reach)
        more = _minted(wider).join(taken, "occurrenceID", "left_semi").select("__key", "__number").checkpoint()
        found = found.unionByName(more)
        counts = more.groupBy("__key").agg(F.count("*").alias("__more"))
        open_ = wider.join(counts, "__key", "left").withColumn("__taken", F.col("__taken") + F.coalesce("__more", F.lit(0)))
        open_ = open_.filter(F.col("__upto") - F.col("__taken") < F.col("__rows")).drop("__more", "__from").checkpoint()
    ranked = number_within(found, ["__key"], "__i", "__number", hot_rows)
    islands = ranked.groupBy("__key", (F.col("__number") - F.col("__i")).alias("__below")).agg(F.max("__i").alias("__i"))
    return islands.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("__below", "__i"))).alias("__islands"))


def generate_ids(
    df: DataFrame, columns: list[str], reserved: DataFrame | None = None, row_id: str = "row_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(row_id, occurrenceID): name-based UUIDs of the row content and its number among equal rows.

    `reserved` (column `id`) holds identifiers that are taken. The rows of one content get, in order, the numbers
    whose identifiers are free, so a later row never passes an earlier one."""
    content = fence(df.select(row_id, content_text(columns).alias("__text")), ["__text"])
    content = content.withColumn("__key", F.coalesce(F.sha2("__text", 256), F.lit("")))
    numbered = number_within(content, ["__key"], "__number", row_id, hot_rows)
    if reserved is not None:
        ensure_checkpoint_dir(df.sparkSession)
        numbered = numbered.checkpoint()  # read for the groups, the first search and the final numbers
        taken = reserved.select(F.col("id").alias("occurrenceID"))
        passed = F.filter("__islands", lambda x: x["__below"] < F.col("__number"))
        shift = F.coalesce(F.array_max(F.transform(passed, lambda x: x["__i"])), F.lit(0))
        numbered = numbered.join(_shifts(numbered, taken, hot_rows), "__key", "left")
        numbered = numbered.withColumn("__number", F.col("__number") + shift)
    return numbered.select(row_id, persistent_id(F.col("__text"), F.col("__number")).alias("occurrenceID"))


def resolve_ids(
    df: DataFrame, source: str | None = None, row_id: str = "row_id", hot_rows: int = HOT_ROWS,
    content_columns: list[str] | None = None,
) -> DataFrame:
    """Add occurrenceID: the mapped column, else a literal occurrenceID column, else generated.

    `id_origin` tells `supplied` from `generated`; both feed `id_counts`."""
    source = source or ("occurrenceID" if "occurrenceID" in df.columns else None)
    columns = content_columns or [c for c in df.columns if c not in (row_id, source, "occurrenceID")]
    if source is None:
        made = generate_ids(df, columns, None, row_id, hot_rows)
        return df.join(made, row_id).withColumn("id_origin", F.lit("generated"))
    supplied = df.withColumn("__given", F.nullif(text(f"`{source}`"), F.lit("")))
    gaps = df.filter(is_blank(F.col(f"`{source}`")))
    reserved = supplied.filter(F.col("__given").isNotNull()).select(F.col("__given").alias("id")).distinct()
    made = generate_ids(gaps, columns, reserved, row_id, hot_rows).withColumnRenamed("occurrenceID", "__made")
    kept = supplied.filter(F.col("__given").isNotNull()).drop("occurrenceID").withColumnRenamed("__given", "occurrenceID")
    filled = supplied.filter(F.col("__given").isNull()).drop("occurrenceID", "__given").join(made, row_id, "left")
    filled = filled.withColumnRenamed("__made", "occurrenceID")
    # Only rows without an identifier meet the generated ones; the others are not shuffled.
    return kept.withColumn("id_origin", F.lit("supplied")).unionByName(filled.withColumn("id_origin", F.lit("generated")))


def id_counts(resolved: DataFrame) -> DataFrame:
    """One row: total, preserved, generated and the strategy they amount to."""
    counts = resolved.agg(
        F.count("*").alias("total"), F.count_if(F.col("id_origin") == "supplied").alias("preserved")
    )
    return counts.select(
        "total",
        "preserved",
        (F.col("total") - F.col("preserved")).alias("generated"),
        F.when(F.col("preserved") == F.col("total"), "user_supplied")
        .when(F.col("preserved") == 0, "generated")
        .otherwise("user_supplied_with_generated")
        .alias("strategy"),
    )


def id_uniqueness(df: DataFrame, column: str) -> DataFrame:
    """One row: total, filled, blank, duplicates, ok. Distinct values are counted after a
    map-side combine per value."""
    per_value = df.groupBy(text(column).alias("v")).agg(F.count("*").alias("n"))
    filled = F.coalesce(F.sum(F.when(F.col("v") != "", F.col("n"))), F.lit(0))
    distinct = F.count_if(F.col("v") != "")
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_value.agg(
        total.alias("total"), filled.alias("filled"), (total - filled).alias("blank"),
        (filled - distinct).alias("duplicates"), (filled == distinct).alias("ok"),
    )


def replace_repeated_ids(
    df: DataFrame, basis: list[str], copies: DataFrame | None = None, row_id: str = "row_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give every member of a repeated occurrenceID a content-derived one; dropped copies do not count."""
    live = df if copies is None else df.join(copies.select(row_id), row_id, "left_anti")
    flagged = repeated_flag(live.select(row_id, "occurrenceID", *basis), "occurrenceID")
    reserved = flagged.filter(~F.col("repeated")).select(text("occurrenceID").alias("id")).filter("id <> ''")
    made = generate_ids(flagged.filter("repeated"), basis, reserved, row_id, hot_rows).withColumnRenamed(
        "occurrenceID", "__new"
    )
    return (
        df.join(made, row_id, "left")
        .withColumn("occurrenceID", F.coalesce("__new", "occurrenceID"))
        .withColumn("id_replaced", F.col("__new").isNotNull())
        .drop("__new")
    )
