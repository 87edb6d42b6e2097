"""Group numbering, duplicates and rank picks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
#: Slice numbers whose rows one task sums.
SLICE_RUN = 1_000


def _rows_before(slices: DataFrame) -> DataFrame:
    """(__group, __slice, __offset) of (__group, __slice, __rows): a group's rows in the slices before, where there are any.

    Summed inside runs of SLICE_RUN slice numbers and then over the runs, so no task sums all slices of a group."""
    runs = slices.withColumn("__run", F.floor(F.col("__slice") / SLICE_RUN))
    within = Window.partitionBy("__group", "__run").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("__group").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy("__group", "__run").agg(F.sum("__rows").alias("__rows"))
    totals = totals.select("__group", "__run", F.sum("__rows").over(over).alias("__before")).filter("__before > 0")
    summed = runs.withColumn("__inside", F.sum("__rows").over(within)).join(totals, ["__group", "__run"], "left")
    offset = F.coalesce("__inside", F.lit(0)) + F.coalesce("__before", F.lit(0))
    return summed.select("__group", "__slice", offset.alias("__offset")).filter("__offset > 0")


def number_within(
    df: DataFrame, keys: list[str], out: str = "number", order: str = "row_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """`row_number` inside groups of `keys` (null keys are a group) by the integer column `order`.

    Every group is cut into slices of `hot_rows` consecutive order values, numbered slice by slice, and
    shifted by the rows of the slices before. A slice holds at most `hot_rows` rows because `order` is
    unique. Rows are dealt by group and slice, never by the group alone, so no task gets a whole hot group."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    group = F.struct(*[F.col(f"`{k}`") for k in keys])  # nulls inside a struct are equal, so they join
    marked = df.select(group.alias("__group"), F.floor(F.col(order) / F.lit(hot_rows)).alias("__slice"), *rest)
    marked = marked.repartition("__group", "__slice")
    numbered = marked.withColumn("__local", F.row_number().over(Window.partitionBy("__group", "__slice").orderBy(order)))
    slices = marked.groupBy("__group", "__slice").agg(F.count("*").alias("__rows"))
    number = (F.col("__local") + F.coalesce("__offset", F.lit(0))).cast("long")
    return numbered.join(_rows_before(slices), ["__group", "__slice"], "left").select("__group.*", *rest, number.alias(out))


def with_group_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Attach per-group aggregates. The aggregate combines map-side and comes back by a join whose
    other side has one row per key, which adaptive execution splits when a key is hot."""
    totals = df.groupBy(*keys).agg(*[v.alias(k) for k, v in stats.items()])
    return df.join(totals, keys, "left")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key as an aggregate (`min_by`), which combines map-side and never
    collects a group."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__row")
    )
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__row")
    )
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def content_hash(columns: list[str]) -> Column:
    """Row digest in which NULL, '' and shifted cells all differ."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0001")) for c in columns]
    return F.coalesce(F.sha2(F.concat_ws("\u001f", *cells), 256), F.lit(""))


def exact_copies(df: DataFrame, columns: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """Rows whose cells all equal an earlier row's: (row_id, of). All-blank rows do not count."""
    from quadrat.functions.text import any_of, is_blank

    columns = columns or [c for c in df.columns if c != row_id]
    filled = any_of([~is_blank(F.col(f"`{c}`")) for c in columns])
    keyed = df.filter(filled).select(F.col(row_id), content_hash(columns).alias("__content"))
    firsts = (
        keyed.groupBy("__content")
        .agg(F.min(row_id).alias("of"), F.count("*").alias("__n"))
        .filter("__n > 1")
        .drop("__n")
    )
    return keyed.join(firsts, "__content").filter(F.col(row_id) > F.col("of")).select(row_id, "of")


def repeated_flag(df: DataFrame, column: str, out: str = "repeated") -> DataFrame:
    """TRUE on every row whose filled value occurs more than once."""
    from quadrat.functions.text import text

    keyed = df.withColumn("__key", text(column))
    repeats = (
        keyed.filter("__key <> ''").groupBy("__key").agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    )
    flagged = repeats.withColumn("__hit", F.lit(True))
    return (
        keyed.join(flagged, "__key", "left")
        .withColumn(out, F.coalesce(F.col("__hit"), F.lit(False)))
        .drop("__key", "__hit")
    )


def drop_copy_id_problems(problems: DataFrame, copies: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Drop id_duplicate problems of an id that only exact copies of one record carry."""
    ids = problems.filter("type = 'id_duplicate'")
    rooted = ids.join(copies, row_id, "left").withColumn("__root", F.coalesce("of", row_id))
    lone = (
        rooted.groupBy("value")
        .agg(F.min("__root").alias("__lo"), F.max("__root").alias("__hi"))
        .filter("__lo = __hi")
        .select("value", F.lit("id_duplicate").alias("type"))
    )
    return problems.join(lone, ["type", "value"], "left_anti").select(*problems.columns)
