"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of 13 words (an item of fewer words is one window). A window can only
occur in a document that holds every one of its shingles, so for exact containment one shingle, the rarest in
the corpus, is the whole prefix. Documents meet windows on that shingle alone; a hit must leave room for the
rest of the window on both sides (position and length bounds) and then be equal word by word.

Rarity is counted over all documents. Benchmark tables are broadcast only when their counted size is
under a limit; beyond it Spark shuffles both sides on the shingle, where a hot shingle is split by adaptive
execution and cannot be a prefix unless all shingles of a window are as hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import broadcast_within, lower_ascii, split_words, stored

BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 13
SHINGLE = 3
BROADCAST_ROWS = 200_000


def item_words(text: Column) -> Column:
    return split_words(lower_ascii(text), BREAKS)


#: The hash of an end mark, whose words are all null: the seed itself.
END_HASH = 42


def _shingles(words: str, width: int, end_mark: bool) -> Column:
    """One struct per position, the `width` words that start there, and last the end mark if asked for.

    `words` is the name of a column, so that the split behind it runs once a row."""
    size = F.size(words)
    parts = [F.slice(F.col(words), F.lit(i + 1), size).alias(f"w{i}") for i in range(width)]
    found = F.slice(F.arrays_zip(*parts), F.lit(1), F.greatest(size - (width - 1), F.lit(0)))
    nothing = F.struct(*[F.lit(None).cast("string").alias(f"w{i}") for i in range(width)])
    return F.concat(found, F.array(nothing)) if end_mark else found


def _hashed(rows: DataFrame, keep: list[str], widths: list[int], end_mark: bool = False) -> DataFrame:
    """`keep` plus position `at` and hash `shingle` of every shingle of the wanted widths; `ends` on end marks.

    Each row gets one end mark if asked for, so that rows without any shingle are seen too."""
    out = None
    for i, width in enumerate(widths):
        at = rows.select(*keep, F.posexplode(_shingles("words", width, end_mark and i == 0)).alias("at", "s"))
        names = [F.col("s")[f"w{j}"] for j in range(width)]
        part = at.select(*keep, "at", F.xxhash64(*names).alias("shingle"), names[0].isNull().alias("ends"))
        out = part if out is None else out.unionAll(part)
    return out


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window, n): the windows of every item as text, with their number of words."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("words"))
    size = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(size - window + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.slice(F.col("words"), i, F.lit(window)))
    return (
        words.filter(size > 0)
        .select("item_id", F.explode(cut).alias("words"))
        .select("item_id", F.array_join("words", " ").alias("window"), F.size("words").alias("n"))
        .distinct()
    )


def _prefixes(docs: DataFrame, windows: DataFrame, shingle: int) -> tuple[DataFrame, list[int], int]:
    """Each distinct window with its rarest shingle and that shingle's place in it."""
    texts = windows.select("window", "n").distinct().withColumn("words", F.split("window", " "))
    texts = texts.withColumn("width", F.least(F.lit(shingle), "n"))
    widths = sorted(r[0] for r in texts.select("width").distinct().collect())
    own = None
    for width in widths:
        part = _hashed(texts.filter(F.col("width") == width), ["window", "n"], [width])
        own = part if own is None else own.unionAll(part)
    if own is None:
        return texts, [], 0
    own = stored(own, "benchmark-shingles")
    distinct = own.select("shingle").distinct()
    counts = (
        _hashed(docs, [], widths)
        .join(broadcast_within(distinct, own.count(), BROADCAST_ROWS), "shingle")
        .groupBy("shingle").agg(F.count("*").alias("df"))
    )
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "at")).alias("p")
    prefix = own.join(counts, "shingle", "left").groupBy("window", "n").agg(rarest)
    prefix = stored(prefix.select("window", "n", "p.shingle", F.col("p.at").alias("inside")), "benchmark-prefixes")
    return prefix, widths, prefix.count()


def _met(met: DataFrame) -> DataFrame:
    """Windows that occur at a hit, and the end marks, from documents' shingles joined to prefixes."""
    first = F.col("at") - F.col("inside")
    fits = (first >= 0) & (first + F.col("n") <= F.size("words"))
    equal = F.array_join(F.slice("words", first + 1, F.col("n")), " ") == F.col("window")
    met = met.filter((F.col("ends") & F.col("window").isNull()) | (fits & equal))
    return met.select("doc_id", "row_key", F.size("words").alias("n_words"),
                      F.when(~F.col("ends"), first).alias("start"), "n", "window")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated), a row per document.

    `row_key` tells rows with one doc_id and different texts apart; equal rows get equal answers. Null or
    wordless texts have no words and are clean, an empty benchmark leaves all clean. Items with one text
    all count; a null item_id hits words but is not listed. Other columns of either table are not read."""
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("row_key"), item_words(F.col("text")).alias("words"),
    )
    windows = stored(item_windows(benchmark, window), "benchmark-windows")
    prefix, widths, size = _prefixes(rows, windows, shingle)
    keep = ["doc_id", "row_key", "words"]
    if widths:
        columns = prefix.select("window", "n", "shingle", "inside")
        mark = docs.sparkSession.range(1).select(
            F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(END_HASH).cast("bigint"), F.lit(0))
        small = broadcast_within(columns.unionAll(mark), size + 1, BROADCAST_ROWS)
        every = None
        for i, width in enumerate(widths):  # one width at a time: above a union Spark would copy whole texts
            part = _met(_hashed(rows, keep, [width], end_mark=i == 0).join(small, "shingle"))
            every = part if every is None else every.unionAll(part)
    else:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("n", "int"), ("window", "string"))]
        every = rows.select("doc_id", "row_key", F.size("words").alias("n_words"), *nothing)
    found = stored(every, "benchmark-hits")
    key = ["doc_id", "row_key"]
    spans = F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "n"))))
    end = lambda s: s["start"] + s["n"]
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("hit")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], end(s)).alias("upto"),
            (a["hit"] + F.greatest(F.lit(0), end(s) - F.greatest(a["upto"], s["start"]))).alias("hit"),
        ),
    )["hit"]
    per_doc = found.groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("start").isNull()).alias("copies"), spans.alias("spans"),
    )
    items = (
        found.filter(F.col("start").isNotNull()).select(*key, "window").distinct()
        .join(windows.select("window", "item_id"), "window")
        .groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    items = items.select(F.col("doc_id").alias("i_doc"), F.col("row_key").alias("i_key"), "items")
    per_doc = per_doc.select(*key, "n_words", covered.alias("n_hit"), "copies")
    same = per_doc["doc_id"].eqNullSafe(items["i_doc"]) & (per_doc["row_key"] == items["i_key"])
    listed = F.coalesce("items", F.array().cast("array<string>"))
    out = per_doc.join(items, same, "left").select(
        *key, F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns as they are, whatever their names."""
    bad = contamination(docs, benchmark, window).filter("contaminated").select(
        F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_key")).distinct()
    bad = stored(bad, "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    same = rows["own_id"].eqNullSafe(bad["bad_id"]) & (rows["own_key"] == bad["bad_key"])
    return rows.join(broadcast_within(bad, bad.count(), BROADCAST_ROWS), same, "left_anti").select("row.*")
