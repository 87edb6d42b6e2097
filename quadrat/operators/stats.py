"""Column statistics, dataset extents, readiness and map samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions import coords as C
from quadrat.functions import dates as D
from quadrat.functions import numbers as M
from quadrat.functions.fence import fence
from quadrat.functions.text import any_of, is_blank, text
from quadrat.lookups import PUBLICATION_TERMS, local_table
from quadrat.operators import quality as P
from quadrat.operators import vocabularies as V
from quadrat.operators.numbering import HOT_ROWS, number_within

GOLDEN = 0.6180339887
MAP_LIMIT = 20000
NAME_PATTERN = r"^[A-Z][A-Za-z-]+(\s+([a-z][A-Za-z-]+|sp\.?|cf\.?\s+[a-z][A-Za-z-]+))?$"


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, completeness, numeric, latitude, longitude, name, count, status, basis): value shares.

    All columns and all rows in one aggregate over cells; nothing is sampled. One set of expressions reads the cells of
    all columns: as many expressions as columns make code too long to compile. A cell's number is worked out once."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), text(F.col(f"`{c}`")).alias("v")) for i, c in enumerate(columns)])
    filled = df.select(F.inline(cells)).withColumn("num", F.when(F.col("v") != "", M.number(F.replace("v", F.lit(","), F.lit(".")))))
    v, num = F.col("v"), F.col("num")
    hits = {
        "numeric": num.isNotNull(), "latitude": F.abs(num) <= 90, "longitude": F.abs(num) <= 180, "name": v.rlike(NAME_PATTERN),
        "count": (num >= 0) & (F.abs(num - F.round(num)) < 1e-9), "status": V.occurrence_status(v).isin("present", "absent"),
        "basis": V.basis_of_record(v) != "",
    }
    staged = fence(filled, ["num"]).select("i", (v != "").alias("f"), *[((v != "") & h).alias(n) for n, h in hits.items()])
    counted = staged.groupBy("i").agg(F.count("*").alias("rows"), F.count_if("f").alias("filled"), *[F.count_if(n).alias(n) for n in hits])
    share = lambda n, of: F.coalesce(F.col(n) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0)).alias(n)
    names = local_table(df.sparkSession, {"n": list(range(len(columns))), "column": columns}, {"n": pa.int32()})
    every = names.join(counted, F.col("n") == F.col("i"), "left")
    filled = F.coalesce("filled", F.lit(0))
    return every.select(
        "column", filled.alias("filled"), F.coalesce(filled / F.nullif("rows", F.lit(0)), F.lit(0.0)).alias("completeness"),
        *[share(n, "filled") for n in hits],
    )


#: Values a column is judged by, by how well its name fits. Fixed values.
SAMPLE_TIERS = ((0.90, 1000), (0.75, 500), (0.0, 200))


def sample_values(df: DataFrame, scores: DataFrame, row_id: str = "row_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(column, row_id, value): an even sample of the filled values of each column in `scores` (column, name_score).

    A column with no more filled values than its tier allows keeps all of them. Of more, the sample takes those at even
    distances, first and last among them, in the order of the rows: which cells are taken depends on the
    data alone. Columns are numbered slice by slice, so none is sorted in one task."""
    names = [c for c in df.columns if c != row_id]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text(F.col(f"`{c}`")).alias("value")) for c in names])
    filled = df.select(row_id, F.explode(cells).alias("c")).select(row_id, "c.column", "c.value").filter("value <> ''")
    wanted = F.lit(SAMPLE_TIERS[-1][1])
    for least, n in reversed(SAMPLE_TIERS[:-1]):
        wanted = F.when(F.col("name_score") >= least, n).otherwise(wanted)
    sizes = filled.groupBy("column").agg(F.count("*").alias("n")).join(scores.select("column", wanted.alias("t")), "column")
    numbered = number_within(filled, ["column"], "i", row_id, hot_rows).join(F.broadcast(sizes), "column")
    step = (F.col("n") - 1) / (F.col("t") - 1)
    near = F.floor((F.col("i") - 1) / step)
    even = any_of([F.rint(1 + (near + k) * step) == F.col("i") for k in (-1, 0, 1, 2)])
    return numbered.filter((F.col("n") <= F.col("t")) | even).select("column", row_id, "value")


def dataset_extents(df: DataFrame, today: str) -> DataFrame:
    """One row: box of usable points, first and last day of the dates that are not in the future."""
    lat, lon = C.coord_number("decimalLatitude"), C.coord_number("decimalLongitude")
    ok = C.usable_point(lat, lon)
    staged = df.select(
        F.when(ok, lat).alias("y"), F.when(ok, lon).alias("x"), D.iso_bound("eventDate", False).alias("a"), D.iso_bound("eventDate", True).alias("b"),
    )
    limit = F.lit(today).cast("date")
    past = F.col("a") <= limit
    return staged.agg(
        F.min("y").alias("south"), F.max("y").alias("north"), F.min("x").alias("west"), F.max("x").alias("east"),
        F.min(F.when(past, F.col("a"))).alias("first_day"), F.max(F.when(past, F.least("b", limit))).alias("last_day"),
    )


def most_common(df: DataFrame, column: str, out: str) -> DataFrame:
    """One row: the most frequent filled value; a tie goes to the first in order."""
    counted = df.filter(~is_blank(column)).groupBy(text(column).alias("v")).agg(F.count("*").alias("n"))
    return counted.agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("v"))).alias(out))


def readiness(df: DataFrame) -> DataFrame:
    """One row: share of required terms that hold something, missing terms, blank required cells, blocked or not."""
    def col(t: str) -> Column:
        return F.col(t) if t in df.columns else F.lit(None).cast("string")

    present = [F.coalesce(F.bool_or(~is_blank(col(t))), F.lit(False)).alias(t) for t in PUBLICATION_TERMS]
    row = df.agg(
        *present, F.coalesce(F.bool_or(~is_blank(col("occurrenceID"))), F.lit(False)).alias("has_id"),
        F.count_if(is_blank(col("basisOfRecord"))).alias("basis_blank"), F.count_if(is_blank(col("scientificName"))).alias("name_blank"),
    )
    flags = [F.struct(F.lit(t).alias("t"), F.col(t).alias("p")) for t in PUBLICATION_TERMS]
    missing = F.transform(F.filter(F.array(*flags), lambda f: ~f["p"]), lambda f: f["t"])
    pct = F.round((len(PUBLICATION_TERMS) - F.size(missing)) * 100 / len(PUBLICATION_TERMS)).cast("int")
    return row.select(
        pct.alias("readiness_pct"), missing.alias("missing"), F.col("has_id").alias("occurrence_id_present"), "basis_blank", "name_blank",
        ((F.size(missing) > 0) | (F.col("basis_blank") > 0) | (F.col("name_blank") > 0)).alias("blocked"),
    )


def export_summary(df: DataFrame, log: DataFrame, plan_counts: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """One row for the export page: records, terms, changes by kind, moved points, formula cells, readiness."""
    live = df if dropped is None else df.join(dropped.select("row_id"), "row_id", "left_anti")
    kinds = {k: log.filter(F.col("kind") == k).agg(F.count("*").alias("n")).scalar() for k in ("names", "coordinates", "country", "preview")}
    formulas = P.formula_cells(live).agg(F.count("*").alias("n")).scalar()
    ready = readiness(live)
    out = ready.withColumns(
        {
            "records": live.agg(F.count("*").alias("n")).scalar(), "terms": F.lit(len([c for c in df.columns if c != "row_id"])),
            **{f"changed_{k}": v for k, v in kinds.items()}, "formula_cells": formulas,
            "n_masked": plan_counts.select("n_masked").scalar(), "n_withheld": plan_counts.select("n_withheld").scalar(),
        }
    )
    return out.withColumn("blocked", F.col("blocked") | (F.col("formula_cells") > 0)).drop("missing")


# ---- maps --------------------------------------------------------------------------------------


def map_markers(points: DataFrame) -> DataFrame:
    """One marker per place and colour: its first record and how many it stands for."""
    shown = points.filter(C.plottable(F.col("lat"), F.col("lon")))
    return shown.groupBy("lat", "lon", "color").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))


def map_sample(markers: DataFrame, ok_color: str, limit: int = MAP_LIMIT, bounds: dict[str, float] | None = None) -> DataFrame:
    """All problem markers and an even spread of ok ones: golden-ratio order of the record number."""
    ok = F.upper("color") == ok_color.upper()
    fine = markers.filter(ok)
    if bounds:
        pad_y, pad_x = (bounds["north"] - bounds["south"]) / 4, (bounds["east"] - bounds["west"]) / 4
        fine = fine.filter(
            F.col("lat").between(bounds["south"] - pad_y, bounds["north"] + pad_y)
            & F.col("lon").between(bounds["west"] - pad_x, bounds["east"] + pad_x)
        )
    spread = F.col("row_id").cast("double") * GOLDEN
    picked = fine.orderBy(spread - F.floor(spread), "row_id").limit(limit)
    return markers.filter(~ok).unionByName(picked)


#: Degrees in one bar of the histogram that narrows an order statistic down: 54,002 bars for both axes at most.
BAR = 0.01


def map_view(points: DataFrame, trim: float = 0.0) -> DataFrame:
    """One row: frame of the points with a share of them trimmed at each edge, by exact order statistics.

    One job counts both axes by bars and finds the bars of the four edges; the result then counts the values inside
    those bars alone."""
    shown = points.filter(C.plottable(F.col("lat"), F.col("lon"))).select(
        F.greatest(F.least("lat", F.lit(85.0)), F.lit(-85.0)).alias("lat"), F.col("lon").alias("lng"))
    edges = _edge_bars(shown, trim) if trim > 0 else []
    if not edges:
        box = shown.agg(*[f(a).alias(f"{a}{k}") for a in ("lat", "lng") for k, f in ((1, F.min), (2, F.max))])
    else:
        targets = points.sparkSession.createDataFrame(edges, "edge string, axis string, bar long, nth long")
        inside = _by_axis(shown).join(F.broadcast(targets), ["axis", "bar"]).groupBy("edge", "nth", "v").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("edge").orderBy("v"))
        met = inside.withColumn("upto", upto).filter(F.col("upto") >= F.col("nth"))
        names = [e[0] for e in edges]
        box = met.agg(*[F.min(F.when(F.col("edge") == e, F.col("v"))).alias(e) for e in names])
    point = (F.col("lat1") == F.col("lat2")) & (F.col("lng1") == F.col("lng2"))
    return box.withColumn("type", F.when(point, "point").otherwise("bounds"))


def _by_axis(shown: DataFrame) -> DataFrame:
    both = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in ("lat", "lng")])
    return shown.select(F.explode(both).alias("x")).select("x.*", F.floor(F.col("x.v") / BAR).alias("bar"))


def _edge_bars(shown: DataFrame, trim: float) -> list[tuple[str, str, int, int]]:
    """(edge, axis, bar, nth value inside the bar) of the four edges; none for fewer than 20 points."""
    bars: dict[str, list[tuple[int, int]]] = {"lat": [], "lng": []}
    for row in _by_axis(shown).groupBy("axis", "bar").agg(F.count("*").alias("n")).collect():
        bars[row["axis"]].append((row["bar"], row["n"]))
    total = sum(n for _, n in bars["lat"])
    if total < 20:
        return []
    cut, edges = max(1, int(total * trim)), []
    for axis, counts in bars.items():
        for side, rank in ((1, cut + 1), (2, total - cut)):
            left = rank
            for bar, n in sorted(counts):
                if left <= n:
                    edges.append((f"{axis}{side}", axis, bar, left))
                    break
                left -= n
    return edges
