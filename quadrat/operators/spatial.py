"""Points against polygons and places.

A polygon layer becomes a cell index: one row per grid cell with, for each polygon near the cell,
whether the cell's anchor is inside and the edges that cross the cell. A point meets its cell in an
equi-join and its parity is the anchor's parity flipped by the edges between anchor and point. No
pair of point and polygon edge is ever shuffled, and the point table is never grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.coords import distance_m

# The anchor sits off the round numbers that polygon corners like to use.
ANCHOR_X, ANCHOR_Y = 0.50001234567, 0.50004321098
METRES_PER_DEGREE = 111319.5


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """(poly, iso3, admin, x1, y1, x2, y2) from ring vertices (poly, iso3, admin, ring, seq, lon, lat).

    Rings may be open or closed; each ring is a bounded reference shape."""
    ring = Window.partitionBy("poly", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    linked = vertices.withColumns(
        {
            "x2": F.coalesce(F.lead("lon").over(ring), F.first("lon").over(whole)),
            "y2": F.coalesce(F.lead("lat").over(ring), F.first("lat").over(whole)),
        }
    )
    edges = linked.select("poly", "iso3", "admin", F.col("lon").alias("x1"), F.col("lat").alias("y1"), "x2", "y2")
    return edges.filter("x1 <> x2 OR y1 <> y2")


def cell_index(edges: DataFrame, cell: float = 1.0, pad: float = 0.0) -> DataFrame:
    """(cx, cy, polys) with polys: array of (iso3, admin, poly, anchored, edges).

    `pad` also lists edges that come within that many degrees of a cell, for distance tests."""
    def at(value: Column) -> Column:
        return F.floor(value / cell).cast("int")

    low_x, high_x = F.least("x1", "x2") - pad, F.greatest("x1", "x2") + pad
    low_y, high_y = F.least("y1", "y2") - pad, F.greatest("y1", "y2") + pad
    near = (
        edges.withColumn("cx", F.explode(F.sequence(at(low_x), at(high_x))))
        .withColumn("cy", F.explode(F.sequence(at(low_y), at(high_y))))
        .groupBy("poly", "iso3", "admin", "cx", "cy")
        .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    )
    anchor_y = (F.col("cy") + ANCHOR_Y) * cell
    crossing = (
        edges.withColumn("cy", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))))
        .filter((F.col("y1") > anchor_y) != (F.col("y2") > anchor_y))
        .withColumn("x", F.col("x1") + (anchor_y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
        .groupBy("poly", "iso3", "admin", "cy")
        .agg(F.sort_array(F.collect_list("x")).alias("xs"))
    )
    anchor_x = (F.col("cx") + ANCHOR_X) * cell
    inside = (
        crossing.withColumn("cx", F.explode(F.sequence(at(F.col("xs")[0]), at(F.element_at("xs", -1)))))
        .withColumn("ax", anchor_x)
        .withColumn("anchored", F.size(F.filter("xs", lambda x: x > F.col("ax"))) % 2 == 1)
        .filter("anchored")
        .select("poly", "iso3", "admin", "cx", "cy", "anchored")
    )
    cells = near.join(inside, ["poly", "iso3", "admin", "cx", "cy"], "full_outer").select(
        "cx", "cy",
        F.struct(
            "iso3", "admin", "poly", F.coalesce("anchored", F.lit(False)).alias("anchored"),
            F.coalesce("edges", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")).alias("edges"),
        ).alias("p"),
    )
    indexed = cells.groupBy("cx", "cy").agg(F.array_sort(F.collect_list("p")).alias("polys"))
    return indexed.withColumn("cell", F.lit(cell))


def _cell_size(index: DataFrame) -> float:
    row = index.select("cell").head(1)
    return row[0][0] if row else 1.0


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Is P left of the line A to B."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax) > 0


def _inside(poly: Column, x: Column, y: Column, ax: Column, ay: Column) -> Column:
    def crosses(e: Column) -> Column:
        over = _side(ax, ay, x, y, e["x1"], e["y1"]) != _side(ax, ay, x, y, e["x2"], e["y2"])
        apart = _side(e["x1"], e["y1"], e["x2"], e["y2"], ax, ay) != _side(e["x1"], e["y1"], e["x2"], e["y2"], x, y)
        return over & apart

    odd = F.size(F.filter(poly["edges"], crosses)) % 2 == 1
    return poly["anchored"] != odd


def _edge_distance_m(e: Column, x: Column, y: Column) -> Column:
    """Distance from a point to an edge on a local plane."""
    scale = F.cos(F.radians(y))
    ux, uy = (e["x2"] - e["x1"]) * scale, e["y2"] - e["y1"]
    px, py = (x - e["x1"]) * scale, y - e["y1"]
    length = ux * ux + uy * uy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * ux + py * uy) / F.when(length == 0, 1.0).otherwise(length)))
    return F.sqrt(F.pow(px - t * ux, 2) + F.pow(py - t * uy, 2)) * METRES_PER_DEGREE


def _within(poly: Column, x: Column, y: Column, ax: Column, ay: Column, metres: float) -> Column:
    inside = _inside(poly, x, y, ax, ay)
    if metres <= 0:
        return inside
    return inside | F.exists(poly["edges"], lambda e: _edge_distance_m(e, x, y) <= metres)


def join_cells(points: DataFrame, index: DataFrame, lon: str, lat: str, cell: float | None = None) -> DataFrame:
    """Attach `__polys`, `__ax`, `__ay` to every point, NULL polys where no polygon comes near."""
    size = cell or _cell_size(index)
    cx, cy = F.floor(F.col(lon) / size).cast("int"), F.floor(F.col(lat) / size).cast("int")
    side = index.select(F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), F.col("polys").alias("__polys"))
    keyed = points.withColumn("__kx", cx).withColumn("__ky", cy)
    joined = keyed.join(side, (F.col("__kx") == F.col("__cx")) & (F.col("__ky") == F.col("__cy")), "left")
    return joined.withColumns(
        {"__ax": (F.col("__kx") + ANCHOR_X) * size, "__ay": (F.col("__ky") + ANCHOR_Y) * size}
    ).drop("__cx", "__cy", "__kx", "__ky")


def locate(points: DataFrame, index: DataFrame, lon: str = "lon", lat: str = "lat", out: str = "place", cell: float | None = None) -> DataFrame:
    """Add `out`: struct(iso3, admin) of the first polygon (by code) that holds the point, else NULL."""
    joined = join_cells(points, index, lon, lat, cell)
    x, y = F.col(lon), F.col(lat)
    hits = F.filter("__polys", lambda p: _inside(p, x, y, F.col("__ax"), F.col("__ay")))
    first = F.get(hits, F.lit(0))
    place = F.when(first.isNotNull(), F.struct(first["iso3"].alias("iso3"), first["admin"].alias("admin")))
    return joined.withColumn(out, place).drop("__polys", "__ax", "__ay")


def in_country(points: DataFrame, index: DataFrame, iso3: str, lon: str, lat: str, out: str = "inside", metres: float = 0.0, cell: float | None = None) -> DataFrame:
    """Add `out`: the point lies in (or within `metres` of) the polygon of the given country."""
    joined = join_cells(points, index, lon, lat, cell)
    x, y = F.col(lon), F.col(lat)
    hit = F.exists(
        "__polys",
        lambda p: (p["iso3"] == F.col(iso3)) & _within(p, x, y, F.col("__ax"), F.col("__ay"), metres),
    )
    return joined.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__polys", "__ax", "__ay")


def near_land(points: DataFrame, index: DataFrame, lon: str, lat: str, metres: float, out: str = "on_land", cell: float | None = None) -> DataFrame:
    """Add `out`: on land, or so close to it that a 16-point ring around the point (8 at the full and
    8 at half the tolerance) touches land. Only distinct points at sea get a ring.

    Their answers grow with the points, while the planner, which knows compressed file sizes only, takes them for small:
    they are joined by sorting, never sent through the driver."""
    size = cell or _cell_size(index)
    first = locate(points, index, lon, lat, "__here", size)
    if metres <= 0:
        return first.withColumn(out, F.col("__here").isNotNull()).drop("__here")
    angle = F.radians(F.col("__k") * 45.0)
    reach = F.col("__r") * metres / METRES_PER_DEGREE
    y = F.col(lat) + F.sin(angle) * reach
    x = F.col(lon) + F.cos(angle) * reach / F.greatest(F.cos(F.radians(F.col(lat))), F.lit(1e-6))
    sea = first.filter(F.col("__here").isNull() & F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(lon, lat).distinct()
    ring = (
        sea.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(7))))
        .withColumn("__r", F.explode(F.array(F.lit(0.5), F.lit(1.0))))
        .select(lon, lat, x.alias("__x"), y.alias("__y"))
    )
    touched = (
        locate(ring, index, "__x", "__y", "__ring", size)
        .groupBy(lon, lat)
        .agg(F.bool_or(F.col("__ring").isNotNull()).alias("__touch"))
    )
    return (
        first.join(touched.hint("merge"), [lon, lat], "left")
        .withColumn(out, F.col("__here").isNotNull() | F.coalesce("__touch", F.lit(False)))
        .drop("__here", "__touch")
    )


def _column_of(lon: Column, cell: float) -> Column:
    """The cell column of a longitude; columns go round the globe, so 180 and -180 share one."""
    return F.pmod(F.floor(lon / cell) + F.lit(round(180 / cell)), F.lit(round(360 / cell))).cast("int")


def place_index(places: DataFrame, cell: float = 1.0) -> DataFrame:
    """(cx, cy, near) for reference places (lat, lon, radius_m), listed in every cell their circle touches.

    `cell` divides 360; circles may cross the 180th meridian."""
    reach_y = F.col("radius_m") / METRES_PER_DEGREE
    reach_x = reach_y / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + reach_y, F.lit(89.0)))), F.lit(0.01))

    def at(v: Column) -> Column:
        return F.floor(v / cell).cast("int")

    return (
        places.withColumn("cx", F.explode(F.array_distinct(F.transform(
            F.sequence(at(F.col("lon") - F.least(reach_x, F.lit(180.0))), at(F.col("lon") + F.least(reach_x, F.lit(180.0)))),
            lambda x: _column_of(x * cell, cell)))))
        .withColumn("cy", F.explode(F.sequence(at(F.col("lat") - reach_y), at(F.col("lat") + reach_y))))
        .groupBy("cx", "cy")
        .agg(F.collect_list(F.struct("lon", "lat", "radius_m")).alias("near"))
    )


def near_place(points: DataFrame, index: DataFrame, lon: str, lat: str, out: str = "near_place", cell: float = 1.0) -> DataFrame:
    """Add `out`: within the radius of some reference place."""
    side = index.select(F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), "near")
    keyed = points.withColumn("__kx", _column_of(F.col(lon), cell)).withColumn(
        "__ky", F.floor(F.col(lat) / cell).cast("int")
    )
    joined = keyed.join(side, (F.col("__kx") == F.col("__cx")) & (F.col("__ky") == F.col("__cy")), "left")
    hit = F.exists("near", lambda p: distance_m(F.col(lon), F.col(lat), p["lon"], p["lat"]) <= p["radius_m"])
    return joined.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__kx", "__ky", "__cx", "__cy", "near")


# Repairs of swapped axes and lost signs, in the order they are tried.
TRANSFORMS = (
    ("swap", "lon", "lat", 1, 1), ("neg_lon", "lat", "lon", 1, -1), ("neg_lat", "lat", "lon", -1, 1),
    ("neg_both", "lat", "lon", -1, -1), ("swap_neg_lon", "lon", "lat", 1, -1),
    ("swap_neg_lat", "lon", "lat", -1, 1), ("swap_neg_both", "lon", "lat", -1, -1),
)
BORDER_BUFFER_DEG = 0.2


def repair_transposed(
    df: DataFrame, index: DataFrame, lat: str = "lat", lon: str = "lon", iso3: str = "iso3", row_id: str = "row_id",
    buffer_deg: float = BORDER_BUFFER_DEG, cell: float | None = None,
) -> DataFrame:
    """Points outside their stated country: the first repair that lands inside wins.

    Returns one row per such point: (row_id, lat_new, lon_new, transform), NULL transform when none
    helps. Countries missing from the layer are left alone. `index` must be padded by the buffer."""
    metres = buffer_deg * METRES_PER_DEGREE
    known = index.select(F.explode("polys.iso3").alias("__iso")).distinct()
    base = df.filter(
        F.col(iso3).isNotNull() & (F.abs(lat) <= 180) & (F.abs(lon) <= 180)
    ).join(known, F.col(iso3) == F.col("__iso"), "left_semi").select(row_id, lat, lon, iso3)
    outside = in_country(base, index, iso3, lon, lat, "__in", metres, cell).filter(~F.col("__in")).drop("__in")
    tries = F.array(
        *[
            F.struct(
                F.lit(i).alias("priority"), F.lit(key).alias("transform"),
                (F.col(lat if a == "lat" else lon) * sa).alias("lat_new"),
                (F.col(lat if b == "lat" else lon) * sb).alias("lon_new"),
            )
            for i, (key, a, b, sa, sb) in enumerate(TRANSFORMS)
        ]
    )
    tried = outside.withColumn("__t", F.explode(tries)).select(
        row_id, iso3, "__t.priority", "__t.transform", "__t.lat_new", "__t.lon_new"
    )
    usable = tried.filter((F.abs("lat_new") <= 90) & (F.abs("lon_new") <= 180))
    good = in_country(usable, index, iso3, "lon_new", "lat_new", "__in", metres, cell).filter("__in")
    best = good.groupBy(row_id).agg(
        F.min_by(F.struct("lat_new", "lon_new", "transform"), "priority").alias("b")
    ).select(row_id, "b.*")
    return outside.select(row_id).join(best, row_id, "left")


def country_case(df: DataFrame, column: str) -> DataFrame:
    """One row: are all country texts upper, or all lower case."""
    v = F.when(F.col(column).rlike("[A-Za-z]"), F.col(column))
    return df.agg(
        F.coalesce(F.bool_and(v == F.upper(v)), F.lit(False)).alias("upper"),
        F.coalesce(F.bool_and(v == F.lower(v)), F.lit(False)).alias("lower"),
    )


def _cased(df: DataFrame, column: str, name: Column) -> Column:
    votes = country_case(df, column)
    return F.when(votes.select("upper").scalar(), F.upper(name)).when(
        votes.select("lower").scalar(), F.lower(name)
    ).otherwise(name)


def fill_country(df: DataFrame, index: DataFrame, lat: str, lon: str, country: str = "country", row_id: str = "row_id", cell: float | None = None) -> DataFrame:
    """(row_id, country) for blank countries whose point falls in a polygon; casing follows the column."""
    from quadrat.functions.text import is_blank

    blank = df.filter(is_blank(country) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)).select(row_id, lat, lon)
    found = locate(blank, index, lon, lat, "__place", cell).filter(F.col("__place").isNotNull())
    return found.select(row_id, _cased(df, country, F.col("__place.admin")).alias("country"))


def swap_and_fill(df: DataFrame, index: DataFrame, lat: str, lon: str, country: str = "country", row_id: str = "row_id", cell: float | None = None) -> DataFrame:
    """(row_id, lat_new, lon_new, country): blank country, point at sea, swapped point on land."""
    from quadrat.functions.text import is_blank

    blank = df.filter(is_blank(country) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)).select(row_id, lat, lon)
    sea = locate(blank, index, lon, lat, "__place", cell).filter(F.col("__place").isNull())
    swapped = sea.select(row_id, F.col(lon).alias("lat_new"), F.col(lat).alias("lon_new")).filter(F.abs("lat_new") <= 90)
    found = locate(swapped, index, "lon_new", "lat_new", "__place", cell).filter(F.col("__place").isNotNull())
    return found.select(row_id, "lat_new", "lon_new", _cased(df, country, F.col("__place.admin")).alias("country"))


def utm_zone_ranking(pairs: DataFrame, index: DataFrame, iso3: str, zones: range, hemisphere: str = "S", datum: str = "SIRGAS2000", cell: float | None = None) -> DataFrame:
    """(zone, matched, tested, share) of distinct projected pairs that fall in a country, per zone.

    pairs: easting, northing. All distinct pairs are tested, not a sample."""
    from quadrat.functions.coords import utm_to_degrees

    distinct = pairs.filter("easting IS NOT NULL AND northing IS NOT NULL").select("easting", "northing").distinct()
    placed = distinct.withColumn("zone", F.explode(F.array(*[F.lit(z) for z in zones]))).withColumn(
        "p", utm_to_degrees(F.col("easting"), F.col("northing"), F.col("zone"), hemisphere, datum)
    ).select("zone", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
    located = locate(placed, index, "lon", "lat", "place", cell)
    hit = F.count_if(F.col("place.iso3") == iso3)
    ranked = located.groupBy("zone").agg(hit.alias("matched"), F.count("*").alias("tested"))
    return ranked.filter("matched > 0").withColumn("share", F.col("matched") / F.col("tested"))
