"""Coordinate text, grids, distances and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.fence import fence
from quadrat.functions.numbers import plain_number_text
from quadrat.functions.text import all_of, as_col, strip, text
from quadrat.session import settled

EARTH_RADIUS_M = 6371008.8
PLAIN_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)\s*$"

# Hemisphere letters include Portuguese O (west) and L (east).
ANGLE_MARKS = "[−–—°º'′’´`\"″”]"
DMS_TEXT = (
    r"^([NSEWOL])?\s*([-+])?\s*(\d+(?:[.,]\d+)?)\s*°?\s*"
    r"(?:(\d+(?:[.,]\d+)?)\s*'\s*)?(?:(\d+(?:[.,]\d+)?)\s*\"\s*)?"
    r"([NSEWOL])?\.?$"
)
_NUM = r"\d+(?:[.,]\d+)?"
_BODY = (
    rf"[-+]?\s*{_NUM}(?:\s*[°º](?:\s*{_NUM}\s*['′’´`](?:\s*{_NUM}\s*(?:\"|''|″|”))?)?)?"
)
_PART = rf"(?:[NSEWOL]\s*{_BODY}|{_BODY}(?:\s*[NSEWOL])?)"
PAIR_TEXT = rf"^({_PART})(?:\s*[;,/|]\s*|\s+|(?<=[NSEWOL°º'\"′’″”]))({_PART})$"
PAIR_SHARE = 0.9
DMS_FROM = "−–—′’´`″”º"
DMS_TO = "---''''\"\"°"
DOUBLE_MARK = "''"


def coord_number(value: Column | str) -> Column:
    """Degrees with a comma or a dot; plain digits only."""
    v = F.replace(as_col(value).cast("string"), F.lit(","), F.lit("."))
    return F.when(v.rlike(PLAIN_NUMBER), strip(v).try_cast("double"))


def coord_parse_failed(value: Column | str) -> Column:
    return (text(value) != "") & coord_number(value).isNull()


def coord_ok(value: Column | str, limit: float) -> Column:
    return F.coalesce(F.abs(coord_number(value)) <= limit, F.lit(False))


def suggest_coordinate(value: Column | str, limit: float) -> Column:
    v = strip(F.regexp_replace(text(value), r"\s*°$", ""))
    v = F.regexp_replace(F.regexp_replace(v, "^−", "-"), "^([^,]*),", "$1.")
    num = v.try_cast("double")
    return F.when(F.abs(num) <= limit, v)


def usable_point(lat: Column, lon: Column) -> Column:
    """In range, not a stand-in near (0, 0), axes not equal."""
    return F.coalesce(
        (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((F.abs(lat) < 0.5) & (F.abs(lon) < 0.5)) & (lat != lon),
        F.lit(False),
    )


def plottable(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def _decimal(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def _stage_degrees(df: DataFrame, sources: dict[str, Column]) -> DataFrame:
    """Add per source text a struct(size, negative, hemi) of its degrees spelling, NULL when it has none.

    Plain numbers carry no mark and give NULL. Each text meets the pattern once."""
    marked = {}
    for name, value in sources.items():
        s = text(value)
        marked[f"{name}__c"] = F.when(s.rlike(ANGLE_MARKS) | F.upper(s).rlike(r"^[NSEWOL]\b|[NSEWOL]\.?$"), F.upper(s))
    df = df.withColumns(marked)
    cleaned = {}
    for name in sources:
        c = F.translate(F.col(f"`{name}__c`"), DMS_FROM, DMS_TO)
        cleaned[f"{name}__c"] = F.replace(c, F.lit(DOUBLE_MARK), F.lit(DMS_TO[7]))
    df = df.withColumns(cleaned)
    split = "\u0001".join(f"${i}" for i in range(1, 7))
    df = df.withColumns(
        {
            f"{name}__g": F.when(
                F.col(f"`{name}__c`").rlike(DMS_TEXT),
                F.split(F.regexp_replace(F.col(f"`{name}__c`"), DMS_TEXT, split), "\u0001"),
            )
            for name in sources
        }
    )
    out = {}
    for name in sources:
        g = [F.get(F.col(f"`{name}__g`"), F.lit(i)) for i in range(6)]
        deg = _decimal(g[2])
        minute, second = F.coalesce(_decimal(g[3]), F.lit(0.0)), F.coalesce(_decimal(g[4]), F.lit(0.0))
        hemi = F.when(g[0] != "", g[0]).otherwise(g[5])
        south_west = hemi.isin("S", "W", "O")
        bad = (
            ((g[0] != "") & (g[5] != "") & (g[0] != g[5])) | (minute >= 60) | (second >= 60)
            | (((g[3] != "") | (g[4] != "")) & (deg != F.floor(deg)))
            | ((g[1] == "-") & (hemi != "") & ~south_west)
        )
        parsed = F.struct(
            (deg + minute / 60 + second / 3600).alias("size"), ((g[1] == "-") | south_west).alias("negative"), hemi.alias("hemi")
        )
        out[name] = F.when(F.col(f"`{name}__g`").isNotNull() & ~bad, parsed)
    return df.withColumns(out).drop(*[f"{n}__c" for n in sources], *[f"{n}__g" for n in sources])


def _axis_degrees(parsed: Column, axis: str) -> Column:
    """Signed degrees, 6 decimals, when the hemisphere letter and the size fit the axis."""
    allowed = ["", "N", "S"] if axis == "lat" else ["", "E", "W", "O", "L"]
    fits = parsed["hemi"].isin(*allowed) & (parsed["size"] <= (90 if axis == "lat" else 180))
    return F.when(fits, F.round(F.when(parsed["negative"], -parsed["size"]).otherwise(parsed["size"]), 6))


def with_degrees(df: DataFrame, columns: dict[str, str], suffix: str = "_deg") -> DataFrame:
    """Add `<column><suffix>`: degrees from DMS, hemisphere or Unicode-minus text (`{column: axis}`)."""
    keep = df.columns
    staged = _stage_degrees(df, {f"__{c}_dms": F.col(f"`{c}`") for c in columns})
    return staged.select(
        *[F.col(f"`{c}`") for c in keep], *[_axis_degrees(F.col(f"`__{c}_dms`"), a).alias(c + suffix) for c, a in columns.items()]
    )


_PAIR_MARKS = "[NSEWOL°º'\"′’´`″”]"


def _plain_half(part: Column, axis: str) -> Column:
    """A plain number that shows decimals."""
    bare = F.regexp_replace(part, r"\s+", "")
    num = F.replace(bare, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(bare.rlike(r"[.,]\d") & (F.abs(num) <= (90 if axis == "lat" else 180)), num)


def with_coordinate_pairs(df: DataFrame, columns: list[str], suffix: str = "_pair") -> DataFrame:
    """Add `<column><suffix>`: struct(lat, lon) of a cell that holds both axes, NULL when it does not.

    Staged like the date parser: the cell and its two halves are each read once."""
    keep = df.columns
    stage = df.withColumns({f"__{c}_t": F.upper(F.translate(text(f"`{c}`"), "−–—", "---")) for c in columns})
    stage = stage.withColumns(
        {f"__{c}_h": F.when(F.col(f"`__{c}_t`").rlike(PAIR_TEXT), F.split(
            F.regexp_replace(F.col(f"`__{c}_t`"), PAIR_TEXT, "$1\u0001$2"), "\u0001")) for c in columns}
    )
    halves = {f"__{c}_p{k}": strip(F.get(F.col(f"`__{c}_h`"), F.lit(k - 1))) for c in columns for k in (1, 2)}
    stage = stage.withColumns(halves)
    texts = {f"__{c}_d{k}": F.col(f"`__{c}_p{k}`") for c in columns for k in (1, 2)}
    texts |= {f"__{c}_d0": F.when(F.col(f"`__{c}_h`").isNotNull(), F.col(f"`__{c}_t`")) for c in columns}
    stage = _stage_degrees(stage, texts)
    marks = {f"__{c}_m{k}": F.col(f"`__{c}_p{k}`").rlike(_PAIR_MARKS) for c in columns for k in (1, 2)}
    letters = {}
    for c in columns:
        for k in (1, 2):
            p = F.col(f"`__{c}_p{k}`")
            ns, ew = p.rlike("[NS]"), p.rlike("[EWOL]")
            letters[f"__{c}_a{k}"] = F.when(ns & ew, "bad").when(ns, "lat").when(ew, "lon").otherwise("")
    stage = stage.withColumns(marks | letters)

    def half(c: str, k: int, axis: str) -> Column:
        return F.when(F.col(f"`__{c}_m{k}`"), _axis_degrees(F.col(f"`__{c}_d{k}`"), axis)).otherwise(
            _plain_half(F.col(f"`__{c}_p{k}`"), axis))

    stage = stage.withColumns(
        {f"__{c}_v{k}{axis}": half(c, k, axis) for c in columns for k in (1, 2) for axis in ("lat", "lon")}
    )
    out = []
    for c in columns:
        a1, a2 = F.col(f"`__{c}_a1`"), F.col(f"`__{c}_a2`")
        whole = F.col(f"`__{c}_d0`")
        single = _axis_degrees(whole, "lat").isNotNull() | _axis_degrees(whole, "lon").isNotNull()
        usable = ~single & (a1 != "bad") & (a2 != "bad") & ((a1 == "") | (a1 != a2))
        swap = F.coalesce(F.abs(F.col(f"`__{c}_v1lon`")) > 90, F.lit(False))
        lat_first = F.when((a1 == "") & (a2 == ""), ~swap).otherwise((a1 == "lat") | (a2 == "lon"))
        lat = F.when(lat_first, F.col(f"`__{c}_v1lat`")).otherwise(F.col(f"`__{c}_v2lat`"))
        lon = F.when(lat_first, F.col(f"`__{c}_v2lon`")).otherwise(F.col(f"`__{c}_v1lon`"))
        pair = F.struct(lat.alias("lat"), lon.alias("lon"))
        out.append(F.when(usable & lat.isNotNull() & lon.isNotNull(), pair).alias(c + suffix))
    return fence(stage.select(*[F.col(f"`{c}`") for c in keep], *out), [c + suffix for c in columns])


def convert_coordinates(df: DataFrame, columns: dict[str, str], pair_column: bool = False) -> DataFrame:
    """Replace coordinate columns (`{column: axis}`) by decimal text: DMS and pairs are converted,
    plain numbers stay. In a pair column a lone value cannot tell its axis, so it is blanked.

    Cells that are no plain number are read once per distinct text and looked up by the rows."""
    stage = df
    for c, axis in columns.items():
        odd = F.when(coord_number(f"`{c}`").isNull() & (text(f"`{c}`") != ""), F.col(f"`{c}`").cast("string"))
        texts = df.select(odd.alias("__ctext")).filter("__ctext IS NOT NULL").distinct()
        read = with_degrees(with_coordinate_pairs(texts, ["__ctext"], "__p"), {"__ctext": axis}, "__o")
        read = settled(read.select("__ctext", F.col("__ctext__p").alias(f"{c}__pair"), F.col("__ctext__o").alias(f"{c}__own")), "__ctext")
        stage = stage.withColumn("__ckey", odd).join(read, F.col("__ckey") == F.col("__ctext"), "left").drop("__ckey", "__ctext")

    def cell(c: str, axis: str) -> Column:
        v, own = F.col(f"`{c}`"), F.col(f"`{c}__own`")
        plain = coord_number(v).isNotNull()
        pair = F.when(own.isNull() & ~plain, F.col(f"`{c}__pair`")[axis])
        if pair_column:
            lone = (text(v) != "") & pair.isNull() & (plain | own.isNotNull())
            return F.when(pair.isNotNull(), plain_number_text(pair)).when(lone, "").otherwise(v)
        return F.coalesce(plain_number_text(F.coalesce(own, pair)), v)

    return stage.select(*[cell(c, columns[c]).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def coordinate_pair_columns(df: DataFrame, columns: list[str], min_share: float = PAIR_SHARE) -> list[str]:
    """Columns whose filled cells mostly hold a whole pair; one aggregate for all of them."""
    if not columns:
        return []
    staged = with_coordinate_pairs(df.select(*[F.col(f"`{c}`") for c in columns]), columns)
    shares = staged.agg(
        *[
            F.coalesce(
                F.count(f"`{c}_pair`") / F.nullif(F.count_if(text(f"`{c}`") != ""), F.lit(0)), F.lit(0.0)
            ).alias(c)
            for c in columns
        ]
    ).first()
    return [c for c in columns if shares[c] >= min_share]


def grid_round(value: Column, grid: Column | float) -> Column:
    """Nearest grid line, ties to the even one, 6 decimals."""
    grid = F.lit(grid) if isinstance(grid, float) else grid
    return F.round(F.rint(value / grid) * grid, 6)


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * EARTH_RADIUS_M)


def cell_radius_m(grid: Column, lon: Column, lat: Column) -> Column:
    """Farthest corner of the grid cell around a point. East and west corners are symmetric."""
    half = grid / 2
    return F.greatest(
        distance_m(lon, lat, lon - half, lat - half), distance_m(lon, lat, lon - half, lat + half)
    )


def decimal_grid(value: Column | str) -> Column:
    """Step of the last written decimal: `-23.55` gives 0.01."""
    v = text(value)
    digits = F.regexp_extract(v, r"^[^.,]*[.,]([0-9]*)", 1)
    return F.when(v != "", F.pow(F.lit(10.0), -F.length(digits)))


def wkt_number(value: Column) -> Column:
    return F.format_string("%.6f", value)


def cell_wkt(lat: Column, lon: Column, grid: Column) -> Column:
    """Grid cell polygon, clamped to the globe."""
    half = grid / 2
    west, east = F.greatest(lon - half, F.lit(-180.0)), F.least(lon + half, F.lit(180.0))
    south, north = F.greatest(lat - half, F.lit(-90.0)), F.least(lat + half, F.lit(90.0))
    return F.format_string(
        "POLYGON ((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))",
        west, south, east, south, east, north, west, north, west, south,
    )


# Plausible ranges of projected axes, in metres.
EASTING_RANGE = (100_000.0, 900_000.0)
NORTHING_RANGE = (0.0, 10_000_000.0)

# Datum label, EPSG base codes, zones, ellipsoid and shift to WGS 84 (metres).
DATUMS = {
    "SIRGAS2000": {"label": "SIRGAS 2000", "north": 31954, "south": 31960, "zones": range(17, 26),
                   "a": 6378137.0, "inv_f": 298.257222101, "shift": (0.0, 0.0, 0.0)},
    "WGS84": {"label": "WGS 84", "north": 32600, "south": 32700, "zones": range(1, 61),
              "a": 6378137.0, "inv_f": 298.257223563, "shift": (0.0, 0.0, 0.0)},
    "SAD69": {"label": "SAD69", "north": None, "south": 29170, "zones": range(18, 26),
              "a": 6378160.0, "inv_f": 298.25, "shift": (-67.35, 3.88, -38.22)},
    "CORREGO": {"label": "Corrego Alegre", "north": None, "south": 22500, "zones": range(21, 26),
                "a": 6378388.0, "inv_f": 297.0, "shift": (-206.05, 168.28, -3.82)},
}


def _in(value: Column, bounds: tuple[float, float]) -> Column:
    return F.coalesce(value.between(*bounds), F.lit(False))


def is_projected_pair(a: Column, b: Column, northings: tuple[float, float] = NORTHING_RANGE) -> Column:
    """Two numbers that fit a projected grid and cannot be degrees; `northings` is the grid's range."""
    degrees = F.coalesce((F.abs(a) <= 90) & (F.abs(b) <= 180), F.lit(False))
    return ~degrees & (
        (_in(a, EASTING_RANGE) & _in(b, northings)) | (_in(a, northings) & _in(b, EASTING_RANGE))
    )


def projected_axes_ambiguous(a: Column, b: Column) -> Column:
    return _in(a, EASTING_RANGE) & _in(b, EASTING_RANGE)


def assign_projected_axes(
    a: Column, b: Column, order: str | None = None, northings: tuple[float, float] = NORTHING_RANGE
) -> Column:
    """struct(easting, northing); `order` settles pairs that fit both ways."""
    both = projected_axes_ambiguous(a, b)
    a_east = _in(a, EASTING_RANGE) & _in(b, northings) & ~both
    b_east = _in(b, EASTING_RANGE) & _in(a, northings) & ~both
    if order == "lat_northing":
        b_east = b_east | both
    elif order == "lat_easting":
        a_east = a_east | both
    return F.struct(
        F.when(b_east, b).when(a_east, a).alias("easting"),
        F.when(b_east, a).when(a_east, b).alias("northing"),
    )


def utm_epsg(zone: int, hemisphere: str = "S", datum: str = "SIRGAS2000") -> int:
    spec = DATUMS[datum]
    base = spec["south"] if hemisphere == "S" else spec["north"]
    if base is None or zone not in spec["zones"]:
        raise ValueError(f"{spec['label']} has no zone {zone}{hemisphere}")
    return base + zone


def utm_label(zone: int, hemisphere: str = "S", datum: str = "SIRGAS2000") -> tuple[str, str]:
    return f"UTM zone {zone}{hemisphere}", f"EPSG:{utm_epsg(zone, hemisphere, datum)}"


def utm_to_degrees(
    easting: Column, northing: Column, zone: Column | int, hemisphere: str = "S", datum: str = "SIRGAS2000"
) -> Column:
    """struct(lat, lon) on WGS 84: inverse transverse Mercator series, then the datum shift."""
    spec = DATUMS[datum]
    zone = F.lit(zone) if isinstance(zone, int) else zone
    f = 1 / spec["inv_f"]
    n = f / (2 - f)
    radius = spec["a"] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    false_north = 10_000_000.0 if hemisphere == "S" else 0.0
    xi = (northing - false_north) / (0.9996 * radius)
    eta = (easting - 500_000.0) / (0.9996 * radius)
    xi_p, eta_p = xi, eta
    for j, b in enumerate(beta, start=1):
        xi_p = xi_p - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        eta_p = eta_p - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    lat = chi
    for j, d in enumerate(delta, start=1):
        lat = lat + F.sin(chi * (2 * j)) * d
    lon = F.radians(zone * 6 - 183) + F.atan2(F.sinh(eta_p), F.cos(xi_p))
    if any(spec["shift"]):
        lat, lon = _shift_datum(lat, lon, spec)
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))


def _shift_datum(lat: Column, lon: Column, spec: dict) -> tuple[Column, Column]:
    """Geocentric translation to WGS 84 for a point on the ellipsoid (radians in, radians out)."""
    f = 1 / spec["inv_f"]
    e2 = f * (2 - f)
    nu = F.lit(spec["a"]) / F.sqrt(1 - F.pow(F.sin(lat), 2) * e2)
    dx, dy, dz = spec["shift"]
    x = nu * F.cos(lat) * F.cos(lon) + dx
    y = nu * F.cos(lat) * F.sin(lon) + dy
    z = nu * (1 - e2) * F.sin(lat) + dz
    a, wf = 6378137.0, 1 / 298.257223563
    b = a * (1 - wf)
    e2w, ep2 = wf * (2 - wf), (a * a - b * b) / (b * b)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * a, p * b)
    new_lat = F.atan2(
        z + F.pow(F.sin(theta), 3) * (ep2 * b), p - F.pow(F.cos(theta), 3) * (e2w * a)
    )
    return new_lat, F.atan2(y, x)


def hemispheres_mixed(northing: Column) -> Column:
    """Aggregate: northings of both hemispheres in one column."""
    return all_of(
        [
            F.coalesce(F.bool_or(northing < 1_000_000), F.lit(False)),
            F.coalesce(F.bool_or(northing >= 5_000_000), F.lit(False)),
        ]
    )


