"""Sensitive locations: tiers, the row plan, masking, copies of protected points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import coords as C
from quadrat.functions import numbers as M
from quadrat.functions.fence import fence
from quadrat.functions.redaction import (
    has_point_text, has_projected_point, might_hold_point, point_tokens, redact_copies, write_back,
)
from quadrat.functions.text import any_of, is_blank, literal_map, text
from quadrat.operators.mapping import coordinate_like_header, is_measurement_column, ordered_columns
from quadrat.operators.spatial import locate
from quadrat.operators.taxa import resolve_sensitivity
from quadrat.session import BROADCAST_ROWS, settled, written

TIER_GRIDS = {"extreme": 1.0, "high": 0.1, "medium": 0.01, "low": 0.001}
TIERS = tuple(TIER_GRIDS)
NOTE_MARK = "[coordinates-generalized:v1]"
WITHHELD_TEXT = "Original location withheld: sensitive species."

# Openings of notes that say a point is already generalised.
NOTE_OPENINGS = (
    "Coordenadas generalizadas para ", "Coordinates generalized to ", "Coordenadas de espécie ",
    "Coordinates of a ", "Coordenadas de una especie ", "coordinates rounded to",
)
# Terms in which one number is a value of its own, not a copy of a coordinate.
ONE_NUMBER_TERMS = frozenset(
    "individualCount organismQuantity objectQuantity sampleSizeValue samplingEffort minimumElevationInMeters "
    "maximumElevationInMeters verbatimElevation minimumDepthInMeters maximumDepthInMeters verbatimDepth "
    "minimumDistanceAboveSurfaceInMeters maximumDistanceAboveSurfaceInMeters coordinateUncertaintyInMeters "
    "coordinatePrecision pointRadiusSpatialFit footprintSpatialFit year month day startDayOfYear endDayOfYear "
    "eventTime verbatimEventDate namePublishedInYear measurementValue measurementAccuracy assertionValue readCount "
    "processedTotalReadCount".split()
)
VERBATIM_COLUMNS = ("verbatimLatitude", "verbatimLongitude", "verbatimCoordinates")
PLACE_TEXT_COLUMNS = ("locality", "verbatimLocality", "georeferenceRemarks", "locationRemarks")
LOCATION_COLUMNS = (*VERBATIM_COLUMNS, "footprintWKT", *PLACE_TEXT_COLUMNS)
MASK_COLUMNS = (
    "dataGeneralizations", "informationWithheld", "coordinateUncertaintyInMeters", "coordinatePrecision",
    "footprintWKT", "footprintSRS",
)


def chapman_tier(at_risk: Column, harmful: Column, sensitive_area: Column) -> Column:
    """Tier from three yes/no answers, asked in turn; NULL while an answer is missing."""
    def done(c: Column) -> Column:
        return F.coalesce(c != "", F.lit(False))

    return (
        F.when(~done(at_risk), F.lit(None).cast("string"))
        .when(at_risk == "yes", "high")
        .when(~done(harmful), F.lit(None).cast("string"))
        .when(harmful == "yes", "medium")
        .when(~done(sensitive_area), F.lit(None).cast("string"))
        .when(sensitive_area == "yes", "low")
        .otherwise("not_sensitive")
    )


def category_code(category: Column) -> Column:
    code = F.regexp_replace(F.lower(F.coalesce(category, F.lit(""))), "[^a-z0-9]", "")
    return F.when(code == "", "other").otherwise(code)


def resolve_levels(overview: DataFrame, group_levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """(scientificName, tier): the answer of the category group, a species exception on top."""
    groups = group_levels.select(F.col("code"), F.col("tier").alias("__group"))
    special = overrides.select("scientificName", F.col("tier").alias("__own"))
    coded = overview.select("scientificName", category_code(F.col("category")).alias("code"))
    joined = coded.join(groups, "code", "left").join(special, "scientificName", "left")
    return joined.select("scientificName", F.coalesce("__own", "__group", F.lit("not_sensitive")).alias("tier"))


def tier_grid(tier: Column) -> Column:
    grids = F.create_map(*[x for t, g in TIER_GRIDS.items() for x in (F.lit(t), F.lit(g))])
    return F.try_element_at(grids, tier)


def tier_number(tier: Column) -> Column:
    numbers = F.create_map(*[x for i, t in enumerate(TIERS, 1) for x in (F.lit(t), F.lit(i))])
    return F.try_element_at(numbers, tier)


def less_aggressive_tiers(tiers: list[str]) -> list[str]:
    ranks = [TIERS.index(t) for t in tiers if t in TIERS]
    return list(TIERS[max(ranks) + 1:]) if ranks else []


TIER_REASONS = {
    "extreme": "Category 1: extreme sensitivity.", "high": "Category 2: high sensitivity.",
    "medium": "Category 3: medium sensitivity.", "low": "Category 4: low sensitivity.",
}


def tier_reason(tier: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(TIER_REASONS), tier), F.lit(""))


def is_generalisation_note(value: Column) -> Column:
    v = text(value)
    openings = "|".join("\\Q" + o + "\\E" for o in NOTE_OPENINGS)
    return v.rlike(r"\[([a-z]+:)?coordinates-generalized:v") | v.rlike(rf"(?i)(^|\| )({openings})")


def _cell(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def already_generalised(df: DataFrame, metres: Column | None = None) -> Column:
    """An uncertainty of a kilometre or more, or a note that says so; `metres` if it is known."""
    if metres is None:
        metres = M.masking_uncertainty_metres(_cell(df, "coordinateUncertaintyInMeters"))
    return F.coalesce(metres >= M.ALREADY_GENERALISED_M, F.lit(False)) | is_generalisation_note(
        _cell(df, "dataGeneralizations")
    )


def snap_grid(df: DataFrame, lat: Column, lon: Column, metres: Column) -> Column:
    """Coarsest grid whose cell stays within the stated uncertainty, for points written finer than that."""
    candidate = F.coalesce(metres >= M.ALREADY_GENERALISED_M, F.lit(False)) & ~is_generalisation_note(
        _cell(df, "dataGeneralizations")
    )
    fits = [F.when(C.cell_radius_m(F.lit(g), lon, lat) <= metres, F.lit(g)) for g in TIER_GRIDS.values()]
    grid = F.greatest(*fits)
    finest = F.least(C.decimal_grid(_cell(df, "decimalLatitude")), C.decimal_grid(_cell(df, "decimalLongitude")))
    return F.when(candidate & (finest < grid), grid)


def _with_uncertainty(df: DataFrame) -> DataFrame:
    """Adds `p_prior`, the stated uncertainty in metres, and `__ambiguous`; each distinct text is read once."""
    column = "coordinateUncertaintyInMeters"
    if column not in df.columns:
        return df.withColumns({"p_prior": F.lit(None).cast("double"), "__ambiguous": F.lit(False)})
    own = F.col(f"`{column}`").cast("string")
    texts = df.select(own.alias("__utext")).filter(~is_blank("__utext")).distinct()
    read = texts.withColumns({"p_prior": M.uncertainty_metres("__utext"), "__ambiguous": M.ambiguous_uncertainty("__utext")})
    joined = df.join(settled(read, "__utext"), own == F.col("__utext"), "left").drop("__utext")
    return joined.withColumn("__ambiguous", F.coalesce("__ambiguous", F.lit(False)))


def generalisation_plan(
    df: DataFrame, levels: DataFrame, threatened: DataFrame, decisions: DataFrame | None = None
) -> DataFrame:
    """The table plus plan columns `p_*`: what happens to each row's point, decided in one projection.

    levels: scientificName, tier. `p_target` rows are moved to the grid, `p_withheld` rows lose their
    location, `p_kept` rows were generalised before, `p_snap` rows use the grid of their uncertainty. Of several
    tiers for one species the coarsest holds."""
    coarseness = F.coalesce(*[F.when(F.col("tier") == t, F.lit(float(g))) for t, g in TIER_GRIDS.items()], F.lit(0.0))
    tiers = levels.groupBy(F.col("scientificName").alias("__sp")).agg(
        F.max_by("tier", F.struct(coarseness, F.col("tier"))).alias("__tier"))
    base = resolve_sensitivity(df, threatened, decisions).withColumnsRenamed(
        {"sensitive": "__sensitive", "category": "p_category"}
    )
    base = base.join(tiers, F.col("scientificName") == F.col("__sp"), "left").drop("__sp")
    base = _with_uncertainty(base)
    base = base.withColumns(
        {
            "p_tier": F.coalesce("__tier", F.lit("not_sensitive")),
            "p_lat": C.coord_number("decimalLatitude"),
            "p_lon": C.coord_number("decimalLongitude"),
            "p_stored": F.greatest(
                C.decimal_grid("decimalLatitude"), C.decimal_grid("decimalLongitude"),
                M.number(text(_cell(df, "coordinatePrecision"))),
            ),
            "p_has_coord": ~is_blank("decimalLatitude") | ~is_blank("decimalLongitude"),
            "__place": any_of([~is_blank(_cell(df, c)) for c in LOCATION_COLUMNS if c in df.columns]),
        }
    )
    lat, lon = F.col("p_lat"), F.col("p_lon")
    base = base.withColumn("__metres", F.when(~F.col("__ambiguous"), F.col("p_prior")))
    base = base.withColumns(
        {
            "p_grid": tier_grid(F.col("p_tier")),
            "__ok": C.usable_point(lat, lon),
            "__before": already_generalised(df, F.col("__metres")),
        }
    )
    base = base.withColumn("__sens", F.col("__sensitive") & F.col("p_grid").isNotNull())
    # Cells are measured only around points that may be moved: distances from NULL cost nothing.
    wide = F.col("__sens") & F.col("__ok") & (F.col("__metres") >= M.ALREADY_GENERALISED_M)
    base = base.withColumns({"__wide_lat": F.when(wide, lat), "__wide_lon": F.when(wide, lon)})
    base = base.withColumn("__snap", snap_grid(df, F.col("__wide_lat"), F.col("__wide_lon"), F.col("__metres")))
    base = base.withColumn("p_snap", F.col("__sens") & F.col("__ok") & F.col("__snap").isNotNull())
    base = base.withColumn("__masked", F.col("__before") & ~F.col("p_snap"))
    base = base.withColumns(
        {
            "p_target": F.col("__sens") & F.col("__ok") & ~F.col("__masked"),
            "p_skipped": F.col("__sens") & F.col("__ok") & F.col("__masked"),
            "p_kept": F.col("__sens") & F.col("__masked"),
            "p_withheld": F.col("__sens") & (F.col("p_has_coord") | F.col("__place")) & ~F.col("__ok") & ~F.col("__masked"),
            "__base": F.when(F.col("p_snap"), F.col("__snap")).otherwise(F.col("p_grid")),
        }
    )
    base = base.withColumns(
        {
            "p_eff_grid": F.when(F.col("__base").isNotNull(), F.greatest("__base", "p_stored")),
            "p_clamped": F.coalesce(F.col("p_target") & (F.col("__base") < F.col("p_stored")), F.lit(False)),
        }
    )
    base = base.withColumns(
        {
            "p_pub_lat": F.when(F.col("p_target"), C.grid_round(lat, F.col("p_eff_grid"))),
            "p_pub_lon": F.when(F.col("p_target"), C.grid_round(lon, F.col("p_eff_grid"))),
        }
    )
    radius = C.cell_radius_m(F.col("p_eff_grid"), F.col("p_pub_lon"), F.col("p_pub_lat"))
    base = base.withColumn("p_metres", F.ceil(radius + F.coalesce("p_prior", F.lit(0.0))))
    done = base.drop("__sensitive", "__tier", "__ambiguous", "__metres", "__place", "__ok", "__wide_lat", "__wide_lon", "__snap", "__before", "__sens", "__masked", "__base")
    return fence(done, plan_columns(done))


def plan_columns(plan: DataFrame) -> list[str]:
    return [c for c in plan.columns if c.startswith("p_")]


def plan_counts(plan: DataFrame) -> DataFrame:
    flags = {
        "n_masked": "p_target", "n_withheld": "p_withheld", "n_kept": "p_kept", "n_skipped_already_masked": "p_skipped",
        "n_snapped_to_uncertainty": "p_snap", "n_clamped_to_precision": "p_clamped",
    }
    return plan.agg(*[F.count_if(F.col(c)).alias(k) for k, c in flags.items()])


def after_note(prior: Column, note: Column) -> Column:
    return F.when(is_blank(prior), note).otherwise(F.concat(text(prior), F.lit(" | "), note))


def dotted(value: Column) -> Column:
    """Number text with a dot, other text as it is, '' for NULL."""
    v = text(value)
    return F.when(C.coord_number(v).isNotNull(), F.regexp_replace(v, "^([^,]*),", "$1.")).otherwise(v)


def _number(value: Column) -> Column:
    return F.coalesce(M.plain_number_text(value), F.lit(""))


def _own_number_term(name: str) -> bool:
    return name in ONE_NUMBER_TERMS or is_measurement_column(name) or name.endswith(("ID", "Number", "Numbers"))


def redact_own_points(df: DataFrame, columns: list[str], rows: Column, lat: Column, lon: Column, grid: Column, pub_lat: Column, pub_lon: Column) -> DataFrame:
    """Replace copies of each row's own point in its other text cells."""
    cells, where = {}, {}
    for c in columns:
        cells[c], where[c] = F.col(f"`{c}`").cast("string"), rows
        if _own_number_term(c):
            where[c] = rows & M.number(F.regexp_replace(text(cells[c]), "^([^,]*),", "$1.")).isNull()
    return redact_copies(df, cells, lat, lon, grid, pub_lat, pub_lon, where) if columns else df


def mask_locations(plan: DataFrame, row_id: str = "row_id", justification: str = "") -> tuple[DataFrame, DataFrame]:
    """(public, private) from one plan.

    Public: points on the grid with precision, additive uncertainty, the grid cell as footprint and a
    note; withheld rows lose point and text; verbatim cells are blanked; copies of the point in other
    cells are replaced. Private: the original points of the moved and withheld rows only."""
    source = [c for c in plan.columns if c not in plan_columns(plan)]
    target, withheld, kept = F.col("p_target"), F.col("p_withheld"), F.col("p_kept")
    touched = target | withheld
    grid = F.col("p_eff_grid")
    shown = F.coalesce(F.nullif(F.col("p_category"), F.lit("")), F.lit("—"))
    note = F.concat_ws(
        " ",
        F.concat(F.lit("Coordinates of a "), shown, F.lit(" species generalized to "), _number(grid), F.lit(" degree.")),
        F.nullif(tier_reason(F.col("p_tier")), F.lit("")),
        F.when(F.col("p_snap"), F.concat(F.lit("Grid from the stated uncertainty of "), _number(F.col("p_prior")), F.lit(" m.")))
        .when(grid > F.col("p_grid"), F.concat(
            F.lit("Category "), tier_number(F.col("p_tier")).cast("string"), F.lit(" asks for "), _number(F.col("p_grid")),
            F.lit("; stored precision is coarser."))),
        F.when(F.col("p_stored").isNotNull(), F.concat(F.lit("Stored precision: "), _number(F.col("p_stored")), F.lit("."))),
        F.lit(justification.strip() or None), F.lit(NOTE_MARK),
    )
    gone = F.concat_ws(
        " ", F.concat(F.lit("Location of a "), shown, F.lit(" species withheld: the point is not usable.")),
        F.lit(justification.strip() or None),
    )
    own = (F.col("p_lat"), F.col("p_lon"), grid)
    pub_lat = F.when(target, _number(F.col("p_pub_lat"))).otherwise("")
    pub_lon = F.when(target, _number(F.col("p_pub_lon"))).otherwise("")
    full = plan.withColumns({c: F.coalesce(_cell(plan, c), F.lit("")) for c in MASK_COLUMNS})
    full = redact_copies(full, {"__prior": F.col("dataGeneralizations")}, *own, pub_lat, pub_lon, {"__prior": touched})
    masked = {
        "decimalLatitude": F.when(target, pub_lat).when(withheld, "").otherwise(F.col("decimalLatitude")),
        "decimalLongitude": F.when(target, pub_lon).when(withheld, "").otherwise(F.col("decimalLongitude")),
        "coordinatePrecision": F.when(target, _number(grid)).when(withheld, "").otherwise(F.col("coordinatePrecision")),
        "coordinateUncertaintyInMeters": F.when(target, F.col("p_metres").cast("string")).when(withheld, "").otherwise(
            F.col("coordinateUncertaintyInMeters")),
        "footprintWKT": F.when(target, C.cell_wkt(F.col("p_pub_lat"), F.col("p_pub_lon"), grid)).when(
            withheld | kept, "").otherwise(F.col("footprintWKT")),
        "footprintSRS": F.when(target, "EPSG:4326").when(withheld | kept, "").otherwise(F.col("footprintSRS")),
        "dataGeneralizations": F.when(target, after_note(F.col("__prior"), note)).when(
            withheld, after_note(F.col("__prior"), gone)).otherwise(F.col("dataGeneralizations")),
        "informationWithheld": F.when(touched, WITHHELD_TEXT).otherwise(F.col("informationWithheld")),
    }
    masked |= {c: F.when(touched | kept, "").otherwise(F.col(c)) for c in VERBATIM_COLUMNS if c in source}
    masked |= {c: F.when(touched, WITHHELD_TEXT).otherwise(F.col(c)) for c in PLACE_TEXT_COLUMNS if c in source}
    managed = {row_id, "occurrenceID", "scientificName", *masked}
    others = [c for c in source if c not in managed]
    keep_lat, keep_lon = dotted(_cell(plan, "decimalLatitude")), dotted(_cell(plan, "decimalLongitude"))
    public = redact_own_points(
        full, others, touched | kept, F.col("p_lat"), F.col("p_lon"), F.when(kept, F.col("p_stored")).otherwise(grid),
        F.when(kept, keep_lat).otherwise(pub_lat), F.when(kept, keep_lon).otherwise(pub_lon),
    )
    public = public.withColumns(masked)
    names = ordered_columns(list(dict.fromkeys([*source, *MASK_COLUMNS])), row_id)
    private = plan.filter(touched & F.col("p_has_coord")).select(
        row_id, text(_cell(plan, "occurrenceID")).alias("occurrenceID"), "scientificName", shown.alias("category"),
        dotted(F.col("decimalLatitude")).alias("decimalLatitude"), dotted(F.col("decimalLongitude")).alias("decimalLongitude"),
    )
    return public.select(*[F.col(f"`{c}`") for c in names]), private


def protected_points(plan: DataFrame) -> DataFrame:
    """Distinct protected points with the text that may replace them."""
    rows = plan.filter((F.col("p_target") | F.col("p_withheld")) & F.col("p_lat").isNotNull() & F.col("p_lon").isNotNull())
    picked = rows.select(
        F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), F.col("p_eff_grid").alias("grid"),
        F.when(F.col("p_target"), _number(F.col("p_pub_lat"))).otherwise("").alias("pub_lat"),
        F.when(F.col("p_target"), _number(F.col("p_pub_lon"))).otherwise("").alias("pub_lon"),
    )
    return picked.groupBy("lat", "lon", "grid").agg(F.max("pub_lat").alias("pub_lat"), F.max("pub_lon").alias("pub_lon"))


#: Sides of the boxes in which token pairs and points meet, and the coarsest step that uses each but the last.
SIDES = (0.05, 0.5, 5.0)
STEPS = (0.01, 0.1)


def find_point_copies(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(cell_id, stage, start, len, published): tokens of a text that spell both axes of one protected point.

    cells: cell_id, text, own_lat, own_lon (a row's own point does not count). points: as from
    `protected_points`. The token values of a text are paired before they meet the points: a pair lies in a box a few
    steps wide on both axes, so an equi-join on the box compares it to the points of that box only, not to all that
    share one axis. Equal pairs of several texts are compared once. Tokens and points are read several times, so both
    are written to the checkpoint folder first."""
    points = written(points)
    most = points.agg(F.max("grid").alias("g"), F.max(F.abs("lat")).alias("lat"), F.max(F.abs("lon")).alias("lon"))
    texts = cells.filter(might_hold_point(F.col("text")))
    tokens = texts.select(
        "cell_id", "own_lat", "own_lon", F.explode(point_tokens(F.col("text"))).alias("t")
    ).select("cell_id", "own_lat", "own_lon", "t.*").filter(~F.col("bare"))
    tokens = written(tokens.filter(F.col("step") < most.select("g").scalar()))

    def reach(step: Column) -> Column:
        return step / 2 + 1e-9

    def side(step: Column) -> Column:
        return F.when(step <= STEPS[0], SIDES[0]).when(step <= STEPS[1], SIDES[1]).otherwise(SIDES[2])

    def boxes(token: Column) -> Column:
        ends = [F.floor((token["value"] + sign * reach(token["step"])) / side(token["step"])) for sign in (-1, 1)]
        return F.sequence(*ends)

    listed = tokens.groupBy("cell_id").agg(F.collect_set(F.struct("value", "step")).alias("all"))

    def fits(axis: str) -> Column:
        return F.filter("all", lambda x: x["value"] - reach(x["step"]) <= F.col(f"most_{axis}"))

    limits = {f"most_{axis}": most.select(axis).scalar() for axis in ("lat", "lon")}
    pairs = listed.withColumns(limits).select("cell_id", fits("lon").alias("b"), F.explode(fits("lat")).alias("a")).select(
        "cell_id", "a", F.explode("b").alias("b"))
    boxed = pairs.select("a", "b").distinct().withColumns({"side_a": side(F.col("a.step")), "side_b": side(F.col("b.step"))})
    boxed = boxed.withColumn("box_a", F.explode(boxes(F.col("a")))).withColumn("box_b", F.explode(boxes(F.col("b"))))
    sides = F.array(*[F.lit(x) for x in SIDES])
    placed = points.withColumn("side_a", F.explode(sides)).withColumn("side_b", F.explode(sides)).withColumns(
        {"box_a": F.floor(F.abs("lat") / F.col("side_a")), "box_b": F.floor(F.abs("lon") / F.col("side_b"))})

    def near(token: str, axis: str) -> Column:
        t = F.col(token)
        return (F.abs(t["value"] - F.abs(axis)) <= reach(t["step"])) & (t["step"] < F.col("grid"))

    # Counted: the size of compressed files would let far too many boxes pass for small.
    placed = F.broadcast(placed) if points.count() * len(SIDES) ** 2 <= BROADCAST_ROWS else placed.hint("merge")
    met = boxed.join(placed, ["side_a", "side_b", "box_a", "box_b"]).filter(near("a", "lat") & near("b", "lon"))
    hits = pairs.join(met.select("a", "b", "lat", "lon", "grid", "pub_lat", "pub_lon"), ["a", "b"])
    own = tokens.groupBy("cell_id").agg(F.max(F.struct("own_lat", "own_lon")).alias("own"))

    def is_own(token: str, axis: str) -> Column:
        t = F.col(token)
        return F.coalesce(F.abs(t["value"] - F.abs(F.col(f"own.own_{axis}"))) <= reach(t["step"]), F.lit(False))

    point = hits.join(own, "cell_id").groupBy("cell_id", "lat", "lon", "grid").agg(
        F.bool_or(is_own("a", "lat")).alias("own_a"), F.bool_or(is_own("b", "lon")).alias("own_b"),
        F.collect_set(F.struct(F.col("a").alias("token"), F.col("pub_lat").alias("published"))).alias("as"),
        F.collect_set(F.struct(F.col("b").alias("token"), F.col("pub_lon").alias("published"))).alias("bs"),
    ).filter(~(F.col("own_a") & F.col("own_b")))
    spelled = point.select("cell_id", F.explode(F.concat("as", "bs")).alias("x")).groupBy(
        "cell_id", F.col("x.token.value").alias("value"), F.col("x.token.step").alias("step")
    ).agg(F.max("x.published").alias("published"))
    return tokens.join(spelled, ["cell_id", "value", "step"]).select("cell_id", "stage", "start", "len", "published")


def redact_point_pairs(df: DataFrame, points: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """Replace protected points that other rows' texts spell out; a row's own published point stays.

    Only the hits are joined back, one short list per text."""
    own_lat, own_lon = C.coord_number("decimalLatitude"), C.coord_number("decimalLongitude")
    boxed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("text")) for c in columns])
    cells = df.select(row_id, own_lat.alias("own_lat"), own_lon.alias("own_lon"), F.explode(boxed).alias("c")).select(
        F.struct(F.col(row_id).alias("row"), F.col("c.column").alias("column")).alias("cell_id"),
        F.col("c.text").alias("text"), "own_lat", "own_lon",
    )
    hits = find_point_copies(cells, points)
    token = F.struct("stage", "start", "len", "published")
    per_cell = hits.groupBy("cell_id").agg(F.collect_list(token).alias("hits"))
    per_row = per_cell.groupBy(F.col("cell_id.row").alias("__row")).agg(
        F.map_from_entries(F.collect_list(F.struct("cell_id.column", "hits"))).alias("__hits")
    )
    joined = df.join(per_row, F.col(row_id) == F.col("__row"), "left")
    out = {}
    for c in columns:
        mine = F.try_element_at("__hits", F.lit(c))
        cell = F.col(f"`{c}`").cast("string")
        out[c] = F.when(mine.isNotNull(), write_back(F.when(mine.isNotNull(), cell), mine)).otherwise(cell)
    return joined.withColumns(out).drop("__row", "__hits")


def redact_shared_text(texts: DataFrame, points: DataFrame) -> DataFrame:
    """(id, text) with every protected point that a text spells removed; one text, many points.

    A single axis is enough here: each token close to some protected axis is replaced."""
    tokens = texts.filter(might_hold_point(F.col("text"))).select("id", F.explode(point_tokens(F.col("text"))).alias("t")).select(
        "id", "t.*"
    ).filter(~F.col("bare"))
    axes = points.select(F.abs("lat").alias("size"), "grid", F.col("pub_lat").alias("published")).unionByName(
        points.select(F.abs("lon").alias("size"), "grid", F.col("pub_lon").alias("published"))
    ).groupBy("size", "grid").agg(F.max("published").alias("published"))
    span = F.ceil(F.col("grid")).cast("int")
    keyed = axes.withColumn(
        "band", F.explode(F.sequence(F.floor(F.col("size") - F.col("grid")), F.floor(F.col("size") + F.col("grid")), span.cast("bigint")))
    )
    near = (F.abs(F.col("t.value") - F.col("a.size")) < F.col("a.grid")) & (F.col("t.step") < F.col("a.grid"))
    hits = tokens.withColumn("band", F.floor("value")).alias("t").join(keyed.alias("a"), (F.col("t.band") == F.col("a.band")) & near)
    best = hits.groupBy("id", "stage", "start", "len").agg(
        F.min_by("published", F.struct(F.abs(F.col("value") - F.col("size")), F.col("published"))).alias("published")
    )
    per_text = best.groupBy("id").agg(F.collect_list(F.struct("stage", "start", "len", "published")).alias("__hits"))
    joined = texts.join(per_text, "id", "left")
    clean = write_back(F.when(F.col("__hits").isNotNull(), F.col("text")), F.col("__hits"))
    return joined.withColumn("text", F.when(F.col("__hits").isNotNull(), clean).otherwise(F.col("text"))).drop("__hits")


def clean_justification(justification: str, points: DataFrame) -> str:
    """The custodian's text without the protected points it spells; one row, read back once per export."""
    if not justification.strip():
        return ""
    one = points.sparkSession.createDataFrame([(0, justification.strip())], "id int, text string")
    return redact_shared_text(one, points).first()["text"].strip()


def point_text_rows(plan: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows of a protected species without a usable point whose text cells still hold a coordinate."""
    no_point = F.col("p_lat").isNull() | F.col("p_lon").isNull()
    tier_digits = F.greatest(F.lit(1), F.round(-F.log10(F.coalesce("p_grid", F.lit(0.1)))).cast("int"))
    skip = {row_id, "scientificName", "decimalLatitude", "decimalLongitude", "footprintSRS", "occurrenceID"}
    columns = [c for c in plan.columns if c not in skip and not c.startswith("p_")]
    checks = []
    for c in columns:
        cell = F.col(f"`{c}`").cast("string")
        if _own_number_term(c):
            cell = F.when(M.number(F.regexp_replace(text(cell), "^([^,]*),", "$1.")).isNull(), cell)
        if c == "dataGeneralizations":
            cell = F.when(~is_generalisation_note(cell), cell)
        by_mask = F.col("p_withheld") & F.lit(c in LOCATION_COLUMNS)
        checks.append(~by_mask & (has_point_text(cell, tier_digits) | has_projected_point(cell)))
    rows = plan.filter(F.col("p_grid").isNotNull() & F.col("p_category").isNotNull() & no_point)
    return rows.filter(any_of(checks)).select(row_id)


def copy_review(plan: DataFrame, columns: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """(row_id, problem): rows whose text carries projected coordinates of a protected record."""
    hidden = F.col("p_target") | F.col("p_withheld")
    blanked = {"decimalLatitude", "decimalLongitude", "footprintWKT", "footprintSRS", *VERBATIM_COLUMNS, row_id}
    names = [c for c in (columns or plan.columns) if c not in blanked and not c.startswith("p_") and not coordinate_like_header(c)]
    checks = []
    for c in names:
        cell = F.col(f"`{c}`").cast("string")
        checks.append(has_projected_point(F.when(~hidden, cell) if c in PLACE_TEXT_COLUMNS else cell))
    rows = plan.filter((hidden | F.col("p_kept")) & any_of(checks))
    return rows.select(row_id, F.lit("projected_point").alias("problem"))


def headers_with_points(headers: DataFrame, points: DataFrame) -> DataFrame:
    """Headers (id, text) that spell a protected point."""
    none = F.lit(None).cast("double")
    cells = headers.select(F.col("id").alias("cell_id"), "text", none.alias("own_lat"), none.alias("own_lon"))
    return find_point_copies(cells, points).select(F.col("cell_id").alias("id")).distinct()


def border_check(plan: DataFrame, index: DataFrame, cell: float, row_id: str = "row_id") -> DataFrame:
    """Country of the original against the published point of each moved row."""
    moved = plan.filter("p_target").select(row_id, "p_tier", "p_lat", "p_lon", "p_pub_lat", "p_pub_lon", "p_metres")
    placed = locate(locate(moved, index, "p_lon", "p_lat", "__a", cell), index, "p_pub_lon", "p_pub_lat", "__b", cell)
    crosses = F.col("__a").isNotNull() & ~F.col("__a.admin").eqNullSafe(F.col("__b.admin"))
    return placed.select(
        row_id, F.col("p_tier").alias("tier"), F.col("__a.admin").alias("country_orig"),
        F.col("__b.admin").alias("country_gen"), crosses.alias("crosses"),
    )


def species_overview(df: DataFrame, threatened: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Sensitive species with their records and located records."""
    marked = resolve_sensitivity(df, threatened, decisions).filter("sensitive")
    located = C.usable_point(C.coord_number("decimalLatitude"), C.coord_number("decimalLongitude"))
    return marked.groupBy("scientificName").agg(
        F.min("category").alias("category"), F.count("*").alias("n_records"), F.count_if(located).alias("n_located")
    )


