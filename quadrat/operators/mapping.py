"""Source columns to target terms: projection, order, patches, diffs and measurements."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import dates as D
from quadrat.functions import numbers as M
from quadrat.functions.coords import convert_coordinates, grid_round, usable_point
from quadrat.functions.jsontext import json_from_columns
from quadrat.functions.text import (
    any_of, as_col, blank_to_null, drop_empty_tokens, is_blank, lookup, match_form, quote_formula,
    semicolon_list, text,
)
from quadrat.lookups import (
    CLASS_ORDER, LICENSE_KEYS, LICENSE_NAMES, LIST_TERMS, PREFERRED_ORDER, VOCABULARY_TERMS, core_terms,
    measurement_terms, term_catalogue_rows,
)
from quadrat.operators import vocabularies as V
from quadrat.operators.countries import derive_country_code, with_alpha2
from quadrat.operators.ids import resolve_ids
from quadrat.operators.numbering import last_per_key
from quadrat.operators.taxa import TAXON_TERMS, refresh_taxon_terms, with_name_parts

COORDINATE_AXES = {"decimalLatitude": "lat", "decimalLongitude": "lon"}
VALUE_COLUMN = re.compile(r"^measurementValue \[(.*)\]$")


@dataclass
class MappingSpec:
    """Which source columns feed which term, and what overrides them."""

    columns: dict[str, list[str]]
    constants: dict[str, str] = field(default_factory=dict)
    json_keys: dict[str, str] = field(default_factory=dict)
    basis_decisions: DataFrame | None = None
    establishment: DataFrame | None = None
    invasive: DataFrame | None = None

    def overridden(self) -> list[str]:
        return [t for t, v in self.constants.items() if v and v.strip()]

    def sources(self, skip: list[str] = ()) -> list[str]:
        return list(dict.fromkeys(c for t, cols in self.columns.items() if t not in skip for c in cols))


def fill_missing(value: Column | str, fallback: Column | str) -> Column:
    return F.coalesce(blank_to_null(value), as_col(fallback))


def license_key(value: Column | str) -> Column:
    v = F.regexp_replace(F.lower(text(value)), "^https?://", "")
    return lookup(LICENSE_KEYS, F.regexp_replace(F.regexp_replace(v, "/legalcode/?$", ""), "/+$", ""))


def license_name(value: Column | str) -> Column:
    """One of the three known names; other text stays as it is."""
    return F.coalesce(lookup(LICENSE_NAMES, license_key(value)), as_col(value))


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def list_cell(value: Column, split: bool = True) -> Column:
    return blank_to_null(semicolon_list(value)) if split else blank_to_null(value)


def joined_cells(columns: list[str]) -> Column:
    """Filled cells of several columns as one ` | ` list."""
    if len(columns) == 1:
        return list_cell(_quoted(columns[0]))
    parts = [drop_empty_tokens(list_cell(_quoted(c))) for c in columns]
    return F.nullif(F.concat_ws(" | ", *parts), F.lit(""))


def term_column(term: str, columns: list[str], json_keys: dict[str, str] | None = None) -> Column:
    """Value expression of one term, chosen from the term name and the number of columns."""
    first = _quoted(columns[0])
    if term == "basisOfRecord":
        return V.basis_of_record(first)
    if term == "occurrenceStatus":
        return V.map_vocabulary(term, V.occurrence_status(first))
    if term in VOCABULARY_TERMS and len(columns) == 1:
        return V.map_vocabulary(term, list_cell(first))
    if term == "dynamicProperties":
        return json_from_columns(columns, json_keys)
    if term == "eventDate" and len(columns) in (2, 3, 4, 6):
        composed = D.event_date_from_columns(columns)
        if composed is not None:
            return F.coalesce(composed, joined_cells(columns))
    if len(columns) == 1:
        return list_cell(first, split=term in LIST_TERMS)
    return joined_cells(columns)


def composed_date_failed(columns: list[str]) -> Column:
    """Rows whose date parts hold something but compose no date."""
    composed = D.event_date_from_columns(columns) if len(columns) in (2, 3, 4, 6) else None
    if composed is None:
        return F.lit(False)
    return any_of([~is_blank(_quoted(c)) for c in columns]) & composed.isNull()


def is_pair_selection(spec: MappingSpec) -> bool:
    """Both axes come from the same single column."""
    lat, lon = spec.columns.get("decimalLatitude", []), spec.columns.get("decimalLongitude", [])
    return len(lat) == 1 and lat == lon


def measurement_value_column(source: str) -> str:
    return f"measurementValue [{source}]"


def is_measurement_column(name: str) -> bool:
    return name == "measurementValue" or bool(VALUE_COLUMN.match(name))


def non_empty_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least one filled cell; one aggregate, one row back."""
    if not columns:
        return []
    row = df.agg(*[F.bool_or(~is_blank(_quoted(c))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"c{i}"]]


def map_terms(
    df: DataFrame, spec: MappingSpec, as_of_year: int | None = None, row_id: str = "row_id",
    ids: DataFrame | None = None, keep_source: bool = False,
) -> DataFrame:
    """Project source columns to target terms.

    Constants win over columns. Identifiers come from `ids` (row_id, occurrenceID) or are resolved
    here. Taxon terms are derived from the name. NULL stays NULL; sinks write it as ''."""
    terms = core_terms() + [t for t in spec.columns if t not in core_terms()]
    out: dict[str, Column] = {}
    for term in terms:
        columns = [c for c in spec.columns.get(term, []) if c in df.columns]
        constant = (spec.constants.get(term) or "").strip()
        if term == "occurrenceID":
            continue
        if constant:
            out[term] = F.lit(constant)
        elif term == "measurementValue" and len(columns) > 1:
            out |= {measurement_value_column(c): list_cell(_quoted(c)) for c in columns}
        elif columns:
            out[term] = term_column(term, columns[:1] if term == "scientificName" else columns, spec.json_keys)
    if ids is None:
        source = (spec.columns.get("occurrenceID") or [None])[0]
        resolved = resolve_ids(df, source, row_id).select(row_id, F.col("occurrenceID").alias("__id"))
    else:
        resolved = ids.select(row_id, F.col("occurrenceID").alias("__id"))
    base = df
    if spec.basis_decisions is not None and "basisOfRecord" in spec.columns and "basisOfRecord" in out:
        base = V.map_basis_of_record(base, spec.columns["basisOfRecord"][0], spec.basis_decisions, "__basis")
        out["basisOfRecord"] = F.col("__basis")
    base = _add_establishment(base, spec, out)
    base = base.join(resolved, row_id)
    extra = [_quoted(c).alias(f"__src_{c}") for c in df.columns if c != row_id] if keep_source else []
    mapped = base.select(
        row_id, F.col("__id").alias("occurrenceID"), *[v.alias(t) for t, v in out.items()], *extra
    )
    mapped = D.fix_dates(mapped, [t for t in D.DATE_TERMS if t in out], as_of_year)
    axes = {t: a for t, a in COORDINATE_AXES.items() if t in out and t not in spec.overridden()}
    if axes:
        mapped = convert_coordinates(mapped, axes, is_pair_selection(spec))
    return add_taxon_terms(mapped) if "scientificName" in out else mapped


def _add_establishment(df: DataFrame, spec: MappingSpec, out: dict[str, Column]) -> DataFrame:
    names = spec.columns.get("scientificName")
    if spec.establishment is None or not names:
        return df
    species, island = names[0], None
    lat, lon = spec.columns.get("decimalLatitude"), spec.columns.get("decimalLongitude")
    if spec.invasive is not None and lat and lon:
        df = V.with_establishment_island(df, spec.invasive, species, lat[0], lon[0], "__island_name")
        island = "__island_name"
    for term, kind in (("establishmentMeans", "means"), ("degreeOfEstablishment", "degree")):
        mapped = spec.columns.get(term, [None])[0]
        df = V.with_establishment(df, spec.establishment, species, kind, mapped, island, f"__{term}")
        out[term] = F.col(f"__{term}")
    return df


def add_taxon_terms(df: DataFrame) -> DataFrame:
    """Derived taxon terms, authorship and qualifier fill blanks; the name itself loses its author."""
    parsed = with_name_parts(df, "scientificName", "__parts")
    filled = {}
    for term in (*TAXON_TERMS, "identificationQualifier"):
        derived = F.col(f"__parts.{term}")
        filled[term] = fill_missing(term, derived) if term in df.columns else derived
    filled["scientificName"] = F.coalesce(F.col("__parts.canonicalName"), F.col("scientificName"))
    return parsed.withColumns(filled).drop("__parts")


def ordered_columns(columns: list[str], row_id: str = "row_id") -> list[str]:
    """Term class, preferred place in the class, catalogue place; unknown columns last as they came."""
    catalogue = term_catalogue_rows()
    class_of = {r[0]: r[1] for r in catalogue}
    place = {r[0]: i for i, r in enumerate(catalogue)}
    preferred = {t: i for cls in PREFERRED_ORDER.values() for i, t in enumerate(cls)}
    classes = {c: i for i, c in enumerate(CLASS_ORDER)}
    far = len(catalogue)

    def rank(item: tuple[int, str]) -> tuple:
        i, name = item
        cls = classes.get(class_of.get(name, ""), far)
        return (name != row_id, cls, preferred.get(name, far), place.get(name, far), i)

    return [name for _, name in sorted(enumerate(columns), key=rank)]


def order_columns(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.select(*[_quoted(c) for c in ordered_columns(df.columns, row_id)])


def geodetic_datum(df: DataFrame) -> DataFrame:
    """`EPSG:4326` for in-range points whose datum is blank."""
    if not {"decimalLatitude", "decimalLongitude"} <= set(df.columns):
        return df
    lat = F.col("decimalLatitude").try_cast("double")
    lon = F.col("decimalLongitude").try_cast("double")
    valid = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    current = F.col("geodeticDatum") if "geodeticDatum" in df.columns else F.lit(None).cast("string")
    return df.withColumn("geodeticDatum", F.when(valid & is_blank(current), F.lit("EPSG:4326")).otherwise(current))


def clean_separators(df: DataFrame) -> DataFrame:
    """Coordinates as numbers; text that is no number becomes NULL."""
    return df.withColumns(
        {c: F.replace(F.col(c).cast("string"), F.lit(","), F.lit(".")).try_cast("double")
         for c in COORDINATE_AXES if c in df.columns}
    )


def normalise_for_export(
    df: DataFrame, as_of_year: int | None = None, row_id: str = "row_id", reference: DataFrame | None = None
) -> DataFrame:
    """Dates, coordinate numbers, identifiers, licence, datum, country code, column order."""
    out = clean_separators(D.fix_dates(df, D.DATE_TERMS, as_of_year))
    out = resolve_ids(out, None, row_id).drop("id_origin")
    if "license" in out.columns:
        out = out.withColumn("license", license_name("license"))
    out = geodetic_datum(out)
    if "country" in out.columns:
        out = derive_country_code(out, reference, texts=df)
    if "countryCode" in out.columns:
        out = with_alpha2(out, "countryCode", reference)
    return order_columns(out, row_id)


# ---- unmapped source columns -------------------------------------------------------------------

# Header words that mark a coordinate column.
COORDINATE_WORDS = {
    "lat", "latitude", "latitud", "lon", "long", "longitude", "longitud", "lng", "x", "y", "utm", "wkt",
    "gps", "easting", "northing", "footprint",
}


def coordinate_like_header(name: str) -> bool:
    words = re.split("[^a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", name).lower())
    return any(w in COORDINATE_WORDS or w.startswith("coord") for w in words)


def unmapped_columns(df: DataFrame, spec: MappingSpec, row_id: str = "row_id") -> list[str]:
    """Filled source columns no term uses. A column whose term a constant overrides counts as unused."""
    used = set(spec.sources(skip=spec.overridden()))
    return non_empty_columns(df, [c for c in df.columns if c not in used and c != row_id])


def unmapped_names(taken: list[str], extras: list[str]) -> dict[str, str]:
    """Output name per extra column: a clash gets `_original`, then a number."""
    names: dict[str, str] = {}
    seen = set(taken)
    for c in extras:
        base = f"{c}_original" if c in taken else c
        name, n = base, 0
        while name in seen:
            n += 1
            name = f"{base}_{n}"
        seen.add(name)
        names[c] = name
    return names


def append_unmapped(mapped: DataFrame, extras: list[str], prefix: str = "__src_") -> DataFrame:
    """Keep unmapped source cells (carried as `__src_<name>`) at the right of the mapped terms."""
    carried = [c for c in mapped.columns if c.startswith(prefix)]
    terms = [c for c in mapped.columns if c not in carried]
    names = unmapped_names(terms, extras)
    return mapped.select(*[_quoted(c) for c in terms], *[_quoted(prefix + c).alias(names[c]) for c in extras])


def blank_coordinate_cells(
    df: DataFrame, columns: list[str], protected: Column, lat: Column, lon: Column, grid: Column
) -> DataFrame:
    """On protected rows blank cells that could hold the point: coordinate headers, a number closer to
    the real point than one grid step, a cell with a degree sign. Other text is redacted."""
    from quadrat.functions.redaction import redact_copies

    step = F.when(grid > 0, grid).otherwise(F.lit(1e-6))
    movable = usable_point(lat, lon)
    from quadrat.functions.numbers import plain_number_text

    shown = {
        axis: F.coalesce(F.when(movable, plain_number_text(grid_round(v, step))), F.lit(""))
        for axis, v in (("lat", lat), ("lon", lon))
    }
    texts = {f"__{i}": _quoted(c) for i, c in enumerate(columns) if not coordinate_like_header(c)}
    df = redact_copies(df, texts, lat, lon, step, shown["lat"], shown["lon"], dict.fromkeys(texts, protected)) if texts else df
    out = {}
    for i, c in enumerate(columns):
        cell = _quoted(c)
        if coordinate_like_header(c):
            out[c] = F.when(protected, F.lit(None).cast("string")).otherwise(cell)
            continue
        num = M.number(F.regexp_replace(text(cell), "^([^,]*),", "$1."))
        near = F.coalesce(F.abs(num - lat) < step, F.lit(False)) | F.coalesce(F.abs(num - lon) < step, F.lit(False))
        hidden = near | F.coalesce(cell.contains("°"), F.lit(False))
        out[c] = F.when(protected & hidden, F.lit(None).cast("string")).when(protected, F.col(f"__{i}")).otherwise(cell)
    return df.withColumns(out).drop(*texts)


# ---- measurements ------------------------------------------------------------------------------


def suggest_measurements(df: DataFrame, exclude: list[str] = (), min_share: float = 0.8) -> dict[str, str]:
    """{column: unit} for headers that end in a unit and hold mostly measurements."""
    named = {c: M.header_unit(c) for c in df.columns if c not in exclude}
    named = {c: u for c, u in named.items() if u}
    if not named:
        return {}
    row = df.agg(*[measure_share(_quoted(c)).alias(f"c{i}") for i, c in enumerate(named)]).first()
    return {c: u for i, (c, u) in enumerate(named.items()) if (row[f"c{i}"] or 0.0) >= min_share}


def measure_share(cell: Column) -> Column:
    """Aggregate: share of filled cells that read as a measurement."""
    filled = F.count_if(~is_blank(cell))
    return F.when(filled > 0, F.count_if(~is_blank(cell) & M.measure_like(cell)) / filled)


def split_measurements(
    df: DataFrame, column: str | None = None, specs: dict[str, dict[str, str]] | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(core, measurements): wide value columns become rows keyed by occurrenceID.

    A spec of a source column (unit, method, ...) beats the row's own measurement terms."""
    specs = specs or {}
    wide = [c for c in df.columns if VALUE_COLUMN.match(c)]
    value_columns = wide or (["measurementValue"] if "measurementValue" in df.columns else [])
    if not value_columns or "occurrenceID" not in df.columns:
        return df, None
    known = measurement_terms()
    present = [t for t in known if t in df.columns]
    asked = [t for t in known if t in present or any(t in s for s in specs.values())]
    shared = ["measurementType"] + [
        t for t in asked if t not in ("measurementID", "measurementValue", "measurementType")
    ]
    sources = {v: VALUE_COLUMN.match(v).group(1) for v in wide} or {"measurementValue": column}
    ids = text("occurrenceID")
    rows = []
    for value_column, source in sources.items():
        spec = specs.get(source or "", {})
        own_id = not wide and "measurementID" in present
        fields = {
            "occurrenceID": ids,
            "measurementID": text("measurementID") if own_id
            else F.concat(ids, F.lit(f":{source}")) if source else F.lit(""),
            "measurementValue": text(_quoted(value_column)),
        }
        for term in shared:
            given = (spec.get(term) or "").strip()
            from_row = term in df.columns and not (wide and term == "measurementType")
            fields[term] = F.lit(given) if given else text(term) if from_row else F.lit("")
        if source:
            kind = fields["measurementType"]
            fields["measurementType"] = F.when(kind == "", F.lit(source)).otherwise(kind)
        rows.append(F.struct(*[v.alias(k) for k, v in fields.items()]))
    lead = ["occurrenceID", "measurementID", "measurementType", "measurementValue", "measurementUnit"]
    names = [t for t in lead if t in ("occurrenceID", "measurementID", "measurementValue", *shared)]
    names += [t for t in shared if t not in names]
    long = df.select(F.explode(F.array(*rows)).alias("m")).select(*[F.col(f"m.{t}") for t in names])
    core = df.drop(*[c for c in df.columns if c in known or c in value_columns])
    return core, long.filter("measurementValue <> ''")


# ---- cell edits --------------------------------------------------------------------------------


def latest_edits(edits: DataFrame) -> DataFrame:
    """Last edit (by seq) per row, term and from value; row_id NULL is a column-wide edit."""
    clean = edits.select("row_id", "term", F.coalesce("from", F.lit("")).alias("from"), "to", "seq")
    return last_per_key(clean, ["row_id", "term", "from"], [F.col("seq")])


def apply_edits(df: DataFrame, edits: DataFrame, terms: list[str], row_id: str = "row_id") -> DataFrame:
    """Change cells that still equal `from`: a row edit beats a column-wide one, blank `to` clears.

    `terms` are the terms the edits touch. Edit tables hold hand-made changes, so their joins are
    broadcast while they stay under the session's size limit."""
    latest = latest_edits(edits.filter(F.col("term").isin(*terms)))
    by_row = latest.filter(F.col("row_id").isNotNull())
    bulk = latest.filter(F.col("row_id").isNull())
    out = df
    for term in [t for t in terms if t in df.columns]:
        key = text(_quoted(term))
        wide = bulk.filter(F.col("term") == term).select(F.col("from").alias("__bf"), F.col("to").alias("__bt"), F.lit(True).alias("__bh"))
        single = by_row.filter(F.col("term") == term).select(
            F.col("row_id").alias("__rr"), F.col("from").alias("__rf"), F.col("to").alias("__rt"), F.lit(True).alias("__rh")
        )
        out = out.withColumn("__key", key).join(wide, F.col("__key") == F.col("__bf"), "left")
        out = out.join(single, (F.col(row_id) == F.col("__rr")) & (F.col("__key") == F.col("__rf")), "left")
        value = F.when(F.col("__rh"), F.col("__rt")).when(F.col("__bh"), F.col("__bt")).otherwise(_quoted(term))
        out = out.withColumn("__value", blank_to_null(value))
        out = out.withColumn(
            "__value", F.when(F.col("__value").isNotNull(), value)
        ).drop(*([term] if term != "scientificName" else []), "__key", "__bf", "__bt", "__bh", "__rr", "__rf", "__rt", "__rh")
        if term == "scientificName":
            out = out.withColumnRenamed("scientificName", "__before").withColumnRenamed("__value", "scientificName")
        else:
            out = out.withColumnRenamed("__value", term)
    if "__before" in out.columns:
        out = refresh_taxon_terms(out, "__before").drop("__before")
    names = df.columns + [c for c in out.columns if c not in df.columns]
    return out.select(*[_quoted(c) for c in names])


def check_edit_values(edits: DataFrame, as_of_year: int | None = None, decimal_dot: bool = False) -> DataFrame:
    """Validate proposed cell values: adds `value` (normalised) and `error` (a key, NULL when fine)."""
    staged = edits.withColumn("__v", text("to")).withColumn("__low", F.lower(text("to")))
    staged = D.dates_to_iso(staged, ["__v"], as_of_year, None, "__iso", "__amb")
    v, term = F.col("__v"), F.col("term")
    result, error = [], []

    def rule(applies: Column, value: Column, ok: Column, key: str) -> None:
        result.append((applies, F.when(ok, value)))
        error.append((applies & ~F.coalesce(ok, F.lit(False)), F.lit(key)))

    for t in VOCABULARY_TERMS:
        rule(term == t, F.col("__low"), (v == "") | F.col("__low").isin(*V.CONCEPTS[t]), "err_vocabulary")
    blank = v == ""
    rule(blank & term.isin("scientificName", "basisOfRecord", "occurrenceID"), v, F.lit(False), "err_blank")
    rule(blank, v, F.lit(True), "")
    basis = V.basis_of_record(v)
    rule(term == "basisOfRecord", basis, basis != "", "err_basis_of_record")
    dated = term.isin(*D.DATE_TERMS)
    iso = D.is_iso_date(v)
    rule(dated & iso, v, F.lit(True), "")
    rule(dated & F.col("__v__amb"), v, F.lit(False), "err_date_ambiguous")
    rule(dated, F.col("__v__iso"), F.col("__v__iso").isNotNull(), "err_date")
    when_time = F.when(D.is_iso_time(v), v).otherwise(D.suggest_event_time(v))
    rule(term == "eventTime", when_time, when_time.isNotNull(), "err_time")
    metres = F.when(M.uncertainty_ok(v, decimal_dot), v).otherwise(M.suggest_uncertainty(v, decimal_dot))
    rule(term == "coordinateUncertaintyInMeters", metres, metres.isNotNull(), "err_uncertainty")
    from quadrat.functions.coords import coord_ok, suggest_coordinate

    for t, limit in (("decimalLatitude", 90), ("decimalLongitude", 180)):
        degrees = F.when(coord_ok(v, limit), v).otherwise(suggest_coordinate(v, limit))
        rule(term == t, degrees, degrees.isNotNull(), "err_coordinate")
    rule(term == "individualCount", v, v.rlike(r"^\d+$"), "err_count")
    measured = (term == "measurementValue") | term.startswith("measurementValue [")
    comma = v.rlike(M.DECIMAL_COMMA) & M.measure_decimal(v).isNotNull()
    rule(measured & comma, M.measure_decimal(v), F.lit(True), "")
    rule(measured & M.has_measure_unit(v), v, F.lit(False), "err_measure_unit")
    rule(measured, v, M.is_measure_number(v), "err_measure_number")
    whole = F.when(v.rlike(r"^\d{1,4}$"), v.try_cast("int"))
    for t, top in (("year", 9999), ("month", 12), ("day", 31)):
        rule(term == t, whole.cast("string"), whole.between(1, top), "err_number")
    rule(F.lit(True), v, F.lit(True), "")

    def chain(pairs: list[tuple[Column, Column]]) -> Column:
        return reduce(lambda acc, p: F.when(p[0], p[1]).otherwise(acc), reversed(pairs), F.lit(None).cast("string"))

    out = staged.withColumn("value", chain(result))
    out = out.withColumn("error", F.when(F.col("value").isNull(), chain([(c, k) for c, k in error])))
    return out.drop("__v", "__low", "__v__iso", "__v__amb")


# ---- plans over mapping metadata ---------------------------------------------------------------


def duplicate_sources(pairs: DataFrame, pair_columns: list[str] = ()) -> DataFrame:
    """(dataset, column, terms): a source column that feeds two or more terms.

    pairs: dataset, term, column, position. Verbatim terms and coordinate-pair columns are exempt.
    A dataset has at most one row per catalogue term, so the collected list is short."""
    first = pairs.filter((F.col("position") == 0) & ~F.lower("term").contains("verbatim") & ~is_blank("column"))
    grouped = first.groupBy("dataset", F.trim("column").alias("column")).agg(
        F.sort_array(F.collect_set("term")).alias("terms")
    ).filter(F.size("terms") >= 2)
    axes = F.array(F.lit("decimalLatitude"), F.lit("decimalLongitude"))
    if pair_columns:
        grouped = grouped.filter(~(F.col("column").isin(*pair_columns) & (F.col("terms") == axes)))
    return grouped


def restore_plan(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """Which terms of saved mappings each dataset can take: (dataset, term, kind, matched, missing, constant, state).

    pairs: dataset, term, kind (column or constant), column, position, constant.
    columns: dataset, column. Lists are bounded by the columns one term names."""
    have = columns.select("dataset", "column", F.lit(True).alias("present"))
    joined = pairs.filter(~is_blank("term")).join(have, ["dataset", "column"], "left")
    hit = F.coalesce(F.col("present"), F.lit(False))
    entry = F.struct("position", "column")

    def listed(keep: Column) -> Column:
        return F.transform(
            F.sort_array(F.collect_list(F.when(keep & ~is_blank("column"), entry))), lambda x: x["column"]
        )

    grouped = joined.groupBy("dataset", "term", "kind").agg(
        listed(hit).alias("matched"), listed(~hit).alias("missing"), F.max("constant").alias("constant")
    )
    state = F.when(F.col("kind") == "constant", F.when(~is_blank("constant"), "applied")).otherwise(
        F.when(F.size("matched") > 0, "applied").when(F.size("missing") > 0, "skipped")
    )
    return grouped.withColumn("state", state).filter(F.col("state").isNotNull())


# Headers and language words of the dataset cards.
LICENSE_HEADERS = ("license", "licence", "licenca", "licencia")
LANGUAGE_HEADERS = ("language", "idioma", "lingua")
LANGUAGE_CODES = {
    "pt": "pt", "por": "pt", "portugues": "pt", "portuguese": "pt",
    "en": "en", "eng": "en", "english": "en", "ingles": "en",
    "es": "es", "spa": "es", "espanol": "es", "spanish": "es",
}


def card_values(df: DataFrame) -> DataFrame:
    """One row: licence and language when exactly one column of that name holds exactly one value."""
    heads = {c: re.sub("^(dcterms|dc) ", "", " ".join(D.fold_header(c))) for c in df.columns}

    def only(names: tuple[str, ...]) -> Column:
        hits = [c for c, h in heads.items() if h in names]
        if len(hits) != 1:
            return F.lit(None).cast("string")
        v = blank_to_null(_quoted(hits[0]))
        return F.when(F.min(v) == F.max(v), F.min(v))

    raw = df.agg(only(LICENSE_HEADERS).alias("l"), only(LANGUAGE_HEADERS).alias("g"))
    key = license_key(F.regexp_replace(F.lower("l"), "[ _-]+", "-"))
    word = F.regexp_replace(match_form("g"), " .*$", "")
    return raw.select(
        lookup(LICENSE_NAMES, key).alias("license"), lookup(LANGUAGE_CODES, word).alias("language")
    )


def sample_rows(df: DataFrame, n: int = 100, row_id: str = "row_id") -> DataFrame:
    """First rows by id, for a look at the result."""
    named = df.withColumn("license", license_name("license")) if "license" in df.columns else df
    return order_columns(named.orderBy(row_id).limit(n), row_id)


# ---- diffs -------------------------------------------------------------------------------------

CHANGE_KINDS = ("names", "coordinates", "country", "preview")
CHANGE_TERMS = {
    "names": ("scientificName",), "coordinates": ("decimalLatitude", "decimalLongitude"), "country": ("country",),
}


def cell_changes(before: DataFrame, after: DataFrame, terms: list[str], row_id: str = "row_id") -> DataFrame:
    """(row_id, term, from, to) of cells that differ between two versions of a table."""
    shared = [t for t in terms if t in before.columns and t in after.columns]
    old = before.select(row_id, *[text(_quoted(t)).alias(f"__o{i}") for i, t in enumerate(shared)])
    new = after.select(row_id, *[text(_quoted(t)).alias(f"__n{i}") for i, t in enumerate(shared)])
    cells = [
        F.struct(F.lit(t).alias("term"), F.col(f"__o{i}").alias("from"), F.col(f"__n{i}").alias("to"))
        for i, t in enumerate(shared)
    ]
    joined = old.join(new, row_id)
    changed = joined.filter(any_of([F.col(f"__o{i}") != F.col(f"__n{i}") for i in range(len(shared))]))
    rows = changed.select(row_id, F.explode(F.array(*cells)).alias("c")).select(row_id, "c.term", "c.from", "c.to")
    return rows.filter(F.col("from") != F.col("to"))


def change_log(
    data: DataFrame, effective: DataFrame, edits: DataFrame | None = None, hidden: DataFrame | None = None,
    dropped: DataFrame | None = None, row_id: str = "row_id",
) -> DataFrame:
    """All cell changes by kind; values of generalised records are hidden except name and country."""
    everything = [t for terms in CHANGE_TERMS.values() for t in terms]
    kind_of = {t: k for k, terms in CHANGE_TERMS.items() for t in terms}
    log = cell_changes(data, effective, everything, row_id).withColumn("kind", lookup(kind_of, F.col("term")))
    if edits is not None:
        log = log.unionByName(edits.select(row_id, "term", "from", "to", F.lit("preview").alias("kind")))
    if dropped is not None:
        log = log.join(dropped.select(row_id), row_id, "left_anti")
    log = log.join(effective.select(row_id, "occurrenceID"), row_id, "left")
    if hidden is None:
        log = log.withColumn("generalized", F.lit(False))
    else:
        marks = hidden.select(row_id).distinct().withColumn("generalized", F.lit(True))
        log = log.join(marks, row_id, "left").withColumn("generalized", F.coalesce("generalized", F.lit(False)))
    hide = F.col("generalized") & ~F.col("term").isin("scientificName", "country")
    return log.select(
        row_id, "occurrenceID", "kind", "term",
        F.when(hide, "").otherwise(F.col("from")).alias("from"),
        F.when(hide, "").otherwise(F.col("to")).alias("to"), "generalized",
    )


def change_examples(log: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Per kind: records touched and the cells of the first record that may be shown."""
    per_row = log.groupBy("kind", row_id).agg(
        F.bool_or(~F.col("generalized") | F.col("term").isin("scientificName", "country")).alias("open")
    )
    return per_row.groupBy("kind").agg(
        F.count("*").alias("records"), F.min(F.when(F.col("open"), F.col(row_id))).alias("example_row")
    )


def log_for_file(log: DataFrame) -> DataFrame:
    """Old and new values that a spreadsheet would run get a leading apostrophe."""
    return log.withColumns({c: quote_formula(c) for c in ("from", "to")})


