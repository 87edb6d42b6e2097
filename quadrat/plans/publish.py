"""The export product: effective records, masking, status, normal form, copies, measurements, files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import coords as C
from quadrat.functions.jsontext import merge_property
from quadrat.functions.text import text
from quadrat.lookups import LICENSE_URIS
from quadrat.operators import generalise as G
from quadrat.operators import mapping as M
from quadrat.operators import payloads as P
from quadrat.operators import quality, stats
from quadrat.operators.countries import with_is_brazilian
from quadrat.operators.taxa import rekey_decisions, threatened_category
from quadrat.session import written

TERM_ROOT = "http://rs.tdwg.org/dwc/terms/"
DUBLIN_TERMS = {"type", "modified", "language", "license", "rightsHolder", "references", "bibliographicCitation"}
ROW_TYPES = {"occurrence": TERM_ROOT + "Occurrence", "measurementorfact": TERM_ROOT + "MeasurementOrFact"}


@dataclass
class ExportInputs:
    """What one export needs; tables that are NULL switch their step off."""

    records: DataFrame
    levels: DataFrame | None = None
    threatened: DataFrame | None = None
    decisions: DataFrame | None = None
    reviews: DataFrame | None = None
    ranks: DataFrame | None = None
    corrections: DataFrame | None = None
    fills: DataFrame | None = None
    red_list: DataFrame | None = None
    dropped: DataFrame | None = None
    edits: DataFrame | None = None
    national_status: bool = False
    justification: str = ""
    as_of_year: int | None = None
    #: row_id and the source columns no term uses, published at the right of the terms.
    extras: DataFrame | None = None


@dataclass
class ExportProduct:
    core: DataFrame = field(repr=False)
    measurements: DataFrame | None = field(repr=False)
    private: DataFrame | None
    changes: DataFrame
    #: What `rows_under_review` reads: the records before masking, their row plan, protected points, unmapped headers.
    records: DataFrame | None = None
    plan: DataFrame | None = None
    points: DataFrame | None = None
    headers: tuple[str, ...] = ()
    dropped: DataFrame | None = None


class LaterProduct(ExportProduct):
    """A product whose core and measurements are made when one of them is first asked for: the private table, the
    change log and the review read the row plan alone."""

    def __init__(self, make: Callable[[], tuple[DataFrame, DataFrame | None]], **known: object) -> None:
        vars(self).update(known)
        self._make = make

    @cached_property
    def _tables(self) -> tuple[DataFrame, DataFrame | None]:
        return self._make()

    @property
    def core(self) -> DataFrame:
        return self._tables[0]

    @property
    def measurements(self) -> DataFrame | None:
        return self._tables[1]


def conservation_status(
    df: DataFrame, threatened: DataFrame | None = None, red_list: DataFrame | None = None, generalised: DataFrame | None = None, row_id: str = "row_id"
) -> DataFrame:
    """National and red-list categories as dynamicProperties keys. The national list only counts for
    national records and for generalised ones."""
    out = df if "dynamicProperties" in df.columns else df.withColumn("dynamicProperties", F.lit(""))
    if threatened is not None:
        out = threatened_category(with_is_brazilian(out, "__br"), threatened).withColumnsRenamed({"category": "__cat", "source": "__src"})
        if generalised is not None:
            marks = generalised.select(row_id).distinct().withColumn("__gen", F.lit(True))
            out = out.join(marks, row_id, "left").withColumn("__br", F.col("__br") | F.coalesce("__gen", F.lit(False))).drop("__gen")
        for key, column in (("mmaThreatStatus", "__cat"), ("mmaSource", "__src")):
            out = out.withColumn("dynamicProperties", merge_property("dynamicProperties", key, F.when(F.col("__br"), F.col(column))))
        out = out.drop("__br", "__cat", "__src")
    if red_list is not None:
        side = red_list.select(F.col("query_name").alias("__n"), F.col("code").alias("__code")).groupBy("__n").agg(F.min("__code").alias("__code"))
        out = out.join(side, F.col("scientificName") == F.col("__n"), "left")
        out = out.withColumn("dynamicProperties", merge_property("dynamicProperties", "iucnRedListCategory", F.col("__code"))).drop("__n", "__code")
    return out


def build_product(inputs: ExportInputs, row_id: str = "row_id") -> ExportProduct:
    """The whole export. Masking comes before number conversion (trailing zeros still tell the stored
    precision), status after masking. The row plan is written once to the checkpoint folder because the
    public table, the private table and the point set all read it; the public table is made when it is asked for."""
    effective = P.apply_payloads(inputs.records, inputs.reviews, inputs.ranks, inputs.corrections, inputs.fills)
    if effective is not inputs.records:
        effective = written(effective)
    masked, private, points, moved, whole = effective, None, None, None, None
    extras, names = inputs.extras, {}
    if extras is not None:
        names = M.unmapped_names([c for c in effective.columns], [c for c in extras.columns if c != row_id])
        extras = extras.select(row_id, *[F.col(f"`{c}`").cast("string").alias(n) for c, n in names.items()])
    if inputs.levels is not None and inputs.threatened is not None:
        decisions = inputs.decisions
        if decisions is not None and inputs.reviews is not None:
            decisions = rekey_decisions(decisions, inputs.reviews)
        plan = written(G.generalisation_plan(effective, inputs.levels, inputs.threatened, decisions))
        points = G.protected_points(plan)
        masked, private = G.mask_locations(plan, row_id, G.clean_justification(inputs.justification, points))
        moved = plan.filter("p_target OR p_withheld").select(row_id)
        whole = plan if extras is None else plan.join(extras, row_id, "left")
        if extras is not None:
            hidden = F.col("p_target") | F.col("p_withheld")
            clean = M.blank_coordinate_cells(whole, list(names.values()), hidden, F.col("p_lat"), F.col("p_lon"), F.col("p_eff_grid"))
            extras = clean.select(row_id, *[F.col(f"`{n}`") for n in names.values()])
    if private is not None and inputs.dropped is not None:
        private = private.join(inputs.dropped.select(row_id), row_id, "left_anti")

    def public() -> tuple[DataFrame, DataFrame | None]:
        shown = masked if points is None else written(masked)
        status = conservation_status(
            shown, inputs.threatened if inputs.national_status else None, inputs.red_list, moved, row_id
        )
        core = M.normalise_for_export(status, inputs.as_of_year, row_id)
        if extras is not None:
            core = core.join(extras, row_id, "left")
        if inputs.dropped is not None:
            core = core.join(inputs.dropped.select(row_id), row_id, "left_anti")
        if points is not None:
            core = written(core)
            keep = {row_id, "occurrenceID", "decimalLatitude", "decimalLongitude", "footprintWKT", "footprintSRS"}
            core = G.redact_point_pairs(core, points, [c for c in core.columns if c not in keep], row_id)
        return M.split_measurements(core)

    changes = M.change_log(inputs.records, effective, inputs.edits, moved, inputs.dropped, row_id)
    return LaterProduct(
        public, private=private, changes=changes, records=effective, plan=whole, points=points, headers=tuple(names), dropped=inputs.dropped)


def _unreadable_points(records: DataFrame, row_id: str) -> DataFrame:
    """(row_id, problem) of records with a coordinate that is no number or out of range."""
    bad = F.lit(False)
    for column, limit in (("decimalLatitude", 90), ("decimalLongitude", 180)):
        if column in records.columns:
            bad = bad | ((text(column) != "") & ~C.coord_ok(column, limit))
    return records.filter(bad).select(row_id, F.lit("coord_invalid").alias("problem"))


def _texts_under_review(plan: DataFrame, points: DataFrame, headers: list[str], row_id: str) -> DataFrame:
    """(row_id, problem): protected records whose texts, unmapped columns among them, still give a place away.

    A text with a point of a record that has none itself, a projected point, and a column header that spells one."""
    texts = G.point_text_rows(plan, row_id).select(row_id, F.lit("point_text").alias("problem"))
    found = texts.unionByName(G.copy_review(plan, row_id=row_id))
    if headers:
        names = plan.sparkSession.createDataFrame(list(enumerate(headers)), "id int, text string")
        spelled = G.headers_with_points(names, points)
        nobody = F.lit(None).cast(plan.schema[row_id].dataType).alias(row_id)
        found = found.unionByName(spelled.select(nobody, F.lit("point_in_header").alias("problem")))
    return found


def rows_under_review(product: ExportProduct, row_id: str = "row_id") -> DataFrame:
    """(row_id, problem): what must be looked at before the product may be written; row_id is null for headers."""
    found = _unreadable_points(product.records, row_id)
    if product.plan is not None:
        found = found.unionByName(_texts_under_review(product.plan, product.points, list(product.headers), row_id))
    return found if product.dropped is None else found.join(product.dropped.select(row_id), row_id, "left_anti")


def blockers(product: ExportProduct, row_id: str = "row_id") -> DataFrame:
    """(problem) rows that stop an export; empty when it may be written."""
    formulas = quality.formula_cells(product.core, row_id).limit(1).select(F.lit("formula_cell").alias("problem"))
    ready = stats.readiness(product.core).filter("blocked").select(F.lit("not_ready").alias("problem"))
    found = formulas.unionByName(ready)
    if product.measurements is not None:
        cells = quality.formula_cells(product.measurements.withColumn(row_id, F.lit(0)), row_id)
        found = found.unionByName(cells.limit(1).select(F.lit("formula_cell").alias("problem")))
    if product.records is not None:
        found = found.unionByName(rows_under_review(product, row_id).select("problem").distinct())
    return found.distinct()


def term_uri(name: str) -> str:
    return ("http://purl.org/dc/terms/" if name in DUBLIN_TERMS else TERM_ROOT) + name


def archive_descriptor(core: list[str], measurements: list[str] | None = None) -> str:
    """Descriptor of the archive; the field lists follow the columns of the tables."""
    def block(tag: str, name: str, columns: list[str], id_tag: str) -> str:
        ident = columns.index("occurrenceID")
        known = [(i, c) for i, c in enumerate(columns) if c[0].islower() and "[" not in c and " " not in c]
        fields = "\n".join(f'    <field index="{i}" term={quoteattr(term_uri(c))}/>' for i, c in known)
        return (
            f'  <{tag} encoding="UTF-8" fieldsTerminatedBy="," linesTerminatedBy="\\n" fieldsEnclosedBy="&quot;" '
            f'ignoreHeaderLines="1" rowType={quoteattr(ROW_TYPES[name])}>\n    <files><location>{name}</location></files>\n'
            f'    <{id_tag} index="{ident}"/>\n{fields}\n  </{tag}>'
        )

    parts = [block("core", "occurrence", core, "id")]
    if measurements:
        parts.append(block("extension", "measurementorfact", measurements, "coreid"))
    return '<?xml version="1.0" encoding="UTF-8"?>\n<archive xmlns="http://rs.tdwg.org/dwc/text/" metadata="eml.xml">\n' + "\n".join(parts) + "\n</archive>\n"


def dataset_metadata(title: str, license_key: str | None, extent: dict, masked: int = 0, review_date: str = "") -> str:
    """Dataset description with extents, licence and a note on generalised records."""
    rights = LICENSE_URIS.get(license_key or "", "")
    geo = "" if extent.get("west") is None else (
        "<geographicCoverage><boundingCoordinates>"
        + "".join(f"<{k}BoundingCoordinate>{extent[k]}</{k}BoundingCoordinate>" for k in ("west", "east", "north", "south"))
        + "</boundingCoordinates></geographicCoverage>"
    )
    time = "" if extent.get("first_day") is None else (
        f"<temporalCoverage><rangeOfDates><beginDate><calendarDate>{extent['first_day']}</calendarDate></beginDate>"
        f"<endDate><calendarDate>{extent['last_day']}</calendarDate></endDate></rangeOfDates></temporalCoverage>"
    )
    note = f"<additionalInfo><para>{masked} records are generalised. Review date: {escape(review_date)}.</para></additionalInfo>" if masked else ""
    right = f"<intellectualRights><para>{escape(rights)}</para></intellectualRights>" if rights else ""
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<eml:eml xmlns:eml="https://eml.ecoinformatics.org/eml-2.2.0"><dataset>'
        f"<title>{escape(title)}</title>{note}{right}<coverage>{geo}{time}</coverage></dataset></eml:eml>\n"
    )


def _write_csv(df: DataFrame, path: str, one_file: bool) -> None:
    table = df.select(*[text(F.col(f"`{c}`")).alias(c) for c in df.columns])
    (table.coalesce(1) if one_file else table).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def _write_text(df: DataFrame, content: str, path: str) -> None:
    df.sparkSession.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_archive(product: ExportProduct, path: str, title: str = "", today: str = "", one_file: bool = False, row_id: str = "row_id") -> None:
    """Core and measurement tables as CSV with descriptor and metadata. Refuses a blocked product.
    Private records never go here; see `write_private`."""
    found = blockers(product, row_id).limit(1).collect()
    if found:
        raise ValueError(f"export is blocked: {found[0][0]}")
    core = product.core.drop(row_id)
    _write_csv(core, f"{path}/occurrence", one_file)
    if product.measurements is not None:
        _write_csv(product.measurements, f"{path}/measurementorfact", one_file)
    extent = {}
    if {"decimalLatitude", "decimalLongitude", "eventDate"} <= set(core.columns):
        extent = stats.dataset_extents(core, today or "9999-12-31").first().asDict()
    masked = 0 if product.private is None else product.private.count()
    names = None if product.measurements is None else product.measurements.columns
    _write_text(core, archive_descriptor(core.columns, names), f"{path}/meta.xml")
    _write_text(core, dataset_metadata(title, None, extent, masked), f"{path}/eml.xml")


def write_private(product: ExportProduct, path: str, public_path: str) -> None:
    """Original points of moved and withheld records, all columns text, outside the public folder."""
    if path.rstrip("/").startswith(public_path.rstrip("/") + "/") or path.rstrip("/") == public_path.rstrip("/"):
        raise ValueError("private records must not be written inside the public folder")
    if product.private is not None:
        _write_csv(product.private, path, False)


def write_change_log(product: ExportProduct, path: str) -> None:
    _write_csv(M.log_for_file(product.changes), path, False)


