"""Problem cells of a mapped table: one wide pass, one row per problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import coords as C
from quadrat.functions import dates as D
from quadrat.functions import numbers as M
from quadrat.functions.text import any_of, formula_fix, is_blank, is_formula_like, literal_map, text, unbalanced_brackets
from quadrat.lookups import THREAT_CODES, VOCABULARY_TERMS
from quadrat.operators import vocabularies as V
from quadrat.operators.countries import resolved_tokens
from quadrat.operators.mapping import is_measurement_column, measure_share
from quadrat.operators.numbering import repeated_flag
from quadrat.operators.taxa import parsed_names
from quadrat.session import settled

# Problem types in display order with their family and whether one fix serves many cells.
PROBLEM_TYPES = {
    "vocab_unknown": ("vocab", True), "date_unparsed": ("date", True), "date_ambiguous": ("date", True),
    "year_range": ("year", True), "interval_inverted": ("interval", True), "date_mismatch": ("date_mismatch", True),
    "time_invalid": ("time", True), "count_invalid": ("count", True), "count_present_zero": ("count", False),
    "uncertainty_invalid": ("uncertainty", True), "measure_unit": ("measure", True), "measure_number": ("measure", True),
    "coord_invalid": ("coord", True), "coord_zero": ("coord", True), "name_hybrid": ("name", True),
    "name_multiple": ("name", True), "name_abbreviated": ("name", True), "name_placeholder": ("name", True),
    "name_extra_text": ("name", True), "name_authorship": ("name", True), "country_threat_code": ("country", True),
    "country_conflict": ("country", False), "cell_formula": ("formula", True), "required_empty": ("empty", False),
    "id_duplicate": ("id", False),
}
NAME_ISSUES = ("hybrid", "multiple", "abbreviated", "placeholder", "extra_text")
DATE_PART_POSITIONS = {"year": (1, 4), "month": (6, 2), "day": (9, 2)}


def problem_rank(type_: Column) -> Column:
    ranks = F.create_map(*[x for i, t in enumerate(PROBLEM_TYPES) for x in (F.lit(t), F.lit(i))])
    return F.try_element_at(ranks, type_)


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _problem(term: str, type_: str | Column, when: Column, value: Column, fix: Column | None = None) -> Column:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    fix = F.lit(None).cast("string") if fix is None else fix
    return F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(
            F.lit(term).alias("term"), kind.alias("type"), value.cast("string").alias("value"),
            fix.cast("string").alias("suggestion"),
        ),
    )


def detect_problems(
    df: DataFrame, as_of_year: int | None = None, reference: DataFrame | None = None, row_id: str = "row_id",
) -> DataFrame:
    """(row_id, term, type, family, bulk, value, suggestion, type_rank); the first check that hits a
    cell wins. Sort by (type_rank, row_id) to list problems in display order.

    Column-wide facts (number habits, measurement share) come as scalar subqueries of one aggregate;
    names, countries and identifiers are resolved per distinct value and joined."""
    year = as_of_year or D.this_year()
    columns = [c for c in df.columns if c != row_id]
    base, facts = _with_lookups(df, columns, year, reference, row_id)
    checks: dict[str, list[Column]] = {c: [] for c in columns}

    def add(term: str, type_: str | Column, when: Column, value: Column | None = None, fix: Column | None = None) -> None:
        checks[term].append(_problem(term, type_, when, text(_col(term)) if value is None else value, fix))

    for c in columns:
        add(c, "cell_formula", is_formula_like(_col(c)), fix=formula_fix(_col(c)))
    for c in [t for t in VOCABULARY_TERMS if t in columns]:
        v = text(_col(c))
        add(c, "vocab_unknown", (v != "") & ~V.is_concept(c, v), fix=V.vocabulary_suggestions(c, v))
    for c in [t for t in D.DATE_TERMS if t in columns]:
        bad = (text(_col(c)) != "") & ~F.col(f"__{c}_iso_ok")
        kind = F.when(F.col(f"{c}__amb"), "date_ambiguous").otherwise("date_unparsed")
        add(c, kind, bad)
    for c in [t for t in (*D.DATE_TERMS, "year") if t in columns]:
        add(c, "year_range", F.col(f"__{c}_year_bad"))
    if "eventDate" in columns:
        _date_checks(columns, add)
    if "individualCount" in columns:
        v = text(_col("individualCount"))
        add("individualCount", "count_invalid", (v != "") & ~v.rlike(r"^\d+$"), fix=M.suggest_count(v))
        if "occurrenceStatus" in columns:
            present = F.lower(text("occurrenceStatus")).isin("present", "presente")
            add("individualCount", "count_present_zero", v.rlike("^0+$") & present)
    if "eventTime" in columns:
        v = text("eventTime")
        add("eventTime", "time_invalid", (v != "") & ~D.is_iso_time(v), fix=D.suggest_event_time(v))
    if "coordinateUncertaintyInMeters" in columns:
        v = text("coordinateUncertaintyInMeters")
        dot = facts["dot"]
        add("coordinateUncertaintyInMeters", "uncertainty_invalid", (v != "") & ~M.uncertainty_ok(v, dot),
            fix=M.suggest_uncertainty(v, dot))
    for c in [c for c in columns if is_measurement_column(c)]:
        kind = M.measure_problem(_col(c))
        add(c, kind, (facts[f"share_{c}"] >= 0.8) & kind.isNotNull(), fix=M.suggest_measure(_col(c)))
    _coordinate_checks(columns, add)
    _name_checks(columns, add)
    for c in [t for t in ("scientificName", "basisOfRecord") if t in columns]:
        add(c, "required_empty", is_blank(_col(c)), F.lit(""))
    if "country" in columns:
        add("country", "country_threat_code", F.upper(text("country")).isin(*THREAT_CODES))
    if {"country", "countryCode"} <= set(columns):
        add("countryCode", "country_conflict", F.col("__iso_country") != F.col("__iso_code"))
    if "occurrenceID" in columns:
        add("occurrenceID", "id_duplicate", F.col("__repeated"))

    # The first hit per cell is a coalesce in check order, so no window over rows is needed.
    hits = F.array_compact(F.array(*[F.coalesce(*found) for found in checks.values() if found]))
    rows = base.select(row_id, F.explode(hits).alias("p")).select(row_id, "p.*")
    families = literal_map({t: f for t, (f, _) in PROBLEM_TYPES.items()})
    bulk = [t for t, (_, b) in PROBLEM_TYPES.items() if b]
    return rows.select(
        row_id, "term", "type", F.try_element_at(families, F.col("type")).alias("family"),
        F.col("type").isin(*bulk).alias("bulk"), "value", "suggestion", problem_rank(F.col("type")).alias("type_rank"),
    )


def _with_lookups(
    df: DataFrame, columns: list[str], year: int, reference: DataFrame | None, row_id: str
) -> tuple[DataFrame, dict[str, Column]]:
    """Everything a check needs beyond its own cell: staged dates, names, countries, repeats, column facts."""
    facts_wanted = {}
    if "coordinateUncertaintyInMeters" in columns:
        facts_wanted["dot"] = F.coalesce(F.bool_or(M.proves_decimal_dot("coordinateUncertaintyInMeters")), F.lit(False))
    for c in columns:
        if is_measurement_column(c):
            facts_wanted[f"share_{c}"] = F.coalesce(measure_share(_col(c)), F.lit(0.0))
    facts: dict[str, Column] = {}
    if facts_wanted:
        totals = df.agg(*[v.alias(f"f{i}") for i, v in enumerate(facts_wanted.values())])
        # Staged as columns: a subquery may not stand inside the functions that read an uncertainty.
        df = df.withColumns({f"__f{i}": totals.select(f"f{i}").scalar() for i in range(len(facts_wanted))})
        facts = {k: F.col(f"__f{i}") for i, k in enumerate(facts_wanted)}
    dated = [t for t in D.DATE_TERMS if t in columns]
    base = D.dates_to_iso(df, dated, year, None, "__iso", "__amb") if dated else df
    staged = {f"__{c}_iso_ok": D.is_iso_date(_col(c)) for c in dated}
    for c in [t for t in (*D.DATE_TERMS, "year") if t in columns]:
        flags = D.year_range_flags(_col(c), max_year=year)
        staged[f"__{c}_year_bad"] = flags["future"] | flags["ancient"]
    base = base.withColumns(staged) if staged else base
    if "scientificName" in columns:
        issues = settled(parsed_names(df, "scientificName").select("__name", F.col("parts.nameIssue").alias("__issue")), "__name")
        base = base.join(issues, F.col("scientificName") == F.col("__name"), "left")
    if {"country", "countryCode"} <= set(columns):
        from quadrat.functions.text import country_token

        codes = settled(resolved_tokens(df, ["country", "countryCode"], reference), "token")
        for source, target in (("country", "__iso_country"), ("countryCode", "__iso_code")):
            side = codes.select(F.col("token").alias("__token"), F.col("iso3").alias(target))
            base = base.withColumn("__t", country_token(source)).join(
                side, F.col("__t") == F.col("__token"), "left").drop("__t", "__token")
    if "occurrenceID" in columns:
        base = repeated_flag(base, "occurrenceID", "__repeated")
    return base, facts


def _date_checks(columns: list[str], add) -> None:  # noqa: ANN001
    v = text("eventDate")
    start, end = D.interval_start(v), D.interval_end(v)
    width = F.least(F.length(start), F.length(end))
    inverted = (
        v.contains("/") & F.col("__eventDate_iso_ok") & end.rlike(r"^\d{4}")
        & (start.substr(F.lit(1), width) > end.substr(F.lit(1), width))
    )
    add("eventDate", "interval_inverted", inverted, fix=F.concat(end, F.lit("/"), start))
    single = ~v.contains("/") & F.col("__eventDate_iso_ok") & (v != "")
    for term, (pos, size) in DATE_PART_POSITIONS.items():
        if term in columns:
            ref = F.when(single & (F.length(v) >= pos + size - 1), F.substring(v, pos, size).try_cast("int"))
            p = text(term)
            given = F.floor(p.try_cast("double")).cast("int")
            bad = ref.isNotNull() & (p != "") & (given.isNull() | (given != ref))
            add(term, "date_mismatch", bad, fix=ref.cast("string"))


def _coordinate_checks(columns: list[str], add) -> None:  # noqa: ANN001
    axes = {t: limit for t, limit in (("decimalLatitude", 90), ("decimalLongitude", 180)) if t in columns}
    for c, limit in axes.items():
        v = text(c)
        add(c, "coord_invalid", (v != "") & ~C.coord_ok(v, limit), fix=C.suggest_coordinate(v, limit))
    if len(axes) == 2:
        def zero(c: str) -> Column:
            return F.coalesce(C.coord_number(text(c)) == 0, F.lit(False))

        filler = (zero("decimalLatitude") | is_blank("decimalLatitude")) & (
            zero("decimalLongitude") | is_blank("decimalLongitude")
        )
        for c in axes:
            add(c, "coord_zero", filler & zero(c))


def _name_checks(columns: list[str], add) -> None:  # noqa: ANN001
    if "scientificName" in columns:
        kind = F.concat(F.lit("name_"), F.col("__issue"))
        add("scientificName", kind, F.col("__issue").isin(*NAME_ISSUES))
    if "scientificNameAuthorship" in columns:
        v = text("scientificNameAuthorship")
        add("scientificNameAuthorship", "name_authorship", (v != "") & unbalanced_brackets(v))


def problem_counts(problems: DataFrame) -> DataFrame:
    return problems.groupBy("type").agg(F.count("*").alias("n"))


def dominant_problem(problems: DataFrame, n_rows: Column, min_share: float = 0.2, min_count: int = 20) -> DataFrame:
    """At most one row: the (type, term) that hits at least 20 records and a fifth of the table."""
    counted = problems.groupBy("type", "term").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "type", "term").limit(1)
    return top.withColumn("share", F.col("n") / n_rows).filter((F.col("n") >= min_count) & (F.col("share") >= min_share))


def match_edits(problems: DataFrame, edits: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Adds `edit_seq`: the edit that serves a problem, a row edit before a column-wide one."""
    clean = edits.withColumn("from", F.coalesce("from", F.lit("")))
    single = clean.filter(F.col("row_id").isNotNull()).groupBy("row_id", "term", "from").agg(F.min("seq").alias("__s1"))
    wide = clean.filter(F.col("row_id").isNull()).groupBy("term", "from").agg(F.min("seq").alias("__s2"))
    status = clean.filter(F.col("term") == "occurrenceStatus").filter("to = 'absent'").groupBy("row_id").agg(F.min("seq").alias("__s3"))
    joined = (
        problems.join(
            single.select(F.col("row_id").alias("__r"), F.col("term").alias("__t"), F.col("from").alias("__f"), "__s1"),
            (F.col(row_id) == F.col("__r")) & (F.col("term") == F.col("__t")) & (F.col("value") == F.col("__f")), "left")
        .drop("__r", "__t", "__f")
        .join(wide.select(F.col("term").alias("__t"), F.col("from").alias("__f"), "__s2"),
              (F.col("term") == F.col("__t")) & (F.col("value") == F.col("__f")), "left")
        .drop("__t", "__f")
        .join(status.select(F.col("row_id").alias("__r"), "__s3"), F.col(row_id) == F.col("__r"), "left")
        .drop("__r")
    )
    absent = F.when(F.col("type") == "count_present_zero", F.col("__s3"))
    return joined.withColumn("edit_seq", F.coalesce("__s1", "__s2", absent)).drop("__s1", "__s2", "__s3")


def fix_keys(problems: DataFrame) -> DataFrame:
    """(term, type, value, suggestion, n): problems one fix serves. Only date parts differ by suggestion."""
    key = F.when(F.col("type") == "date_mismatch", F.col("suggestion")).otherwise("")
    return problems.groupBy("term", "type", "value", key.alias("suggestion")).agg(F.count("*").alias("n"))


def unparsed_dates(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, term, value) of date cells that are no ISO date."""
    terms = [t for t in D.DATE_TERMS if t in df.columns]
    cells = F.array(*[F.struct(F.lit(t).alias("term"), text(_col(t)).alias("value"), D.is_iso_date(_col(t)).alias("ok")) for t in terms])
    return df.select(row_id, F.explode(cells).alias("c")).select(row_id, "c.*").filter("value <> '' AND NOT ok").drop("ok")


def formula_cells(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, term, value) of cells a spreadsheet would run."""
    columns = [c for c in df.columns if c != row_id]
    hits = [F.when(is_formula_like(_col(c)), F.struct(F.lit(c).alias("term"), text(_col(c)).alias("value"))) for c in columns]
    return df.select(row_id, F.explode(F.array_compact(F.array(*hits))).alias("c")).select(row_id, "c.*")


def count_and_sample(cells: DataFrame, n: int = 5, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(one-row count, first n cells)."""
    return cells.agg(F.count("*").alias("count")), cells.orderBy(row_id, "term").limit(n)


def year_range_counts(df: DataFrame, min_year: int = D.MIN_YEAR, max_year: int | None = None) -> DataFrame:
    """One row: cells with a year after `max_year` or before `min_year`."""
    terms = [t for t in (*D.DATE_TERMS, "year") if t in df.columns]
    top = max_year or D.this_year()
    cells = df.select(F.explode(F.array(*[D.year_range_flags(_col(t), min_year, top) for t in terms])).alias("c"))
    future, ancient = F.col("c.future"), F.col("c.ancient")
    return cells.agg(
        F.count_if(any_of([future, ancient])).alias("count"), F.count_if(future).alias("future_count"),
        F.count_if(ancient).alias("ancient_count"),
    )
