"""Date and time text to ISO 8601 with partial precision.

The parsers are staged: each step lands in its own short-lived column, so Catalyst
evaluates every regular expression once per row and keeps the stage in codegen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.fence import fence
from quadrat.functions.text import as_col, is_blank, lookup, match_form, strip, text
from quadrat.session import ensure_checkpoint_dir, settled

DATE_TERMS = ("eventDate", "dateIdentified", "modified")

# Month names and abbreviations in Portuguese, English and Spanish.
MONTH_NAMES = {
    "jan": "01", "janeiro": "01", "january": "01", "ene": "01", "enero": "01",
    "fev": "02", "fevereiro": "02", "feb": "02", "february": "02", "febrero": "02",
    "mar": "03", "marco": "03", "march": "03", "marzo": "03",
    "abr": "04", "abril": "04", "apr": "04", "april": "04",
    "mai": "05", "maio": "05", "may": "05", "mayo": "05",
    "jun": "06", "junho": "06", "june": "06", "junio": "06",
    "jul": "07", "julho": "07", "july": "07", "julio": "07",
    "ago": "08", "agosto": "08", "aug": "08", "august": "08",
    "set": "09", "setembro": "09", "sep": "09", "sept": "09", "september": "09",
    "septiembre": "09", "setiembre": "09",
    "out": "10", "outubro": "10", "oct": "10", "october": "10", "octubre": "10",
    "nov": "11", "novembro": "11", "november": "11", "noviembre": "11",
    "dez": "12", "dezembro": "12", "dec": "12", "december": "12", "dic": "12", "diciembre": "12",
}
# Roman month numerals.
ROMAN_MONTHS = {
    "i": "01", "ii": "02", "iii": "03", "iv": "04", "v": "05", "vi": "06",
    "vii": "07", "viii": "08", "ix": "09", "x": "10", "xi": "11", "xii": "12",
}
MIN_YEAR = 1600

# Date text patterns.
DMY = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})$"
YMD = r"^\d{4}([-/.])\d{1,2}\1\d{1,2}$"
MONTH_YEAR = r"^(\d{1,2})[/.-](\d{4})$"
YEAR_MONTH = r"^(\d{4})[/.-](\d{1,2})$"
NAME_SEP = r"(?:[ /.-]+de)?[ /.-]+"
DAY_NAME_YEAR = rf"^(\d{{1,2}}){NAME_SEP}(\p{{L}}+)\.?{NAME_SEP}(\d{{4}})$"
NAME_YEAR = rf"^(\p{{L}}+)\.?{NAME_SEP}(\d{{4}})$"
YEAR_RANGE = r"^(\d{4})\s*-\s*(\d{4})$"
INTERVAL = r"^(\S+)\s+(-|a)\s+(\S+)$"
CLOCK_12H = r"^(.+?)\s+(\d{1,2})(:[0-5][0-9](?::[0-5][0-9])?)\s*([AaPp])\.?[Mm]\.?$"
TIME_SUFFIX = (
    r"^(.+?)[ T]((?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.][0-9]+)?)?)"
    r"\s*(Z|UTC|GMT|[+-](?:0[0-9]|1[0-4]):?[0-5][0-9])?$"
)
ISO_TIME = r"(T([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d(\.\d+)?)?)?(Z|[+-](0\d|1[0-4])(:?[0-5]\d)?)?)?$"
ISO_WITHOUT_DAY = r"^\d{4}(-(0[1-9]|1[0-2]))?" + ISO_TIME
ISO_WITH_DAY = r"^\d{4}-(0[1-9]|1[0-2])-\d{2}" + ISO_TIME
CLOCK = r"(([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?|24:00(:00(\.0+)?)?)"
CLOCK_ZONE = CLOCK + r"(Z|[+-]([01][0-9]|2[0-3])(:?[0-5][0-9])?)?"


def this_year() -> int:
    return dt.date.today().year


def _int(value: Column) -> Column:
    return value.try_cast("int")


def clock_24h(value: Column | str) -> Column:
    """`<date> 08:30 PM` to `<date> 20:30`; other text is unchanged."""
    v = as_col(value)
    hour = _int(F.regexp_extract(v, CLOCK_12H, 2))
    pm = F.lower(F.regexp_extract(v, CLOCK_12H, 4)) == "p"
    hour24 = (hour % 12) + F.when(pm, 12).otherwise(0)
    rebuilt = F.concat(
        F.regexp_extract(v, CLOCK_12H, 1), F.lit(" "),
        F.lpad(hour24.cast("string"), 2, "0"), F.regexp_extract(v, CLOCK_12H, 3),
    )
    # Nested conditions: Catalyst would otherwise hoist the costly pattern out of the conjunction.
    return F.when(
        v.rlike(r"[Mm]\.?$"), F.when(v.rlike(CLOCK_12H), F.when(hour.between(1, 12), rebuilt).otherwise(v)).otherwise(v)
    ).otherwise(v)


def date_part(value: Column | str) -> Column:
    v = as_col(value)
    return F.when(
        v.contains(":"), F.when(v.rlike(TIME_SUFFIX), strip(F.regexp_extract(v, TIME_SUFFIX, 1))).otherwise(v)
    ).otherwise(v)


def time_part(value: Column | str) -> Column:
    """24-hour time with its zone, '' when the text has none."""
    v = as_col(value)
    clock = F.regexp_replace(F.regexp_extract(v, TIME_SUFFIX, 2), "^([0-9]):", "0$1:")
    zone = F.regexp_replace(F.regexp_extract(v, TIME_SUFFIX, 3), "^(UTC|GMT)$", "Z")
    return F.when(v.contains(":"), F.when(v.rlike(TIME_SUFFIX), F.concat(clock, zone)).otherwise("")).otherwise("")


def date_text_without_time(value: Column | str) -> Column:
    """Both ends of a date text without their clock part."""
    iso_time = r"T\d{2}(:?\d{2}){0,2}([.,]\d+)?(Z|[+-]\d{2}(:?\d{2})?)?$"
    ends = F.transform(
        F.split(as_col(value), "/"), lambda x: F.regexp_replace(date_part(x), iso_time, "")
    )
    return F.array_join(ends, "/")


# Forms a date text can have; the first that matches is the only one that can.
DMY_KIND, YMD_KIND, MONTH_YEAR_KIND, YEAR_MONTH_KIND, COMPACT_KIND, DAY_NAME_KIND, NAME_YEAR_KIND, RANGE_KIND = range(1, 9)
FORMS = (DMY, YMD, MONTH_YEAR, YEAR_MONTH, r"^\d{8}$", DAY_NAME_YEAR, NAME_YEAR, YEAR_RANGE)


def month_token(value: Column) -> Column:
    """Two-digit month of a month name."""
    return lookup(MONTH_NAMES, F.replace(match_form(value), F.lit(" "), F.lit("")))


def _name_month(token: Column) -> Column:
    return F.coalesce(lookup(ROMAN_MONTHS, F.lower(token)), month_token(token))


def _real_day(year: Column, month: Column, day: Column) -> Column:
    return F.coalesce(year.isNotNull() & (day >= 1) & (day <= days_in_month(year, month)), F.lit(False))


def _kind(value: Column) -> Column:
    kind = F.when(value.isNull() | (value == ""), 0)
    for number, pattern in enumerate(FORMS, start=1):
        kind = kind.when(value.rlike(pattern), number)
    return kind.otherwise(0)


def _fields(value: Column, kind: Column, parts: Column, as_of_year: int) -> dict[str, Column]:
    """a, b, y of a date text: first and second field of d/m/y, else day and month."""
    w0, w1, w2 = (F.get(parts, F.lit(i)) for i in range(3))
    pivot = as_of_year % 100
    short = _int(w2)
    dmy_year = F.when(F.length(w2) == 4, short).when(
        value.contains("/"), F.when(short <= pivot, short + 2000).otherwise(short + 1900)
    )

    def cut(at: int, size: int) -> Column:
        return _int(F.substring(value, at, size))

    named = F.when(kind == DAY_NAME_KIND, w1).when(kind == NAME_YEAR_KIND, w0)
    return {
        "a": F.when(kind.isin(DMY_KIND, DAY_NAME_KIND), _int(w0)).when(kind == YMD_KIND, _int(w2)).when(kind == COMPACT_KIND, cut(7, 2)),
        "b": F.when(kind.isin(DMY_KIND, YMD_KIND, YEAR_MONTH_KIND), _int(w1)).when(kind == MONTH_YEAR_KIND, _int(w0))
        .when(kind == COMPACT_KIND, cut(5, 2)).when(kind >= DAY_NAME_KIND, _int(_name_month(named))),
        "y": F.when(kind == DMY_KIND, dmy_year).when(kind.isin(YMD_KIND, YEAR_MONTH_KIND), _int(w0))
        .when(kind.isin(MONTH_YEAR_KIND, NAME_YEAR_KIND), _int(w1)).when(kind == DAY_NAME_KIND, _int(w2)).when(kind == COMPACT_KIND, cut(1, 4)),
    }


def _prepare(df: DataFrame, columns: Iterable[str], as_of_year: int) -> DataFrame:
    """Stage the clock, the interval ends, the form and the fields of each date column."""
    columns = list(columns)
    df = df.withColumns({f"__{c}_x": clock_24h(text(f"`{c}`")) for c in columns})
    df = df.withColumns(
        {f"__{c}_t": time_part(f"`__{c}_x`") for c in columns} | {f"__{c}_d": date_part(f"`__{c}_x`") for c in columns}
    )
    df = df.withColumns(
        {
            f"__{c}_i": F.when(F.col(f"`__{c}_d`").contains(" "), (F.col(f"`__{c}_t`") == "") & F.col(f"`__{c}_d`").rlike(INTERVAL))
            .otherwise(F.lit(False))
            for c in columns
        }
    )
    staged = {}
    for c in columns:
        whole, interval = F.col(f"`__{c}_d`"), F.col(f"`__{c}_i`")
        staged[f"__{c}_r1"] = F.when(interval, F.regexp_extract(whole, INTERVAL, 1)).otherwise(whole)
        staged[f"__{c}_r2"] = F.when(interval, F.regexp_extract(whole, INTERVAL, 3))
    df = df.withColumns(staged)
    staged = {}
    for c in columns:
        for k in "12":
            raw, interval = F.col(f"`__{c}_r{k}`"), F.col(f"`__{c}_i`")
            staged[f"__{c}_p{k}"] = F.when(interval, date_part(raw)).otherwise(raw)
            staged[f"__{c}_u{k}"] = F.when(interval, time_part(raw)).otherwise(F.col(f"`__{c}_t`"))
    df = df.withColumns(staged)
    ends = [(c, k) for c in columns for k in "12"]
    df = df.withColumns({f"__{c}_k{k}": _kind(F.col(f"`__{c}_p{k}`")) for c, k in ends})
    df = df.withColumns(
        {f"__{c}_w{k}": F.when(F.col(f"`__{c}_k{k}`") > 0, F.split(F.col(f"`__{c}_p{k}`"), NAME_SEP)) for c, k in ends}
    )
    fields = {}
    for c, k in ends:
        found = _fields(F.col(f"`__{c}_p{k}`"), F.col(f"`__{c}_k{k}`"), F.col(f"`__{c}_w{k}`"), as_of_year)
        fields |= {f"__{c}_{name}{k}": value for name, value in found.items()}
    return df.withColumns(fields)


def _end(c: str, k: str) -> dict[str, Column]:
    return {name: F.col(f"`__{c}_{name}{k}`") for name in ("a", "b", "y", "k", "u", "w", "p")}


def _votes(c: str) -> Column:
    """Day-first proofs count up, month-first proofs count down."""
    def vote(k: str) -> Column:
        e = _end(c, k)
        counts = (e["k"] == DMY_KIND) & (~F.col(f"`__{c}_i`") | (e["u"] == ""))
        day = (e["a"] > 12) & _real_day(e["y"], e["b"], e["a"])
        month = (e["b"] > 12) & _real_day(e["y"], e["a"], e["b"])
        return F.when(counts & day, 1).when(counts & month, -1).otherwise(0)

    return vote("1") + F.when(F.col(f"`__{c}_i`"), vote("2")).otherwise(0)


def day_first_votes(
    df: DataFrame, columns: Iterable[str] = DATE_TERMS, as_of_year: int | None = None
) -> DataFrame:
    """One row with, per date column, TRUE (day first), FALSE (month first) or NULL (tie or no proof)."""
    columns = [c for c in columns if c in df.columns]
    staged = _prepare(df.select(*[F.col(f"`{c}`") for c in columns]), columns, as_of_year or this_year())
    totals = staged.agg(*[F.coalesce(F.sum(_votes(c)), F.lit(0)).alias(c) for c in columns])
    return totals.select(*[F.when(F.col(c) > 0, True).when(F.col(c) < 0, False).alias(c) for c in columns])


def _day_first_columns(
    df: DataFrame, columns: list[str], day_first: bool | None | str, as_of_year: int
) -> dict[str, Column]:
    if day_first != "vote":
        return {c: F.lit(day_first).cast("boolean") for c in columns}
    votes = day_first_votes(df, columns, as_of_year)
    return {c: votes.select(c).scalar() for c in columns}


def _order(e: dict[str, Column], day_first: Column) -> Column:
    a, b = e["a"], e["b"]
    return (
        F.when(e["k"] != DMY_KIND, F.lit(True))
        .when((a > 12) & (b <= 12), F.lit(True))
        .when((b > 12) & (a <= 12), F.lit(False))
        .when(a == b, F.lit(True))
        .when((a <= 12) & (b <= 12), day_first)
    )


def _iso(e: dict[str, Column], order: Column, as_of_year: int) -> Column:
    """ISO text of one end once its field order is known."""
    kind = e["k"]
    day = F.when(order, e["a"]).when(~order, e["b"])
    month = F.when(order, e["b"]).when(~order, e["a"])
    year_text = F.lpad(e["y"].cast("string"), 4, "0")
    month_text = F.lpad(month.cast("string"), 2, "0")
    whole = kind.isin(DMY_KIND, YMD_KIND, DAY_NAME_KIND) | (
        (kind == COMPACT_KIND) & e["y"].between(MIN_YEAR, as_of_year)
    )
    span = (kind == RANGE_KIND) & (F.substring(e["p"], 1, 4) < F.substring(e["p"], -4, 4))
    return (
        F.when(whole & _real_day(e["y"], month, day), F.concat_ws("-", year_text, month_text, F.lpad(day.cast("string"), 2, "0")))
        .when(kind.isin(MONTH_YEAR_KIND, YEAR_MONTH_KIND, NAME_YEAR_KIND) & month.between(1, 12), F.concat_ws("-", year_text, month_text))
        .when(span, F.concat(F.substring(e["p"], 1, 4), F.lit("/"), F.substring(e["p"], -4, 4)))
    )


def dates_to_iso(
    df: DataFrame,
    columns: Iterable[str] = DATE_TERMS,
    as_of_year: int | None = None,
    day_first: bool | None | str = "vote",
    suffix: str = "_iso",
    ambiguous_suffix: str | None = None,
) -> DataFrame:
    """Add `<column><suffix>`: the ISO text of each date column, NULL where it cannot be read.

    With `day_first="vote"` every column decides its own field order from all of its rows;
    the vote is a scalar subquery, so only one boolean per column travels. `ambiguous_suffix`
    also adds a flag for text whose day and month could be swapped, in a single date or in an
    end of an interval. Each distinct text is read once and looked up by the rows; a stream is read row by row.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    year = as_of_year or this_year()
    if df.isStreaming:
        return _read_dates(df, columns, year, _day_first_columns(df, columns, day_first, year), suffix, ambiguous_suffix)
    ensure_checkpoint_dir(df.sparkSession)
    out = df
    for c in columns:
        texts = df.groupBy(text(f"`{c}`").alias("__dtext")).agg(F.count("*").alias("__n")).filter("__dtext <> ''").checkpoint()
        order = F.lit(None if day_first == "vote" else day_first).cast("boolean")
        if day_first == "vote":
            total = _prepare(texts, ["__dtext"], year).agg(F.coalesce(F.sum(_votes("__dtext") * F.col("__n")), F.lit(0)).alias("t"))
            order = total.select(F.when(F.col("t") > 0, True).when(F.col("t") < 0, False)).scalar()
        read = settled(_read_dates(texts, ["__dtext"], year, {"__dtext": order}, "__i", "__a").drop("__n"), "__dtext")
        out = out.withColumn("__dkey", text(f"`{c}`")).join(read, F.col("__dkey") == F.col("__dtext"), "left")
        found = [F.col("__dtext__i").alias(c + suffix)]
        if ambiguous_suffix:
            found.append(F.coalesce("__dtext__a", F.lit(False)).alias(c + ambiguous_suffix))
        out = out.select(*[F.col(f"`{x}`") for x in out.columns if x not in ("__dkey", "__dtext", "__dtext__i", "__dtext__a")], *found)
    added = [c + suffix for c in columns] + ([c + ambiguous_suffix for c in columns] if ambiguous_suffix else [])
    return out.select(*[F.col(f"`{x}`") for x in [*df.columns, *added]])


def _read_dates(
    df: DataFrame, columns: list[str], year: int, order: dict[str, Column], suffix: str, ambiguous_suffix: str | None
) -> DataFrame:
    """`dates_to_iso` row by row, once the field order of each column is known."""
    keep = df.columns
    staged = _prepare(df, columns, year)
    ends = [(c, k) for c in columns for k in "12"]
    staged = staged.withColumns({f"__{c}_o{k}": _order(_end(c, k), order[c]) for c, k in ends})
    staged = staged.withColumns({f"__{c}_s{k}": _iso(_end(c, k), F.col(f"`__{c}_o{k}`"), year) for c, k in ends})

    def end(c: str, k: str) -> Column:
        iso, clock = F.col(f"`__{c}_s{k}`"), F.col(f"`__{c}_u{k}`")
        return F.when(clock == "", iso).otherwise(F.concat(iso, F.lit("T"), clock))

    out = {
        c + suffix: F.when(F.col(f"`__{c}_i`"), F.concat(end(c, "1"), F.lit("/"), end(c, "2"))).otherwise(end(c, "1"))
        for c in columns
    }
    if ambiguous_suffix:
        out |= {c + ambiguous_suffix: _ambiguous(c) for c in columns}
    parsed = staged.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in out.items()])
    return fence(parsed, list(out))


def _swappable(e: dict[str, Column]) -> Column:
    a, b = e["a"], e["b"]
    fits = (e["k"] == DMY_KIND) & (e["u"] == "") & (a <= 12) & (b <= 12) & (a != b) & e["y"].isNotNull()
    return F.coalesce(fits, F.lit(False))


def _ambiguous(c: str) -> Column:
    swap = {k: _swappable(_end(c, k)) for k in "12"}
    like = {k: swap[k] | F.col(f"`__{c}_s{k}`").isNotNull() for k in "12"}
    interval = (swap["1"] | swap["2"]) & like["1"] & like["2"]
    return F.coalesce(F.when(F.col(f"`__{c}_i`"), interval).otherwise(swap["1"]), F.lit(False))


def fix_dates(
    df: DataFrame, columns: Iterable[str] = DATE_TERMS, as_of_year: int | None = None,
    day_first: bool | None | str = "vote",
) -> DataFrame:
    """Replace date columns by their ISO text; text that cannot be read stays as it is."""
    columns = [c for c in columns if c in df.columns]
    parsed = dates_to_iso(df, columns, as_of_year, day_first, suffix="__iso")
    return parsed.select(
        *[
            F.coalesce(F.col(f"`{c}__iso`"), F.nullif(F.col(f"`{c}`"), F.lit(""))).alias(c)
            if c in columns else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def _iso_part_ok(value: Column) -> Column:
    return value.rlike(ISO_WITHOUT_DAY) | (
        value.rlike(ISO_WITH_DAY) & F.substring(value, 1, 10).try_cast("date").isNotNull()
    )


def expand_interval_end(start: Column, end: Column) -> Column:
    """Give a shortened interval end (`05` or `06-05`) the leading part of its start."""
    day = F.substring(start, 1, 10)
    head = day.substr(F.lit(1), F.greatest(F.length(day) - F.length(end), F.lit(0)))
    return F.when(end.rlike(r"^\d{2}(-\d{2})?$"), F.concat(head, end)).otherwise(end)


def interval_start(value: Column) -> Column:
    return F.substring_index(value, "/", 1)


def interval_end(value: Column) -> Column:
    """Text after the slash of an interval with one slash."""
    return F.substring_index(value, "/", -1)


def is_iso_date(value: Column | str) -> Column:
    """A valid ISO date, date-time or interval."""
    v = text(value)
    start, end = interval_start(v), interval_end(v)
    return _iso_part_ok(start) & (
        ~v.contains("/") | (~v.rlike("/.*/") & _iso_part_ok(expand_interval_end(start, end)))
    )


def is_iso_time(value: Column | str) -> Column:
    return text(value).rlike(f"^{CLOCK_ZONE}(/{CLOCK_ZONE})?$")


LOOSE_TIME = r"^([0-9]{1,2})(?:[:h]([0-9]{2}))?(?::([0-9]{2}))?h?(am|pm|a\.m\.|p\.m\.)?$"


def suggest_event_time(value: Column | str) -> Column:
    """24-hour time for `8:30`, `12h30` or `08:30 PM`, NULL when it is not one."""
    v = F.lower(F.regexp_replace(text(value), r"\s+", ""))
    hour = _int(F.regexp_extract(v, LOOSE_TIME, 1))
    minute_text = F.regexp_extract(v, LOOSE_TIME, 2)
    minute = F.coalesce(_int(minute_text), F.lit(0))
    second = F.regexp_extract(v, LOOSE_TIME, 3)
    half = F.substring(F.regexp_extract(v, LOOSE_TIME, 4), 1, 1)
    marked = (minute_text != "") | (half != "") | v.contains("h")
    hour24 = F.when(half == "", hour).when(
        hour.between(1, 12), (hour % 12) + F.when(half == "p", 12).otherwise(0)
    )
    ok = v.rlike(LOOSE_TIME) & marked & (hour24 <= 23) & (minute <= 59) & (
        (second == "") | (_int(second) <= 59)
    )
    base = F.concat(F.lpad(hour24.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))
    return F.when(ok, F.when(second == "", base).otherwise(F.concat(base, F.lit(":"), second)))


def parse_year(value: Column | str) -> Column:
    """The four-digit year in a cell; other numbers are not years."""
    v = text(value)
    plain = F.regexp_replace(
        v, r"(?<![0-9.,])([0-9]{1,4})[.]([0-9]{1,2})[.]([0-9]{1,4})(?![0-9.,])", "$1-$2-$3"
    )
    found = F.regexp_extract(plain, r"(?<![0-9.,])([0-9]{4})(?![0-9]|[.,][0-9])", 1)
    return (
        F.when(v.rlike(r"^[0-9]{4}([.,]0+)?$"), _int(F.substring(v, 1, 4)))
        .when(v.rlike(r"^[+-]?[0-9]+([.,][0-9]+)?$"), F.lit(None).cast("int"))
        .otherwise(_int(found))
    )


def parse_month(value: Column | str) -> Column:
    """`01`..`12` from a number or a month name."""
    v = text(value)
    number = _int(F.regexp_replace(v, r"\..*$", ""))
    return F.when(
        v.rlike(r"^\d{1,2}(\.0+)?$") & number.between(1, 12), F.lpad(number.cast("string"), 2, "0")
    ).otherwise(month_token(v))


def parse_day(value: Column | str) -> Column:
    number = text(value).try_cast("double")
    return F.when((number == F.floor(number)) & number.between(1, 31), number.cast("int"))


def days_in_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return (
        F.when(month.isin(1, 3, 5, 7, 8, 10, 12), 31)
        .when(month.isin(4, 6, 9, 11), 30)
        .when(month == 2, F.when(leap, 29).otherwise(28))
    )


def compose_date(year: Column | str, month: Column | str | None, day: Column | str | None) -> Column:
    """struct(value, valid, partial, any_input) from year, month and day cells."""
    none = F.lit(None).cast("string")
    month = none if month is None else month
    day = none if day is None else day
    y, m, d = parse_year(year), parse_month(month), parse_day(day)
    no_y, no_m, no_d = is_blank(year), is_blank(month), is_blank(day)
    y_text = F.lpad(y.cast("string"), 4, "0")
    ym_text = F.concat(y_text, F.lit("-"), m)
    only_year = ~no_y & no_m & no_d & y.isNotNull()
    year_month = ~no_y & ~no_m & no_d & y.isNotNull() & m.isNotNull()
    full = ~no_y & ~no_m & ~no_d & (d <= days_in_month(y, m.try_cast("int")))
    full = F.coalesce(full, F.lit(False))
    value = (
        F.when(only_year, y_text)
        .when(year_month, ym_text)
        .when(full, F.concat(ym_text, F.lit("-"), F.lpad(d.cast("string"), 2, "0")))
    )
    return F.struct(
        value.alias("value"),
        (only_year | year_month | full).alias("valid"),
        (only_year | year_month).alias("partial"),
        (~(no_y & no_m & no_d)).alias("any_input"),
    )


def compose_interval_parts(start: Column, end: Column) -> Column:
    """Interval of two composed dates: equal ends collapse, a lone end stands alone."""
    return (
        F.when(
            start["valid"] & end["valid"],
            F.when(start["value"] == end["value"], start["value"]).otherwise(
                F.concat(start["value"], F.lit("/"), end["value"])
            ),
        )
        .when(start["valid"] & ~end["any_input"], start["value"])
        .when(end["valid"] & ~start["any_input"], end["value"])
    )


def compose_month_interval(
    start_month: Column | str, start_year: Column | str, end_month: Column | str, end_year: Column | str
) -> Column:
    """yyyy-MM/yyyy-MM, needing all four parts; equal ends collapse."""

    def part(year: Column | str, month: Column | str) -> Column:
        return F.concat(F.lpad(parse_year(year).cast("string"), 4, "0"), F.lit("-"), parse_month(month))

    start, end = part(start_year, start_month), part(end_year, end_month)
    return F.when(start == end, start).otherwise(F.concat(start, F.lit("/"), end))


def iso_bound(value: Column | str, last: bool) -> Column:
    """First or last day an ISO date or interval covers; NULL for other text."""
    v = text(value)
    start = interval_start(v)
    day = F.substring(expand_interval_end(start, interval_end(v)) if last else start, 1, 10)
    filler = F.lit("0000-12-01" if last else "0000-01-01")
    whole = F.concat(day, filler.substr(F.length(day) + 1, F.lit(10))).try_cast("date")
    bound = F.when(F.length(day) < 10, F.last_day(whole)).otherwise(whole) if last else whole
    return F.when(is_iso_date(v), bound)


def years_in(value: Column | str) -> Column:
    """All four-digit numbers of a date text, clock digits left out."""
    v = text(value)
    scan = F.when(v.rlike("[T:]"), date_text_without_time(v)).otherwise(v)
    return F.transform(F.regexp_extract_all(scan, F.lit(r"(?<!\d)(\d{4})(?!\d)"), 1), lambda x: x.cast("int"))


def year_range_flags(value: Column | str, min_year: int = MIN_YEAR, max_year: int | None = None) -> Column:
    """struct(future, ancient): a year after `max_year`, a year before `min_year`."""
    top = max_year or this_year()
    years = years_in(value)
    return F.struct(
        F.exists(years, lambda y: y > top).alias("future"),
        F.exists(years, lambda y: y < min_year).alias("ancient"),
    )


def fold_header(name: str) -> list[str]:
    """Words of a column header, for role detection on the driver (header metadata only)."""
    import re

    from quadrat.functions.text import FOLD_FROM, FOLD_TO

    spaced = re.sub("([a-z])([A-Z])", r"\1 \2", name).lower()
    folded = spaced.translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return re.findall("[a-z0-9]+", folded)


# Header words that give a date part its role.
ROLE_WORDS = {
    "start": {"start", "begin", "initial", "inicio", "from"},
    "end": {"end", "final", "fim", "to"},
    "day": {"day", "dia", "dd"},
    "month": {"month", "mo", "mes", "mm"},
    "year": {"year", "yr", "ano", "yyyy", "aaaa"},
}


def detect_roles(columns: list[str], wanted: list[tuple[str, ...]]) -> list[str | None]:
    """First unused header that carries all words of each wanted role."""
    words = {c: set(fold_header(c)) for c in columns}
    used: set[str] = set()
    found: list[str | None] = []
    for role in wanted:
        pick = next(
            (c for c in columns if c not in used and all(words[c] & ROLE_WORDS[r] for r in role)), None
        )
        if pick:
            used.add(pick)
        found.append(pick)
    return found


def event_date_from_columns(columns: list[str]) -> Column | None:
    """eventDate expression for 2 or 3 (one date), 4 (month/year interval) or 6 (d/m/y interval) columns."""
    if len(columns) in (2, 3):
        day, month, year = detect_roles(columns, [("day",), ("month",), ("year",)])
        if year is None or sum(x is not None for x in (day, month, year)) != len(columns):
            return None
        if day is not None and month is None:
            return None
        return compose_date(year, month, day)["value"]
    if len(columns) == 4:
        parts = detect_roles(
            columns, [("start", "month"), ("start", "year"), ("end", "month"), ("end", "year")]
        )
        rest = [c for c in columns if c not in parts]
        for k, role in enumerate(("month", "year", "month", "year")):
            if parts[k] is None:
                parts[k] = detect_roles(rest, [(role,)])[0]
                rest = [c for c in rest if c != parts[k]]
        if None in parts:
            parts = list(columns)
        return compose_month_interval(*parts)
    if len(columns) == 6:
        wanted = [(side, part) for side in ("start", "end") for part in ("year", "month", "day")]
        parts = detect_roles(columns, wanted)
        if None in parts:
            return None
        return compose_interval_parts(compose_date(*parts[:3]), compose_date(*parts[3:]))
    return None
