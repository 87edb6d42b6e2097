"""Copies of a point inside free text: find them, blank them or replace them by the published point.

Cells are tested in Catalyst with one cheap pattern first; only cells that could hold a number of the
right shape reach the Arrow functions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType,
)

# Spellings of numbers and of degrees, minutes and seconds inside text.
EXPONENT = r"(?:[eE][-+]?[0-9]+|\s*[x*×]\s*10(?:\^[-+]?[0-9]+|[⁺⁻]?[⁰¹²³⁴-⁹]+))"
NUMBER = (
    r"(?<![0-9])(?<![0-9]\.)[-+]?(?:(?>[0-9]+[.,][0-9]+)(?!\.[0-9])" + EXPONENT + r"?|[.,]?[0-9]+" + EXPONENT + ")"
)
DMS_MARKS = (
    r"([-+−]?)(\d{1,3})\s*[°º]?\s*(\d{1,2}(?:[.,]\d+)?)\s*['′’´`]"
    r"(?:\s*(\d{1,2}(?:[.,]\d+)?)\s*\\?(?:[\"″”]|''))?(?:\s*([NSEWOLnsewol])\b)?"
)
DMS_START = r"(?<![0-9.,])(?<![0-9][-/])([-+−]?)(\d{1,3})"
DMS_PART = r"(\d{1,2}(?:[.,]\d+)?)"
DMS_HEMISPHERE = r"(?:\s*([NSEWOLnswl])\b)?"
DMS_LETTERS = rf"{DMS_START}\s*[dD]\s*{DMS_PART}\s*[mM](?:\s*{DMS_PART}\s*[sS])?{DMS_HEMISPHERE}"
DMS_SPACED = rf"{DMS_START}[\s:°º]+{DMS_PART}(?![0-9])(?:[\s:]+{DMS_PART}(?![0-9]))?{DMS_HEMISPHERE}"
DMS_BARE = r"^[-+−]?\d+[\s:]+\d+$|^\d+:\d+:\d+(?:[.,]\d+)?$"
HINT = (
    r"[0-9][.,][0-9]|[0-9]\s*['′’´`]|[0-9]" + EXPONENT + r"|[0-9][\s:dD°º]+[0-9]"
)
# Structured text that carries projected coordinates.
PROJECTED_KEY = (
    r"(?i)(?<![a-z])(?:easting|northing|utm|epsg|srid|crs)(?![a-z])|(?<![a-z0-9])[xy][\"']?\s*[:=]"
    r"|\"coordinates\"\s*:|(?<![a-z])(?:multi)?(?:point|linestring|polygon)\s*(?:zm|z|m)?\s*\("
)
PROJECTED_CODE = r"(?i)(?:epsg|srid|crs)[^0-9]{0,8}[0-9]+"
PROJECTED_NUMBER = r"((?<![0-9])(?<![0-9]\.)[-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?(?![0-9]))"
LINK = r"(?:https?://|doi:|\b10\.[0-9]{4,}/)\S*"

_DMS = [re.compile(p) for p in (DMS_MARKS, DMS_LETTERS, DMS_SPACED)]
_NUMBER = re.compile(NUMBER)
_BARE = re.compile(DMS_BARE)
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-")

TOKEN_TYPE = ArrayType(
    StructType(
        [
            StructField("stage", IntegerType()), StructField("start", IntegerType()), StructField("len", IntegerType()),
            StructField("value", DoubleType()), StructField("step", DoubleType()), StructField("bare", BooleanType()),
        ]
    )
)


def might_hold_point(cell: Column) -> Column:
    return F.coalesce(cell.rlike(HINT), F.lit(False))


def _read_number(token: str) -> tuple[float, int] | None:
    """(size, written decimals) of a number token."""
    plain = re.sub(r"\s*[x*×]\s*10\^?", "e", token.replace(",", ".", 1)).translate(_SUPER)
    mantissa, _, power = plain.lower().partition("e")
    try:
        return abs(float(plain)), len(mantissa.partition(".")[2]) - int(power or 0)
    except (ValueError, OverflowError):
        return None


def _read_dms(found: re.Match) -> tuple[float, float]:
    """(size, step of the last written part) of a degrees token."""
    degrees, minutes, seconds = (float((found.group(k) or "0").replace(",", ".")) for k in (2, 3, 4))
    last = found.group(4) or found.group(3)
    decimals = len(re.sub("^[^.,]*[.,]?", "", last))
    return degrees + minutes / 60 + seconds / 3600, (1 / 3600 if found.group(4) else 1 / 60) * 10.0**-decimals


def _show_number(token: str, published: str) -> str:
    value = published.removeprefix("-")
    value = value.replace(".", ",", 1) if "," in token else value
    return "-" + value if token.startswith("-") and value else value


def _show_dms(found: re.Match, published: str) -> str:
    value = published.removeprefix("-")
    if not value:
        return ""
    if found.group(5):
        return f"{value} {found.group(5).upper()}"
    return ("-" if found.group(1) not in ("", "+") else "") + value


def redact_cell(text: str, lat: float | None, lon: float | None, grid: float, pub_lat: str, pub_lon: str) -> str:
    """Replace every copy of one point in one text, written finer than the grid, sign ignored."""
    floor = max(0, round(-math.log10(grid)))

    def nearest(size: float) -> str | None:
        if lat is not None and abs(size - abs(lat)) < grid:
            return pub_lat
        if lon is not None and abs(size - abs(lon)) < grid:
            return pub_lon
        return None

    def dms(found: re.Match) -> str:
        size, step = _read_dms(found)
        shown = nearest(size) if step < grid and not _BARE.match(found.group(0)) else None
        return found.group(0) if shown is None else _show_dms(found, shown)

    def number(found: re.Match) -> str:
        read = _read_number(found.group(0))
        shown = nearest(read[0]) if read and read[1] > floor else None
        return found.group(0) if shown is None else _show_number(found.group(0), shown)

    for pattern in _DMS:
        text = pattern.sub(dms, text)
    return _NUMBER.sub(number, text)


def _none(value: float | None) -> float | None:
    return None if value is None or math.isnan(value) else value


@F.pandas_udf(ArrayType(StringType()))
def _redact(rows: pd.DataFrame) -> pd.Series:
    out = pd.Series([None] * len(rows), dtype=object)
    there = rows[rows["texts"].notna()]
    for at, texts, lat, lon, grid, pub_lat, pub_lon in there.itertuples(name=None):
        point = _none(lat), _none(lon), grid, pub_lat or "", pub_lon or ""
        out[at] = [t if t is None or not grid > 0 else redact_cell(t, *point) for t in texts]
    return out


def redact_copies(
    df: DataFrame, cells: dict[str, Column], lat: Column, lon: Column, grid: Column, pub_lat: Column, pub_lon: Column,
    rows: dict[str, Column],
) -> DataFrame:
    """`df` with the columns `cells`, in each the copies of its row's own point replaced where `rows` holds.

    One Arrow call a row takes all its candidates; cells that are none stay in the JVM untouched."""
    names = list(cells)
    texts = F.array(*[
        F.when(F.coalesce(rows[c] & might_hold_point(cells[c]) & grid.isNotNull(), F.lit(False)), cells[c]) for c in names])
    staged = df.withColumn("__texts", texts)
    found = F.exists("__texts", lambda x: x.isNotNull())
    shown = lambda x: F.when(found, x)
    packed = F.struct(
        shown(F.col("__texts")).alias("texts"), shown(lat).alias("lat"), shown(lon).alias("lon"), shown(grid).alias("grid"),
        shown(pub_lat).alias("pub_lat"), shown(pub_lon).alias("pub_lon"),
    )
    staged = staged.withColumn("__clean", _redact(packed))
    return staged.withColumns(
        {c: F.coalesce(F.get("__clean", F.lit(i)), cells[c]) for i, c in enumerate(names)}
    ).drop("__texts", "__clean")


def _tokens(text: str) -> list[dict]:
    out = []
    for stage, pattern in enumerate(_DMS):
        for found in pattern.finditer(text):
            size, step = _read_dms(found)
            out.append((stage, found, size, step, bool(_BARE.match(found.group(0)))))
    for found in _NUMBER.finditer(text):
        read = _read_number(found.group(0))
        if read:
            out.append((len(_DMS), found, read[0], 10.0 ** -read[1], False))
    return [
        {"stage": s, "start": f.start(), "len": f.end() - f.start(), "value": v, "step": d, "bare": b}
        for s, f, v, d, b in out
    ]


@F.pandas_udf(TOKEN_TYPE)
def point_tokens(texts: pd.Series) -> pd.Series:
    """Numbers and degree spellings of a text with their place, size and step."""
    return pd.Series([None if t is None else _tokens(t) for t in texts], dtype=object)


@F.pandas_udf(StringType())
def _write_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for frame in frames:
        yield pd.Series([_replace(text, hits) for text, hits in frame.itertuples(index=False, name=None)], dtype=object)


def _replace(text: str | None, hits: list[dict] | None) -> str | None:
    """Apply the token hits of one text: earlier stages win where tokens overlap."""
    if text is None or hits is None:
        return text
    kept: list[tuple[int, int, str]] = []
    for hit in sorted(hits, key=lambda h: (h["stage"], h["start"])):
        start, end = hit["start"], hit["start"] + hit["len"]
        if any(start < e and s < end for s, e, _ in kept):
            continue
        token = text[start:end]
        if hit["stage"] < len(_DMS):
            found = _DMS[hit["stage"]].match(text, start)
            shown = _show_dms(found, hit["published"] or "") if found else ""
        else:
            shown = _show_number(token, hit["published"] or "")
        kept.append((start, end, shown))
    for start, end, shown in sorted(kept, reverse=True):
        text = text[:start] + shown + text[end:]
    return text


def write_back(cell: Column, hits: Column) -> Column:
    return _write_back(F.struct(cell.alias("text"), hits.alias("hits")))


def has_projected_point(cell: Column) -> Column:
    """Structured text with a projected coordinate: a key word and two numbers of 10,000 or more."""
    bare = F.regexp_replace(cell, PROJECTED_CODE, "")
    big = F.filter(
        F.regexp_extract_all(bare, F.lit(PROJECTED_NUMBER), 1), lambda x: F.abs(x.try_cast("double")) >= 10000
    )
    return F.coalesce(F.when(cell.rlike(PROJECTED_KEY), F.size(big) >= 2), F.lit(False))


def has_point_text(cell: Column, min_decimals: Column) -> Column:
    """A degree spelling, or a number up to 180 with more decimals than given; links are ignored."""
    text = F.regexp_replace(cell, LINK, "")
    dms = text.rlike(DMS_MARKS) | text.rlike(DMS_LETTERS)
    tokens = F.regexp_extract_all(text, F.lit("(" + NUMBER + ")"), 1)
    fine = F.exists(
        tokens,
        lambda t: (F.abs(F.regexp_replace(t, "^([^,]*),", "$1.").try_cast("double")) <= 180)
        & (F.length(F.regexp_extract(t, r"^[^.,eE]*[.,]([0-9]*)", 1))
           - F.coalesce(F.regexp_extract(t, "[eE]([-+]?[0-9]+)$", 1).try_cast("int"), F.lit(0)) > min_decimals),
    )
    return F.coalesce(F.when(cell.rlike(HINT), dms | fine), F.lit(False))
