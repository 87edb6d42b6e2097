"""Counts, uncertainties and measurements written as text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.functions.text import strip, text

MAX_UNCERTAINTY_M = 20037509
ALREADY_GENERALISED_M = 1000

# Number and unit patterns.
APPROX_PREFIX = r"^(aprox\.?|approx\.?|ca\.?|cerca de|~|\+/-|±)\s*"
LENGTH_UNIT = r"\s*(km|m|metros|meters|metres)$"
THOUSANDS_ONE = r"^[0-9]{1,3}\.[0-9]{3}$"
THOUSANDS = r"^[0-9]{1,3}(\.[0-9]{3})+$"
FLOAT_TEXT = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
MEASURE_NUMBER = r"^[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?$"
MEASURE_UNIT = r"^(-?[0-9]+([.,][0-9]+)?) *([\p{L}°%µ][\p{L}\p{N}°%µ²³/.^-]*)$"
DECIMAL_COMMA = r"^-?[0-9]+,[0-9]+$"

# Unit suffix of a measurement header and the unit it stands for.
HEADER_UNITS = {
    "ha": "ha", "m": "m", "m2": "m2", "km": "km", "km2": "km2", "cm": "cm", "mm": "mm",
    "kg": "kg", "g": "g", "mg": "mg", "l": "L", "ml": "mL", "c": "°C", "pct": "%",
}


def number(value: Column) -> Column:
    """Plain or exponent number, NULL for anything else (no hex, no words)."""
    return F.when(value.rlike(FLOAT_TEXT), value.try_cast("double"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` worked out once, however often `then` names it: nothing shares it inside a condition."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def plain_number_text(value: Column) -> Column:
    """Number text without exponent and without trailing zeros."""
    fixed = value.cast("decimal(28,12)").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def uncertainty_ok(value: Column | str, decimal_dot: Column | bool = False) -> Column:
    v = text(value)
    dot = F.lit(decimal_dot) if isinstance(decimal_dot, bool) else F.coalesce(decimal_dot, F.lit(False))
    num = v.try_cast("double")
    return F.coalesce(
        v.rlike(r"^[0-9]+(\.[0-9]+)?$") & (dot | ~v.rlike(THOUSANDS_ONE)) & (num > 0) & (num <= MAX_UNCERTAINTY_M),
        F.lit(False),
    )


def uncertainty_number(value: Column | str, decimal_dot: Column | bool = False) -> Column:
    """Metres in a text such as `30 m`, `ca. 2 km` or `1.500`, before the range test."""
    dot = F.lit(decimal_dot) if isinstance(decimal_dot, bool) else F.coalesce(decimal_dot, F.lit(False))

    def plain(bare: Column) -> Column:
        return F.when(~dot & bare.rlike(THOUSANDS), F.replace(bare, F.lit("."), F.lit(""))).otherwise(
            F.regexp_replace(bare, "^([^,]*),", "$1.")
        )

    def metres(v: Column) -> Column:
        bare = strip(F.regexp_replace(F.regexp_replace(v, APPROX_PREFIX, ""), LENGTH_UNIT, ""))
        num = _once(_once(bare, plain), number)
        return num * F.when(v.rlike("[0-9 ]km$"), 1000).otherwise(1)

    return _once(F.lower(text(value)), metres)


def suggest_uncertainty(value: Column | str, decimal_dot: Column | bool = False) -> Column:
    out = plain_number_text(uncertainty_number(value, decimal_dot))
    return _once(out, lambda x: F.when(uncertainty_ok(x, decimal_dot), x))


def uncertainty_metres(value: Column | str) -> Column:
    return suggest_uncertainty(value).try_cast("double")


def ambiguous_uncertainty(value: Column | str) -> Column:
    """`1.000`: one thousand or one."""
    v = F.regexp_replace(F.lower(text(value)), APPROX_PREFIX, "")
    return strip(F.regexp_replace(v, r"\s*(m|metros|meters|metres)$", "")).rlike(THOUSANDS_ONE)


def masking_uncertainty_metres(value: Column | str) -> Column:
    return F.when(~ambiguous_uncertainty(value), uncertainty_metres(value))


def proves_decimal_dot(value: Column | str) -> Column:
    """A dot that cannot be a thousands mark."""
    v = text(value)
    return v.rlike(r"^[0-9]+\.[0-9]+$") & ~v.rlike(THOUSANDS_ONE)


def suggest_count(value: Column | str) -> Column:
    """Whole number in a count cell: the cell itself, or its only run of digits."""
    v = text(value)
    num = number(F.replace(v, F.lit(","), F.lit(".")))
    whole = F.when((num >= 0) & (F.abs(num - F.round(num)) < 1e-9), F.round(num).cast("bigint").cast("string"))
    runs = F.regexp_extract_all(v, F.lit(r"(\d+)"), 1)
    return F.coalesce(whole, F.when(F.size(runs) == 1, F.element_at(runs, 1)))


def is_measure_number(value: Column) -> Column:
    return value.rlike(MEASURE_NUMBER)


def has_measure_unit(value: Column) -> Column:
    return value.rlike(MEASURE_UNIT)


def measure_like(value: Column | str) -> Column:
    v = text(value)
    return is_measure_number(v) | has_measure_unit(v) | v.rlike(DECIMAL_COMMA)


def measure_decimal(value: Column) -> Column:
    """Comma to dot; NULL for the ambiguous `1,234`."""
    return F.when(~value.rlike(r"^-?[0-9]{1,3},[0-9]{3}$"), F.regexp_replace(value, "^([^,]*),", "$1."))


def suggest_measure(value: Column | str) -> Column:
    v = text(value)
    runs = F.regexp_extract_all(v, F.lit(r"(-?[0-9]+(?:[.,][0-9]+)?)"), 1)
    lone = F.when((F.size(runs) == 1) & ~v.rlike("[<>~≤≥±]"), F.element_at(runs, 1))
    return measure_decimal(F.when(has_measure_unit(v), F.regexp_extract(v, MEASURE_UNIT, 1)).otherwise(lone))


def measure_problem(value: Column | str) -> Column:
    """Problem type of one cell of a measurement column."""
    v = text(value)
    return (
        F.when(v == "", F.lit(None).cast("string"))
        .when(has_measure_unit(v), "measure_unit")
        .when(~is_measure_number(v), "measure_number")
    )


def header_unit(header: str) -> str | None:
    """Unit named by the end of a header such as `AREA_HA` or `peso (kg)`."""
    pattern = r"[ _.(\[-](" + "|".join(HEADER_UNITS) + r")[\])]?$"
    found = re.search(pattern, header, re.IGNORECASE)
    return HEADER_UNITS[found.group(1).lower()] if found else None
