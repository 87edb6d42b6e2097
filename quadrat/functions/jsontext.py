"""JSON objects held as text (dynamicProperties)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.functions.text import FOLD_FROM, FOLD_TO, any_of, as_col, is_blank

ENTRY_TYPE = "array<struct<key:string,value:variant>>"


def property_key(header: str) -> str:
    """`Área Protegida` becomes `area_protegida` (header metadata, driver side)."""
    import re

    folded = header.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return re.sub("[^a-z0-9]+", "_", folded).strip("_") or "field"


def _is_object(value: Column) -> Column:
    return F.coalesce(value.contains("{") & F.json_object_keys(value).isNotNull(), F.lit(False))


def _entries(value: Column) -> Column:
    """Members of an object cell in their own order."""
    return F.map_entries(F.from_json(value, "map<string,variant>")).cast(ENTRY_TYPE)


def _first_per_key(entries: Column) -> Column:
    return F.filter(
        entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1
    )


def _object_text(entries: Column) -> Column:
    return F.when(F.size(entries) > 0, F.to_json(F.map_from_entries(entries))).otherwise("")


def json_from_columns(columns: list[str], keys: dict[str, str] | None = None) -> Column:
    """One flat JSON object per row: blank cells are skipped, object cells are spliced in,
    the first column wins when two give the same key."""
    keys = keys or {}
    chosen: dict[str, str] = {}
    for column in columns:
        override = (keys.get(column) or "").strip()
        key = override if override and '"' not in override else property_key(column)
        chosen.setdefault(key, column)
    flat = F.to_json(
        F.struct(*[F.when(~is_blank(c), F.col(f"`{c}`").cast("string")).alias(k) for k, c in chosen.items()])
    )
    pieces = []
    for key, column in chosen.items():
        value = F.col(f"`{column}`").cast("string")
        own = F.array(F.struct(F.lit(key).alias("key"), value.cast("variant").alias("value")))
        pieces.append(
            F.when(is_blank(value), F.array().cast(ENTRY_TYPE))
            .when(_is_object(value), _entries(value))
            .otherwise(own.cast(ENTRY_TYPE))
        )
    spliced = _object_text(_first_per_key(F.flatten(F.array(*pieces))))
    some_object = any_of([F.coalesce(F.col(f"`{c}`").contains("{"), F.lit(False)) for c in chosen.values()])
    return F.when(some_object, spliced).otherwise(F.replace(flat, F.lit("{}"), F.lit("")))


def merge_property(existing: Column | str, key: str, value: Column) -> Column:
    """Set one key of a JSON object text; other members keep their place. NULL or blank changes nothing."""
    old = F.coalesce(as_col(existing), F.lit(""))
    fresh = F.to_json(F.struct(value.cast("string").alias(key)))
    member = F.substring(fresh, 2, 1_000_000_000)
    body = F.regexp_replace(F.regexp_replace(old, r"^\{", ""), r"\}$", "")
    appended = F.when(body == "", fresh).otherwise(F.concat(F.lit("{"), body, F.lit(","), member))
    entries = _entries(old)
    pair = F.struct(F.lit(key).alias("key"), value.cast("string").cast("variant").alias("value"))
    replaced = _first_per_key(F.transform(entries, lambda e: F.when(e["key"] == key, pair).otherwise(e)))
    has_key = F.coalesce(F.array_contains(F.json_object_keys(old), key), F.lit(False))
    merged = F.when(old == "", fresh).when(
        (old.contains(f'"{key}"') | old.contains("\\u")) & has_key, _object_text(replaced)
    ).otherwise(appended)
    return F.when(is_blank(value), old).otherwise(merged)
