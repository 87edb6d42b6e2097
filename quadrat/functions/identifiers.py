"""Identifiers derived from row content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The RFC 4122 URL namespace and the separators between cells.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"
CELL_SEP = "\u001f"
NUMBER_SEP = "\u001e"
ESCAPE = "\u001c"


def hash_cell(value: Column) -> Column:
    """Cell text with separators escaped, so that different rows never join to the same text."""
    v = value.cast("string")
    escaped = v
    for char, mark in ((ESCAPE, "c"), (NUMBER_SEP, "e"), (CELL_SEP, "f")):
        escaped = F.replace(escaped, F.lit(char), F.lit(ESCAPE + mark))
    special = (v == "NA") | v.rlike("[\\u001c\\u001e\\u001f]")
    return F.coalesce(F.when(special, F.concat(F.lit(ESCAPE), escaped)).otherwise(v), F.lit("NA"))


def content_text(columns: list[str]) -> Column:
    if not columns:
        return F.lit("")
    return F.concat_ws(CELL_SEP, *[hash_cell(F.col(f"`{c}`")) for c in columns])


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5) from built-in hashing."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def persistent_id(content: Column, number: Column) -> Column:
    return F.concat(F.lit("urn:uuid:"), uuid5(F.concat(content, F.lit(NUMBER_SEP), number.cast("string"))))
