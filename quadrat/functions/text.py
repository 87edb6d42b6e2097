"""Text keys, tokens and cell tests."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\r\n"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim blanks, tabs and line ends."""
    return F.trim(as_col(value), F.lit(WHITESPACE))


def text(value: Column | str) -> Column:
    """Stripped text with '' for NULL: the form all cell checks compare."""
    return strip(F.coalesce(as_col(value).cast("string"), F.lit("")))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(strip(as_col(value).cast("string")), F.lit(""))


def is_blank(value: Column | str) -> Column:
    return text(value) == ""


def domain_key(value: Column | str) -> Column:
    """Lower, stripped, '' for NULL."""
    return F.lower(text(value))


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letter, from Unicode decomposition."""
    source, target = [], []
    for code in range(0x00C0, 0x0250):
        char = chr(code)
        base = unicodedata.normalize("NFD", char)[0]
        if base != char and base.isascii():
            source.append(char)
            target.append(base)
    for char, base in {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i"}.items():
        source.append(char)
        target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}


def fold_accents(value: Column | str) -> Column:
    """Replace accented Latin letters by ASCII ones; plain ASCII cells skip the work."""
    value = as_col(value)
    folded = F.translate(value, FOLD_FROM, FOLD_TO)
    for char, base in LIGATURES.items():
        folded = F.replace(folded, F.lit(char), F.lit(base))
    return F.when(value.rlike(r"[^\x00-\x7f]"), folded).otherwise(value)


def match_form(value: Column | str) -> Column:
    """Matching form: lower, no accents, everything but letters and digits a single space."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(as_col(value))), "[^a-z0-9]+", " "))


def country_token(value: Column | str) -> Column:
    return match_form(text(value))


def tokens(value: Column | str) -> Column:
    """Words of the matching form."""
    form = match_form(F.coalesce(as_col(value), F.lit("")))
    return F.when(form == "", F.array().cast("array<string>")).otherwise(F.split(form, " "))


def split_camel(value: Column | str) -> Column:
    return F.regexp_replace(as_col(value), "([a-z])([A-Z])", "$1 $2")


def camel_tokens(value: Column | str) -> Column:
    """Distinct words of a header, camelCase split first."""
    return F.array_distinct(tokens(split_camel(value)))


CELL_REFERENCE = r"\$?[A-Za-z]{1,3}\$?[1-9][0-9]*"


def is_formula_like(value: Column | str) -> Column:
    """A cell a spreadsheet would run as a formula."""
    v = text(value)
    signed = v.rlike("^[+-]")
    return F.when(
        v.rlike("^[-+=@]"),
        v.rlike("^[=@]")
        | v.rlike(f"^[+-]{CELL_REFERENCE}(:{CELL_REFERENCE})?$")
        | v.rlike(f"^[+-]{CELL_REFERENCE}[+-]")
        | (
            signed
            & v.rlike(r"[=*/^(!|&]|^[+-][0-9.]+[+-][0-9]")
            & ~v.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$")
        ),
    ).otherwise(F.lit(False))


def formula_fix(value: Column | str) -> Column:
    """The cell without its leading formula marks, NULL when that changes nothing."""
    v = text(value)
    fixed = strip(F.regexp_replace(v, "^[=@+]+", ""))
    return F.when((fixed != "") & (fixed != v), fixed)


def quote_formula(value: Column | str) -> Column:
    value = as_col(value)
    return F.when(is_formula_like(value), F.concat(F.lit("'"), value)).otherwise(value)


def unbalanced_brackets(value: Column | str) -> Column:
    value = F.coalesce(as_col(value), F.lit(""))

    def count(char: str) -> Column:
        return F.length(value) - F.length(F.replace(value, F.lit(char), F.lit("")))

    return (count("(") != count(")")) | (count("[") != count("]"))


SPACE_CHARS = r"[\u00A0\u2028\u2029\u2007\u202F]"
INVISIBLE_CHARS = r"[\u0080-\u009F\u200B-\u200F\u202A-\u202E\u2060\uFEFF\u00AD]"
NON_ASCII = r"[^\x01-\x7f]"


def clean_invisible(value: Column | str) -> Column:
    """Odd spaces become a space; control, zero-width and direction marks go."""
    value = as_col(value)
    cleaned = F.regexp_replace(F.regexp_replace(value, SPACE_CHARS, " "), INVISIBLE_CHARS, "")
    return F.when(value.rlike(NON_ASCII), cleaned).otherwise(value)


def join_filled(columns: list[Column | str], sep: str = " | ") -> Column:
    """Concatenate the filled cells of a row, NULL when none is."""
    joined = F.concat_ws(sep, *[blank_to_null(c) for c in columns])
    return F.nullif(joined, F.lit(""))


def drop_empty_tokens(value: Column | str, sep: str = " | ") -> Column:
    """Remove blank items of an already joined list."""
    value = as_col(value)
    mark = sep.strip()
    parts = F.transform(F.split(value, F.lit("\\Q" + mark + "\\E")), lambda x: strip(x))
    rebuilt = F.nullif(F.array_join(F.filter(parts, lambda x: x != ""), sep), F.lit(""))
    return F.when(value.contains(mark), rebuilt).otherwise(blank_to_null(value))


def semicolon_list(value: Column | str) -> Column:
    """`a; b;` becomes `a | b`."""
    value = as_col(value)
    parts = F.filter(F.transform(F.split(value, ";"), lambda x: strip(x)), lambda x: x != "")
    return F.when(value.contains(";"), F.nullif(F.array_join(parts, " | "), F.lit(""))).otherwise(value)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def literal_map(entries: dict[str, str]) -> Column:
    """A small constant lookup; only for lists of fixed, short length."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def lookup(entries: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(entries), key)
