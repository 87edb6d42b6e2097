"""Controlled vocabularies: values, decisions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.coords import coord_number
from quadrat.functions.text import as_col, domain_key, fold_accents, literal_map, lookup, match_form, text
from quadrat.lookups import (
    ABSENT_MARKS, BASIS_LABELS, BLANK_KEY, CONCEPTS, ESTABLISHMENT_DEGREES, ESTABLISHMENT_MEANS, ISLAND_BOXES,
    PRESENT_MARKS, basis_rows, vocabulary_rows,
)
from quadrat.operators.taxa import join_listed

# The word lists are fixed and short, so they are constant maps inside the projection
# instead of joins.


def vocabulary_key(value: Column | str) -> Column:
    return F.regexp_replace(F.lower(text(value)), r"\s+", " ")


def _auto_words(term: str) -> dict[str, str]:
    return {key: target for t, key, target, auto in vocabulary_rows() if t == term and auto}


def _offers(term: str) -> dict[str, str]:
    found: dict[str, list[str]] = {}
    for t, key, target, _ in vocabulary_rows():
        if t == term and target not in found.setdefault(key, []):
            found[key].append(target)
    return {key: "|".join(targets) for key, targets in found.items()}


def map_vocabulary(term: str, value: Column | str) -> Column:
    """Known words become their controlled term, unknown text passes, blank is NULL."""
    v = text(value)
    return F.when(v != "", F.coalesce(lookup(_auto_words(term), vocabulary_key(value)), v))


def vocabulary_suggestions(term: str, value: Column | str) -> Column:
    """All controlled terms a word may stand for, joined by `|`; NULL for an unknown word."""
    return lookup(_offers(term), vocabulary_key(value))


def is_concept(term: str, value: Column | str) -> Column:
    return text(value).isin(*CONCEPTS[term])


def occurrence_status(value: Column | str) -> Column:
    """Presence and absence marks to present / absent."""
    v = text(value)
    low = F.lower(v)
    return F.when(low.isin(*PRESENT_MARKS), "present").when(low.isin(*ABSENT_MARKS), "absent").when(v != "", v)


def basis_of_record(value: Column | str) -> Column:
    """Term, label or synonym to basisOfRecord; '' when unknown."""
    form = match_form(text(value))
    compact = F.replace(form, F.lit(" "), F.lit(""))
    words = literal_map(basis_rows())
    found = F.coalesce(F.try_element_at(words, compact), F.try_element_at(words, form))
    return F.when(form == "", "").otherwise(F.coalesce(found, F.lit("")))


def basis_key(value: Column | str) -> Column:
    key = domain_key(value)
    return F.when(key == "", BLANK_KEY).otherwise(key)


def map_basis_of_record(df: DataFrame, column: str, decisions: DataFrame | None = None, out: str = "basisOfRecord") -> DataFrame:
    """User decision (key, term; '' means skip) first, then the word lists. Of several for a key a term beats a skip."""
    auto = basis_of_record(F.col(f"`{column}`"))
    if decisions is None:
        return df.withColumn(out, auto)
    term = text("term")
    side = decisions.select(
        F.col("key").alias("__key"), F.when(term.isin(*BASIS_LABELS), term).otherwise("").alias("__choice")
    ).groupBy("__key").agg(F.max("__choice").alias("__choice"))
    joined = df.join(side, basis_key(F.col(f"`{column}`")) == F.col("__key"), "left")
    return joined.withColumn(out, F.coalesce("__choice", auto)).drop("__key", "__choice")


def distinct_values(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """(key, raw, n): each value of a vocabulary column with its first spelling; blank cells last."""
    keyed = df.select(F.col(row_id), text(f"`{column}`").alias("raw"), basis_key(f"`{column}`").alias("key"))
    return keyed.groupBy("key").agg(F.min_by("raw", row_id).alias("raw"), F.count("*").alias("n"))


def species_entries(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """(key, raw, n_records) of filled names, most frequent first."""
    keyed = df.select(F.col(row_id), text(f"`{column}`").alias("raw"), domain_key(f"`{column}`").alias("key"))
    grouped = keyed.filter("key <> ''").groupBy("key").agg(
        F.min_by("raw", row_id).alias("raw"), F.count("*").alias("n_records")
    )
    return grouped.orderBy(F.desc("n_records"), "raw")


def oceanic_island(lat: Column | str, lon: Column | str) -> Column:
    """Island whose box holds the point, NULL elsewhere."""
    y, x = coord_number(lat), coord_number(lon)
    out = F.lit(None).cast("string")
    for name, (south, north, west, east) in ISLAND_BOXES.items():
        out = F.when(y.between(south, north) & x.between(west, east), name).otherwise(out)
    return out


def with_establishment_island(df: DataFrame, invasive: DataFrame, species: str, lat: str, lon: str, out: str = "island") -> DataFrame:
    """Island of a record when its species is a translocated native that is not marine."""
    joined = join_listed(df, invasive, ["origin_class", "introduction_reason"], species)
    marine = F.coalesce(match_form("introduction_reason").contains("especies marinhas"), F.lit(False))
    applies = (F.col("origin_class") == "translocated_native") & ~marine
    return joined.withColumn(out, F.when(applies, oceanic_island(F.col(lat), F.col(lon)))).drop(
        "origin_class", "introduction_reason"
    )


def canonical_establishment(value: Column | str, field: str = "means") -> Column:
    """Controlled establishment term whose letters match, '' otherwise."""
    allowed = ESTABLISHMENT_DEGREES if field == "degree" else ESTABLISHMENT_MEANS
    key = F.regexp_replace(fold_accents(F.lower(F.coalesce(as_col(value), F.lit("")))), "[^a-z0-9]", "")
    return F.coalesce(lookup({a.lower(): a for a in allowed}, key), F.lit(""))


def _clean_answer(value: Column | str, field: str) -> Column:
    v = text(value)
    return F.when(v.isin(*(ESTABLISHMENT_DEGREES if field == "degree" else ESTABLISHMENT_MEANS)), v).otherwise("")


def clean_answers(answers: DataFrame) -> DataFrame:
    """Answers per species key (key, means, degree, island_means, island_degree), unknown terms blanked."""
    return answers.select(
        domain_key("key").alias("key"),
        *[_clean_answer(c, c.split("_")[-1]).alias(c) for c in ("means", "degree", "island_means", "island_degree")],
    ).filter("key <> ''")


def with_establishment(
    df: DataFrame, answers: DataFrame, species: str, field: str = "means", mapped: str | None = None,
    island: str | None = None, out: str | None = None,
) -> DataFrame:
    """Establishment term per record: a mapped controlled value, else the answer for its species.
    Island records only take the island answer."""
    out = out or ("degreeOfEstablishment" if field == "degree" else "establishmentMeans")
    both = F.struct(F.col(field).alias("__main"), F.col(f"island_{field}").alias("__island"))
    side = clean_answers(answers).groupBy(F.col("key").alias("__key")).agg(F.max(both).alias("__both")).select("__key", "__both.*")
    joined = df.join(side, domain_key(species) == F.col("__key"), "left")
    answer = F.col("__main") if island is None else F.when(F.col(island).isNotNull(), F.col("__island")).otherwise(F.col("__main"))
    own = F.lit("") if mapped is None else canonical_establishment(mapped, field)
    return joined.withColumn(out, F.when(own != "", own).otherwise(F.coalesce(answer, F.lit("")))).drop(
        "__key", "__main", "__island"
    )


def dropped_establishment(df: DataFrame, raw: str, published: str) -> DataFrame:
    """(raw, n_records) of mapped values that no controlled term could keep."""
    lost = df.filter((text(raw) != "") & (text(published) == ""))
    return lost.groupBy(text(raw).alias("raw")).agg(F.count("*").alias("n_records")).orderBy(F.desc("n_records"), "raw")


def answer_coverage(answers: DataFrame) -> DataFrame:
    """One row: species with an answer per field, and with means but no degree."""
    clean = clean_answers(answers)
    means = (F.col("means") != "") | (F.col("island_means") != "")
    degree = (F.col("degree") != "") | (F.col("island_degree") != "")
    lacking = ((F.col("means") != "") & (F.col("degree") == "")) | (
        (F.col("island_means") != "") & (F.col("island_degree") == "")
    )
    return clean.agg(
        F.count_if(means).alias("answered_means"), F.count_if(degree).alias("answered_degree"),
        F.count_if(lacking).alias("missing_degree"),
    )
