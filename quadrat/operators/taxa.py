"""Operators on scientific names: parse once per distinct name, then join back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.names import DERIVED_TERMS, query_name, with_parts
from quadrat.functions.text import blank_to_null, is_blank, match_form, text
from quadrat.operators.numbering import first_per_key, last_per_key
from quadrat.session import settled

TAXON_TERMS = (*DERIVED_TERMS, "scientificNameAuthorship")


def parsed_names(df: DataFrame, column: str, key: str = "__name") -> DataFrame:
    """(key, parts) for each distinct non-NULL name of a column."""
    distinct = df.select(F.col(f"`{column}`").alias(key)).filter(F.col(key).isNotNull()).distinct()
    return with_parts(distinct, key)


def with_name_parts(df: DataFrame, column: str = "scientificName", out: str = "parts") -> DataFrame:
    """Attach the parsed parts of each name. Only distinct names are parsed."""
    parsed = settled(parsed_names(df, column).withColumnRenamed("parts", out), "__name")
    return df.join(parsed, F.col(f"`{column}`") == F.col("__name"), "left").drop("__name")


def taxon_key(parts: Column) -> Column:
    """Rank-exact key of a name: the matching form of its canonical query name."""
    return F.nullif(match_form(query_name(parts)), F.lit(""))


def with_taxon_key(df: DataFrame, column: str = "scientificName", out: str = "taxon_key") -> DataFrame:
    keys = settled(parsed_names(df, column).select("__name", taxon_key(F.col("parts")).alias(out)), "__name")
    return df.join(keys, F.col(f"`{column}`") == F.col("__name"), "left").drop("__name")


def listed_taxa(names: DataFrame, column: str = "scientificName") -> DataFrame:
    """Build a lookup list: adds `match_key` and keeps the first row per key."""
    keyed = with_taxon_key(names, column, "match_key").filter(F.col("match_key").isNotNull())
    return first_per_key(keyed, ["match_key"], [F.col(column)])


def join_listed(df: DataFrame, lookup: DataFrame, fields: list[str], column: str = "scientificName") -> DataFrame:
    """Left join a species list on the rank-exact key. Catalyst broadcasts it when it is small."""
    side = lookup.select(F.col("match_key").alias("__key"), *fields)
    keyed = with_taxon_key(df, column, "__taxon")
    return keyed.join(side, F.col("__taxon") == F.col("__key"), "left").drop("__taxon", "__key")


def threatened_category(df: DataFrame, threatened: DataFrame, column: str = "scientificName") -> DataFrame:
    return join_listed(df, threatened, ["category", "source"], column)


def invasive_info(df: DataFrame, invasive: DataFrame, column: str = "scientificName") -> DataFrame:
    """Adds invasive, origin_class, introduction_reason and native_range."""
    filled = invasive.withColumn("origin_class", F.coalesce(blank_to_null("origin_class"), F.lit("alien")))
    joined = join_listed(
        df, filled.withColumn("invasive", F.lit(True)),
        ["invasive", "origin_class", "introduction_reason", "native_range"], column,
    )
    return joined.withColumn("invasive", F.coalesce("invasive", F.lit(False)))


def suggest_establishment_means(df: DataFrame, invasive: DataFrame, column: str = "scientificName") -> DataFrame:
    """`introduced` for listed aliens only; translocated natives get no suggestion."""
    joined = join_listed(
        df, invasive.withColumn("origin_class", F.coalesce(blank_to_null("origin_class"), F.lit("alien"))),
        ["origin_class"], column,
    )
    return joined.withColumn(
        "suggested_means", F.when(F.col("origin_class") == "alien", "introduced").otherwise("")
    ).drop("origin_class")


def _truthy(value: Column) -> Column:
    return F.lower(text(value)).isin("true", "1", "yes", "t")


def resolve_sensitivity(
    df: DataFrame, threatened: DataFrame, decisions: DataFrame | None = None, column: str = "scientificName"
) -> DataFrame:
    """Adds `sensitive` and `category`: a researcher's decision beats the list, an unseen name keeps it.

    decisions: scientificName, sensitive, category. The first decision of a key counts."""
    keyed = with_taxon_key(df, column, "__taxon")
    listed = threatened.select(F.col("match_key").alias("__taxon"), F.col("category").alias("__listed"))
    joined = keyed.join(listed, "__taxon", "left")
    if decisions is None:
        return joined.withColumn("category", F.col("__listed")).withColumn(
            "sensitive", F.col("__listed").isNotNull()
        ).drop("__taxon", "__listed")
    marks = with_taxon_key(decisions, "scientificName", "__taxon").filter(F.col("__taxon").isNotNull())
    marks = first_per_key(
        marks.select("__taxon", "scientificName", _truthy(F.col("sensitive")).alias("__mark"),
                     blank_to_null("category").alias("__chosen")),
        ["__taxon"], [F.col("scientificName")],
    ).drop("scientificName")
    return (
        joined.join(marks, "__taxon", "left")
        .withColumn("sensitive", F.coalesce("__mark", F.col("__listed").isNotNull()))
        .withColumn("category", F.coalesce("__chosen", "__listed"))
        .drop("__taxon", "__listed", "__mark", "__chosen")
    )


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Last confirm or correct review per query name (reviewed_at, then seq)."""
    kept = reviews.filter(
        F.lower("review_type").isin("confirm", "correct") & ~is_blank("query_name")
    ).withColumn("review_type", F.lower("review_type"))
    order = [F.col("reviewed_at").isNull(), F.col("reviewed_at"), F.col("seq")]
    return last_per_key(kept, ["query_name"], order)


def rekey_decisions(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Carry decisions over to corrected names; a merged name is sensitive if either was."""
    fixes = latest_reviews(reviews).filter((F.col("review_type") == "correct") & ~is_blank("corrected_name"))
    keyed = with_taxon_key(decisions, "scientificName", "__key")
    by_query = with_taxon_key(fixes, "query_name", "__key").select("__key", F.trim("corrected_name").alias("__to"))
    by_original = with_taxon_key(fixes, "original_name", "__key").select("__key", F.trim("corrected_name").alias("__to2"))
    moved = (
        keyed.join(first_per_key(by_query.filter("__key IS NOT NULL"), ["__key"], [F.col("__to")]), "__key", "left")
        .join(first_per_key(by_original.filter("__key IS NOT NULL"), ["__key"], [F.col("__to2")]), "__key", "left")
        .withColumn("__target", F.coalesce("__to", "__to2"))
        .filter(F.col("__target").isNotNull())
    )
    flag = _truthy(F.col("sensitive")).alias("sensitive")
    own = decisions.select("scientificName", flag, blank_to_null("category").alias("category"), F.lit(0).alias("step"))
    carried = moved.select(
        F.col("__target").alias("scientificName"), flag, blank_to_null("category").alias("category"), F.lit(1).alias("step")
    )
    both = with_taxon_key(own.unionByName(carried), "scientificName", "__key").withColumn(
        "__key", F.coalesce("__key", "scientificName")
    )
    order = F.struct("step", "scientificName")
    return both.groupBy("__key").agg(
        F.min_by("scientificName", order).alias("scientificName"),
        F.bool_or("sensitive").alias("sensitive"),
        F.min_by(F.col("category"), F.when(F.col("sensitive") & F.col("category").isNotNull(), order)).alias("category"),
    ).drop("__key")


def synonym_sensitivity(report: DataFrame, threatened: DataFrame) -> DataFrame:
    """Typed synonyms whose accepted name is listed while they are not: new decision rows."""
    synonyms = report.filter(
        (F.col("validation_status") == "synonym") & ~is_blank("acceptedNameUsage") & ~is_blank("input_name")
    ).select("input_name", "acceptedNameUsage")
    typed = first_per_key(synonyms, ["input_name"], [F.col("acceptedNameUsage")])
    own = threatened_category(typed, threatened, "input_name").filter(F.col("category").isNull())
    accepted = threatened_category(own.drop("category", "source"), threatened, "acceptedNameUsage")
    return accepted.filter(F.col("category").isNotNull()).select(
        F.col("input_name").alias("scientificName"), F.lit(True).alias("sensitive"), "category"
    )


def refresh_taxon_terms(df: DataFrame, old_name: str, new_name: str = "scientificName") -> DataFrame:
    """After a name edit let the derived terms follow: blank ones and ones that came from the old name.

    A new name that parses loses its authorship to its own term."""
    old = parsed_names(df.filter(~F.col(old_name).eqNullSafe(F.col(new_name))), old_name, "__old")
    new = parsed_names(df.filter(~F.col(old_name).eqNullSafe(F.col(new_name))), new_name, "__new")
    joined = (
        df.join(old.withColumnRenamed("parts", "__op"), F.col(old_name) == F.col("__old"), "left")
        .join(new.withColumnRenamed("parts", "__np"), F.col(new_name) == F.col("__new"), "left")
        .withColumn("__changed", F.coalesce(F.col(old_name), F.lit("")) != F.coalesce(F.col(new_name), F.lit("")))
    )
    updated = {}
    for term in TAXON_TERMS:
        current = F.col(term) if term in df.columns else F.lit(None).cast("string")
        follow = F.col("__changed") & (
            is_blank(current) | F.coalesce(current == F.col(f"__op.{term}"), F.lit(False))
        )
        updated[term] = F.when(follow, F.col(f"__np.{term}")).otherwise(current)
    cut = F.col("__changed") & F.col("__np.canonicalName").isNotNull() & ~is_blank(
        F.col("__np.scientificNameAuthorship")
    )
    updated[new_name] = F.when(cut, F.col("__np.canonicalName")).otherwise(F.col(new_name))
    return joined.withColumns(updated).drop("__old", "__new", "__op", "__np", "__changed")


def apply_name_reviews(df: DataFrame, reviews: DataFrame) -> DataFrame:
    """Replace names by their reviewed correction and let the taxon terms follow."""
    latest = latest_reviews(reviews).filter("review_type = 'correct'").select(
        F.col("query_name").alias("__query"), "corrected_name", "original_name"
    )
    keyed = with_name_parts(df, "scientificName", "__parts").withColumn(
        "__query", F.coalesce(query_name(F.col("__parts")), text("scientificName"))
    )
    joined = keyed.join(latest, "__query", "left").withColumn("__before", F.col("scientificName"))
    corrected = F.coalesce(blank_to_null("corrected_name"), blank_to_null("original_name"), F.col("scientificName"))
    renamed = joined.withColumn("scientificName", corrected).drop(
        "__parts", "__query", "corrected_name", "original_name"
    )
    return refresh_taxon_terms(renamed, "__before").drop("__before")


def name_ranks(report: DataFrame) -> DataFrame:
    """(query_name, taxonRank) of resolved names, first per name."""
    kept = report.filter(
        F.col("validation_status").isin("accepted", "synonym") & ~is_blank("query_name") & ~is_blank("taxonRank")
    ).select("query_name", F.lower(text("taxonRank")).alias("taxonRank"))
    return first_per_key(kept, ["query_name"], [F.col("taxonRank")])


def apply_name_ranks(df: DataFrame, ranks: DataFrame) -> DataFrame:
    """One-word names resolved above genus: fix taxonRank and clear a genus equal to the name."""
    side = ranks.select(F.col("query_name").alias("__query"), F.col("taxonRank").alias("__rank"))
    joined = df.withColumn("__query", text("scientificName")).join(side, "__query", "left")
    current = F.col("taxonRank") if "taxonRank" in df.columns else F.lit(None).cast("string")
    fix = (
        (F.col("__query") != "") & ~F.col("__query").contains(" ") & (F.col("__rank") != "genus")
        & (is_blank(current) | F.coalesce(current == "genus", F.lit(False)))
    )
    fix = F.coalesce(fix, F.lit(False))
    out = joined.withColumn("__fix", fix).withColumn(
        "taxonRank", F.when(F.col("__fix"), F.col("__rank")).otherwise(current)
    )
    if "genus" in df.columns:
        clear = F.col("__fix") & (F.col("genus") == F.col("__query"))
        out = out.withColumn("genus", F.when(F.coalesce(clear, F.lit(False)), F.lit("")).otherwise(F.col("genus")))
    return out.drop("__query", "__rank", "__fix")


def distinct_species(df: DataFrame, column: str = "scientificName") -> DataFrame:
    """One row: number of different taxa, unreadable names counted by their text."""
    keyed = with_taxon_key(df.filter(~is_blank(column)), column, "__key")
    per_key = keyed.groupBy(F.coalesce("__key", column).alias("k")).agg(F.count("*").alias("n"))
    return per_key.agg(F.count("*").alias("species"))
