"""Country text to ISO codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.text import as_col, country_token, is_blank
from quadrat.lookups import country_reference
from quadrat.operators.fuzzy import fuzzy_pairs
from quadrat.session import settled

MIN_FUZZY_LENGTH = 4


def edit_budget(length: int) -> int:
    return max(1, length // 4)


def _edit_budget(length: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length / 4))


def fuzzy_countries(tokens: DataFrame, reference: DataFrame) -> DataFrame:
    """(token, iso3) for misspelt tokens whose single closest name is within the edit budget."""
    names = reference.filter("layer >= 3").select(F.col("token").alias("name"), "iso3")
    near = fuzzy_pairs(
        tokens.filter(F.length("token") >= MIN_FUZZY_LENGTH), names.select("name").distinct(),
        "token", "name", edit_budget, _edit_budget,
    )
    per_distance = near.groupBy("token", "distance").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    best = per_distance.groupBy("token").agg(
        F.min_by(F.struct("n", "name"), F.col("distance")).alias("b")
    ).filter("b.n = 1")
    return best.select("token", F.col("b.name").alias("name")).join(names, "name").select("token", "iso3")


def resolved_tokens(df: DataFrame, columns: list[Column | str], reference: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """(token, iso3) for the distinct country texts of some columns: codes, names, aliases, then spelling."""
    reference = country_reference(df.sparkSession) if reference is None else reference
    parts = [df.select(country_token(as_col(c)).alias("token")) for c in columns]
    tokens = reduce(lambda a, b: a.unionByName(b), parts).filter("token <> ''").distinct()
    exact = tokens.join(reference.select("token", "iso3"), "token", "left")
    found = exact.filter(F.col("iso3").isNotNull())
    if not fuzzy:
        return found
    return found.unionByName(fuzzy_countries(exact.filter(F.col("iso3").isNull()).select("token"), reference))


def with_country_codes(
    df: DataFrame, columns: dict[str, str], reference: DataFrame | None = None, fuzzy: bool = True, texts: DataFrame | None = None
) -> DataFrame:
    """Add an ISO3 column per country column (`{source: target}`); only distinct texts are resolved.

    They are read from `texts`, a table that is cheaper to make and holds the same cells, if one is given."""
    codes = settled(resolved_tokens(df if texts is None else texts, [F.col(f"`{c}`") for c in columns], reference, fuzzy), "token")
    out = df
    for source, target in columns.items():
        side = codes.select(F.col("token").alias("__token"), F.col("iso3").alias(target))
        out = out.withColumn("__t", country_token(F.col(f"`{source}`"))).join(
            side, F.col("__t") == F.col("__token"), "left"
        ).drop("__t", "__token")
    return out


def with_alpha2(df: DataFrame, column: str = "countryCode", reference: DataFrame | None = None) -> DataFrame:
    """Three-letter codes become two-letter ones, blanks become NULL, other text stays."""
    reference = country_reference(df.sparkSession) if reference is None else reference
    codes = reference.filter("layer = 1").select(F.col("iso3").alias("__iso3"), F.col("iso2").alias("__iso2"))
    v = F.nullif(F.trim(F.col(column)), F.lit(""))
    joined = df.join(codes, F.upper(v) == F.col("__iso3"), "left")
    return joined.withColumn(column, F.when(F.length(v) == 3, F.col("__iso2")).otherwise(v)).drop("__iso3", "__iso2")


def derive_country_code(df: DataFrame, reference: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Fill a blank countryCode from the country text; `texts` as in `with_country_codes`."""
    coded = with_country_codes(df, {"country": "__iso3"}, reference, texts=texts)
    if "countryCode" not in df.columns:
        return coded.withColumnRenamed("__iso3", "countryCode")
    return coded.withColumn(
        "countryCode", F.when(is_blank("countryCode"), F.col("__iso3")).otherwise(F.col("countryCode"))
    ).drop("__iso3")


def with_is_brazilian(df: DataFrame, out: str = "is_brazilian", reference: DataFrame | None = None) -> DataFrame:
    """countryCode decides, the country text only where the code tells nothing."""
    present = [c for c in ("countryCode", "country") if c in df.columns]
    if not present:
        return df.withColumn(out, F.lit(False))
    coded = with_country_codes(df, {c: f"__{c}" for c in present}, reference)
    iso = F.coalesce(*[F.col(f"__{c}") for c in present])
    return coded.withColumn(out, F.coalesce(iso == "BRA", F.lit(False))).drop(*[f"__{c}" for c in present])
