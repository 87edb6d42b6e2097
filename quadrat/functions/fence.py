"""A stop for predicate pushdown between staged projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pass `columns` through a one-row generator.

    Catalyst inlines aliases when it pushes a filter below a projection; over many stages that
    repeats every pattern match again and again. Filters on generated columns stay above the
    generator, filters on all other columns still reach the scan."""
    rest = [c for c in df.columns if c not in columns]
    picked = F.struct(*[F.col(f"`{c}`") for c in df.columns if c in columns])
    return df.select(*[F.col(f"`{c}`") for c in rest], F.inline(F.array(picked)))
