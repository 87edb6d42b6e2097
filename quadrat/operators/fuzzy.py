"""Edit-distance joins without comparing all pairs.

If two strings differ by at most k edits and one is cut into k + 1 segments, some segment
survives unchanged in the other, near its own position. Both sides emit (k, length, segment
number, segment text) and meet in an equi-join; the distance test is the residual condition.
The result is exact: no candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _largest_k(rule: Callable[[int], int], longest: int) -> int:
    """Largest edit budget any query can spend against references of at most `longest` letters."""
    length, best = 1, 0
    while length - rule(length) <= longest:
        best = max(best, rule(length))
        length += 1
    return best


def _cut(i: Column, length: Column, k: Column) -> Column:
    return F.floor(i * length / (k + 1)).cast("int")


def fuzzy_pairs(
    queries: DataFrame, references: DataFrame, query: str, reference: str,
    budget: Callable[[int], int], budget_column: Callable[[Column], Column],
) -> DataFrame:
    """(query, reference, distance) for all pairs within the query's edit budget.

    `queries` and `references` are distinct strings; `budget` gives the edits allowed for a
    query length, as a Python rule and as a Column rule."""
    longest = references.agg(F.max(F.length(reference))).first()[0] or 0
    top = _largest_k(budget, longest)
    if top == 0:
        top = 1
    refs = (
        references.select(F.col(reference), F.length(reference).alias("l"))
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(top))))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        .withColumn("s", _cut(F.col("i"), F.col("l"), F.col("k")))
        .withColumn("e", _cut(F.col("i") + 1, F.col("l"), F.col("k")))
        .select(reference, "k", "l", "i", F.col(reference).substr(F.col("s") + 1, F.col("e") - F.col("s")).alias("seg"))
    )
    n = F.length(query)
    sized = queries.select(F.col(query), n.alias("n"), budget_column(n).cast("int").alias("k")).filter(
        (F.col("k") >= 1) & (F.col("n") - F.col("k") <= longest)
    )
    probes = (
        sized.withColumn(
            "l", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - F.col("k")), F.least(F.lit(longest), F.col("n") + F.col("k"))))
        )
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        .withColumn("s", _cut(F.col("i"), F.col("l"), F.col("k")))
        .withColumn("len", _cut(F.col("i") + 1, F.col("l"), F.col("k")) - F.col("s"))
        .withColumn("d", F.col("n") - F.col("l"))
        .withColumn("lo", F.greatest(F.lit(0), F.col("s") - F.col("i"), F.col("s") + F.col("d") - (F.col("k") - F.col("i"))))
        .withColumn(
            "hi", F.least(F.col("n") - F.col("len"), F.col("s") + F.col("i"), F.col("s") + F.col("d") + (F.col("k") - F.col("i")))
        )
        .filter("lo <= hi")
        .withColumn("at", F.explode(F.sequence("lo", "hi")))
        .select(query, "k", "l", "i", F.col(query).substr(F.col("at") + 1, F.col("len")).alias("seg"))
        .distinct()
    )
    near = F.levenshtein(F.col(query), F.col(reference)) <= F.col("p.k")
    return (
        probes.alias("p")
        .join(
            refs.alias("r"),
            (F.col("p.k") == F.col("r.k")) & (F.col("p.l") == F.col("r.l")) & (F.col("p.i") == F.col("r.i"))
            & (F.col("p.seg") == F.col("r.seg")) & near,
        )
        .select(query, reference)
        .distinct()
        .withColumn("distance", F.levenshtein(F.col(query), F.col(reference)))
    )
