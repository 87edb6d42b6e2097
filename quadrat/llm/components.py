"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import Scratch, stored


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """`pairs` with `m`, the least of u and all its v. A key with many links is pre-aggregated, then split."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    met = _least_neighbour(down)
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        met.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node each linked node can reach. `links` has columns u and v of one ordered type.

    Each round is written to the shared folder; the rounds end when one changes nothing, after a number that
    grows with the logarithm of the longest chain. Nodes without links are not listed."""
    with Scratch(links.sparkSession) as scratch:
        now, mark, made = scratch.stored(links.select("u", "v").filter("u <> v").distinct(), "0"), None, 0
        while True:
            sums = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
            last, mark = mark, now.agg(sums.alias("m")).collect()[0]["m"]
            if mark == last or not mark[0]:
                break
            made += 1
            now = scratch.stored(_small_star(_large_star(now)), str(made))
            scratch.drop(str(made - 1))
        now = stored(now, "components")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
