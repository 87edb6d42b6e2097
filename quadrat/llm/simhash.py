"""SimHash near duplicates by pigeonhole blocks.

A fingerprint holds, bit by bit, the majority of the 64-bit hashes of a text's 3-word shingles. Two
fingerprints that differ in at most 2 of 64 bits, cut into 4 blocks, agree on at least 2 blocks: each of the 6
block pairs is a key, fingerprints join on keys and their Hamming distance is verified inside the join.

Texts with one fingerprint are linked already, so only distinct fingerprints are joined and a group of copies of
any size is one row. A key that many distinct fingerprints share is split by the same principle: the 32 bits
outside it are cut into 8 blocks, of which 6 must agree. Such a finer key fixes 56 bits, so at most 256 distinct
fingerprints can share it: the pairs looked at grow with the number of fingerprints, and no link is lost."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quadrat.llm.common import broadcast_within, stored
from quadrat.llm.components import components

BITS = 64
DISTANCE = 2
SHINGLE = 3
BLOCKS, FINE_BLOCKS = 4, 8
#: Distinct fingerprints that share a coarse key from which it is split; the results do not depend on it.
SPLIT_FROM = 48
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number; zero without words. Memory is bounded by CHUNK."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    count, ones = max(1, len(words) - shingle + 1), np.zeros(BITS, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, count, CHUNK):
        upto = min(count, at + CHUNK)
        values = np.array([hashed(b" ".join(words[i:i + shingle]), SEED) for i in range(at, upto)], np.uint64)
        ones += np.unpackbits(values.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count).view(np.int64)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: fingerprint(t if isinstance(t, str) else None)).astype("int64")


def _key(fp: Column, blocks: list[tuple[int, int]]) -> Column:
    """The bits of `fp` in the given (first bit, width) blocks; all others zero."""
    mask = sum(((1 << width) - 1) << first for first, width in blocks)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _keyed(rows: DataFrame, groups: list[list[tuple[int, int]]], columns: list[str]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(i).alias("which"), _key(F.col("fp"), g).alias("key")) for i, g in enumerate(groups)])
    return rows.select(*columns, F.explode(keys).alias("k")).select(*columns, "k.which", "k.key")


def _verified(keyed: DataFrame, by: list[str], distance: int) -> DataFrame:
    """Pairs that share a key and differ in at most `distance` bits, u < v."""
    left, right = keyed.withColumnRenamed("fp", "u"), keyed.withColumnRenamed("fp", "v")
    on = [left[c] == right[c] for c in by]
    near = (left["u"] < right["v"]) & (F.bit_count(left["u"].bitwiseXOR(right["v"])) <= distance)
    return left.join(right, [*on, near]).select("u", "v")


def _blocks(first: int, width: int, count: int) -> list[tuple[int, int]]:
    size = width // count
    return [(first + i * size, size) for i in range(count)]


def linked_fingerprints(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v), u < v: all pairs of distinct values of `fp` at most `distance` bits apart."""
    coarse = [list(c) for c in combinations(_blocks(0, BITS, BLOCKS), BLOCKS - distance)]
    keyed = stored(_keyed(fps.select("fp").distinct(), coarse, ["fp"]), "blocks")
    sizes = keyed.groupBy("which", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    sizes = stored(sizes, "block-sizes")
    small = keyed.join(sizes.filter(F.col("n") <= SPLIT_FROM).drop("n"), ["which", "key"])
    found = _verified(small, ["which", "key"], distance)
    hot = keyed.join(sizes.filter(F.col("n") > SPLIT_FROM).drop("n"), ["which", "key"])
    for i, fixed in enumerate(coarse):
        inside = lambda b: any(first <= b[0] < first + width for first, width in fixed)  # noqa: E731, B023
        free = [b for b in _blocks(0, BITS, 2 * FINE_BLOCKS) if not inside(b)]
        fine = [fixed + list(c) for c in combinations(free, FINE_BLOCKS - distance)]
        rows = _keyed(hot.filter(F.col("which") == i).select("fp"), fine, ["fp"])
        found = found.unionAll(_verified(rows, ["which", "key"], distance))
    return found.distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, row_key, fingerprint, root, component_id), a row per document.

    `component_id` is the least doc_id that links lead to, the document's own included; null ids are passed
    over. `root`, the least fingerprint of the component as a signed number, names it even where one doc_id is the least
    of two. `row_key` tells rows of one doc_id and different texts apart. Texts without words, null among
    them, have fingerprint zero and are linked like any other."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), _fingerprints(F.col("text")).alias("fp"))
    rows = stored(rows, "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(linked_fingerprints(nodes, distance)).withColumnRenamed("node", "fp")
    nodes = stored(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("fp", "root", "component_id")
    out = rows.join(named, "fp")
    return out.select("doc_id", "row_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`docs` with one row of each component: that with the least doc_id, then the least text hash.

    Rows with equal ids and texts count as copies. Columns pass through as they are, whatever their names."""
    return keep_first(docs, stored(near_duplicates(docs, distance), "near-duplicates"))


#: Rows to leave out that are broadcast at most; beyond it the same join is shuffled.
BROADCAST_ROWS = 200_000


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` with one row of each `root` of `found` (doc_id, row_key, root): the least doc_id, then row_key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("f")
    kept = found.groupBy("root").agg(first).select(F.col("f.doc_id").alias("keep_id"), F.col("f.row_key").alias("keep_key"))
    own = found.select("doc_id", "row_key").distinct()
    lost = own.join(kept, own["doc_id"].eqNullSafe(kept["keep_id"]) & (own["row_key"] == kept["keep_key"]), "left_anti")
    lost = stored(lost, "lost-rows")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    on = rows["own_id"].eqNullSafe(lost["doc_id"]) & (rows["own_key"] == lost["row_key"])
    stay = rows.join(broadcast_within(lost, lost.count(), BROADCAST_ROWS), on, "left_anti")
    if _any_twice(found):
        stay = stay.groupBy("own_id", "own_key").agg(F.first("row").alias("row"))
    return stay.select("row.*")


def _any_twice(found: DataFrame) -> bool:
    again = found.groupBy("doc_id", "row_key").agg(F.count("*").alias("n")).filter("n > 1")
    return not again.isEmpty()
