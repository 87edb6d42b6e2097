"""Packing by cutting-stock column generation.

A text becomes its token ids and an end id. Every 2048 ids are a piece of their own, the rest is one shorter piece,
so all that packing needs is a histogram of at most 2048 lengths, however many texts there are. A linear program over
patterns (multisets of lengths that fit a sequence) asks for the fewest sequences that hold the histogram: a greedy
basis starts it, a knapsack dynamic program prices new patterns, and it ends when the bound of the duals is met
within a tolerance. Rounded-down patterns are used as often as they say; the few pieces left are packed greedily.
Pieces are ranked within their length and patterns own ranges of ranks, so a join on length places them all."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import stored
from quadrat.llm.tokens import public_encoder

CAPACITY = 2048
END_ID = 1
RANK_ROWS = 50_000
Pattern = dict[int, int]


@dataclass(frozen=True)
class Solution:
    """Patterns with the times each is used, the LP's bound on the number of sequences, and pricing rounds."""

    patterns: list[tuple[Pattern, int]]
    bound: float
    rounds: int


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, Pattern]:
    """The multiset of lengths within capacity that is worth most, by dynamic programming."""
    use = values > 1e-12
    lengths, values = lengths[use], values[use]
    order = np.argsort(lengths)
    lengths, values = lengths[order], values[order]
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            worth = best[c - lengths[:k]] + values[:k]
            top = int(worth.argmax())
            if worth[top] > best[c] + 1e-12:
                best[c], last[c] = worth[top], top
    pattern: Pattern = {}
    c = capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
            continue
        size = int(lengths[last[c]])
        pattern[size] = pattern.get(size, 0) + 1
        c -= size
    return float(best[capacity]), pattern


def _greedy(counts: dict[int, float], capacity: int, whole: bool) -> list[tuple[Pattern, float, list[int]]]:
    """Longest length first, each time the longest that still fits; a pattern repeats until a length runs out.

    Returns each pattern with its use and the lengths it used up."""
    left = dict(counts)
    found: list[tuple[Pattern, float, list[int]]] = []
    while left:
        lengths = np.array(sorted(left))
        space, pattern, top = capacity, {}, len(lengths) - 1
        while space and (top := min(top, int(np.searchsorted(lengths, space, "right")) - 1)) >= 0:
            size = int(lengths[top])
            fit = space // size
            if whole:
                fit = min(fit, int(left[size]))
            if fit:
                pattern[size] = fit
            space -= fit * size
            top -= 1
        times = min(left[size] // n if whole else left[size] / n for size, n in pattern.items())
        for size, n in pattern.items():
            left[size] -= times * n
        gone = [size for size in pattern if left[size] <= 1e-9]
        for size in gone:
            del left[size]
        found.append((pattern, times, gone))
    return found


def solve(histogram: dict[int, int], capacity: int = CAPACITY, tolerance: float = 0.001, rounds: int = 150) -> Solution:
    """Patterns and their whole-number use for all pieces of `histogram` (length -> pieces)."""
    histogram = {size: n for size, n in histogram.items() if n > 0}
    if not histogram:
        return Solution([], 0.0, 0)
    basis = _greedy({k: float(v) for k, v in histogram.items()}, capacity, whole=False)
    lengths = np.array(sorted(histogram))
    row = {int(size): i for i, size in enumerate(lengths)}
    need = np.array([histogram[int(size)] for size in lengths], float)
    columns: list[tuple[Pattern, float, int]] = []
    for pattern, times, gone in basis:  # one column for each length that a pattern uses up
        columns.append((pattern, times, gone[0]))
        columns += [({size: capacity // size}, 0.0, size) for size in gone[1:]]
    patterns, x = [p for p, _, _ in columns], np.array([t for _, t, _ in columns])
    total = float(lengths @ need) / capacity
    bound, done, inverse = total, 0, None
    while done < rounds:
        if x.sum() <= max(bound, total) * (1 + tolerance) and done:
            break
        if inverse is None:
            inverse = _triangular_inverse(columns, row)
        dual = inverse.sum(axis=0)
        worth, new = knapsack(lengths, dual, capacity)
        done += 1
        bound = max(bound, float(np.maximum(dual, 0) @ need) / max(worth, 1.0))
        if worth <= 1 + 1e-9:
            break
        column = sum(n * inverse[:, row[size]] for size, n in new.items())
        up = column > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, column, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * column
        x[out] = step
        patterns[out] = new
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
    uses = [(p, int(t + 1e-6)) for p, t in zip(patterns, x, strict=True)]
    rest = dict(histogram)
    kept: list[tuple[Pattern, int]] = []
    for pattern, times in uses:
        times = min([times, *(rest[size] // n for size, n in pattern.items())])
        if times > 0:
            kept.append((pattern, times))
            for size, n in pattern.items():
                rest[size] -= times * n
    kept += [(p, int(t)) for p, t, _ in _greedy({k: v for k, v in rest.items() if v > 0}, capacity, whole=True)]
    return Solution(kept, bound, done)


def _triangular_inverse(columns: list[tuple[Pattern, float, int]], row: dict[int, int]) -> np.ndarray:
    """The inverse of the greedy basis: a length is in no column after the one that used it up."""
    holds: dict[int, list[tuple[int, int]]] = {}
    for j, (pattern, _, _) in enumerate(columns):
        for size, n in pattern.items():
            holds.setdefault(size, []).append((j, n))
    inverse = np.zeros((len(columns), len(columns)))
    for j, (pattern, _, size) in enumerate(columns):
        inverse[j, row[size]] = 1.0
        for before, n in holds[size]:
            if before < j:
                inverse[j] -= n * inverse[before]
        inverse[j] /= pattern[size]
    return inverse


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
               vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the pieces of every row, in Arrow batches."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = public_encoder(vocabulary, ranks)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = encoder.encode(text) + end
                size = len(raw) // 4
                for start in range(0, size, capacity):
                    piece = raw[4 * start:4 * (start + capacity)]
                    made = (i, start, len(piece) // 4, zlib.crc32(piece), size, np.frombuffer(piece, "<u4").tolist() if keep_ids else None)
                    for values, value in zip(out, made, strict=True):
                        values.append(value)
            columns = [batch.column(0).take(pa.array(out[0], pa.int64())), *[pa.array(v, pa.int64()) for v in out[1:5]]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns, names = [*columns, pa.array(out[5], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(cut, schema + (", ids array<long>" if keep_ids else ""))


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, **paths: str) -> DataFrame:
    """The pieces of `docs` with sequence_id and offset, without gaps from 0, and no sequence over capacity.

    A null or empty text is its end id alone. Repeated rows are packed again, each on its own; other columns are
    not read. Sequence ids count from 0."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, capacity, end_id, keep_ids, **paths), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, first, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in solve(histogram, capacity).patterns:
        offset = 0
        for size, each in sorted(pattern.items(), reverse=True):
            slots.append((size, first[size], first[size] + times * each, each, sequence, offset))
            first[size] += times * each
            offset += size * each
        sequence += times
    kinds = "length long, from_rank long, to_rank long, each long, sequence long, at long"
    table = F.broadcast(spark.createDataFrame(slots, kinds))  # as many rows as patterns have lengths
    parts = max(16, sum(histogram.values()) // RANK_ROWS)
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts))
    pieces = pieces.withColumn("part", part)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = pieces.groupBy("length", "part").agg(F.count("*").alias("n")).select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(ahead, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead")).drop("ahead", "part")
    place = F.col("rank") - F.col("from_rank")
    on = (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    names = [ranked[c] for c in pieces.columns if c != "part"]
    return ranked.join(table, on).select(
        *names, (F.col("sequence") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + place % F.col("each") * ranked["length"]).cast("long").alias("offset"))
