"""Repeated passages by relative Lempel-Ziv parsing.

Every document is a reference for those after it. The texts are cut into reference blocks by content, so that equal
passages are cut alike: of the SHINGLE-word shingles in a window of 50 words the one with the least hash is the
window's anchor, and windows in a row with one anchor are a block. Each window is in just one block.

The index lists each distinct block once, with the least document that holds it. A document is parsed greedily
from left to right against all of the index: a block that a smaller document holds whole continues the factor. Where the
index has the anchor, but only in other blocks, a factor ends: there the windows are checked one by one against
the windows of all blocks with that anchor, each again listed once with its least document. Factors of
at least 50 words that meet become the repeated spans of the document.

A block or window that any number of documents share is one row of the index, aggregated before it is shuffled; no
two documents are ever paired. The second pass over the texts reads windows of such boundaries alone, chosen
by a bit table of fixed size, and only rows that such tables let through are joined; what passes wrongly is
checked like the rest. Words, shingles, blocks
and windows are compared by 64-bit hashes; a window needs its own and its anchor's to agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quadrat.llm.common import bit_table, broadcast_within, is_listed, listed, split_words, stored, xxhash64_of

WINDOW = 50
SHINGLE = 8
#: Windows of one text that are looked at together; it bounds memory, the results do not depend on it.
STEP = 1 << 20
#: Anchors with several blocks that are broadcast at most; beyond it the same join is shuffled.
BROADCAST_ROWS = 1 << 19
_KNOWN_WORDS = 1 << 17
_PLACE_BITS = 21
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _FACTORS[0] + (right ^ (right >> np.uint64(29))) * _FACTORS[1]
    return out ^ (out >> np.uint64(32))


class WordHashes(dict):
    """Hashes of words, each computed once; forgets all when it holds many."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _windows(words: np.ndarray, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows and of all shingles of a sequence of word hashes."""

    def spans(size: int) -> np.ndarray:
        out, upto = None, 0
        for width, level in reversed(list(levels.items())):
            if upto + width <= size:
                part = level[upto:upto + len(words) - size + 1]
                out, upto = part if out is None else _joined(out[:len(part)], part), upto + width
        return out[:len(words) - size + 1]

    levels, width = {1: words}, 1
    while 2 * width <= max(window, shingle):
        levels[2 * width] = _joined(levels[width][:-width], levels[width][width:])
        width *= 2
    return spans(window), spans(shingle)


Piece = tuple[int, int, np.ndarray]


def pieces_of(words: np.ndarray, row: int, window: int) -> Iterator[Piece]:
    """(row, first word, word hashes) of a text: the whole text, or overlapping parts with STEP windows each."""
    for first in range(0, len(words) - window + 1, STEP):
        yield row, first, words[first:first + STEP + window - 1]


def blocks_of(pieces: list[Piece], window: int, shingle: int) -> tuple[np.ndarray, ...]:
    """(row, start, count, anchor, block, windows): arrays with an entry per block, the windows one after another."""
    sizes = np.array([len(w) for _, _, w in pieces])
    words = np.concatenate([w for _, _, w in pieces])
    hashes, shingles = _windows(words, window, shingle)
    piece = np.repeat(np.arange(len(pieces)), sizes)[:len(hashes)]
    inside = np.arange(len(hashes)) - (np.cumsum(sizes) - sizes)[piece]
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    least = (shingles & ~mask) | (mask - np.arange(len(shingles), dtype=np.uint64))
    width, left = 1, window - shingle
    while left:  # the least of all shingles in a window, the last of equal ones
        step = min(width, left)
        least, width, left = np.minimum(least[:-step], least[step:]), width + step, left - step
    at = (mask - (least & mask)).astype(np.int64)
    within = np.flatnonzero(inside <= (sizes - window)[piece])
    at, piece, inside, hashes = at[within], piece[within], inside[within], hashes[within]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]))))
    offsets = np.random.default_rng(7).integers(0, 1 << 63, window, np.int64).view(np.uint64) | np.uint64(1)
    block = np.add.reduceat(hashes * offsets[at - within], new)
    rows, firsts = (np.array([p[i] for p in pieces], np.int64)[piece[new]] for i in range(2))
    return (rows, inside[new] + firsts, np.diff(new, append=len(hashes)), shingles[at[new]],
            block ^ (block >> np.uint64(32)), hashes)


def _batched(batch: pa.RecordBatch, known: WordHashes, window: int) -> Iterator[list[Piece]]:
    """The pieces of all texts of a batch, as many together as STEP words allow."""
    held, size = [], 0
    for row, text in enumerate(batch.column(2)):
        for piece in pieces_of(known.of(text.as_buffer().to_pybytes().split()), row, window):
            if held and size + len(piece[2]) > STEP + window:
                yield held
                held, size = [], 0
            held.append(piece)
            size += len(piece[2])
    if held:
        yield held


FIELDS = [StructField(c, LongType()) for c in ("doc_id", "row_key", "start", "count", "anchor", "block")]


def _parsed(docs: DataFrame, window: int, shingle: int) -> DataFrame:
    """The blocks of all rows (doc_id, row_key, text)."""
    schema = StructType(FIELDS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy() for i in range(2))
            for pieces in _batched(batch, known, window):
                row, start, count, anchor, block, _ = blocks_of(pieces, window, shingle)
                yield pa.record_batch([pa.array(x) for x in (
                    ids[row], keys[row], start, count, anchor.view(np.int64), block.view(np.int64))], schema.names)

    return docs.mapInArrow(parse, schema)


def _boundaries(docs: DataFrame, wanted: bytes, window: int, shingle: int) -> DataFrame:
    """(doc_id, row_key, anchor, starts, windows) of the blocks in the bit table `wanted`, once per text."""
    lists = [StructField(c, ArrayType(LongType())) for c in ("starts", "windows")]
    schema = StructType([FIELDS[0], FIELDS[1], FIELDS[4], *lists])

    def as_lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy() for i in range(2))
            for pieces in _batched(batch, known, window):
                row, start, count, anchor, block, hashes = blocks_of(pieces, window, shingle)
                keep = np.flatnonzero(is_listed(wanted, xxhash64_of(anchor, block, ids[row])))
                if not len(keep):
                    continue
                order = keep[np.lexsort((start[keep], block[keep], anchor[keep], row[keep]))]
                same = [(x[order][1:] == x[order][:-1]) for x in (row, anchor, block)]
                new = np.flatnonzero(np.concatenate(([True], ~np.logical_and.reduce(same))))
                one = order[new]
                begin = (np.cumsum(count) - count)[one]
                at = np.arange(count[one].sum()) - np.repeat(np.cumsum(count[one]) - count[one] - begin, count[one])
                yield pa.record_batch([
                    pa.array(ids[row[one]]), pa.array(keys[row[one]]), pa.array(anchor[one].view(np.int64)),
                    as_lists(start[order], np.diff(new, append=len(order))), as_lists(hashes[at].view(np.int64), count[one]),
                ], schema.names)

    return docs.mapInArrow(parse, schema)


def _met(spans: Column) -> Column:
    """Spans (start, end) in order, those that overlap or touch joined."""
    one = "array<struct<start:bigint,end:bigint>>"

    def add(a: Column, s: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        joined = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        touch = F.coalesce(last["end"] >= s["start"], F.lit(False))
        return F.when(touch, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), joined)).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(one), add)


def repeated_spans(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, spans) of documents with words in a window that a smaller doc_id holds too.

    `spans` are (start, end) in words, end exclusive, in order and apart. `row_key` is the hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    blocks = stored(_parsed(rows, window, shingle), "reference-blocks")
    index = blocks.groupBy("anchor", "block").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    index = stored(index, "reference-index")
    repeated, name = index.filter("first < last"), F.xxhash64("anchor", "block")
    maybe = blocks.filter(listed(bit_table(repeated.select(name.alias("h")), "h"), name))
    whole = maybe.join(repeated, ["anchor", "block"]).filter(F.col("doc_id") > F.col("first"))
    whole = whole.select("doc_id", "row_key", "start", (F.col("start") + F.col("count") + window - 1).alias("end"))

    several = index.groupBy("anchor").agg(F.count("*").alias("n"), F.min("first").alias("f"), F.max("last").alias("l"))
    several = stored(several.filter("n > 1 AND f < l").select("anchor"), "shared-anchors")
    holders = index.join(broadcast_within(several, several.count(), BROADCAST_ROWS), "anchor")
    wanted = bit_table(holders.select(F.xxhash64("anchor", "block", "first").alias("h")), "h")
    edges = stored(_boundaries(rows, wanted, window, shingle), "boundary-windows")
    at = edges.select("doc_id", "row_key", "anchor", "starts", F.posexplode("windows").alias("i", "w"))
    first = at.groupBy("anchor", "w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first, name = stored(first.filter("first < last"), "repeated-windows"), F.xxhash64("anchor", "w")
    maybe = at.filter(listed(bit_table(first.select(name.alias("h")), "h"), name))
    part = maybe.join(first, ["anchor", "w"]).filter(F.col("doc_id") > F.col("first"))
    part = part.select("doc_id", "row_key", F.col("i"), F.explode("starts").alias("start"))
    part = part.select("doc_id", "row_key", (F.col("start") + F.col("i")).alias("start"),
                       (F.col("start") + F.col("i") + window).alias("end"))
    factors = whole.unionAll(part).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "end")).alias("s"))
    return factors.select("doc_id", "row_key", _met(F.col("s")).alias("spans"))


def drop_repeated(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept), a row per document: `kept` joins the other words by one space.

    Null and empty texts have no words. Texts of fewer than `window` words are kept whole. Rows of one doc_id are never
    compared with each other, so repeated rows get equal answers; a null doc_id is smaller than none and greater than
    none, its text is kept whole. Other columns are not read."""
    found = stored(repeated_spans(docs, window, shingle), "repeated-spans")
    found = found.select(F.col("doc_id").alias("of_id"), F.col("row_key").alias("of_key"), "spans")
    table = bit_table(found.select(F.xxhash64("of_id", "of_key").alias("h")), "h")
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    maybe = listed(table, F.xxhash64(F.col("doc_id").cast("long"), "row_key"))
    same = (F.col("doc_id").cast("long") == F.col("of_id")) & (F.col("row_key") == F.col("of_key"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = rows.filter(maybe).join(found, same, "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    rows = joined.unionAll(rows.filter(~maybe).select("doc_id", "text", none.alias("spans")))
    rows = rows.select("doc_id", split_words(F.col("text")).alias("words"), "spans")
    size = F.size("words")
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    upto = F.concat(F.transform("spans", lambda s: s["start"]), F.array(size.cast("long")))
    between = F.zip_with(froms, upto, lambda a, b: F.slice(F.col("words"), (a + 1).cast("int"), (b - a).cast("int")))
    kept = F.when(F.size("spans") > 0, F.flatten(between)).otherwise(F.col("words"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", size.cast("long").alias("n_words"), removed.alias("n_removed"), "spans",
                       F.array_join(kept, " ").alias("kept"))
