"""Phrase collocations by prefix-free parsing.

The words of a text, with a mark between its pieces, are cut at trigger places, where the hash of three words in a
row is divisible by TRIGGER. A chunk runs from one trigger to the end of the next, so that neighbours overlap by
those three words. The distinct chunks of a language with the number of times each was parsed are the dictionary.
A phrase of up to four words belongs to the chunk in which it starts before the closing overlap, where it is whole:
counted in each distinct chunk, weighted by that chunk's frequency, it is counted once for each occurrence.

Phrases are counted by length, as pairs of the hash of all words but the last and the hash of the last. A phrase can be
frequent only if the two phrases one word shorter are. Those pass through a bit table of fixed size: it keeps
rare phrases from being shuffled and, as it lets every frequent one through, changes no count. The words of the
frequent ones are put together by joins from length to length, and their text from that of their words at the
end, for the listed phrases only.

Words and phrases are told apart by 64-bit hashes, of which the word's own holds its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import bit_table, is_listed, stored, xxhash64_of

LONGEST = 4
LEAST = 30
LISTED = 2000
COVERED_PERCENT = 80
SCALE = 2_000_000
TRIGGER = 24
OVERLAP = LONGEST - 1
#: Words counted together before the task hands counts on; it bounds memory, the results do not depend on it.
AT_ONCE = 3 << 19
_KNOWN_WORDS = 1 << 17
_P1 = np.uint64(0x9E3779B97F4A7C15)
MARK = b"."
# Bytes that end a piece become line ends, a tab becomes a space, A-Z lower-case.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def tokens(text: bytes) -> list[bytes]:
    """The lower-cased words of a text, MARK between pieces."""
    return text.translate(_BYTES).replace(b"\n", b" . ").split()


class _Hashes(dict):
    """Hashes of words in one language, each computed once."""

    def __init__(self, lang: str) -> None:
        super().__init__()
        self.prefix = lang.encode() + b"\0"

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(self.prefix + word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _KNOWN_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _cut(words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[bytes, int]]:
    """(chunk, number of places at which phrases start in it)."""
    n = len(words)
    three = xxhash64_of(hashes[:-2], hashes[1:-1], hashes[2:]) if n > OVERLAP else hashes[:0]
    at = np.flatnonzero(three % np.uint64(TRIGGER) == 0)
    bounds = [0, *at[at > 0].tolist(), n]
    for begin, end in zip(bounds, bounds[1:]):
        yield b" ".join(words[begin:end + OVERLAP]), end - begin


def chunk_dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, places, times): the distinct chunks of each language. Null languages are `und`."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter("text IS NOT NULL")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Hashes] = {}
        for batch in batches:
            times: dict[tuple[str, bytes, int], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = tokens(text.as_buffer().to_pybytes())
                hashes = known.setdefault(lang, _Hashes(lang)).of(words)
                for chunk, places in _cut(words, hashes):
                    key = (lang, chunk, places)
                    times[key] = times.get(key, 0) + 1
            langs, chunks, places = zip(*times) if times else ((), (), ())
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(chunks, pa.binary()).cast(pa.string()),
                                   pa.array(places, pa.int64()), pa.array(times.values(), pa.int64())],
                                  ["lang", "chunk", "places", "times"])

    cut = rows.mapInArrow(parse, "lang string, chunk string, places long, times long")
    return cut.groupBy("lang", "chunk", "places").agg(F.sum("times").alias("times"))


class _Stream:
    """Words of many chunks in a row: `hash`, `times` of the chunk, whether a phrase `starts` there, `is_word`, `lang`."""

    def __init__(self, parts: list[tuple], words: list[bytes], langs: list[str]) -> None:
        self.hash, self.times, self.starts, self.is_word, self.lang = (np.concatenate(x) for x in zip(*parts))
        self.words, self.langs = words, langs

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether all are words) of `length` words from each place on."""
        count = max(0, len(self.hash) - length + 1)
        named = xxhash64_of(*[self.hash[i:i + count] for i in range(length)])
        return named, np.logical_and.reduce([self.is_word[i:i + count] for i in range(length)])


def _streams(batches: Iterator[pa.RecordBatch], with_words: bool = False) -> Iterator[_Stream]:
    known: dict[str, _Hashes] = {}
    parts, words, size = [], [], 0
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        chunks = batch.column(1).cast(pa.binary()).to_pylist()
        places, times = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        codes = lang.indices.to_numpy()
        for code, name in enumerate(lang.dictionary.to_pylist()):
            rows = np.flatnonzero(codes == code)
            found = b" . ".join([chunks[i] for i in rows.tolist()]).split(b" ") + [MARK]
            hashes = known.setdefault(name, _Hashes(name))
            count = np.array([chunks[i].count(b" ") + 2 for i in rows.tolist()], np.int64)
            inside = np.arange(len(found)) - np.repeat(np.cumsum(count) - count, count)
            values = hashes.of(found)
            parts.append((values, np.repeat(times[rows], count), inside < np.repeat(places[rows], count),
                          values != np.uint64(hashes[MARK]), np.full(len(found), list(known).index(name), np.int32)))
            words += found if with_words else ()
            size += len(found)
        if size >= AT_ONCE:
            yield _Stream(parts, words, list(known))
            parts, words, size = [], [], 0
    if parts:
        yield _Stream(parts, words, list(known))


def _summed(times: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, each with the sum of its times."""
    order = np.argsort(keys[0] + sum(k * _P1 for k in keys[1:]) if len(keys) > 1 else keys[0])
    keys = [k[order] for k in keys]
    new = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))))
    return *[k[new] for k in keys], np.add.reduceat(times[order], new)


def _first_of_each(times: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, the sum of its times)."""
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return order[new], np.add.reduceat(times[order], new)


def _counted(dictionary: DataFrame, length: int, shorter: bytes, least: int) -> DataFrame:
    """(head, last, f) of the phrases of `length` words; `head` is the hash of all words but the last.

    Only phrases of which both parts one word shorter are listed there, and only those with f >= least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in _streams(batches):
            head, good = stream.phrases(length - 1)
            good &= is_listed(shorter, head)
            at = np.flatnonzero(good[:-1] & good[1:] & stream.starts[:len(good) - 1])
            if len(at):
                first, last, f = _summed(stream.times[at], head[at], stream.hash[at + length - 1])
                yield pa.record_batch([pa.array(first.view(np.int64)), pa.array(last.view(np.int64)), pa.array(f)],
                                      ["head", "last", "f"])

    rows = dictionary.mapInArrow(count, "head long, last long, f long")
    return rows.groupBy("head", "last").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _words_counted(dictionary: DataFrame) -> DataFrame:
    """(lang, w, f, word): how often each word, named by its hash, stands in its language, and its text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in _streams(batches, with_words=True):
            at = np.flatnonzero(stream.starts & stream.is_word)
            if len(at):
                place, f = _first_of_each(stream.times[at], stream.hash[at])
                place = at[place]
                names = pa.array(stream.langs).take(pa.array(stream.lang[place]))
                texts = pa.array([stream.words[i] for i in place.tolist()], pa.binary()).cast(pa.string())
                yield pa.record_batch([names, pa.array(stream.hash[place].view(np.int64)), pa.array(f), texts],
                                      ["lang", "w", "f", "word"])

    rows = dictionary.mapInArrow(count, "lang string, w long, f long, word string")
    texts = F.first("word").alias("word")  # one hash, one text
    return rows.groupBy("lang", "w").agg(F.sum("f").alias("f"), texts)


def _name(length: int) -> Column:
    """The hash of a phrase of `length` words, `ws`."""
    return F.xxhash64(*[F.get("ws", F.lit(i)) for i in range(length)])


def _frequent(dictionary: DataFrame, words: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, ws, f): all phrases of up to `longest` words with f >= least, as the hashes of their words."""
    ones = words.filter(F.col("f") >= least)
    found = ones.select("lang", F.array("w").alias("ws"), "f")
    shorter, listed = found, bit_table(ones.select(F.xxhash64("w").alias("h")), "h")
    for length in range(2, longest + 1):
        counts = stored(_counted(dictionary, length, listed, least), "phrase-counts")
        longer = counts.join(shorter.select("lang", "ws", _name(length - 1).alias("head")), "head")
        shorter = stored(longer.select("lang", F.concat("ws", F.array("last")).alias("ws"), "f"), "phrases")
        found = found.unionAll(shorter)
        listed = bit_table(shorter.select(_name(length).alias("h")), "h")
    return found


def _scored(found: DataFrame, longest: int) -> DataFrame:
    """(lang, ws, a, l, r, score): each phrase of two words or more by its weakest cut."""
    whole = found.filter(F.size("ws") > 1)
    cuts = whole.select("lang", "ws", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    part = lambda name: found.select(F.col("ws").alias(f"{name}_ws"), F.col("f").alias(name))
    cuts = cuts.withColumns({"l_ws": F.slice("ws", F.lit(1), F.col("k")), "r_ws": F.slice("ws", F.col("k") + 1, F.lit(longest))})
    cuts = cuts.join(part("l"), "l_ws").join(part("r"), "r_ws")
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")
    return cuts.groupBy("lang", "ws", "a").agg(weakest).select("lang", "ws", "a", "m.l", "m.r", "m.score")


def _uncovered(scored: DataFrame, percent: int) -> DataFrame:
    """Without the phrases of which so many per cent stand inside one longer phrase."""
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ws") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.slice(F.col("ws"), i, n))))
    longer = scored.filter(F.size("ws") > 2).select(F.explode(inside).alias("ws"), "a")
    longer = longer.groupBy("ws").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    covered = F.coalesce(wide("longer") * 100 >= wide("a") * percent, F.lit(False))
    return scored.join(longer, "ws", "left").filter(~covered).drop("longer")


def _texts(words: DataFrame, listed: DataFrame) -> DataFrame:
    """(h, phrase): the text of the phrases (h, ws) in `listed`, put together from the texts of their words."""
    parts = listed.select("h", F.posexplode("ws").alias("i", "w"))
    named = parts.join(words.select("w", "word"), "w").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("words"))
    return named.select("h", F.array_join("words.word", " ").alias("phrase"))


def collocations(docs: DataFrame, listed: int = LISTED, least: int = LEAST, percent: int = COVERED_PERCENT,
                 longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by score, frequency and text.

    Phrases of 2 to `longest` words with at least `least` occurrences, without those of which `percent` per cent stand
    in one longer phrase. `l` and `r` are the frequencies of the two parts at the weakest cut, `n` the words of
    the language. Null texts have no words, a null language is `und`. Repeated rows count as often as they stand
    there. Other columns are not read. Sums are exact; the ratio is taken in whole decimals."""
    if longest > LONGEST:
        raise ValueError(f"chunks overlap for phrases of at most {LONGEST} words")
    dictionary = stored(chunk_dictionary(docs), "chunks")
    words = stored(_words_counted(dictionary), "words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    scored = stored(_scored(_frequent(dictionary, words, least, longest), longest), "scored-phrases")
    kept = _uncovered(scored, percent)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = kept.withColumn("place", F.rank().over(best)).filter(F.col("place") <= listed).drop("place")
    name = F.coalesce(*[F.when(F.size("ws") == length, _name(length)) for length in range(2, longest + 1)])
    first = stored(first.withColumn("h", name), "first-phrases")
    texts = stored(_texts(words, first), "phrase-texts")
    named = first.join(texts, "h").join(sizes, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    named = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= listed)
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                        F.col("score").cast("long").alias("score"))
