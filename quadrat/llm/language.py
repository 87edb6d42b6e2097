"""Language identification: scripts narrow the candidates, Viterbi labels the words.

Each language is a table of character trigram counts (hashed into a fixed number of buckets) and the scripts it was
seen in, learned from all labelled training rows. A word's score in a language is the log probability of its
trigrams; languages not seen in the word's script are out. Viterbi over the words, with a penalty for each change of
language, cuts a text into spans; the language with most letters names the text.

Training sums counts inside tasks, then by (language, bucket); the model's size is languages x buckets, whatever the
number of rows. Prediction is row by row and shuffles nothing."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
UNKNOWN = "und"
CHUNK_CHARS = 1 << 19
CELLS = 1 << 21
# First code points of the Unicode blocks that begin a script; a block runs to the next entry.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"),
    (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Bopomofo"),
    (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"),
    (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF65, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def character_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter or a mark, its lower case, its script, is it a mark."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    mark = np.zeros(0x110000, bool)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] in "LM":
            letter[code], mark[code] = True, kind[0] == "M"
            if kind in ("Lu", "Lt") and len(small := chr(code).lower()) == 1:
                lower[code] = ord(small)
    firsts = np.array([first for first, _ in SCRIPTS])
    numbers = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.uint8)
    return letter, lower, numbers[np.searchsorted(firsts, np.arange(0x110000), "right") - 1], mark


@dataclass
class Words:
    """The words of several texts: text number, first and end character in it, letters, and trigram buckets."""

    text: np.ndarray
    first: np.ndarray
    end: np.ndarray
    script: np.ndarray
    buckets: np.ndarray
    at: np.ndarray

    @property
    def letters(self) -> np.ndarray:
        return self.end - self.first


def words_of(texts: list[str]) -> Words:
    letter, lower, scripts, mark = character_tables()
    joined = "\n" + "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    offsets = np.cumsum([1, *[len(t) + 1 for t in texts]])
    inside = letter[codes]
    edges = np.diff(inside.view(np.int8))
    starts, ends = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    for i in np.flatnonzero(mark[codes[starts]]):  # marks alone, such as those in emoji, are no word
        inside[starts[i]:ends[i]] = not mark[codes[starts[i]:ends[i]]].all()
    starts, ends = starts[inside[starts]], ends[inside[starts]]
    small = np.where(inside, lower[codes], 0).astype(np.uint32)
    places = np.flatnonzero(inside)
    mixed = small[places - 1] * np.uint32(0x9E3779B1) ^ small[places] * np.uint32(0x85EBCA77) ^ small[places + 1] * np.uint32(0xC2B2AE3D)
    buckets = ((mixed ^ (mixed >> 15)) & np.uint32(BUCKETS - 1)).astype(np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    at = np.concatenate([[0], np.cumsum(ends - starts)[:-1]]) if len(starts) else np.zeros(0, np.int64)
    return Words(text, starts - offsets[text], ends - offsets[text], scripts[codes[starts]], buckets, at)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about CHUNK_CHARS characters; one longer text is a run of its own."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or "")
        size += len(text or "")
        if size >= CHUNK_CHARS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


@dataclass
class LanguageModel:
    """Log probabilities (buckets x languages) and which languages are written in which script."""

    languages: list[str]
    log_prob: np.ndarray
    in_script: np.ndarray
    penalty: float = 12.0

    def scores(self, words: Words) -> np.ndarray:
        if not len(words.at):
            return np.zeros((0, len(self.languages)), np.float32)
        scores = np.add.reduceat(self.log_prob[words.buckets], words.at, axis=0)
        allowed = self.in_script[words.script]
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), scores, scores.min(axis=1, keepdims=True) - 50)

    def labels(self, words: Words) -> np.ndarray:
        """The language number of each word on the best path of its text."""
        scores = self.scores(words)
        found = np.zeros(len(scores), np.int64)
        if not len(scores):
            return found
        begins = np.flatnonzero(np.diff(words.text, prepend=-1))
        sizes = np.diff(np.append(begins, len(scores)))
        alone, best = _one_language(scores, begins, sizes, self.penalty)
        found[:] = np.repeat(best, sizes)
        order = np.argsort(sizes, kind="stable")
        order = order[~alone[order]]
        width, done = len(self.languages), 0
        while done < len(order):
            most = max(1, CELLS // (int(sizes[order[done]]) * width))
            group = order[done:done + min(most, 512)]
            while len(group) > 1 and int(sizes[group[-1]]) * width * len(group) > CELLS:
                group = group[: len(group) // 2]
            done += len(group)
            steps = np.arange(int(sizes[group[-1]]))
            there = steps < sizes[group][:, None]
            index = np.where(there, begins[group][:, None] + steps, 0)
            path = _viterbi(np.where(there[:, :, None], scores[index], 0), self.penalty)
            found[index[there]] = path[there]
        return found


def _one_language(scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Texts whose best path is surely one language, and the best single language of each text.

    If no run of words gains more than half a penalty in any other language, no change pays: k runs in others need
    k - 1 changes at least, and one run over the whole text gains nothing. The greatest gain of a run is a running sum less its running minimum; a large drop at each text's start begins the minimum anew."""
    best = np.add.reduceat(scores, begins, axis=0).argmax(axis=1)
    gains = scores - np.take_along_axis(scores, np.repeat(best, sizes)[:, None], axis=1)
    drop = 1e9
    upto = np.cumsum(gains, axis=0, dtype=np.float64) - drop * np.repeat(np.arange(1, len(sizes) + 1), sizes)[:, None]
    before = upto - gains
    most = np.maximum.reduceat((upto - np.minimum.accumulate(before, axis=0)).max(axis=1), begins)
    return most <= penalty / 2 - 0.01, best


def _viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best paths of several texts at once: (texts, words, languages) -> (texts, words)."""
    texts, steps, width = scores.shape
    value, back = scores[:, 0].astype(np.float64), np.zeros((steps, texts, width), np.uint8 if width < 256 else np.int32)
    own, rows = np.arange(width), np.arange(texts)
    for t in range(1, steps):
        top = value.argmax(axis=1)
        change = (value[rows, top] - penalty)[:, None]
        back[t] = np.where(value >= change, own, top[:, None])
        value = np.maximum(value, change) + scores[:, t]
    path = np.zeros((texts, steps), np.int64)
    path[:, -1] = value.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[t][rows, path[:, t]]
    return path


def fit(docs: DataFrame, smoothing: float = 0.05, script_share: float = 0.01, penalty: float = 12.0) -> LanguageModel:
    """Counts over all rows of `docs` with a text and a lang. `script_share`: of a language's letters, to be written in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, held in _chunks(texts):
                words = words_of(held)
                each = np.repeat(words.text, words.letters)
                by_script = np.repeat(words.script.astype(np.int64), words.letters)
                names = langs[first:first + len(held)]
                for lang in set(names):
                    chosen = np.array([x == lang for x in names])[each]
                    total = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    total[:BUCKETS] += np.bincount(words.buckets[chosen], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(by_script[chosen], minlength=len(SCRIPT_NAMES))
        for lang, total in sums.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())],
                ["lang", "bucket", "n"])

    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string"))
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # languages x buckets rows at most
    langs, buckets, n = (table.column(c).to_pylist() for c in ("lang", "bucket", "n"))
    languages = sorted(set(langs))
    total = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    total[buckets, [languages.index(x) for x in langs]] = n
    grams, scripts = total[:BUCKETS], total[BUCKETS:]
    log_prob = np.log((grams + smoothing) / (grams.sum(axis=0) + smoothing * BUCKETS)) if languages else grams
    return LanguageModel(languages, log_prob.astype(np.float32), scripts > script_share * np.maximum(scripts.sum(axis=0), 1), penalty)


def detect(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with lang_pred, score and `spans`, an array of (start, end, lang) in characters.

    A null text, one without letters, and any text under a model of no languages is `und` with score 0 and no
    spans. `score` is the share of letters in spans of lang_pred; of equal shares the first language by name
    wins. Columns of `docs` with these names are replaced."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    kind = "struct<lang_pred:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>"

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = []
            for _, held in _chunks([t if isinstance(t, str) else None for t in texts]):
                found += label_texts(held, model)
            yield pd.DataFrame(found, columns=["lang_pred", "score", "spans"])

    made = docs.select(*[F.col(f"`{c}`") for c in rest], F.pandas_udf(label, kind)(F.col("text")).alias("__made"))
    return made.select(*[F.col(f"`{c}`") for c in rest], "__made.*")


def label_texts(texts: list[str], model: LanguageModel) -> list[tuple[str, float, list[dict]]]:
    words = words_of(texts)
    if not model.languages or not len(words.text):
        return [(UNKNOWN, 0.0, [])] * len(texts)
    labels = model.labels(words)
    width = len(model.languages)
    letters = np.bincount(words.text * width + labels, words.letters, len(texts) * width).reshape(-1, width)
    total, top = letters.sum(axis=1), letters.argmax(axis=1)
    begins = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
    lasts = np.append(begins[1:], len(labels)) - 1
    spans: list[list[dict]] = [[] for _ in texts]
    for text, a, b, lang in zip(words.text[begins].tolist(), words.first[begins].tolist(), words.end[lasts].tolist(), labels[begins].tolist(), strict=True):
        spans[text].append({"start": a, "end": b, "lang": model.languages[lang]})
    return [(model.languages[top[i]], float(letters[i, top[i]] / total[i]), spans[i]) if total[i] else (UNKNOWN, 0.0, [])
            for i in range(len(texts))]


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.25) -> DataFrame:
    """Rows whose language is known and holds at least `least` of the letters; columns as they are."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    found = detect(docs.select(F.struct(*names).alias("row"), "text"), model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
