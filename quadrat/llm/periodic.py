"""Periodic runs of words, found with string synchronising sets.

A run is a stretch whose words repeat with a smallest period q, at least two periods and `least` words long, that
no neighbour extends. Periods up to SMALL are read off directly: a text is compared with itself shifted by q.

Longer periods are found at dyadic scales. At scale t a position is selected if the hash of the t words at it or t
places later is the least among the t + 1 windows between: the choice depends on the 2 t words of context alone, so
places with equal contexts are selected alike. Two selected places with equal contexts between 6 t and 12 t words
apart propose their distance as a period; comparing words outwards from there settles the run exactly.

Windows with a period of at most t / 3 are left out of the choice, else such a stretch would select everything.
They are stretches of runs that smaller scales have found. A run of a longer period can hide in them only if it
lies across two of them with one root that meet; those pairs propose the distances that keep the root in phase.

Everything here is inside one text, in memory proportional to its words; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 12
SMALL = 11
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(values: np.ndarray, factor: np.uint64) -> np.ndarray:
    out = values * factor
    return (out ^ (out >> np.uint64(31))) * _FACTORS[2]


def word_numbers(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and a number for each, equal for equal words."""
    words = (text or "").encode().split()
    number: dict[bytes, int] = {}
    return words, np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def _stretches(ids: np.ndarray, period: int, least: int) -> list[tuple[int, int]]:
    """Maximal (start, end) of at least `least` > `period` words in which words `period` apart are equal."""
    same = ids[period:] == ids[:-period]
    need = least - period
    if np.count_nonzero(same) < need:
        return []
    edges = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
    long = np.flatnonzero(np.diff(edges) > need)
    return [(int(edges[j]) + 1, int(edges[j + 1]) + period) for j in long]


def _agreeing(ids: np.ndarray, at: int, other: int, step: int) -> int:
    """How many words agree from `at` and `other` > `at` on, going by `step` (1 or -1)."""
    total, chunk = 0, 16
    while True:
        if step > 0:
            size = min(chunk, len(ids) - other - total)
            differ = ids[at + total:at + total + size] != ids[other + total:other + total + size]
        else:
            size = min(chunk, at + 1 - total)
            upto, far = at + 1 - total, other + 1 - total
            differ = (ids[upto - size:upto] != ids[far - size:far])[::-1]
        if size <= 0:
            return total
        first = int(differ.argmax())
        if differ[first]:
            return total + first
        total, chunk = total + size, chunk * 2


class _Runs:
    """The runs of one text, by ascending period; a stretch keeps the smallest period it is found with."""

    def __init__(self, ids: np.ndarray, least: int) -> None:
        self.ids, self.least, self.period = ids, least, {}

    def keep(self, start: int, end: int, period: int) -> None:
        if end - start >= max(self.least, 2 * period):
            self.period.setdefault((start, end), period)

    def settle(self, proposals: list[tuple[int, int, int]]) -> None:
        """Proposals (period, a, b): words of [a, b) equal those `period` later. Each becomes its whole run."""
        last, covered = 0, 0
        for period, a, b in sorted(proposals):
            if period == last and a < covered:
                continue
            left = a - _agreeing(self.ids, a - 1, a - 1 + period, -1) if a else 0
            right = b + _agreeing(self.ids, b, b + period, 1)
            self.keep(left, right + period, period)
            last, covered = period, right

    def highly_periodic(self, longest: int, size: int) -> Iterator[tuple[int, int, int]]:
        for (start, end), period in self.period.items():
            if period <= longest and end - start >= size:
                yield period, start, end


def _selected(names: np.ndarray, scale: int) -> np.ndarray:
    """The synchronising positions: where the least name of a window stands at one of its ends."""
    least, width = names, 1
    while width < scale:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:-1], least[1:])
    ends = (least == names[:len(least)]) | (least == names[scale:scale + len(least)])
    return np.flatnonzero(ends & (least != _NONE))


def _equal_contexts(where: np.ndarray, context: np.ndarray, low: int, high: int) -> tuple[list, bool]:
    """((distance, place) of selected places with one context and a distance in [low, high), whether any two agree)."""
    order = np.argsort(context, kind="stable")
    names, places = context[order], where[order]
    found: list[tuple[int, int]] = []
    some = False
    for lag in range(1, len(places)):
        apart = places[lag:] - places[:-lag]
        same = names[lag:] == names[:-lag]
        some = some or bool(same.any())
        same &= apart < high
        if not same.any():
            break
        same &= apart >= low
        found += zip(apart[same].tolist(), places[:-lag][same].tolist())
    return found, some


def _in_phase(runs: _Runs, hashes: list[np.ndarray], scale: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """Proposals from two runs of one small period and root that touch or overlap."""
    out = []
    ordered = sorted(runs.highly_periodic(scale // 3, low - scale // 3))
    for (period, s1, e1), (other, s2, e2) in zip(ordered, ordered[1:]):
        if period != other or s2 > e1:
            continue
        level = (period - 1).bit_length()
        match = np.flatnonzero(hashes[level][s2:s2 + period] == hashes[level][s1])
        if not len(match):
            continue
        shift = s2 + int(match[0]) - s1
        first = shift % period + (max(0, low - shift % period) + period - 1) // period * period
        for distance in range(first, min(high, min(e1 - s1, e2 - s2) + period + 1), period):
            a, b = max(s1, s2 - distance), min(e1, e2 - distance)
            if a < b:
                out.append((distance, a, b))
    return out


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of numbers, by start and then period."""
    n = len(ids)
    if n < least:
        return []
    runs = _Runs(ids, least)
    for period in range(1, min(SMALL, n // 2) + 1):
        for start, end in _stretches(ids, period, max(least, 2 * period)):
            runs.keep(start, end, period)
    hashes = [_mixed(ids.astype(np.uint64) + np.uint64(1), _FACTORS[0])]
    level = 0
    while 12 << level <= n:
        hashes.append(_mixed(hashes[-1][:-(1 << level)] + _mixed(hashes[-1][1 << level:], _FACTORS[0]), _FACTORS[1]))
        level += 1
        scale = 1 << level
        if 12 * scale > n:
            break
        size = n - 2 * scale + 1
        context = _mixed(hashes[level][:size] + _mixed(hashes[level][scale:scale + size], _FACTORS[0]), _FACTORS[1])
        names = _mixed(hashes[level], _FACTORS[0])
        if scale < LEAST:  # too short to be runs
            small = [x for q in range(1, scale // 3 + 1) for x in _stretches(ids, q, scale)]
        else:
            small = [(s, e) for _, s, e in runs.highly_periodic(scale // 3, scale)]
        for start, end in small:
            names[start:end - scale + 1] = _NONE
        where = _selected(names, scale)
        low, high = 6 * scale, 12 * scale
        met, some = _equal_contexts(where, context[where], low, high)
        runs.settle([(d, i, i + 2 * scale) for d, i in met])
        if small:
            runs.settle(_in_phase(runs, hashes, scale, low, high))
        elif not some:  # every longer context holds a selected one, so none of them is repeated
            break
    return sorted((s, e - s, p) for (s, e), p in runs.period.items())


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words left when each run keeps its first period only."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, k in zip(words, np.cumsum(gone).tolist()) if not k]
    return b" ".join(words).decode()


def _periodic(text: Column) -> Column:
    @F.pandas_udf("n_words long, start array<long>, length array<long>, period array<long>, collapsed string")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for one in batch:
                words, ids = word_numbers(one if isinstance(one, str) else None)
                runs = runs_of(ids)
                rows.append((len(words), *([list(x) for x in zip(*runs)] or ([], [], [])), _collapsed(words, runs)))
            yield pd.DataFrame(rows, columns=["n_words", "start", "length", "period", "collapsed"])

    return found(text)


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), a row per document.

    `runs` lists (start, length, period) in words, by start and then period; `collapsed` is the text with one period
    of each run, its words joined by one space. Null and empty texts have no words, no runs and an empty
    `collapsed`. Repeated rows get equal answers, a null doc_id stays null, other columns are not read."""
    rows = docs.select("doc_id", _periodic(F.col("text")).alias("r")).select("doc_id", "r.*")
    runs = F.arrays_zip("start", "length", "period").alias("runs")
    return rows.select("doc_id", "n_words", runs, "collapsed")
