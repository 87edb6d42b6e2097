"""Phrase collocations against plain counters."""

import random
import re
from collections import Counter

import pytest

from quadrat.llm import phrases

SF = "/root/testdata/sf0.001"


def plain(rows, listed, least):
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    out = []
    for lang in {x or "und" for x, _ in rows}:
        f, n = Counter(), 0
        for x, text in rows:
            for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(upper)) if (x or "und") == lang else ():
                ws = re.findall("[^ \t]+", piece)
                n += len(ws)
                f.update(tuple(ws[i:i + m]) for m in range(1, 5) for i in range(len(ws) - m + 1))
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((p, a, f[p[:k]], f[p[k:]], score))
        covered = {q for p, a, *_ in found for q in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}
                   if 100 * a >= 80 * f[q]}
        kept = sorted((-s, -a, " ".join(p).encode(), l, r) for p, a, l, r, s in found if p not in covered)
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(kept[:listed])]
    return sorted(out)


def made(seed, letters):
    chance = random.Random(seed)
    word = lambda: chance.choice("abcdéfghijßklm")[:1].upper() + str(int(chance.paretovariate(0.8)) % letters)
    fixed = [" ".join(word() for _ in range(chance.randint(2, 9))) for _ in range(12)]
    rows = []
    for _ in range(150):
        text = "".join((chance.choice(fixed) if chance.random() < 0.2 else word()) + chance.choice([" ", " ", " ", "\t ", ", ", ".", "\n"])
                       for _ in range(chance.randrange(200)))
        rows.append((chance.choice(["en", "de", None]), text))
    return rows + rows[:30] + [("en", None), ("en", ""), ("fr", " .,; \n"), (None, "a " * 4000), ("de", "x\x1cy x\xa0z " * 50)]


@pytest.mark.parametrize("letters, least, listed", [(3, 5, 50), (20, 3, 2000), (200, 4, 40)])
def test_phrases_equal_plain_counts(spark, monkeypatch, letters, least, listed):
    monkeypatch.setattr(phrases, "AT_ONCE", 500)
    rows = made(letters, letters)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS ws", "'h' AS h", "2 AS f").repartition(4)
    got = phrases.collocations(docs, listed=listed, least=least)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, listed, least)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    got = phrases.collocations(docs).collect()
    assert got and sorted(tuple(r) for r in got) == plain([(r.lang, r.text) for r in docs.collect()], 2000, 30)


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_chunks_are_few_where_texts_repeat(spark):
    """Copies add to frequencies, not to the dictionary, and each start of a phrase is counted in one chunk."""
    text = " ".join(f"w{i % 97}x{i % 89}" for i in range(3000))
    rows = [("en", text)] * 40
    found = phrases.chunk_dictionary(spark.createDataFrame(rows, "lang string, text string").repartition(4)).collect()
    assert {r.times for r in found} == {40} and len(found) > 50
    assert sum(r.places * r.times for r in found) == 40 * 3000


def test_words_keep_their_text(spark):
    """Listed phrases take their text from their words; the chunks are not read again for it."""
    rows = [("en", "red fox, Red fox\tof"), ("de", "fox red"), (None, "fox")]
    words = phrases._words_counted(phrases.chunk_dictionary(spark.createDataFrame(rows, "lang string, text string")))
    assert {(r.lang, r.word): r.f for r in words.collect()} == {
        ("en", "red"): 2, ("en", "fox"): 2, ("en", "of"): 1, ("de", "fox"): 1, ("de", "red"): 1, ("und", "fox"): 1}
    first = words.selectExpr("w AS h", "array(w, w) AS ws")
    assert {r.phrase for r in phrases._texts(words, first).collect()} == {"red red", "fox fox", "of of"}
