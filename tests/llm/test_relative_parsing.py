"""Repeated passages against a plain dictionary of windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import common, relative

SF = "/root/testdata/sf0.001"


def plain(rows, window):
    """The rows (doc_id, n_words, n_removed, kept) of the contract."""
    first, out = {}, []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1 if doc_id is not None else 0):
            key = tuple(words[i:i + window])
            first[key] = min(doc_id, first.get(key, doc_id))
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1 if doc_id is not None else 0):
            if first[tuple(words[i:i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        out.append((doc_id, len(words), len(gone), kept))
    return sorted(out, key=str)


def planted(chance, letters, window):
    """Texts made of shared passages, their cut and changed forms, and words of their own."""
    word = lambda: f"w{chance.randrange(letters)}"
    passages = [[word() for _ in range(chance.randint(window - 2, 3 * window))] for _ in range(8)]
    rows = []
    for doc_id in range(120):
        words = []
        for _ in range(chance.randrange(4)):
            words += [word() for _ in range(chance.randrange(window))]
            part = list(chance.choice(passages))
            if chance.random() < 0.3:
                part[chance.randrange(len(part))] = "changed"
            words += part[chance.randrange(5):len(part) - chance.randrange(5)]
        rows.append((doc_id % 100, " ".join(words)))
    return rows


@pytest.mark.parametrize("letters, window, shingle", [(2, 5, 2), (3, 12, 3), (50, 12, 4), (5000, 50, 8)])
def test_spans_equal_plain_windows(spark, monkeypatch, letters, window, shingle):
    odd = [(None, "a " * 80), (7, None), (8, ""), (9, " \t"), (3000, "q " * 200), (3001, "q " * 199), (3001, "q " * 199),
           (3002, "one\x1ctwo " + "q " * 60), (-5, "q " * 49)]
    rows = planted(random.Random(letters), letters, window) + odd
    monkeypatch.setattr(relative, "STEP", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS row_key", "'a' AS words")
    got = relative.drop_repeated(docs.repartition(5), window, shingle)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()], key=str) == plain(rows, window)


def test_given_documents_and_a_passage_in_many(spark):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    passage = " ".join(f"p{i}" for i in range(90))
    rows = given + [(100_000 + i, f"own{i} {passage} tail{i}") for i in range(3000)]
    got = relative.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()], key=str) == plain(rows, 50)


def test_no_rows(spark):
    assert relative.drop_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hashes_and_bit_table_agree_with_spark(spark):
    x = np.random.default_rng(1).integers(-(1 << 63), 1 << 63 - 1, 500, np.int64)
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, x[::-1])], "a long, b long")
    want = [r.h for r in rows.select(F.xxhash64("a", "b").alias("h")).collect()]
    assert common.xxhash64_of(x, x[::-1]).view(np.int64).tolist() == want
    table = common.bit_table(rows, "a", 1 << 16)
    assert common.is_listed(table, x.view(np.uint64)).all() and len(table) == 1 << 13
    assert common.is_listed(table, np.arange(1 << 16, dtype=np.uint64)).sum() == len(set((x & 0xFFFF).tolist()))
