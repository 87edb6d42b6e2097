"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quadrat.llm import periodic
from quadrat.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=periodic.LEAST):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def made(chance, kind):
    letters, n = chance.choice([1, 2, 2, 3, 5, 50]), chance.randrange(400)
    x = [chance.randrange(letters) for _ in range(n)]
    if kind == "fibonacci":
        a, x = [0], [0, 1]
        while len(x) < n:
            a, x = x, x + a
    elif kind == "periodic":
        p = chance.randrange(1, n // 3 + 2)
        x = [x[i % p] for i in range(n)]
        for _ in range(chance.randrange(3) if n else 0):
            x[chance.randrange(n)] = letters
    elif kind == "squares of powers":
        r, m = chance.randrange(2, 8), chance.randrange(20, 150)
        root = [chance.randrange(2) for _ in range(r)]
        x = x[:5] + 2 * [root[i % r] for i in range(m)] + x[:4]
        x = x + x if chance.random() < 0.3 else x
    elif kind == "powers in a row":
        x = []
        while len(x) < 300:
            root = [chance.randrange(2) for _ in range(chance.randrange(1, 6))]
            x += [root[i % len(root)] for i in range(chance.randrange(10, 120))]
            x += x[-chance.randrange(1, len(x) + 1):] if chance.random() < 0.4 else []
    elif kind == "copied tails":
        x = [0]
        while len(x) < 300:
            x += [chance.randrange(2) for _ in range(chance.randrange(1, 30))]
            for _ in range(chance.randrange(3)):
                x += x[-chance.randrange(1, len(x) + 1):]
        x = x[:600]
    return x


@pytest.mark.parametrize("kind", ["random", "fibonacci", "periodic", "squares of powers", "powers in a row", "copied tails"])
def test_runs_equal_plain_search(kind):
    chance = random.Random(kind)
    for _ in range(60):
        x = made(chance, kind)
        for least in (2, 12):
            assert periodic.runs_of(np.array(x, np.int64), least) == plain_runs(x, least), (x, least)


def test_a_long_text_in_time():
    unit = list(range(5000))
    assert periodic.runs_of(np.array(unit * 40 + [7] * 100_000, np.int64)) == [(0, 200_000, 5000), (200_000, 100_000, 1)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return (doc_id, len(runs), *top, top[1] and 1000 * top[1] // top[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            digest(b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))


def test_query_equals_plain_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    ODD = [(9001, None), (9002, ""), (9003, " \t\n "), (9004, "a " * 5000), (9005, "x y \x1cz " * 9), (9006, "la " * 11),
           (9007, "b " * 12), (9007, "b " * 12), (None, "c d " * 20)]
    wide = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    wide = wide.selectExpr("*", "1 AS runs", "'q' AS start", "map(1, 2) AS words")
    wide.write.parquet(str(tmp_path / "documents.parquet"))
    texts = [(r.doc_id, r.text) for r in wide.collect() if not r.text or len(r.text) < 9000]
    ids = {i for i, _ in texts}
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect() if r.doc_id in ids]
    want = [plain_row(i, t) if i is not None else (None, *plain_row("none", t)[1:]) for i, t in texts]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > len(got) / 20


def test_no_rows(spark):
    assert periodic.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
