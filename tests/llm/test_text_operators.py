"""The text operators against plain versions, and on odd rows: nulls, empty and long texts, repeats, clashing columns."""

import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrat.llm import decontaminate, language, line_rules, packing, pii, simhash, token_counts, toxicity, url_filter, warc
from quadrat.llm.components import components
from quadrat.llm.tokens import public_encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, score string, spans string"
LONG = "Word by word the long text goes on and on. " * 4_000
ODD = [(9001, None), (9002, ""), (9003, "x"), (9003, "x"), (9003, "another text"), (None, "no id here"), (9005, LONG), (9006, "!!! 123")]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(i, t, None, None, None, "w", "s", "p") for i, t in ODD], SCHEMA)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    return given.unionByName(odd, allowMissingColumns=True).repartition(4).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ascii_lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def test_decontamination_equals_plain_windows(spark, docs, nothing):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    bench = bench.unionByName(spark.createDataFrame([(900, "x"), (901, None), (902, ""), (903, "no ID here"), (None, "goes on")], bench.schema))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    windows: dict = {}
    for row in bench.collect():
        w = words(row.text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add(row.item_id)
    want = []
    for row in docs.select("doc_id", "text").collect():
        w, hit, items = words(row.text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(w[i:i + n])]
        ids = sorted(str(i) for i in items if i is not None)
        want.append((row.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)))
    got = [tuple(r) for r in decontaminate.contamination(docs, bench).drop("row_key").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_line_rules_on_odd_rows(docs, nothing):
    found = {(r.doc_id, r.text): r for r in line_rules.clean_lines(docs).collect()}
    assert found[9001, None].n_words == 0 and found[9001, None].base_failed and not found[9001, None].kept
    assert found[9005, LONG].n_words == 40_000 and found[9005, LONG].base_failed
    assert line_rules.clean_lines(docs).count() == docs.count() and line_rules.clean_lines(nothing).count() == 0


def test_line_rules_remove_lines_first(spark):
    prose = " ".join(f"Plain{i} words stand in one quiet sentence{i} which ends well{i}." for i in range(8))
    text = f"Home | About | Shop | Contact\n{prose}\nAll rights reserved.\nread on\n#### $$$$ ####"
    menu = "\n".join(["one | two | three | four | five | six"] * 3 + ["a | b | c | d | e | f | g | h | i"] * 6) + " | " + " | ".join(map(str, range(60)))
    rows = line_rules.clean_lines(spark.createDataFrame([(1, text), (2, menu)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0].kept and rows[0].clean_text == prose
    assert [x.rule for x in rows[0].removed_lines] == ["navigation", "boilerplate", "punctuation", "symbols"]
    assert not rows[1].kept


def base_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    luhn = lambda d: sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    out = []
    for n, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_base_spans_equal_plain_patterns(spark, docs, nothing):
    chance, parts = random.Random(1), ["a", "b.c", "@", ".", "+", "1", "23", "4111 1111 1111 1111", " ", "-", "(", ")", "é", "😀", "255", "256", "+1 (988) 555-2485", "x@y.de", "%"]
    made = [(i, "".join(chance.choice(parts) for _ in range(chance.randint(1, 40)))) for i in range(400)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    model = pii.fit(rows)
    for row in pii.find_spans(rows, model).select("text", pii.span_text("base_spans").alias("b"), pii.span_text("spans").alias("s")).collect():
        assert row.b == base_spans(row.text or "")
        assert set(filter(None, row.b.split(","))) <= set(row.s.split(","))
    assert pii.find_spans(nothing).count() == 0 and pii.redact(docs, model).columns == docs.columns


def test_redaction_replaces_spans_and_counts_characters(spark):
    rows = spark.createDataFrame([(1, "é x@y.de, 1.2.3.4!", 17), (2, None, None)], "doc_id long, text string, n_chars long")
    got = pii.redact(rows, pii.SpanModel(least=dict.fromkeys(range(4), float("inf")))).orderBy("doc_id").collect()
    assert got[0].text == "é [EMAIL], [IP]!" and got[0].n_chars == len(got[0].text) and got[1].text is None


def test_trees_add_spelled_out_addresses_near_cues(spark):
    made = [(i, f"please mail user{i}@site{i}.example.com today or mail me again") for i in range(200)]
    rows = spark.createDataFrame([*made, (999, "you can mail bob at example dot com")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_spans(rows).collect()}
    assert [(x.kind, x.start, x.end) for x in spans[999]] == [(0, 13, 35)] and all(len(spans[i]) == 1 for i in range(200))


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", ascii_lower(text or "").encode())
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(nodes, linked):
    root = {n: n for n in nodes}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_equals_plain_groups(spark, docs, nothing):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()
    prints = {(r.doc_id, r.k): plain_fingerprint(r.text) for r in rows}
    root = roots_of(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least: dict = {}
    for (i, _), f in prints.items():
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert len(got) == len(rows)
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id, r.row_key] and r.component_id == least.get(root[prints[r.doc_id, r.row_key]])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values())) and simhash.near_duplicates(nothing).count() == 0


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT_FROM", 4)
    chance = random.Random(2)
    values = {0}
    for _ in range(150):
        base = chance.choice(sorted(values))
        values.add(base ^ (1 << chance.randrange(64)) ^ (1 << chance.randrange(64)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(r) for r in simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    assert got == {tuple(sorted(p)) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) & (2**64 - 1)).bit_count() <= 2}


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_ids_equal_the_tokenizer(tokenizer):
    chance, encoder = random.Random(3), public_encoder()
    letters = " \n\t'stmdrevl aé9²½!?　\xa0\x1c​中😀ñ<|endoftext|>    abcabc"
    for _ in range(3000):
        text = "".join(chance.choice(letters) for _ in range(chance.randint(0, 30))) + "<|endoftext|>b" * (chance.random() < 0.1)
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_round_trip(docs, nothing, tokenizer):
    rows = packing.pack(docs.filter("doc_id < 60 or doc_id > 9000 or doc_id is null")).collect()
    source = docs.filter("doc_id < 60 or doc_id > 9000 or doc_id is null").select("doc_id", "text").collect()
    want = []
    for d in source:
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1]
        want += [(d.doc_id, s, len(ids[s:s + 2048]), zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    assert sorted(([*r[:5]] for r in rows), key=str) == sorted(([*w] for w in want), key=str)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
    assert sorted(sequences) == list(range(len(sequences))) and packing.pack(nothing).count() == 0


@pytest.mark.parametrize(("histogram", "sequences"), [({}, 0), ({1: 5}, 1), ({1100: 100, 700: 300, 400: 150}, 210), ({1025: 1000, 683: 3000, 512: 777}, 2000)])
def test_column_generation_meets_its_bound(histogram, sequences):
    found = packing.solve(histogram)
    used: dict = {}
    for pattern, times in found.patterns:
        assert sum(size * n for size, n in pattern.items()) <= 2048
        for size, n in pattern.items():
            used[size] = used.get(size, 0) + n * times
    assert used == histogram and sum(t for _, t in found.patterns) == sequences >= found.bound - 1e-6


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts_equal_offsets(spark, tokenizer, rule):
    texts = ["a\n\n\nb c\n", "", None, "中文😀\n  x\ny", "one two\nthree", "\n\n", "it's\r\nso"]
    got: dict = {}
    for r in token_counts.section_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = r.tokens
    for i, text in enumerate(t or "" for t in texts):
        ends = [m.end() for m in re.finditer("\n", text)]
        ends = ends if ends and ends[-1] == len(text) else [*ends, len(text)]
        want = [0.0] * len(ends)
        for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
            held = [max(0, min(b, e) - max(a, s)) for s, e in zip([0, *ends], ends, strict=False)]
            if rule == "share":
                want = [w + h / sum(held) for w, h in zip(want, held, strict=True)]
            else:
                want[held.index(max(held)) if rule == "most" else next(k for k, h in enumerate(held) if h)] += 1
        assert [got[i][k] for k in range(len(ends))] == pytest.approx(want)


def test_language_on_held_out_rows(docs, nothing):
    given = docs.filter("lang is not null")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = language.fit(given.filter(~held))
    found = language.detect(docs.drop("source"), model)
    rows = found.filter(held).filter("lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    odd = {r.doc_id: r for r in found.filter("doc_id in (9001, 9002, 9006)").collect()}
    assert all(r.lang_pred == "und" and r.score == 0 and r.spans == [] for r in odd.values())
    assert language.fit(nothing).languages == [] and language.detect(docs, language.fit(nothing)).filter("lang_pred <> 'und'").count() == 0
    assert language.keep_identified(docs, model).columns == docs.columns


def test_marks_without_letters_are_no_language():
    model = language.LanguageModel(["a", "b"], np.log(np.full((language.BUCKETS, 2), 0.5, np.float32)), np.ones((len(language.SCRIPT_NAMES), 2), bool))
    texts = ["❤️ 1️⃣ 23", "café ❤️", "́a", ""]
    assert [(p, len(s)) for p, _, s in language.label_texts(texts, model)] == [("und", 0), ("a", 1), ("a", 1), ("und", 0)]
    assert language.words_of(texts).letters.tolist() == [5, 2]


def test_viterbi_equals_all_paths():
    scores = np.random.default_rng(0).normal(size=(6, 6, 3)) * 3
    for row, path in zip(scores, language._viterbi(scores, 2.0), strict=True):
        value = lambda p: sum(row[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))  # noqa: E731, B023
        assert tuple(path) == max(itertools.product(range(3), repeat=6), key=value)


def test_texts_taken_as_one_language_are_so_on_the_best_path():
    chance = np.random.default_rng(1)
    sizes = chance.integers(1, 40, 200)
    begins, scores = np.cumsum(sizes) - sizes, chance.normal(size=(int(sizes.sum()), 3)).astype(np.float32)
    alone, best = language._one_language(scores, begins, sizes, 4.0)
    assert alone.any()
    for i in np.flatnonzero(alone):
        assert (language._viterbi(scores[None, begins[i]:begins[i] + sizes[i]], 4.0)[0] == best[i]).all()


def test_toxicity_on_held_out_rows(spark, docs, nothing):
    data = "/root/testdata/sf0.01"
    given, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = toxicity.fit(given, labels.filter(~held))
    rows = toxicity.score(given, model).join(labels, "doc_id").filter(held).select("toxic", "predicted", "lang").collect()
    assert not any(r.predicted and not r.toxic for r in rows) and all(r.predicted for r in rows if r.toxic and r.lang == "en")
    assert toxicity.score(docs, model).filter("score is null or score < 0 or score > 1").count() == 0
    empty = toxicity.fit(nothing, labels.limit(0))
    assert toxicity.score(docs, empty).count() == docs.count()


def test_label_model_finds_accuracies_and_dependencies():
    chance = np.random.default_rng(4)
    truth = chance.random(20_000) < 0.2
    votes = np.zeros((20_000, len(toxicity.VOTERS)), int)
    for v in range(toxicity.TOXIC_VOTERS):
        votes[:, v] = chance.random(20_000) < np.where(truth, 0.6, 0.03)
    votes[:, 1] = votes[:, 0]
    votes[:, 12:] = (chance.random((20_000, 2)) < np.where(truth, 0.05, 0.8)[:, None])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.fit_label_model(patterns, counts.astype(float))
    assert abs(model.prior - 0.2) < 0.02 and (model.parent[0] == 1 or model.parent[1] == 0)
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.97


def test_url_rules_and_terms(spark):
    urls = {"http://A.Example.com/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"), None: ("", "", None, "allow"), "no url": ("", "", None, "allow"),
            "https://x.www.example.com/en/?q": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"), "ftp://foo.net/es/x": ("foo.net", "/es/x", "net/es/", "block"),
            "http://foo.org/xxx": ("foo.org", "/xxx", None, "block"), "http://foo.org/free-casino-poker": ("foo.org", "/free-casino-poker", None, "block"),
            "http://essex.org/sextant/casino": ("essex.org", "/sextant/casino", None, "allow"), "http://com": ("com", "", None, "allow"), "http://porn.com/": ("porn.com", "/", "com/", "allow")}
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows).collect()}
    assert got == urls and url_filter.judge(rows.limit(0)).count() == 0


def test_archives_round_trip_and_salvage(spark, tmp_path):
    odd = [(1, None, None), (2, "u", ""), (3, "a\nb", "WARC/1.1\r\nx\r\n\r\n"), (4, "a", "WARC/1.1\r\nx\r\n\r\n"), (None, "n", "é"), (6, "n", "é"), (7, None, LONG)]
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("page_id", F.col("page_id") + 100)
    pages = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    folder = f"file://{tmp_path}/archives"
    warc.write_archives(pages, folder, records_per_file=20)
    read = warc.read_archives(spark, folder).collect()
    assert not any(r.problem for r in read) and len(read) == pages.count()
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in read}
    assert kinds["1"][0] == "response" and kinds["2"] == ("revisit", "1") and kinds["4"] == ("revisit", "3") and kinds[None] == ("revisit", "6")
    want = {str(r.page_id): (r.html or "").encode() for r in pages.filter("page_id is not null").collect()}
    assert all(bytes(r.payload) == want[r.page_id] and r.payload_bytes == len(want[r.page_id]) for r in read if r.record_type == "response")
    whole = max(tmp_path.glob("archives/part*"), key=lambda p: p.stat().st_size).read_bytes()
    records = list(warc.salvage(whole))
    assert gzip.decompress(whole).count(b"X-Page-ID") == len(records) > 3
    at, size = records[1][:2]
    broken = bytearray(whole)
    broken[at + size // 2] ^= 255
    found = list(warc.salvage(bytes(broken)))
    assert [x[:2] for x in found if x[3]] == [(at, size)] and len(found) == len(records)
    found = list(warc.salvage(b"junk" + whole[:-40]))
    assert found[0][:2] == (0, 4) and found[-1][3] and [x[2] for x in found[1:-1]] == [x[2] for x in records[:-1]]
    plain = b"".join(gzip.decompress(whole[o:o + n]) for o, n, *_ in records[:3])
    cut = plain.index(b"WARC/1.1", 10)
    assert [x[3] == "" for x in warc.salvage(plain[:cut - 30] + plain[cut:])] == [False, True, True] and list(warc.salvage(b"")) == []
