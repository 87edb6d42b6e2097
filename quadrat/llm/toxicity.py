"""Toxicity by weak supervision.

Many weak voters (word lists, mined words and word beginnings, patterns) each vote or abstain. A generative model
with a hidden class estimates from the vote patterns of all rows how often each voter fires in either class, and
which voters depend on each other (a tree of the strongest dependencies within the classes). Its posteriors are
the labels on which a linear classifier over votes and lexicon entries is trained; the classifier scores texts.

Lexicon entries are mined from a sample of at most `labelled` labelled rows and are at most `entries`. Vote patterns
are at most 2**voters whatever the number of rows, so the label model is fitted from counts of all rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from quadrat.llm.common import broadcast_within, stored

# Common insults of four languages.
INSULTS = {
    "en": "idiot moron stupid loser pathetic worthless scum trash clown disgusting dumb imbecile fool jerk creep filth vermin coward",
    "de": "idiot trottel dumm blöd versager abschaum arschloch dreck widerlich wertlos depp ekelhaft feigling",
    "fr": "idiot imbécile stupide crétin abruti minable ordure déchet dégoûtant débile connard salaud lâche",
    "es": "idiota imbécil estúpido tonto perdedor basura asqueroso inútil payaso patético cretino escoria cobarde",
}
ADDRESS = {"you", "your", "youre", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "tú", "eres", "usted", "ustedes"}
HOSTILE = ("shut up", "go away", "get lost", "hate you", "halt die klappe", "hau ab", "ta gueule", "cállate", "vete ya")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
VOTERS = ("insult_en", "insult_de", "insult_fr", "insult_es", "words_a", "words_b", "stems_a", "stems_b", "two_hits",
          "addressed", "hostile", "shouting", "no_hit", "plain")
TOXIC_VOTERS = 12


@dataclass(frozen=True)
class Settings:
    labelled: int = 10_000
    entries: int = 400
    min_rows: int = 4
    min_toxic_share: float = 0.01
    min_share: float = 0.95
    sample: int = 20_000
    repeats: int = 50
    rounds: int = 60
    dependency: float = 0.005


@dataclass
class LabelModel:
    """P(toxic), the parent of each voter (-1: none), and P(fires | parent's vote, class)."""

    prior: float
    parent: list[int]
    fires: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log([1 - self.prior, self.prior]) + np.zeros((len(votes), 2))
        for v, up in enumerate(self.parent):
            given = votes[:, up] if up >= 0 else np.zeros(len(votes), int)
            p = self.fires[v][given]
            logs += np.log(np.where(votes[:, [v]] == 1, p, 1 - p))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -60, 60)))


@dataclass
class ToxicityModel:
    words: frozenset = frozenset()
    stems: frozenset = frozenset()
    label_model: LabelModel | None = None
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0


@lru_cache(maxsize=4)
def _automaton(words: frozenset, stems: frozenset) -> ahocorasick.Automaton:
    """Finds every entry in one pass over a text; the value says where it counts."""
    entries: dict[str, set[str]] = {}
    for kind, names in (("word", words), ("stem", stems), ("phrase", HOSTILE), *((k, v.split()) for k, v in INSULTS.items())):
        for name in names:
            entries.setdefault(name, set()).add(kind)
    found = ahocorasick.Automaton()
    for name, kinds in entries.items():
        found.add_word(name, (name, frozenset(kinds)))
    found.make_automaton()
    return found


def votes_of(text: str | None, words: frozenset, stems: frozenset) -> tuple[int, list[str]]:
    """The voters that fire, as bits, and the lexicon entries found. Null is an empty text.

    Entries count at the start of a word, all but stems also only at its end."""
    low = (text or "").lower()
    hits: dict[str, set[str]] = {}
    marked: set[int] = set()
    for last, (name, kinds) in _automaton(words, stems).iter(low):
        first = last - len(name) + 1
        if first and low[first - 1].isalpha():
            continue
        ends = last + 1 == len(low) or not low[last + 1].isalpha()
        for kind in kinds if ends else kinds & {"stem"}:
            hits.setdefault(kind, set()).add(name)
            if kind != "phrase":
                marked.add(first)
    side = lambda kind, odd: any(sum(x.encode()) % 2 == odd for x in hits.get(kind, ()))
    distinct = {WORD.match(low, at)[0] for at in marked}
    addressed = bool(marked) and not ADDRESS.isdisjoint(WORD.findall(low))
    loud = bool(marked) and ("!!" in low or sum(map(str.isupper, text)) * 2 > len(text))
    fired = [
        *(k in hits for k in INSULTS), side("word", 0), side("word", 1), side("stem", 0), side("stem", 1),
        len(distinct) >= 2, addressed, "phrase" in hits, loud, not hits, not hits and "!" not in low,
    ]
    return sum(bool(x) << i for i, x in enumerate(fired)), [*sorted(hits.get("word", ())), *(f"{x}-" for x in sorted(hits.get("stem", ())))]


def mine_entries(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[frozenset, frozenset]:
    """Words and word beginnings that are common in toxic sample rows and nearly absent from others.

    An entry needs min_rows toxic rows, min_toxic_share of all toxic rows, and min_share of the rows it is in. Rows
    with the same least word hash, mostly near copies, count once, so that their rare words are no entries."""
    sample = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.labelled)
    sample = broadcast_within(stored(sample, "labelled"), settings.labelled, settings.labelled)
    tokens = F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(sample, "doc_id").select(
        "toxic", tokens.alias("tokens"))
    long = lambda n: F.array_distinct(F.transform(F.filter("tokens", lambda w: F.char_length(w) >= n), lambda w: F.concat(F.left(w, F.lit(n)), F.lit("-"))))
    rows = rows.withColumn("copies", F.array_min(F.transform("tokens", lambda w: F.xxhash64(w))))
    every = F.concat("tokens", *[long(n) for n in PREFIXES])
    counts = rows.select("toxic", "copies", F.explode(every).alias("entry")).distinct().groupBy("entry").agg(
        F.sum(F.col("toxic").cast("long")).alias("hits"), F.count("*").alias("rows"))
    toxic = sample.filter(F.col("toxic") > 0).count()
    least = max(settings.min_rows, toxic * settings.min_toxic_share)
    good = counts.filter((F.col("hits") >= least) & (F.col("hits") >= F.col("rows") * settings.min_share) & (F.char_length("entry") >= 3))
    best = [r["entry"] for r in good.orderBy(F.desc("hits"), "entry").limit(settings.entries).collect()]
    return frozenset(x for x in best if not x.endswith("-")), frozenset(x[:-1] for x in best if x.endswith("-"))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, settings: Settings = Settings()) -> LabelModel:
    """EM over vote patterns (rows of 0/1 votes with counts); dependencies are found anew every 20 rounds.

    Toxic voters are held to fire more often in toxic rows and the others less, which keeps the classes named."""
    size = len(VOTERS)
    lean = patterns[:, :TOXIC_VOTERS].sum(axis=1) - patterns[:, TOXIC_VOTERS:].sum(axis=1)
    q = 1 / (1 + np.exp(-2.0 * lean))
    parent, fires, prior = [-1] * size, np.zeros((size, 2, 2)), 0.1
    for turn in range(settings.rounds):
        weight = np.stack([counts * (1 - q), counts * q])
        if turn % 20 == 10:
            parent = _dependencies(patterns, weight, settings.dependency)
        prior = float(np.clip(weight[1].sum() / max(weight.sum(), 1), 0.001, 0.5))
        for v in range(size):
            up = parent[v]
            for given in (0, 1):
                rows = patterns[:, up] == given if up >= 0 else np.ones(len(patterns), bool)
                n = weight[:, rows]
                fires[v, given] = ((n * patterns[rows, v]).sum(axis=1) + 0.5) / (n.sum(axis=1) + 1.0)
            if up < 0:
                low, high = sorted(fires[v, 0])
                fires[v, :] = [low, high] if v < TOXIC_VOTERS else [high, low]
        fires = np.clip(fires, 1e-4, 1 - 1e-4)
        q = LabelModel(prior, parent, fires).posterior(patterns)
    return LabelModel(prior, list(parent), fires.copy())


def _dependencies(patterns: np.ndarray, weight: np.ndarray, least: float) -> list[int]:
    """The parent of each voter: the maximum tree of mutual information within the classes, weak edges left out."""
    size, total = patterns.shape[1], weight.sum()
    edges = []
    for i in range(size):
        for j in range(i):
            info = 0.0
            for w in weight:
                n = w.sum()
                if n < 1:
                    continue
                for a in (0, 1):
                    for b in (0, 1):
                        both = w[(patterns[:, i] == a) & (patterns[:, j] == b)].sum() / n
                        alone = w[patterns[:, i] == a].sum() * w[patterns[:, j] == b].sum() / n / n
                        info += n / total * both * np.log(both / alone) if both > 0 else 0
            edges.append((info, i, j))
    parent, group = [-1] * size, list(range(size))
    linked: dict[int, list[int]] = {i: [] for i in range(size)}
    for info, i, j in sorted(edges, reverse=True):
        if info > least and group[i] != group[j]:
            linked[i].append(j)
            linked[j].append(i)
            group = [group[i] if g == group[j] else g for g in group]
    seen: set[int] = set()
    for root in range(size):
        todo = [] if root in seen else [root]
        seen.add(root)
        while todo:
            at = todo.pop()
            for other in linked[at]:
                if other not in seen:
                    seen.add(other)
                    parent[other] = at
                    todo.append(other)
    return parent


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(len(VOTERS))) & 1


def _features(bits: int, entries: list[str]) -> list[str]:
    return [*(f"vote:{v}" for i, v in enumerate(VOTERS) if bits >> i & 1), *entries]


def train_linear(rows: list[tuple[int, list[str]]], labels: np.ndarray, epochs: int = 200, l2: float = 1e-4) -> tuple[dict[str, float], float]:
    """Logistic regression on soft labels by full gradient steps (AdaGrad)."""
    names = sorted({f for bits, entries in rows for f in _features(bits, entries)})
    index = {f: i for i, f in enumerate(names)}
    columns = np.array([index[f] for bits, entries in rows for f in _features(bits, entries)], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(_features(*r)) for r in rows])
    weights, bias, squares, square = np.zeros(len(names)), 0.0, np.full(len(names), 1e-8), 1e-8
    for _ in range(epochs):
        raw = np.bincount(row, weights[columns], len(rows)) + bias
        slope = 1 / (1 + np.exp(-raw)) - labels
        grad = np.bincount(columns, slope[row], len(names)) / len(rows) + l2 * weights
        step = slope.mean()
        squares, square = squares + grad**2, square + step**2
        weights, bias = weights - 0.5 * grad / np.sqrt(squares), bias - 0.5 * step / np.sqrt(square)
    return dict(zip(names, weights.tolist(), strict=True)), float(bias)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> ToxicityModel:
    """`labels` has doc_id and toxic (0/1) of the rows that may be learned from; the greatest of repeated labels holds.

    The classifier learns from at most `settings.sample` rows, of which rows alike in votes and entries weigh as
    `settings.repeats` at most. Without labels the hand lists alone vote; an empty table gives a model that scores
    all texts low."""
    words, stems = mine_entries(docs, labels, settings)

    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([votes_of(t if isinstance(t, str) else None, words, stems)[0] for t in texts], dtype="int32")

    voted = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.pandas_udf(vote, IntegerType())(F.col("text")).alias("votes"))
    voted = stored(voted, "votes")
    table = np.array([(r["votes"], r["n"]) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()], np.int64)
    if not len(table):
        return ToxicityModel(words, stems)
    model = fit_label_model(_unpacked(table[:, 0]), table[:, 1].astype(float), settings)
    chosen = voted.select("row", "votes").distinct().orderBy("row").limit(settings.sample)
    chosen = broadcast_within(stored(chosen, "training-rows"), settings.sample, settings.sample)
    some = docs.withColumn("row", F.xxhash64("doc_id", "text")).join(chosen, "row").select("text")
    rows = some.mapInPandas(_hits(words, stems), "bits int, entries array<string>").groupBy("bits", "entries").agg(
        F.count("*").alias("n")).orderBy("bits", "entries").limit(settings.sample).collect()
    kinds = [(r["bits"], list(r["entries"])) for r in rows for _ in range(min(r["n"], settings.repeats))]
    soft = model.posterior(_unpacked(np.array([bits for bits, _ in kinds], np.int64)))
    weights, bias = train_linear(kinds, soft)
    return ToxicityModel(words, stems, model, weights, bias)


def _hits(words: frozenset, stems: frozenset):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [votes_of(t if isinstance(t, str) else None, words, stems) for t in batch["text"]]
            yield pd.DataFrame(found, columns=["bits", "entries"])

    return rows


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted`; columns of these names are replaced. Null texts are empty."""
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            raw = [model.bias + sum(model.weights.get(f, 0.0) for f in _features(*votes_of(t if isinstance(t, str) else None, model.words, model.stems)))
                   for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(raw, float), -30, 30))))

    df = docs.drop("score", "predicted").withColumn("score", F.pandas_udf(rate, DoubleType())(F.col("text")))
    return df.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
