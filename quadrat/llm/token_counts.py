"""Token counts by section: whole texts are encoded once, token spans are joined to section intervals.

A section is an interval of characters. A token belongs to the section that holds its characters; one that crosses
a boundary is allocated by the rule asked for: "first" gives it to the section of its first character, "most" to
the one with most of its characters (the earlier on a tie), "share" to each in proportion. The counts of a text's
sections always add up to the tokens of the whole text, which counting each section alone would not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.tokens import Encoder, public_encoder

RULES = ("first", "most", "share")
ROWS = 50_000


def token_spans(text: str, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token. Tokens that split one character both cover it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(encoder.bytes_of[np.frombuffer(encoder.encode(text), "<u4")])
    starts = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]])
    return character[starts], character[ends - 1] + 1


def allocate(first: np.ndarray, last: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section; `bounds` are the ascending ends of all sections.

    The interval join is a binary search of both ends of each token; only tokens whose ends fall into different
    sections need the rule."""
    a, b = np.searchsorted(bounds, first, "right"), np.searchsorted(bounds, last - 1, "right")
    size = len(bounds)
    counts = np.bincount(a[a == b], minlength=size).astype(float)
    crossing = np.zeros(size, np.int64)
    for i in np.flatnonzero(a != b):
        span = np.arange(a[i], b[i] + 1)
        edges = np.clip(np.concatenate([[first[i]], bounds[span]]), first[i], last[i])
        held = np.diff(edges)
        crossing[span[held > 0]] += 1
        if rule == "share":
            counts[span] += held / held.sum()
        else:
            counts[span[np.argmax(held > 0)] if rule == "first" else span[np.argmax(held)]] += 1
    return counts, crossing


def line_ends(text: str) -> np.ndarray:
    """The ends of a text's lines, each with its line break."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(codes == 0x0A) + 1
    return ends if len(ends) and ends[-1] == len(codes) else np.append(ends, len(codes))


def section_tokens(docs: DataFrame, rule: str = "first", fields: list[str] | None = None,
                   vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, section, start, end, tokens, crossing): the token count of every section of every text.

    Sections are the lines of `text`, or, with `fields`, those columns joined by line breaks (section i is
    fields[i] and the break after it; null is empty). Null and empty texts have one empty section without tokens.
    Repeated rows are counted again; other columns are not read. With rule "share" tokens are fractions."""
    if rule not in RULES:
        raise ValueError(f"rule is none of {RULES}")
    names = fields or ["text"]
    rows = docs.select(F.col("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"f{i}") for i, c in enumerate(names)])
    kind = dict(rows.dtypes)["doc_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = public_encoder(vocabulary, ranks)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids = batch.column(0)
            for i, parts in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)):
                text = "\n".join(parts)
                bounds = line_ends(text) if fields is None else np.cumsum([len(p) + 1 for p in parts]) - np.eye(1, len(parts), len(parts) - 1, dtype=np.int64)[0]
                counts, crossing = allocate(*token_spans(text, encoder), bounds, rule)
                starts = np.concatenate([[0], bounds[:-1]])
                out[0] += [i] * len(bounds)
                for values, more in zip(out[1:], (range(len(bounds)), starts, bounds, counts, crossing), strict=True):
                    values.extend(more)
                if len(out[0]) >= ROWS:
                    yield _rows(ids, out)
                    out = [[], [], [], [], [], []]
            yield _rows(ids, out)

    schema = f"doc_id {kind}, section long, start long, end long, tokens double, crossing long"
    made = rows.mapInArrow(count, schema)
    return made if rule == "share" else made.withColumn("tokens", F.col("tokens").cast("long"))


def _rows(ids: pa.Array, out: list[list]) -> pa.RecordBatch:
    columns = [ids.take(pa.array(out[0], pa.int64()))]
    columns += [pa.array(x, t) for x, t in zip(out[1:], (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "start", "end", "tokens", "crossing"])
