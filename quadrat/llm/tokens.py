"""Token ids of the public byte-level BPE vocabulary, made from cached words.

The vocabulary splits a text into pieces (a word with the space before it, a number, a run of marks, white space)
and encodes each alone, so what stands between two single spaces or line breaks is encoded once and then looked up.
Texts with other runs of white space are split into pieces on arrays of character classes. Ids equal those of the `tokenizers` library with add_special_tokens=False, added tokens in the text included."""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
CACHED_WORDS = 600_000
LETTER, NUMBER, SPACE = 1, 2, 3
# The characters of Unicode's White_Space, and the contractions that are pieces of their own.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)")


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """A class for each code point: letter, number, white space or (0) other."""
    kinds = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        first = unicodedata.category(chr(code))[0]
        if first in "LN":
            kinds[code] = LETTER if first == "L" else NUMBER
    kinds[list(WHITE_SPACE)] = SPACE
    return kinds


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """Where the pieces of a text start: a change of class, one space going to what it precedes."""
    kinds = character_classes()[codes]
    starts = np.ones(len(codes), bool)
    starts[1:] = kinds[1:] != kinds[:-1]
    after = np.flatnonzero(starts[1:] & (kinds[1:] != SPACE) & (kinds[:-1] == SPACE)) + 1
    starts[after - 1] = True
    starts[after[codes[after - 1] == 0x20]] = False
    return np.flatnonzero(starts)


class Words(dict):
    """Maps a word to the ids of `before` and the word, four bytes each; None if they depend on what follows."""

    def __init__(self, before: str, bpe: tiktoken.Encoding):
        self.before, self.encode, self.encode_piece = before, bpe.encode_ordinary, bpe._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= CACHED_WORDS:
            self.clear()
        if word.isalpha():  # one piece
            made = array("I", self.encode_piece((self.before + word).encode())).tobytes()
        elif word[:-1].isalpha() and word[-1] in ".,;:!?":  # two pieces
            made = self[word[:-1]] + array("I", self.encode_piece(word[-1].encode())).tobytes()
        elif not word or word[-1].isspace():
            made = None
        else:
            made = array("I", self.encode(self.before + word)).tobytes()
        self[word] = made
        return made


class Encoder:
    def __init__(self, vocabulary: str, ranks: str):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        bpe = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        with open(vocabulary, encoding="utf-8") as file:
            added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        self.added = {text: array("I", [i]).tobytes() for text, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.bytes_of = np.zeros(max([*table.values(), *added.values()]) + 1, np.int64)
        for piece, i in table.items():
            self.bytes_of[i] = len(piece)
        for text, i in added.items():
            self.bytes_of[i] = len(text.encode())
        self.first, self.later, self.pieces = Words("", bpe), Words(" ", bpe), Pieces("", bpe)
        self.line_break = self.pieces["\n"]

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, four bytes each."""
        if not text:
            return b""
        if any(t in text for t in self.added):
            parts = [p for p in self.cut.split(text) if p]
            return b"".join(self.added[p] if p in self.added else self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            head = None if line[:1].isspace() else self.first[words[0]]
            if head is None:
                return self._by_pieces(text)
            try:
                lines.append(head + b"".join(map(self.later.__getitem__, words[1:])))
            except TypeError:  # a word whose ids depend on what follows
                return self._by_pieces(text)
        return self.line_break.join(lines)

    def _by_pieces(self, text: str) -> bytes:
        if "'" in text and CONTRACTION.search(text):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        starts = piece_starts(np.frombuffer(text.encode("utf-32-le"), "<u4")).tolist()
        cut = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        return b"".join(map(self.pieces.__getitem__, cut))


class Pieces(Words):
    """Maps a piece, white space included, to its ids."""

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        made = self[piece] = array("I", self.encode(piece)).tobytes()
        return made


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str) -> Encoder:
    return Encoder(vocabulary, ranks)


def public_encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    """The worker's encoder; paths default to the installed public vocabulary."""
    return encoder(vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS))
