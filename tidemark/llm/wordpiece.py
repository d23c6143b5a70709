"""Operator 3: token counts by a linear longest-match automaton.

A trie holds the vocabulary, pieces that start a word below one root and pieces
that continue a word below another.  Each node has a failure link and the
number of pieces that the greedy match has certainly finished ("popped") when
the link is taken.  A word is read once, left to right; the popped counts add
up to its number of pieces and no piece is ever built.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import SPACES, hold, map_texts

#: Words whose counts a worker remembers at most.
REMEMBERED = 300_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAPS = bytes(SPACES)


class LongestMatch:
    """Greedy longest-match-first piece counts over bytes.

    ``start`` and ``inside`` are the pieces that may begin a word and those
    that may continue one.  A word that they can't cover counts as one
    unknown piece.
    """

    def __init__(self, start: list[bytes], inside: list[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]  # node 0: root of starts; node 1: root of continuations
        self.final = [False, False]
        for root, pieces in ((0, start), (1, inside)):
            for piece in pieces:
                node = root
                for b in piece:
                    to = self.edges[node].get(b)
                    if to is None:
                        to = self.edges[node][b] = len(self.edges)
                        self.edges.append({})
                        self.final.append(False)
                    node = to
                if piece:
                    self.final[node] = True
        n = len(self.edges)
        # link[v]: where the match goes on after the popped pieces; -1 if it fails
        self.link, self.popped = [-1] * n, [0] * n
        level = [0, 1]
        while level:
            below = []
            for v in level:
                for b, u in self.edges[v].items():
                    below.append(u)
                    if self.final[u]:
                        self.link[u], self.popped[u] = 1, 1
                        continue
                    z, count = self.link[v], self.popped[v]
                    while z >= 0 and b not in self.edges[z]:
                        count += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[u], self.popped[u] = self.edges[z][b], count
            level = below
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Number of pieces of one word."""
        edges, link, popped = self.edges, self.link, self.popped
        node, total = 0, 0
        for b in word:
            to = edges[node].get(b)
            while to is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                to = edges[node].get(b)
            node = to
        while node != 1:
            if node < 0 or link[node] < 0:
                return 1
            total += popped[node]
            node = link[node]
        return total

    def count_text(self, text: str, lower: bool) -> tuple[int, int]:
        """Words and pieces of a text; words are runs without ASCII white space."""
        raw = text.encode()
        words = (raw.translate(_LOWER) if lower else raw).split()
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[w] = self.count(w)
            total += n
        return len(words), total


@lru_cache(2)
def automaton(pieces: bytes) -> LongestMatch:
    """One automaton per worker process; ``pieces`` is JSON [[hex of starts], [hex of continuations]]."""
    hold(__name__, automaton.cache_clear)
    start, inside = json.loads(pieces)
    return LongestMatch([bytes.fromhex(x) for x in start], [bytes.fromhex(x) for x in inside])


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in own}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    return letters


def pieces_of(path: str, word_end: str = "</w>") -> bytes:
    """The surface pieces of a byte-level tokenizer file, as ``automaton`` takes them.

    The mark of a word's end is dropped, and any piece may start or continue
    a word.  All 256 bytes are pieces in such a vocabulary, so no word is
    unknown.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    found = {bytes(letters[c] for c in t) for x in vocab if (t := x.removesuffix(word_end)) and all(c in letters for c in t)}
    listed = sorted(x.hex() for x in found)
    return json.dumps([listed, listed]).encode()


def token_counts(docs: DataFrame, pieces: bytes, lower: bool = True) -> DataFrame:
    """doc_id, n_words long, n_pieces long: one row per row of ``docs`` (doc_id, text).

    Null and empty texts have no words.  Repeated rows give repeated results, a
    null doc_id stays null, and other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(texts: list[str]) -> list[pa.Array]:
        match = automaton(shared.value)
        counts = [match.count_text(t, lower) for t in texts]
        return [pa.array([c[i] for c in counts], type=pa.int64()) for i in (0, 1)]

    return map_texts(docs, run, "n_words long, n_pieces long", "doc_id")
