"""Operator 6: text quality by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins.  Boosting goes round the
features in turn; each turn fits a shallow tree of one feature to the gradient
and adds it to that feature's table.  Then the pairs whose joint bins explain
most of what is left get tables of their own, boosted in the same way.  A score
is the sum of one table entry per feature and per pair.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import buffers, gram_hashes, held_out, labelled_sample, map_texts, word_hashes

FEATURES = (
    "words", "word_length", "letters", "capitals", "digits", "marks", "odd_marks", "bars", "bangs", "line_words",
    "distinct", "repeats", "pair_repeats", "line_repeats", "worst_capitals", "worst_odd", "worst_distinct", "worst_bars",
    "long_words", "tags",
)
#: Words per block for the "worst block" features.
BLOCK = 50


def _classes() -> np.ndarray:
    kinds = np.zeros((8, 256), dtype=np.float64)
    kinds[0, 65:91] = kinds[0, 97:123] = kinds[0, 128:] = 1  # letters
    kinds[1, 65:91] = 1  # capitals
    kinds[2, 48:58] = 1  # digits
    kinds[3, [ord(c) for c in ".,;:?'\"()-"]] = 1  # marks
    kinds[4, [ord(c) for c in "#$%&*@^~=_+<>[]{}\\/"]] = 1  # odd marks
    kinds[5, ord("|")] = 1
    kinds[6, ord("!")] = 1
    kinds[7, [ord("<"), ord(">")]] = 1
    return kinds


_KINDS = _classes()
_CAPITAL, _ODD, _BAR = (_KINDS[i] > 0 for i in (1, 4, 5))
_ODD = _ODD | (_KINDS[6] > 0)


def features_of(data: np.ndarray) -> np.ndarray:
    """The features of one UTF-8 text; those of an empty text are all 0."""
    out = np.zeros(len(FEATURES))
    words, start, end = word_hashes(data, lower=True)
    n = len(words)
    if not n:
        return out
    counts = np.bincount(data, minlength=256).astype(float)
    size = float(len(data))
    per = _KINDS @ counts
    lengths = end - start
    unique = np.unique(words)
    pairs = gram_hashes(words, 2)
    newlines = np.flatnonzero(data == 10)
    line_of = np.searchsorted(newlines, start)
    lines = np.bincount(line_of, minlength=len(newlines) + 1)
    first = np.flatnonzero(np.diff(np.concatenate(([-1], line_of))))
    # a line is told by the wrapped sum of its words' hashes and places
    sums = np.add.reduceat(words * (2 * np.arange(n, dtype=np.uint64) + np.uint64(1) - 2 * np.repeat(first, np.diff(np.append(first, n))).astype(np.uint64)), first)
    filled = len(first)

    def worst(flags: np.ndarray, most: bool = True) -> float:
        total = np.concatenate(([0], np.cumsum(flags)))
        edges = np.arange(0, max(n, 1), BLOCK)
        tops = np.minimum(edges + BLOCK, n)
        share = (total[tops] - total[edges]) / np.maximum(tops - edges, 1)
        share = share[(tops - edges) >= min(n, BLOCK // 2)]
        return float(share.max() if most else share.min())

    has = {}
    for name, kind in (("capitals", _CAPITAL), ("odd", _ODD), ("bars", _BAR)):
        total = np.concatenate(([0], np.cumsum(kind[data])))
        has[name] = (total[end] - total[start]) * (3 if name != "capitals" else 1) >= (lengths + 1) // 2
        if name != "capitals":
            has[name] = (total[end] - total[start]) > 0
    order = np.argsort(words, kind="stable")
    same = np.zeros(n, dtype=bool)
    near = np.flatnonzero(words[order][1:] == words[order][:-1])
    same[order[near + 1]] = (order[near + 1] - order[near]) <= BLOCK // 2
    out[:] = (
        math.log1p(n), lengths.mean(), per[0] / size, per[1] / size, per[2] / size, per[3] / n, per[4] / n, per[5] / n, per[6] / n, math.log1p(n / filled),
        len(unique) / math.sqrt(n), float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0,
        1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0,
        1 - len(np.unique(sums)) / filled, worst(has["capitals"]), worst(has["odd"]), worst(same), worst(has["bars"]),
        float((lengths > 20).mean()), per[7] / n,
    )
    del lines
    return out


class Additive:
    """Bin edges per feature, one table per feature, one per chosen pair, and a bias."""

    def __init__(self, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int]], pair_tables: list[np.ndarray], coarse: list[np.ndarray], bias: float):
        self.edges, self.tables, self.pairs, self.pair_tables, self.coarse, self.bias = edges, tables, pairs, pair_tables, coarse, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 by table look-ups alone."""
        z = np.full(len(x), self.bias)
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        for j, table in enumerate(self.tables):
            z += table[bins[j]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int) -> np.ndarray:
    """Step per bin of a tree of at most ``depth`` levels over gradient and curvature sums per bin."""
    out = np.full(len(g), -g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge)
    gain[(left_h < 1e-3) | (right_h < 1e-3)] = -1
    k = int(gain.argmax())
    if gain[k] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
        return out
    return np.concatenate((_tree(g[: k + 1], h[: k + 1], ridge, depth - 1), _tree(g[k + 1 :], h[k + 1 :], ridge, depth - 1)))


def _quarter(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Best step table with one cut on each of two features, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, ah = cg[:-1, :-1], ch[:-1, :-1]
    b, bh = cg[:-1, -1:] - a, ch[:-1, -1:] - ah
    c, c_h = cg[-1:, :-1] - a, ch[-1:, :-1] - ah
    d, dh = cg[-1, -1] - a - b - c, ch[-1, -1] - ah - bh - c_h
    parts = ((a, ah), (b, bh), (c, c_h), (d, dh))
    gain = sum(x**2 / (y + ridge) for x, y in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    table = np.empty_like(g)
    steps = [-x[i, j] / (y[i, j] + ridge) for x, y in parts]
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = steps
    return table, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 250, pairs: int = 6, rate: float = 0.08, ridge: float = 1.0, cells: int = 8) -> Additive:
    """Boost single tables, then ``pairs`` pair tables.  With no rows, or one class, scores are the smoothed class share."""
    n, f = len(y), len(FEATURES)
    n1 = float(y.sum())
    bias = math.log((n1 + 0.5) / (n - n1 + 0.5))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(f)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = [np.arange(len(e) + 1) * min(cells, len(e) + 1) // (len(e) + 1) for e in edges]
    if n == 0 or n1 in (0.0, float(n)):
        return Additive(edges, tables, [], [], coarse, bias)
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    z = np.full(n, bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(f):
            g, h = slopes()
            step = rate * _tree(np.bincount(binned[j], g, len(tables[j])), np.bincount(binned[j], h, len(tables[j])), ridge, 2)
            tables[j] += step
            z += step[binned[j]]
    small = [coarse[j][binned[j]] for j in range(f)]
    shape = [int(c.max()) + 1 for c in coarse]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(small[a] * shape[b] + small[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b])

    g, h = slopes()
    ranked = sorted((-_quarter(grid(a, b, g), grid(a, b, h), ridge)[1], a, b) for a, b in combinations(range(f), 2) if shape[a] > 1 and shape[b] > 1)
    chosen = [(a, b) for _, a, b in ranked[:pairs]]
    pair_tables = [np.zeros((shape[a], shape[b])) for a, b in chosen]
    for _ in range(rounds // 4 if chosen else 0):
        for k, (a, b) in enumerate(chosen):
            g, h = slopes()
            step = rate * _quarter(grid(a, b, g), grid(a, b, h), ridge)[0]
            pair_tables[k] += step
            z += step[small[a], small[b]]
    return Additive(edges, tables, chosen, pair_tables, coarse, bias)


def feature_rows(texts: list[str]) -> np.ndarray:
    offsets, data = buffers(pa.array(texts, type=pa.large_string()))
    return np.array([features_of(data[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Additive:
    """Fit on at most ``sample`` labelled rows whose crc32(doc_id) mod 5 isn't 0; the driver gets their features only."""
    chosen = labelled_sample(docs, labels, "quality", sample)

    def run(texts: list[str]) -> list[pa.Array]:
        return [pa.array(list(feature_rows(texts)), type=pa.list_(pa.float64()))]

    rows = map_texts(chosen, run, "x array<double>", "doc_id", "label").toArrow().sort_by("doc_id")
    x = np.array(rows["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array([int(v > 0) for v in rows["label"].to_pylist()], dtype=float))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id, score double: one row per row of ``docs`` (doc_id, text).

    Null and empty texts get the score of all-zero features.  Repeated rows
    give repeated results, a null doc_id stays null, and other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> list[pa.Array]:
        return [pa.array(shared.value.scores(feature_rows(texts)), type=pa.float64())]

    return map_texts(docs, run, "score double", "doc_id")


def classify(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; see ``learn`` and ``score``.

    A null doc_id isn't held out.  Without labelled rows every score is 0.5.
    """
    scored = score(docs, learn(docs, labels, sample))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
