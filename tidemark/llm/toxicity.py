"""Operator 2: toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and word beginnings.  For each
labelled text that names a group, copies are made with the group's term swapped
for the others of its list, and the squared change of the score's logit is
penalised.  Terms of one list are thus pulled to one weight, so that a neutral
mention of a group doesn't raise the score.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch, cut, free_name, held_out, hold, labelled_sample, map_texts

#: Terms that may stand for one another (fixed values; a parameter of ``fit``).
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"), ("christen", "muslime", "juden"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside the word.
HEADS = (4, 5, 6)
#: Texts that a feature must be in to be chosen.
LEAST = 4
#: Words whose features a worker remembers at most.
REMEMBERED = 300_000


def features_of(word: str) -> tuple[str, ...]:
    """The word itself, and its beginnings, marked by a hyphen."""
    return (word, *(word[:k] + "-" for k in HEADS if len(word) >= k))


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


class Model:
    """Weights by feature and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[str, ...]] = {}

    def score(self, text: str) -> float:
        """Probability of label 1."""
        found: set[str] = set()
        known, weights = self.known, self.weights
        for w in words_of(text):
            got = known.get(w)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = known[w] = tuple(f for f in features_of(w) if f in weights)
            if got:
                found.update(got)
        z = self.bias + sum(weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def counterfactuals(words: set[str], groups: tuple[tuple[str, ...], ...]) -> list[set[str]]:
    """The words with each group term replaced by each other term of its list."""
    out = []
    for group in groups:
        for term in words.intersection(group):
            out += [(words - {term}) | {other} for other in group if other != term]
    return out


def pick(counts: Iterable[tuple[str, int, int]], n1: int, n0: int, vocabulary: int, groups: tuple[tuple[str, ...], ...]) -> list[str]:
    """Features that tell the classes apart best, then the group terms' features; ``counts`` are (feature, texts of label 1, of label 0)."""
    share = n1 / (n1 + n0)

    def gain(a: int, b: int) -> float:
        up, down = (a + b) * share, (a + b) * (1 - share)
        return (a - up) ** 2 / (up + 1) + (b - down) ** 2 / (down + 1)

    best = heapq.nsmallest(vocabulary, ((-gain(a, b), f) for f, a, b in counts if a + b >= LEAST))
    names = [f for _, f in best]
    terms = {f for group in groups for t in group for f in features_of(t)}
    return names + sorted(terms.difference(names))


def encode(words: set[str], index: dict[str, int], groups: tuple[tuple[str, ...], ...]) -> tuple[list[int], list[list[int]]]:
    """A text's features, and per swap of a group term the features that go (-1 - i) and come (1 + i)."""
    features = {f for w in words for f in features_of(w) if f in index}
    swaps = []
    for other in counterfactuals(words, groups):
        changed = {f for w in other for f in features_of(w) if f in index}
        row = sorted([-1 - index[f] for f in features - changed] + [1 + index[f] for f in changed - features])
        if row:
            swaps.append(row)
    return sorted(index[f] for f in features), swaps


def fit_encoded(rows: list[list[int]], swaps: list[list[int]], labels: list[int], names: list[str], penalty: float = 10.0, ridge: float = 2e-4, steps: int = 500) -> Model:
    """Fit on encoded texts.  With no rows, or one class, all scores are the smoothed class share."""
    y = np.array(labels, dtype=float)
    n, n1 = len(y), float(y.sum())
    bias = math.log((n1 + 0.5) / (n - n1 + 0.5))
    if n == 0 or n1 in (0.0, float(n)):
        return Model({}, bias)

    def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([k for x in lists for k in x], dtype=np.int64)

    size = len(names)
    at, col = flat(rows)
    s_at, signed = flat(swaps)
    s_col, sign = np.abs(signed) - 1, np.sign(signed).astype(float)
    w, b = np.zeros(size), bias
    look_w, look_b, t = w.copy(), b, 1.0
    most = np.bincount(at, minlength=n).max(initial=1)
    if swaps:
        rate: float | np.ndarray = 1.0 / (0.25 * (most + 1) + 2 * penalty * np.bincount(s_at).max() + ridge)
    else:  # a feature of few texts may take longer steps
        rate = 1.0 / (0.25 * np.sqrt(np.bincount(col, minlength=size) / n * most + 1e-9) + ridge + 0.05)
    for _ in range(steps * (4 if swaps else 1)):
        z = np.bincount(at, look_w[col], minlength=n) + look_b
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        grad = np.bincount(col, error[at], minlength=size) + ridge * look_w
        if swaps:
            change = np.bincount(s_at, look_w[s_col] * sign, minlength=len(swaps))
            grad += 2 * penalty / len(swaps) * np.bincount(s_col, change[s_at] * sign, minlength=size)
        new_w, new_b = look_w - rate * grad, look_b - error.sum()
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        if float(((look_w - new_w) * grad).sum()) > 0:  # going uphill: restart the acceleration
            look_w, look_b, t_next = new_w, new_b, 1.0
        w, b, t = new_w, new_b, t_next
    return Model({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-4}, float(b))


def fit(texts: list[set[str]], labels: list[int], groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, vocabulary: int = 4000, **options) -> Model:
    """Fit on the word sets of labelled texts.  ``penalty`` weighs the mean squared logit change under swaps of group terms."""
    seen: list[Counter] = [Counter(), Counter()]
    for words, label in zip(texts, labels, strict=True):
        seen[label].update({f for w in words for f in features_of(w)})
    if len(set(labels)) < 2:
        return fit_encoded([], [], labels, [])
    names = pick(((f, seen[1][f], seen[0][f]) for f in seen[1].keys() | seen[0].keys()), sum(labels), len(labels) - sum(labels), vocabulary, groups)
    index = {f: i for i, f in enumerate(names)}
    made = [encode(words, index, groups) for words in texts]
    return fit_encoded([x for x, _ in made], [s for _, swaps in made for s in swaps], labels, names, **options)


@lru_cache(1)
def _model(weights: tuple[tuple[str, float], ...], bias: float) -> Model:
    hold(__name__, _model.cache_clear)
    return Model(dict(weights), bias)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, vocabulary: int = 4000, **options) -> Model:
    """Fit on at most ``sample`` labelled rows whose crc32(doc_id) mod 5 isn't 0.

    Features are counted on the executors.  The driver gets the counts of
    those in ``LEAST`` texts or more, and the ``vocabulary`` chosen ones per
    row of the sample: both are bounded by the sample.
    """
    scratch = Scratch(docs.sparkSession)

    def reduce(texts: list[str]) -> list[pa.Array]:
        return [pa.array([" ".join(sorted(words_of(t))) for t in texts], type=pa.string())]

    rows = labelled_sample(docs, labels, "toxic", sample).withColumn("label", (F.col("label") > 0).cast("int"))
    rows = scratch.table(map_texts(rows, reduce, "text string", "doc_id", "label"), "words")
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return fit_encoded([], [], [1] * n1 + [0] * n0, [])
    counts = rows.mapInArrow(_count, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    found = counts.where(F.col("n1") + F.col("n0") >= LEAST).toArrow()
    names = pick(zip(*(found[c].to_pylist() for c in ("feature", "n1", "n0")), strict=True), n1, n0, vocabulary, groups)
    index = {f: i for i, f in enumerate(names)}

    def run(texts: list[str]) -> list[pa.Array]:
        made = [encode(set(t.split()), index, groups) for t in texts]
        return [pa.array([x for x, _ in made], type=pa.list_(pa.int32())), pa.array([s for _, s in made], type=pa.list_(pa.list_(pa.int32())))]

    made = map_texts(rows, run, "x array<int>, swaps array<array<int>>", "doc_id", "label").toArrow().sort_by("doc_id")
    swaps = [s for per_row in made["swaps"].to_pylist() for s in per_row]
    return fit_encoded(made["x"].to_pylist(), swaps, made["label"].to_pylist(), names, **options)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of either label have each feature, per slice."""
    for batch in batches:
        for part in cut(batch):
            seen: list[Counter] = [Counter(), Counter()]
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                seen[label].update({f for w in text.split() for f in features_of(w)})
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][f] for f in names], pa.int64()) for k in (1, 0))], names=["feature", "n1", "n0"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score double: one row per row of ``docs`` (doc_id, text).

    Null and empty texts get the score of a text without features.  Repeated
    rows give repeated results, a null doc_id stays null, and other columns
    are ignored.
    """
    packed = docs.sparkSession.sparkContext.broadcast((tuple(sorted(model.weights.items())), model.bias))

    def run(texts: list[str]) -> list[pa.Array]:
        m = _model(*packed.value)
        return [pa.array([m.score(t) for t in texts], type=pa.float64())]

    return map_texts(docs, run, "score double", "doc_id")


def classify(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.5, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; see ``learn`` and ``score``.

    A null doc_id isn't held out.  Without labelled rows every score is 0.5.
    """
    scored = score(docs, learn(docs, labels, sample, groups))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.5, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; columns and other rows unchanged."""
    model = learn(docs, labels, sample, groups)
    packed = docs.sparkSession.sparkContext.broadcast((tuple(sorted(model.weights.items())), model.bias))
    mark = free_name("tidemark_toxic_score", docs.columns)

    def run(texts: list[str]) -> list[pa.Array]:
        m = _model(*packed.value)
        return [pa.array(texts, type=pa.string()), pa.array([m.score(t) for t in texts], type=pa.float64())]

    null = free_name("tidemark_null_text", docs.columns)
    others = [c for c in docs.columns if c != "text"]
    out = map_texts(docs.withColumn(null, F.isnull("text")), run, f"text string, {mark} double", *others, null)
    return out.where(F.col(mark) < threshold).withColumn("text", F.when(~F.col(null), F.col("text"))).select(*docs.columns)
