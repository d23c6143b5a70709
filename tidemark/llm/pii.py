"""Operator 8: personal data by patterns and a skip-chain conditional random field.

Four patterns find the base spans.  The nodes of the field are a text's tokens
with a digit or an at sign, and those that repeat an address's local part;
words without either can't be personal data of these kinds.  Neighbouring tokens
of a run ("+49 30 1234567") share a chain potential.  Tokens of equal or similar
form, however far apart, share a skip potential, each with the one before it and
with the first base token of that form and label.  Loopy sum-product message
passing lets base spans, which are clamped, and tokens that look like personal
data pull their repetitions to their own label.

All potentials are fitted together by pseudo-likelihood on the tokens of all
documents, where the base spans serve as labels.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.secret_scan import SPAN_FIELDS
from tidemark.llm.shared import Scratch, free_name, map_texts, struct_lists

#: Kinds of the patterns, in the order in which spans with one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the field adds.
FIELD_KINDS = tuple(f"like_{k}" for k in BASE_KINDS)
KINDS = (*BASE_KINDS, *FIELD_KINDS)
LABELS = (*BASE_KINDS, "other")
OTHER = len(BASE_KINDS)

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its first digit fails from any later one, so only firsts are tried.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# a run of these letters is tried from its beginning alone, and what has no digit or at sign is given up at once
TOKEN = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*")
WORD = re.compile(r"[A-Za-z0-9._%+-]+")
LETTERS = re.compile(r"[^\W\d_]+")
PIECE = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
GAP = re.compile(r"[\x20()./-]+")

#: Prior means of the weights by which two tokens agree: of equal form, of similar form, of one short form, which may be chance.
AGREE = np.array([6.0, 6.0, 1.0])
#: A word is a feature of an example's kind if it is in at least one in so many of all examples.
RAREST = 100_000
#: Edges whose messages are made at once.
AT_ONCE = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four patterns' spans, in no order."""
    out = []
    done = 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            s = at = m.start()
            while s > done and text[s - 1] in _LOCAL_LETTERS:
                s -= 1
            if s < at:
                out.append(("email", s, m.end()))
                done = m.end()
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def names_of(base: list[tuple[str, int, int]], text: str) -> set[str]:
    """Local parts of the text's addresses that are told from ordinary words by a sign or digit."""
    return {x for k, s, e in base if k == "email" for x in [local_of(text[s:e])] if x}


def local_of(token: str) -> str:
    """An address's local part, or a whole token without at sign, in lower case; empty if it is too plain."""
    local = token.partition("@")[0].lower()
    return local if len(local) >= 5 and not local.isalpha() else ""


def tokens_of(text: str, names: set[str]) -> list[tuple[int, int]]:
    """(start, end) of the tokens with a digit or an at sign, and of those that repeat an address's local part, in order."""
    out = []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while text[s] in "._%-":
            s += 1
        while text[e - 1] in "._%+-":
            e -= 1
        out.append((s, e))
    if names:
        starts = [s for s, _ in out]
        for m in WORD.finditer(text):
            if m[0].lower().strip("._%+-") in names:
                i = bisect(starts, m.start())
                if (not i or out[i - 1][1] <= m.start()) and (i == len(out) or starts[i] >= m.end()):
                    out.append(m.span())
        out.sort()
    return out


def runs_of(text: str, tokens: list[tuple[int, int]]) -> list[int]:
    """For each token the number of its run: numbers that only blanks, brackets, dots, slashes or hyphens part."""
    out: list[int] = []
    for i, (s, e) in enumerate(tokens):
        near = bool(i) and s - tokens[i - 1][1] <= 3 and not GAP.sub("", text[tokens[i - 1][1] : s]) and "@" not in text[tokens[i - 1][0] : e]
        out.append(out[-1] + (not near) if out else 0)
    return out


def shape_of(token: str) -> str:
    """Digits as 9, letters as a, mixed runs as x, signs as they are; ten at most."""
    return "".join("9" if p.isdigit() else "a" if p.isalpha() else "x" if p.isalnum() else p for p in PIECE.findall(token)[:10])


class Graph:
    """The tokens of one text: labels where a pattern matched, features, chain and skip edges."""

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        names = names_of(base, text)
        self.tokens = tokens = tokens_of(text, names)
        self.runs = runs = runs_of(text, tokens)
        digits = [digits_of(text[s:e]) for s, e in tokens]
        self.labels = [-1] * len(tokens)
        starts = [s for s, _ in tokens]
        #: digits of the base numbers by their last seven
        known: dict[str, set[str]] = {}
        keys: list[list[tuple[str, int]]] = [[] for _ in tokens]
        for kind, s, e in sorted(base, key=lambda x: (BASE_KINDS.index(x[0]), x[1])):
            whole = digits_of(text[s:e])
            i = max(0, bisect(starts, s) - 1)
            while i < len(tokens) and tokens[i][0] < e:
                if tokens[i][1] > s:
                    if self.labels[i] < 0:
                        self.labels[i] = LABELS.index(kind)
                    if kind == "email":
                        keys[i] += [(f"local {x}", 1) for x in [local_of(text[s:e])] if x]
                    elif len(whole) >= 7:
                        keys[i].append((f"tail {whole[-7:]}", 1))
                        known.setdefault(whole[-7:], set()).add(whole)
                i += 1
        for i, (s, e) in enumerate(tokens):
            form = text[s:e].lower()
            if len(form) >= 4:
                keys[i].append((f"form {form}", 0 if len(digits[i]) >= 7 or len(form) >= 6 and not form.isdigit() else 2))
            if self.labels[i] < 0 and names and local_of(form) in names:
                keys[i].append((f"local {local_of(form)}", 1))
            if self.labels[i] < 0 and known and digits[i]:
                self._suffixes(i, digits, known, keys)
        self.chain = [i for i in range(1, len(tokens)) if runs[i] == runs[i - 1]]
        self.skips: list[tuple[int, int, int]] = []
        hubs: dict[str, dict[int, int]] = {}
        for i, label in enumerate(self.labels):
            if label >= 0:
                for key, _ in keys[i]:
                    hubs.setdefault(key, {}).setdefault(label, i)
        last: dict[str, int] = {}
        #: whether a base span says something about the token, so that it is no example of "other"
        self.echo = [False] * len(tokens)
        for i, label in enumerate(self.labels):
            for key, similar in dict(keys[i]).items():
                # each token meets the last one of its form, and the first base token of each label: edges stay in proportion to tokens
                met = set(hubs.get(key, {}).values()) if label < 0 else set()
                self.echo[i] = self.echo[i] or bool(met)
                if key in last:
                    met.add(last[key])
                self.skips += [(j, i, similar) for j in sorted(met)]
                last[key] = i
        totals: dict[int, int] = {}
        for i, r in enumerate(runs):
            totals[r] = totals.get(r, 0) + len(digits[i])
        written = {r: "" for r, n in totals.items() if 12 <= n <= 19}
        for i, r in enumerate(runs):
            if r in written:
                written[r] += digits[i]
        self.features, self.words = [], []
        first = 0
        for i, (s, e) in enumerate(tokens):
            begins, ends = not i or runs[i] != runs[i - 1], i + 1 == len(tokens) or runs[i + 1] != runs[i]
            first = i if begins else first
            at = tokens[first][0]
            before = LETTERS.findall(text[max(0, at - 24) : at].lower())
            self.words.append(before[-1][:12] if before else "")
            self.features.append((
                f"digits {min(len(digits[i]), 20)}", f"shape {shape_of(text[s:e])}", f"run {min(totals[runs[i]], 24)}", f"place {begins:d}{ends:d}",
                f"before {_sign(text, s - 1)}", f"after {_sign(text, e)}", f"sum {luhn(written[runs[i]]) if runs[i] in written else ''}", "any",
            ))

    def _suffixes(self, i: int, digits: list[str], known: dict[str, set[str]], keys: list[list[tuple[str, int]]]) -> None:
        """Give the key of a base number to the tokens of a run, up to ``i``, that spell its end in seven digits or more."""
        j, tail = i, digits[i]
        while len(tail) < 24 and j and self.runs[j - 1] == self.runs[i]:
            j -= 1
            tail = digits[j] + tail
        for whole in sorted(known.get(tail[-7:], ())):
            same = next((n for n, (a, b) in enumerate(zip(reversed(tail), reversed(whole), strict=False)) if a != b), min(len(tail), len(whole)))
            at, k = 0, i
            while k >= j and at < same:
                if self.labels[k] < 0 and (f"tail {whole[-7:]}", 1) not in keys[k]:
                    keys[k].append((f"tail {whole[-7:]}", 1))
                at += len(digits[k])
                k -= 1


def _sign(text: str, at: int) -> str:
    c = text[at : at + 1] if at >= 0 else ""
    return "" if not c else "a" if c.isalnum() else "blank" if c.isspace() else c if c in "()[]{}<>+:;=,.\"'#/|" else "sign"


class SkipChain:
    """The fitted potentials and inference: of features and words to labels, of neighbouring labels, and of agreement across skips."""

    def __init__(self, unary: dict[str, np.ndarray] | None = None, chain: np.ndarray | None = None, skip: np.ndarray | None = None):
        self.unary = unary or {}
        self.chain = np.zeros((len(LABELS), len(LABELS))) if chain is None else chain
        self.skip = AGREE.copy() if skip is None else skip

    def marginals(self, graphs: list[Graph], rounds: int = 1000) -> list[np.ndarray]:
        """Label probabilities of each text's tokens by loopy message passing until no message changes, or ``rounds``.

        All texts' graphs are one graph here.  Messages on loops need not
        settle, hence the last bound.
        """
        sizes = [len(g.tokens) for g in graphs]
        starts = np.cumsum([0, *sizes])
        node = np.zeros((int(starts[-1]), len(LABELS)))
        edges: list[tuple[int, int, int]] = []
        nothing = np.zeros(len(LABELS))
        for at, g in zip(starts.tolist(), graphs, strict=False):
            for i, label in enumerate(g.labels):
                if label >= 0:
                    node[at + i] = -1e9  # below what any number of repetitions can say against it
                    node[at + i, label] = 0.0
                else:
                    node[at + i] = sum((self.unary.get(f, nothing) for f in (*g.features[i], f"word {g.words[i]}")), nothing)
            edges += [(at + i - 1, at + i, 0) for i in g.chain]
            edges += [(at + i, at + j, 1 + similar) for i, j, similar in g.skips]
        if edges:
            node = self._pass(node, np.array(edges), rounds)
        all_ = np.exp(_norm(node)) if len(node) else node
        return [all_[a : a + n] for a, n in zip(starts.tolist(), sizes, strict=False)]

    def _pass(self, node: np.ndarray, edges: np.ndarray, rounds: int) -> np.ndarray:
        a, b, kind = edges.T
        potentials = np.stack([self.chain, *(w * np.eye(len(LABELS)) for w in self.skip)])
        forth, back = np.zeros((len(a), len(LABELS))), np.zeros((len(a), len(LABELS)))

        def belief() -> np.ndarray:
            out = node.copy()
            np.add.at(out, b, forth)
            np.add.at(out, a, back)
            return out

        for _ in range(rounds):
            now, moved = belief(), 0.0
            for low in range(0, len(a), AT_ONCE):
                part = slice(low, low + AT_ONCE)
                potential = potentials[kind[part]]
                new_forth = _norm(_logsum((now[a[part]] - back[part])[:, :, None] + potential, 1))
                new_back = _norm(_logsum((now[b[part]] - forth[part])[:, None, :] + potential, 2))
                moved = max(moved, np.abs(new_forth - forth[part]).max(), np.abs(new_back - back[part]).max())
                forth[part], back[part] = (forth[part] + new_forth) / 2, (back[part] + new_back) / 2
            if moved < 1e-6:
                break
        return belief()


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _norm(x: np.ndarray) -> np.ndarray:
    return x - _logsum(x, 1)[:, None]


def examples_of(graph: Graph) -> Counter:
    """(example, word) -> how often; an example is a token's label, features, and the labels of its neighbours.

    A token that no pattern matched counts as "other", unless it repeats a
    base span's form: what it is, is for the field to say, so it is no example
    and no neighbour.
    """
    labels = [x if x >= 0 else None if e else OTHER for x, e in zip(graph.labels, graph.echo, strict=True)]
    around: list[Counter] = [Counter() for _ in labels]
    for i in graph.chain:
        if labels[i - 1] is not None:
            around[i][f"left {labels[i - 1]}"] += 1
        if labels[i] is not None:
            around[i - 1][f"right {labels[i]}"] += 1
    for i, j, similar in graph.skips:
        for x, y in ((i, j), (j, i)):
            if labels[y] is not None:
                around[x][f"skip {similar} {labels[y]}"] += 1
    out: Counter = Counter()
    for label, features, word, near in zip(labels, graph.features, graph.words, around, strict=True):
        if label is not None:
            out["\t".join((str(label), *features, *(f"{k} {min(n, 3)}" for k, n in sorted(near.items())))), word] += 1
    return out


def fit_field(examples: list[tuple[str, str, int]], ridge: float = 0.1, steps: int = 400) -> SkipChain:
    """The field that makes each token's label most likely given its neighbours' (pseudo-likelihood), with Gaussian priors.

    ``examples`` are (example, word, how often).  Potentials of features, words
    and neighbouring labels have prior mean 0, those of agreement ``AGREE``.
    """
    n = len(LABELS)
    names: dict[str, int] = {}
    label, times, f_row, f_at, l_row, l_at, r_row, r_at, s_row, s_kind, s_label, s_times = ([] for _ in range(12))
    for k, (example, word, count) in enumerate(examples):
        own, *parts = example.split("\t")
        label.append(int(own))
        times.append(count)
        for p in (*parts, f"word {word}"):
            what, _, rest = p.partition(" ")
            if what in ("left", "right"):
                (l_row if what == "left" else r_row).append(k)
                (l_at if what == "left" else r_at).append(int(rest.split()[0]))
            elif what == "skip":
                kind, met, often = map(int, rest.split())
                s_row.append(k), s_kind.append(kind), s_label.append(met), s_times.append(often)
            else:
                f_row.append(k), f_at.append(names.setdefault(p, len(names)))
    if not examples:
        return SkipChain()
    y, t = np.array(label), np.array(times, dtype=float)
    ints = lambda x: np.array(x, dtype=np.int64)
    f_row, f_at, l_row, l_at, r_row, r_at, s_row, s_kind, s_label, s_times = map(ints, (f_row, f_at, l_row, l_at, r_row, r_at, s_row, s_kind, s_label, s_times))
    want = np.zeros((len(y), n))
    want[np.arange(len(y)), y] = 1

    def grown(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, values[:, c], minlength=size) for c in range(values.shape[1])], axis=1)

    def gradient(u: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = grown(f_row, u[f_at], len(y))
        z += grown(l_row, c[l_at], len(y)) if len(l_row) else 0
        z += grown(r_row, c.T[r_at], len(y)) if len(r_row) else 0
        np.add.at(z, (s_row, s_label), s[s_kind] * s_times)
        error = (np.exp(_norm(z)) - want) * t[:, None]
        g_c = np.zeros((n, n))
        np.add.at(g_c, l_at, error[l_row])
        np.add.at(g_c.T, r_at, error[r_row])
        return grown(f_at, error[f_row], len(u)) + ridge * u, g_c + ridge * c, np.bincount(s_kind, error[s_row, s_label] * s_times, minlength=len(AGREE)) + (s - AGREE)

    # each potential's step follows how often it can matter; the number of parts of an example bounds how they add up
    most = np.bincount(f_row, minlength=len(y)) + np.bincount(l_row, minlength=len(y)) + np.bincount(r_row, minlength=len(y)) + np.bincount(s_row, s_times, minlength=len(y))
    rate_u = 1 / (0.5 * np.bincount(f_at, (t * most)[f_row], minlength=len(names))[:, None] + ridge)
    seen = np.bincount(l_at, (t * most)[l_row], minlength=n) if len(l_row) else np.zeros(n)
    rate_c = 1 / (0.5 * (seen.max() + seen[:, None] + seen[None]) + ridge)
    rate_s = 1 / (0.5 * np.bincount(s_kind, (t * most)[s_row] * s_times, minlength=len(AGREE)) + 1)
    now = [np.zeros((len(names), n)), np.zeros((n, n)), AGREE.copy()]
    look, momentum = [x.copy() for x in now], 1.0
    for _ in range(steps):
        grads = gradient(*look)
        new = [x - r * g for x, r, g in zip(look, (rate_u, rate_c, rate_s), grads, strict=True)]
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        if sum(float(((a - b) * g).sum()) for a, b, g in zip(new, now, grads, strict=True)) > 0:
            after = momentum = 1.0  # going uphill: restart the acceleration
        look = [a + (momentum - 1) / after * (a - b) for a, b in zip(new, now, strict=True)]
        now, momentum = new, after
    unary, chain, skip = now
    return SkipChain({f: unary[i] for f, i in names.items()}, chain, skip)


def learn_field(docs: DataFrame) -> SkipChain:
    """The field fitted on all tokens of all documents, the base spans being the labels.

    Equal examples are counted by Spark, so what reaches the driver grows with
    the number of different ones.  Labels, features and neighbours come from
    small fixed sets; only words don't, so a word in fewer than one in
    ``RAREST`` of an example's kind of all examples counts as no word.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        found: Counter = Counter()
        for text in texts:
            if TOKEN.search(text):
                found.update(examples_of(Graph(text, base_spans(text))))
        # one row per text is asked for; the slice's counts go with the first
        rows = [[(a, b, c) for (a, b), c in found.items()]] + [[] for _ in texts[1:]]
        return [struct_lists(rows, [("example", pa.string()), ("word", pa.string()), ("n", pa.int64())])]

    scratch = Scratch(docs.sparkSession)
    seen = map_texts(docs, run, "seen array<struct<example:string,word:string,n:long>>", module=__name__).select(F.inline("seen"))
    counted = scratch.table(seen.groupBy("example", "word").agg(F.sum("n").alias("n")), "field")
    total = counted.agg(F.sum("n")).first()[0] or 0
    word = F.when(F.col("n") >= total / RAREST, F.col("word")).otherwise("").alias("word")
    found = counted.select("example", word, "n").groupBy("example", "word").agg(F.sum("n").alias("n")).collect()
    scratch.drop("field")
    return fit_field(sorted((r["example"], r["word"], r["n"]) for r in found))


def added_spans(graph: Graph, p: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of tokens whose likeliest label is a kind of personal data; neighbours in a run with one label are one span."""
    out: list[tuple[str, int, int]] = []
    before = (-1, -1)
    for i, (s, e) in enumerate(graph.tokens):
        best = int(p[i].argmax())
        if graph.labels[i] >= 0 or best == OTHER or p[i, best] <= 0.5:
            before = (-1, -1)
            continue
        if before == (best, graph.runs[i]):
            out[-1] = (out[-1][0], out[-1][1], e)
        else:
            out.append((FIELD_KINDS[best], s, e))
        before = (best, graph.runs[i])
    return out


def pii_of(texts: list[str], field: SkipChain | None) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text, by start, then kind as listed: the patterns' spans and those the field adds."""
    spans = [base_spans(t) for t in texts]
    if field is not None:
        graphs = {i: Graph(t, spans[i]) for i, t in enumerate(texts) if TOKEN.search(t)}
        open_ = {i: g for i, g in graphs.items() if -1 in g.labels}
        for i, p in zip(open_, field.marginals(list(open_.values())), strict=True):
            spans[i] += added_spans(open_[i], p)
    return [sorted(x, key=lambda x: (x[1], KINDS.index(x[0]))) for x in spans]


def find_pii(docs: DataFrame, field: SkipChain | None = None) -> DataFrame:
    """doc_id, spans array<struct<kind,start,end>>: one row per row of ``docs`` (doc_id, text).

    Starts and ends are code points, ends exclusive; kinds ``like_*`` are the
    field's, which by default is fitted on all of ``docs``.  Null text counts
    as empty and has no spans.  Repeated rows give repeated results, a null
    doc_id stays null, and other columns are ignored.
    """
    packed = docs.sparkSession.sparkContext.broadcast(learn_field(docs) if field is None else field)

    def run(texts: list[str]) -> list[pa.Array]:
        return [struct_lists(pii_of(texts, packed.value), SPAN_FIELDS)]

    return map_texts(docs, run, "spans array<struct<kind:string,start:int,end:int>>", "doc_id", module=__name__)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or chain of overlapping spans, replaced by its first kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind.removeprefix('like_').upper()}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, field: SkipChain | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``[EMAIL]`` and the like; other columns unchanged.

    Null text stays null.  Every row is kept.
    """
    packed = docs.sparkSession.sparkContext.broadcast(learn_field(docs) if field is None else field)
    others = [c for c in docs.columns if c != "text"]
    mark = free_name("tidemark_null_text", docs.columns)

    def run(texts: list[str]) -> list[pa.Array]:
        return [pa.array([redacted(t, spans) for t, spans in zip(texts, pii_of(texts, packed.value), strict=True)], type=pa.string())]

    out = map_texts(docs.withColumn(mark, F.isnull("text")), run, "text string", *others, mark, module=__name__)
    return out.withColumn("text", F.when(~F.col(mark), F.col("text"))).select(*docs.columns)
