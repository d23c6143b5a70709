"""Operator 5: secret scans by patterns and a randomness test battery.

Three patterns find secrets of known form.  Other long runs of code letters
face a battery that asks whether they look drawn at random from the encoding
they seem to be written in: chi-squared uniformity over its alphabet, a runs
test about the alphabet's middle, and lag-1 serial correlation.

Passing alone would report short ordinary words, which the tests are too weak
to reject.  So each survivor also has a p-value against the null that it is
drawn from its own document's letters: 2 ** -(sum of log2 likelihood ratios),
valid by Markov's inequality, which falls with every further letter.  A
Benjamini-Hochberg step over the document's candidates bounds the share of
false reports; a short string thus needs a sharper contrast than a long one.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import map_texts, struct_lists

#: Kinds of the fixed patterns, in the order in which spans with one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run is taken whole, so a shorter one can't hold a match
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
VALUE = re.compile(r"[^=]{20,}")
#: Ways to part a value that no alphabet holds: base64url, base64, and base62 or narrower are left.
PARTS = tuple(re.compile(p) for p in (r"[^+/]{20,}", r"[^_-]{20,}", r"[^+/_-]{20,}"))

#: Encodings from the narrowest alphabet to the widest.
ALPHABETS = tuple(
    (name, {c: i for i, c in enumerate(letters)})
    for name, letters in (
        ("hex", "0123456789abcdef"),
        ("hex", "0123456789ABCDEF"),
        ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
        ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
        ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
        ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    )
)

#: Shares of letters in ordinary English text, in per mille (fixed values).
LETTER_SHARES = {
    "a": 82, "b": 15, "c": 28, "d": 43, "e": 127, "f": 22, "g": 20, "h": 61, "i": 70, "j": 2, "k": 8, "l": 40, "m": 24,
    "n": 67, "o": 75, "p": 19, "q": 1, "r": 60, "s": 63, "t": 91, "u": 28, "v": 10, "w": 24, "x": 2, "y": 20, "z": 1,
}
_PRIOR = np.full(128, 0.5)
for _c, _n in LETTER_SHARES.items():
    _PRIOR[ord(_c)] += _n / 2
    _PRIOR[ord(_c.upper())] += _n / 20


def encoding_of(token: str) -> tuple[str, dict[str, int]] | None:
    """The narrowest encoding that can have written the token; digits alone are none."""
    body = token.rstrip("=")
    letters = set(body)
    if not letters or letters <= set("0123456789"):
        return None
    return next(((name, a) for name, a in ALPHABETS if letters <= a.keys()), None)


def battery(body: str, alphabet: dict[str, int]) -> tuple[float, float, float]:
    """One p-value per test, under the null of independent uniform letters."""
    x = np.array([alphabet[c] for c in body], dtype=float)
    n, size = len(x), len(alphabet)
    counts = np.bincount(x.astype(int), minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    z_chi = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    high = x >= size / 2
    up, down = int(high.sum()), int(n - high.sum())
    if up and down:
        mean = 2 * up * down / n + 1
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        z_runs = (1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)
        p_runs = math.erfc(abs(z_runs) / math.sqrt(2))
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    spread = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / spread if spread else 1.0
    z_serial = (r + 1 / n) * math.sqrt(n)
    return 0.5 * math.erfc(z_chi / math.sqrt(2)), p_runs, math.erfc(abs(z_serial) / math.sqrt(2))


def evidence_bits(body: str, alphabet: dict[str, int], background: np.ndarray) -> float:
    """log2 of the likelihood of uniform letters over that of the background's letters."""
    own = background[[ord(c) for c in alphabet]]
    share = dict(zip(alphabet, own / own.sum(), strict=True))
    return sum(-math.log2(len(alphabet) * share[c]) for c in body)


def parts_of(run: str) -> list[tuple[int, int, str, dict[str, int]]]:
    """(start, end, letters, alphabet) of what one encoding can have written in a run of code letters.

    "=" is padding at the run's end and parts names from values elsewhere.  A
    value of no encoding is parted at "+" and "/", at "_" and "-", and at all
    four, so parts may overlap.
    """
    body = run.rstrip("=")
    found = {}
    for value in VALUE.finditer(body):
        spans = [value.span()]
        if not encoding_of(value[0]):
            spans = [m.span() for p in PARTS for m in p.finditer(body, *value.span())]
        for s, e in spans:
            if enc := encoding_of(body[s:e]):
                found[s, e] = (s, len(run) if e == len(body) else e, body[s:e], enc[1])
    return list(found.values())


def random_spans(text: str, taken: list[tuple[int, int]], alpha: float, fdr: float) -> list[tuple[int, int]]:
    """Spans that look random, apart from those that overlap ``taken``."""
    found = []
    for m in CANDIDATE.finditer(text):
        for s, e, body, alphabet in parts_of(m[0]):
            s, e = m.start() + s, m.start() + e
            if not any(a < e and s < b for a, b in taken):
                found.append((s, e, body, alphabet))
    if not found:
        return []
    data = np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    for s, e, _, _ in found:
        inside[s] += 1
        inside[e] -= 1
    background = _PRIOR + np.bincount(data[np.cumsum(inside[:-1]) == 0], minlength=128)[:128]
    scored = sorted(((min(1.0, 2.0 ** -min(1000.0, evidence_bits(body, a, background))), s, e, body, a) for s, e, body, a in found), key=lambda x: x[:3])
    keep = 0
    for i, (p, *_rest) in enumerate(scored, 1):
        if p <= fdr * i / len(scored):
            keep = i
    out: list[tuple[int, int]] = []
    for _, s, e, body, a in scored[:keep]:  # of overlapping parts the least likely one
        if not any(x < e and s < y for x, y in out) and 3 * min(battery(body, a)) >= alpha:
            out.append((s, e))
    return out


def secrets_of(text: str, alpha: float = 1e-3, fdr: float = 1e-3) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a text, by start, then kind as listed."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    spans += [("random", s, e) for s, e in random_spans(text, [x[1:] for x in spans], alpha, fdr)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


SPAN_FIELDS = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]


def find_secrets(docs: DataFrame, alpha: float = 1e-3, fdr: float = 1e-3) -> DataFrame:
    """doc_id, spans array<struct<kind,start,end>>: one row per row of ``docs`` (doc_id, text).

    Starts and ends are code points, ends exclusive.  Null text counts as
    empty and has no spans.  Repeated rows give repeated results, a null
    doc_id stays null, and other columns are ignored.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        return [struct_lists([secrets_of(t, alpha, fdr) for t in texts], SPAN_FIELDS)]

    return map_texts(docs, run, "spans array<struct<kind:string,start:int,end:int>>", "doc_id")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(found: DataFrame, base_kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> long for each base kind, base_sha256, spans string."""
    base = F.filter("spans", lambda s: s["kind"].isin(*base_kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base_kinds), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
