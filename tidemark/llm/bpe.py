"""Operator 7: byte-level BPE encoding and decoding by corpus-level merge replay.

Distinct words lie in one array of symbols.  An inverted index maps the rank of
each applicable merge to the positions of its left symbols.  Merges are replayed
in rank order over all words at once, and a merge looks again only at the two
neighbours of the symbol it made.

The words of all documents are counted first.  Those that recur most across the
corpus, as many as ``TABLE_BYTES`` hold, are replayed once into a table of packed
arrays, which is broadcast.  A slice of documents looks its distinct words up in
that table, and replays together those that aren't there.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch, buffers, cut, hold, map_texts, release, string_hashes

#: Words of a text that are in work at once, so that memory doesn't follow the longest text.
AT_ONCE = 400_000
#: Words that are replayed together.
REPLAYED = 20_000
#: Words counted by a task before it sends their counts on.
COUNTED = 200_000
#: Bytes of the corpus's table of replayed words, and what a word takes there beside its letters.
TABLE_BYTES, WORD_BYTES = 16 << 20, 40


class MergeReplay:
    """Encoder and decoder for one rank file's content (lines of base64 token, rank)."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.token = {int(r): base64.b64decode(t) for t, r in map(bytes.split, ranks.splitlines()) if t}
        self.rank = {t: r for r, t in self.token.items()}
        self.find = regex.compile(pattern)
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        # merges[a][b] is the rank of the token that symbols a and b make together
        self.merges: list[dict[int, int]] = [{} for _ in range(max(self.token, default=0) + 1)]
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                a = self.rank.get(token[:i])
                if a is not None:
                    b = self.rank.get(token[i:])
                    if b is not None:
                        self.merges[a][b] = rank
        self.byte_pairs = np.array([[self.rank.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int64)
        self.whole: dict[str, int] = {}
        for token, rank in self.rank.items():
            try:
                self.whole[token.decode()] = rank
            except UnicodeDecodeError:
                continue
        last = max(self.token, default=-1) + 1
        self.spelt = Packed([self.token.get(r, b"") for r in range(last)])
        self.printed = Packed([b"%d," % r for r in range(last)])
        self.table = no_table()

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers; all words are merged together, in rank order."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        n = len(data)
        symbols = self.byte[data]
        if (symbols < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        following, preceding = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[starts + sizes - 1] = -1
        preceding[starts] = -1
        # the inverted index: rank of an applicable merge -> positions of its left symbols
        ranks = np.full(n, -1, dtype=np.int64)
        ranks[:-1] = self.byte_pairs[data[:-1], data[1:]]
        ranks[following < 0] = -1
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        distinct, cuts = np.unique(ranks[at], return_index=True)
        listed = at.tolist()
        bounds = [*cuts.tolist(), len(listed)]
        index = {r: listed[bounds[i] : bounds[i + 1]] for i, r in enumerate(distinct.tolist())}
        heap = list(index)
        heapq.heapify(heap)
        symbol, after, before, merges, push = symbols.tolist(), following.tolist(), preceding.tolist(), self.merges, heapq.heappush
        while heap:
            rank = heapq.heappop(heap)
            positions = index.pop(rank)
            positions.sort()
            of_new = merges[rank]
            for k, p in enumerate(positions):
                q = after[p]
                a = symbol[p]
                if a < 0 or q < 0 or merges[a].get(symbol[q]) != rank:
                    continue  # a neighbour's merge used one of the two symbols
                far = after[q]
                symbol[p], symbol[q], after[p] = rank, -1, far
                lower = False
                if far >= 0:
                    before[far] = p
                    r = of_new.get(symbol[far])
                    if r is not None:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            push(heap, r)
                        lower = r < rank
                left = before[p]
                if left >= 0:
                    r = merges[symbol[left]].get(rank)
                    if r is not None:
                        if r in index:
                            index[r].append(left)
                        else:
                            index[r] = [left]
                            push(heap, r)
                        lower = lower or r < rank
                if lower and k + 1 < len(positions):  # the new pair comes first; the others wait
                    if rank not in index:
                        push(heap, rank)
                    index.setdefault(rank, []).extend(positions[k + 1 :])
                    break
        left_over = np.array(symbol, dtype="<i4")
        alive = left_over >= 0
        raw = left_over[alive].tobytes()
        ends = (4 * np.cumsum(np.add.reduceat(alive, starts, dtype=np.int64))).tolist() if len(words) else []
        return [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def replay_all(self, words: list[str]) -> list[bytes]:
        """``replay`` a part of the words at a time."""
        out: list[bytes] = []
        for i in range(0, len(words), REPLAYED):
            out += self.replay([w.encode() for w in words[i : i + REPLAYED]])
        return out

    def parts(self, text: str) -> Iterator[list[str]]:
        if len(text) <= 4 * AT_ONCE:
            yield self.find.findall(text)
        else:
            found = self.find.finditer(text)
            while part := [m.group() for m in islice(found, AT_ONCE)]:
                yield part

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and how many each word has."""
        coded = pa.array(words, type=pa.string()).dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        hashes, known, starts, ids = self.table
        at = np.searchsorted(hashes, string_hashes(distinct))
        at[at == len(hashes)] = 0
        there = pc.equal(distinct, known.take(pa.array(at))).to_numpy(zero_copy_only=False) if len(hashes) else np.zeros(len(distinct), dtype=bool)
        made: list[np.ndarray] = [ids[starts[i] : starts[i + 1]] for i in at.tolist()] if len(hashes) else [ids] * len(distinct)
        hard, spelt = [], []
        for i in np.flatnonzero(~there).tolist():
            w = distinct[i].as_py()
            whole = self.whole.get(w)
            if whole is not None:
                made[i] = np.array([whole], dtype="<i4")
            else:
                hard.append(i)
                spelt.append(w)
        for i, raw in zip(hard, self.replay_all(spelt), strict=True):
            made[i] = np.frombuffer(raw, dtype="<i4")
        packed = Packed([])
        packed.size = np.array([len(x) for x in made], dtype=np.int64)
        packed.start = np.cumsum(packed.size) - packed.size
        packed.flat = np.concatenate(made) if made else ids
        return packed.take(codes), packed.size[codes]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian 32-bit integers."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, int]] = []
        words: list[str] = []

        def flush() -> None:
            if words:
                ids, sizes = self.ids_of(words)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                at = 0
                for i, n in waiting:
                    out[i].append(ids[ends[at] : ends[at + n]])
                    at += n
            waiting.clear()
            words.clear()

        for i, text in enumerate(texts):
            for part in self.parts(text):
                waiting.append((i, len(part)))
                words += part
                if len(words) >= AT_ONCE:
                    flush()
        flush()
        return [np.concatenate(x) if x else np.zeros(0, dtype="<i4") for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.spelt.take(ids).tobytes()

    def hard_words(self, texts: list[str]) -> set[str]:
        """The distinct words of the texts that are no token themselves."""
        found: set[str] = set()
        for text in texts:
            for part in self.parts(text):
                found.update(part)
        return found.difference(self.whole)


class Packed:
    """Rows of bytes or ids in one array, taken by number without Python objects."""

    def __init__(self, rows: list[bytes]):
        self.size = np.array([len(x) for x in rows], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(rows), dtype=np.uint8)

    def take(self, at: np.ndarray) -> np.ndarray:
        """The rows ``at``, one after the other."""
        out = []
        for i in range(0, len(at), 1 << 18):
            some = at[i : i + (1 << 18)]
            size = self.size[some]
            shift = np.repeat(self.start[some] - (np.cumsum(size) - size), size)
            out.append(self.flat[shift + np.arange(len(shift))])
        return np.concatenate(out) if out else self.flat[:0]


def no_table() -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    return np.zeros(0, dtype=np.uint64), pa.array([], pa.string()), np.zeros(1, dtype=np.int64), np.zeros(0, dtype="<i4")


_coders: dict[tuple[str, str], MergeReplay] = {}


def replayer(ranks, digest: str, pattern: str) -> MergeReplay:
    """One encoder per worker process; ``ranks`` is the broadcast of the rank file, ``digest`` tells files apart."""
    hold(__name__, _coders.clear)
    if (digest, pattern) not in _coders:
        _coders.clear()
        _coders[digest, pattern] = MergeReplay(ranks.value, pattern)
    return _coders[digest, pattern]


def word_table(docs: DataFrame, ranks, digest: str, pattern: str) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Hashes, words, and starts and ids of the corpus's most widespread words, in the order of hashes.

    A word counts once for each slice of documents that it is in.  Words of one
    slice only are left out; of the others, counts are halved into classes, and
    the most frequent classes that fit ``TABLE_BYTES`` are taken.
    """
    scratch = Scratch(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(but=__name__)
        coder = replayer(ranks, digest, pattern)
        seen: Counter = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for part in cut(batch):
                seen.update(coder.hard_words(part.column("text").to_pylist()))
                if len(seen) >= COUNTED:
                    yield send()
        yield send()

    def replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replayer(ranks, digest, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, REPLAYED):
                words = batch.column("word").slice(at, REPLAYED)
                yield pa.RecordBatch.from_arrays([words, pa.array(coder.replay_all(words.to_pylist()), pa.binary())], names=["word", "ids"])

    words = docs.select("text").where("text is not null").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = scratch.table(words.withColumn("class", F.floor(F.log2("n")).cast("int")), "words")
    sizes = counted.groupBy("class").agg(F.sum(F.octet_length("word") + WORD_BYTES).alias("size")).collect()
    least, room = 64, TABLE_BYTES
    for r in sorted(sizes, key=lambda r: -r["class"]):
        room -= r["size"]
        if room < 0:
            break
        least = r["class"]
    held = counted.where(F.col("class") >= least).select("word").mapInArrow(replay, "word string, ids binary").toArrow()
    scratch.drop("words")
    if not held.num_rows:
        return no_table()
    held = held.combine_chunks()
    known, ids = held["word"].chunk(0).cast(pa.string()), held["ids"].chunk(0).cast(pa.large_binary())
    hashes = string_hashes(known)
    order = np.argsort(hashes, kind="stable")
    known, ids = known.take(pa.array(order)), ids.take(pa.array(order))
    return hashes[order], known, buffers(ids)[0].astype(np.int64) // 4, np.frombuffer(b"".join(ids.to_pylist()), dtype="<i4")


def _map_coded(docs: DataFrame, ranks_path: str, pattern: str, made, fields: str) -> DataFrame:
    """doc_id and ``fields``, which ``made(coder, texts)`` gives as Arrow arrays.  The driver reads the rank file; executors need no access to it."""
    with open(ranks_path, "rb") as f:
        content = f.read()
    context = docs.sparkSession.sparkContext
    ranks, digest = context.broadcast(content), hashlib.sha256(content).hexdigest()
    table = context.broadcast(word_table(docs, ranks, digest, pattern))

    def run(texts: list[str]) -> list[pa.Array]:
        coder = replayer(ranks, digest, pattern)
        coder.table = table.value
        return made(coder, texts)

    return map_texts(docs, run, fields, "doc_id", module=__name__)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary: one row per row of ``docs`` (doc_id, text).

    Null text counts as empty and has no ids.  Repeated rows give repeated
    results, a null doc_id stays null, an empty table gives an empty one, and
    other columns of ``docs`` are ignored.
    """

    def made(coder: MergeReplay, texts: list[str]) -> list[pa.Array]:
        ids = coder.encode(texts)
        offsets = np.zeros(len(ids) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False))), pa.array([coder.decode(x) for x in ids], type=pa.binary())]

    return _map_coded(docs, ranks_path, pattern, made, "ids array<int>, decoded binary")


def encoded_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``encode_decode`` returns, hashed where it is made."""

    def made(coder: MergeReplay, texts: list[str]) -> list[pa.Array]:
        ids = coder.encode(texts)
        return [
            pa.array([len(x) for x in ids], type=pa.int64()),
            pa.array([hashlib.sha256(coder.printed.take(x)[:-1].tobytes()).hexdigest() for x in ids], type=pa.string()),
            pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], type=pa.string()),
        ]

    return _map_coded(docs, ranks_path, pattern, made, "n_tokens long, ids_sha256 string, decoded_sha256 string")
