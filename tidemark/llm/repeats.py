"""Operator 10: removal of repeated passages by repeated-phrase automata.

A window is a run of consecutive words.  Its phrase is the eight-word gram of
least hash in it, so equal windows have equal phrases and only one gram in
about seven is ever a phrase.  Passes:

1. Exact copies of a text are set aside: all their windows start earlier.
2. Phrases are counted over the corpus; those that occur once are done with.
   The others are confirmed, and go to a shard by the section of the document
   in which they occur first, so that a passage's phrases share a shard.
3. The corpus's confirmed phrases are spelt out from their first documents, one
   character per word, and each shard is compiled into an Aho-Corasick
   automaton of a bounded number of phrases.
4. Every document is streamed through each shard that may apply to it: those
   that one of its own phrases belongs to.  Nothing but the automata tells where
   phrases occur; windows whose phrase was found are the only ones that go on.
5. Each slice sends on the first occurrence of each of its windows; the corpus
   minimum per window tells which occurrences come first.
6. Words covered by any other occurrence are removed.

The automata only narrow the windows down; equality is decided by 64-bit
hashes of whole windows.  What is shuffled is at most one row per phrase, the
texts once per shard that applies, and one row per repeated window and slice;
hot windows are reduced before every shuffle, and a shard that a large share of
all documents is streamed through is compiled in several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BROADCAST_BYTES, Scratch, buffers, copies_of, cut, gram_hashes, map_texts, small, sweep, unique_ids, word_hashes

#: Words per phrase.
GRAM = 8
#: Confirmed phrases of a shard, about; phrases that occur first within so many words of one document share one.
SHARD_PHRASES, SECTION = 100_000, 4_096
#: Phrases, confirmed or not, of the documents that one task streams through a shard, about.
SHARD_LOAD = 1_000_000
#: Different characters that words are spelt with in an automaton.
LETTERS = 256


def phrases(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for each window the position of its phrase: the leftmost of the least hashes."""
    grams = gram_hashes(words, GRAM)
    span = window - GRAM + 1
    if len(grams) < span:
        return grams, np.zeros(0, dtype=np.int64)
    return grams, sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), type=kind))


def _words(texts: list[str], lower: bool = False) -> Iterator[np.ndarray]:
    offsets, data = buffers(pa.array(texts, type=pa.large_string()))
    for i in range(len(texts)):
        yield word_hashes(data[offsets[i] : offsets[i + 1]], lower)[0]


def _sketch(window: int):
    def run(texts: list[str]) -> list[pa.Array]:
        found, places = [], []
        for words in _words(texts):
            grams, at = phrases(words, window)
            at = np.unique(at)
            found.append(grams[at].view(np.int64))
            places.append(at)
        return [_lists(found, pa.int64()), _lists(places, pa.int32())]

    return run


def automaton(phrases: Iterable[str]):
    """A compiled shard that finds the given strings; None without any."""
    shard = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        shard.add_word(p)
    if not len(shard):
        return None
    shard.make_automaton()
    return shard


def letters(words: np.ndarray) -> str:
    """One character per word, by hash.

    The alphabet is small because an automaton looks a node's branches through
    one by one.  A false hit, two phrases of the same eight characters, lets a
    window go on that is then found not to repeat.
    """
    return (words % np.uint64(LETTERS) + np.uint64(0x100)).astype("<u4").tobytes().decode("utf-32-le")


def located(shard, words: np.ndarray) -> np.ndarray:
    """Which gram positions hold one of the shard's phrases."""
    hit = np.zeros(max(0, len(words) - GRAM + 1), dtype=bool)
    if shard is not None:
        ends = [end for end, _ in shard.iter(letters(words))]
        hit[np.array(ends, dtype=np.int64) - (GRAM - 1)] = True
    return hit


def _spelt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, phrase): the letters of the phrases that occur first in a document."""
    for batch in batches:
        for part in cut(batch):
            shards, found = [], []
            for words, own in zip(_words(part.column("text").to_pylist()), part.column("own").to_pylist(), strict=True):
                text = letters(words)
                for x in own:
                    shards.append(x["shard"])
                    found.append(text[x["place"] : x["place"] + GRAM])
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(found, pa.string())], names=["shard", "phrase"])


def _stream(window: int, compiled: Callable):
    """Rows (doc_id, again, hashes, starts): starts known to be repeated, and the slice's first occurrences.

    Takes rows sorted by (shard, part): a shard's phrases, then its documents.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, phrases_here, shard = None, [], None
        for batch in batches:
            keys = list(zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist(), strict=True))
            is_phrase = batch.column("phrase").is_valid().to_numpy(zero_copy_only=False)
            edges = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            for low, high in zip(edges, edges[1:], strict=False):
                if keys[low] != group:
                    group, phrases_here, shard = keys[low], [], None
                n = int(is_phrase[low:high].sum())
                phrases_here += batch.column("phrase").slice(low, n).to_pylist()
                if n < high - low:
                    if phrases_here:
                        shard, phrases_here = compiled(phrases_here), []
                    yield from search(shard, batch.slice(low + n, high - low - n))

    def search(shard, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in cut(batch):
            ids = part.column("doc_id").to_numpy()
            found, at, owner = [], [], []
            for i, w in enumerate(_words(part.column("text").to_pylist())):
                hit = located(shard, w)
                if hit.any():
                    _, place = phrases(w, window)
                    starts = np.flatnonzero(hit[place])
                    if len(starts):
                        found.append(gram_hashes(w, window)[starts])
                        at.append(starts)
                        owner.append(np.full(len(starts), i))
            if not found:
                continue
            h, s, o = np.concatenate(found), np.concatenate(at), np.concatenate(owner)
            order = np.lexsort((s, ids[o], h))
            first = np.zeros(len(h), dtype=bool)
            first[order[np.flatnonzero(np.diff(h[order], prepend=~h[order][:1]))]] = True
            bounds = np.searchsorted(o, np.arange(len(ids) + 1))
            rows = [np.arange(bounds[i], bounds[i + 1]) for i in range(len(ids))]
            keep = [i for i, r in enumerate(rows) if len(r)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[keep], type=pa.int64()), _lists([s[rows[i]][~first[rows[i]]] for i in keep], pa.int32()),
                    _lists([h[rows[i]][first[rows[i]]].view(np.int64) for i in keep], pa.int64()), _lists([s[rows[i]][first[rows[i]]] for i in keep], pa.int32()),
                ],
                names=["doc_id", "again", "hashes", "starts"],
            )

    return run


def _spans(window: int):
    """Merge window starts to spans of words: start, end, start, end ..."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts in batch.column("starts").to_pylist():
                s = np.unique(np.array(starts, dtype=np.int64))
                new = np.flatnonzero(np.diff(s, prepend=s[:1] - window - 1) > window)
                ends = s[np.append(new[1:], len(s)) - 1] + window
                out.append(np.stack((s[new], ends), axis=1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(out, pa.int32())], names=["doc_id", "spans"])

    return run


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in cut(batch):
            total, gone, kept = [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                total.append(len(words))
                if spans:
                    at, left = 0, []
                    for s, e in zip(spans[::2], spans[1::2], strict=True):
                        left += words[at:s]
                        at = e
                    words = left + words[at:]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = 20, compiled: Callable = automaton) -> DataFrame:
    """doc_id, n_words long, n_removed long, kept string: one row per row of ``docs`` (doc_id, text).

    Words are runs without ASCII white space.  A word goes if it is covered
    by a window whose words also start earlier: in a document of smaller
    doc_id, or earlier in its own.  Windows are judged on the input.  Null
    and empty texts have no words.  A null doc_id comes after all others;
    documents of one doc_id but different texts come in the order of a hash
    of the text; rows equal in both are one document and each has its result.
    Other columns are ignored.  ``compiled`` makes a shard of phrases.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs, restore, _ = unique_ids(docs, scratch)
    text = F.coalesce("text", F.lit("")).alias("text")
    copies = copies_of(docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key")), ["key"], scratch, "copies")
    firsts = docs.select("doc_id", text).join(small(copies.select("doc_id")), "doc_id", "left_anti")

    sketch = scratch.table(map_texts(firsts, _sketch(window), "phrases array<long>, places array<int>", "doc_id"), "sketch")
    each = sketch.select("doc_id", F.explode(F.arrays_zip(F.col("phrases").alias("phrase"), F.col("places").alias("place"))).alias("x")).select("doc_id", "x.phrase", "x.place")
    # of a phrase several times in its first document any one place will do; once written it stays the same
    counted = each.groupBy("phrase").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min_by("place", "doc_id").alias("at"))
    confirmed = scratch.table(counted.where("n > 1").drop("n"), "confirmed")
    shards = max(1, -(-confirmed.count() // SHARD_PHRASES))
    shard = F.pmod(F.xxhash64("first", F.floor(F.col("at") / SECTION)), F.lit(shards)).alias("shard")
    sweep(spark)
    met = each.join(confirmed, "phrase").select("doc_id", "place", shard, (F.col("doc_id") == F.col("first")) & (F.col("place") == F.col("at")))
    met = met.toDF("doc_id", "place", "shard", "own")
    routes = met.groupBy("doc_id").agg(F.collect_set("shard").alias("shards"), F.collect_list(F.when(F.col("own"), F.struct("place", "shard"))).alias("own"))
    routes = scratch.table(routes.join(sketch.select("doc_id", F.size("phrases").alias("weight")), "doc_id"), "routes")
    scratch.drop("sketch", "confirmed")
    sweep(spark)

    size = routes.agg(F.sum(8 * F.size("shards") + 12 * F.size("own") + 64)).first()[0] or 0
    routed = firsts.join(F.broadcast(routes) if size <= BROADCAST_BYTES else routes, "doc_id")
    spelt = scratch.table(routed.where("size(own) > 0").select("text", "own").mapInArrow(_spelt, "shard long, phrase string"), "phrases")
    # a shard that very many documents may hold phrases of is compiled in several tasks, each for a part of them
    load = routes.select(F.explode("shards").alias("shard"), "weight").groupBy("shard").agg(F.ceil(F.sum("weight") / SHARD_LOAD).cast("int").alias("parts"))
    load = scratch.table(load, "load")
    held = spelt.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("doc_id"), "phrase", F.lit("").alias("text"))
    sought = routed.select("doc_id", F.explode("shards").alias("shard"), "text").join(small(load), "shard")
    sought = sought.select("shard", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), "doc_id", F.lit(None).cast("string").alias("phrase"), "text")
    work = held.unionByName(sought).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("phrase").isNull())
    windows = scratch.table(work.mapInArrow(_stream(window, compiled), "doc_id long, again array<int>, hashes array<long>, starts array<int>"), "windows")
    scratch.drop("phrases", "load")
    sweep(spark)
    sent = windows.select("doc_id", F.explode(F.arrays_zip(F.col("hashes").alias("hash"), F.col("starts").alias("start"))).alias("x")).select("doc_id", "x.hash", "x.start")
    # a window's phrase is in one shard and the document in one part of it, so the id tells the occurrence
    least = sent.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = scratch.table(least.where("least < most").select("hash", "least"), "least")
    sweep(spark)
    later = sent.join(least, "hash").where("doc_id <> least")
    starts = later.groupBy("doc_id").agg(F.collect_list("start").alias("starts")).unionByName(windows.where("size(again) > 0").select("doc_id", F.col("again").alias("starts")))
    starts = starts.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    spans = scratch.table(starts.mapInArrow(_spans(window), "doc_id long, spans array<int>"), "spans")
    scratch.drop("windows", "least", "routes")
    sweep(spark)

    size = spans.agg(F.sum(F.size("spans") * 4 + 64)).first()[0] or 0
    done = firsts.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, "doc_id", "left")
    done = done.select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")
    # a copy has no window of its own, so it keeps all words if it has fewer than a window's
    others = docs.select("doc_id", text).join(small(copies.select("doc_id")), "doc_id", "left_semi")
    whole = others.withColumn("spans", F.lit(None).cast("array<int>")).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")
    long = F.col("n_words") >= window
    whole = whole.select("doc_id", "n_words", F.when(long, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"), F.when(long, "").otherwise(F.col("kept")).alias("kept"))
    return restore(done.unionByName(whole))


def digests(result: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of what ``remove_repeats`` returns."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 18 AS BIGINT))) AS p FROM d WHERE len(w) >= 20)
), seen AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM win
), gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM seen WHERE n > 1
), removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS q FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.q) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.q = gone.q WHERE gone.q IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN removed ON d.doc_id = removed.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
