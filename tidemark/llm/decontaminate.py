"""Operator 1: benchmark decontamination with DataFrame functions only.

All windows of ten words of the benchmark's items form a hash set, which is
broadcast in blocks of a checked size.  Every word position of a document gives
the hash of its own window; a hit is verified by comparing the words.  The scan
is one code-generated stage without a shuffle: only hits, and one row per
document, leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words per window; a shorter item is one window.
WINDOW = 10
#: Bytes of windows in one broadcast; more windows are scanned for in several blocks.
BLOCK_BYTES = 32 << 20
#: Contaminated ids that are broadcast to drop their documents; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def words(text: Column) -> Column:
    """Lower-cased words: runs of digits, ASCII letters and non-ASCII characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), GAP), "")


def windows_of(benchmark: DataFrame) -> DataFrame:
    """length, hash, window array<string>, items array<bigint>: the distinct windows of the items; an item without id has windows, but is in no ``items``."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(WINDOW), F.size("w"))
    at = items.select("item_id", "w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("p"))
    cut = at.select("item_id", "length", F.slice("w", F.col("p"), F.col("length")).alias("window"))
    return cut.groupBy("length", F.xxhash64("window").alias("hash"), "window").agg(F.collect_set("item_id").alias("items"))


def _hits(docs: DataFrame, benchmark: DataFrame, all_documents: bool) -> DataFrame:
    """doc_id, text_hash, n_words, first, p, length, items: verified hits, and with ``all_documents`` one row (``first``) per document."""
    scratch = Scratch(docs.sparkSession)
    windows = scratch.table(windows_of(benchmark), "windows")
    size = windows.agg(F.count("*"), F.sum(F.length(F.array_join("window", " ")) + 16 * F.size("window") + 8 * F.size("items") + 64)).first()
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect()) or [WINDOW]
    blocks = max(1, -(-(size[1] or 0) // BLOCK_BYTES))
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    source = source.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "w", F.posexplode_outer("w").alias("p", "word"))

    def key(n: int) -> Column:
        return F.xxhash64(F.slice("w", F.col("p") + 1, n))

    if len(lengths) == 1:
        source = source.withColumns({"length": F.lit(lengths[0]), "hash": key(lengths[0])})
    else:
        source = source.withColumn("k", F.explode(F.array(*[F.struct(F.lit(n).alias("length"), key(n).alias("hash")) for n in lengths])))
        source = source.withColumns({"length": F.col("k.length"), "hash": F.col("k.hash")})
    out = None
    for block in range(blocks):
        part = windows.select(F.col("length").alias("b_length"), F.col("hash").alias("b_hash"), "window", "items")
        if blocks > 1:
            part = part.where(F.pmod(F.col("b_hash"), F.lit(blocks)) == block)
        same = (F.col("hash") == F.col("b_hash")) & (F.slice("w", F.col("p") + 1, F.col("length")) == F.col("window"))
        keep = all_documents and block == 0
        found = source.join(F.broadcast(part), same, "left" if keep else "inner")
        first = (F.coalesce("p", F.lit(0)) == 0) & (F.col("length") == lengths[0]) if keep else F.lit(False)
        if keep:
            found = found.where(first | F.col("items").isNotNull())
        found = found.select("doc_id", "text_hash", "n_words", first.alias("first"), "p", "length", "items")
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words long, hits array<struct<start,end>>, items array<bigint>.

    One row per row of ``docs`` (doc_id, text).  ``hits`` are word positions,
    ends exclusive, one per occurrence of a window, in order.  Null and empty
    texts have no words and no hits.  Rows with the same doc_id count by
    themselves unless their texts agree too, and then each still has its own,
    equal, row; a null doc_id stays null.  Items without words take no
    part; the windows of an item without id are hits, but only ids are in
    ``items``; an item listed twice counts once.  Other columns are ignored.
    """
    hit = F.col("items").isNotNull()
    found = _hits(docs, benchmark, True).groupBy("doc_id", "text_hash", "n_words").agg(
        F.sum(F.col("first").cast("int")).alias("copies"),
        F.array_sort(F.collect_set(F.when(hit, F.struct(F.col("p").alias("start"), (F.col("p") + F.col("length")).alias("end"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_words", "hits", "items")


def covered(hits: Column) -> Column:
    """Number of positions in the union of sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], x["end"]).alias("end"))

    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of what ``contamination`` returns."""
    named = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which a window occurs; columns and other rows unchanged.

    The ids of hit documents are broadcast if there are at most
    ``BROADCAST_IDS`` of them, else the tables are joined by a shuffle.
    """
    scratch = Scratch(docs.sparkSession)
    ids = scratch.table(_hits(docs, benchmark, False).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct(), "hit")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, docs["doc_id"].eqNullSafe(ids["hit_id"]) & (F.xxhash64(docs["text"]) == ids["hit_hash"]), "left_anti")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS p FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT l FROM item_windows
), doc_windows AS (
  SELECT doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') AS k
  FROM (SELECT doc_id, w, l, unnest(range(1, CAST(len(w) - l + 2 AS BIGINT))) AS p FROM d CROSS JOIN lengths WHERE len(w) >= l)
), hits AS (
  SELECT doc_id, p, doc_windows.l, item_id FROM doc_windows JOIN item_windows ON doc_windows.k = item_windows.k AND doc_windows.l = item_windows.l
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + l)) AS q FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
