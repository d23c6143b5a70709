"""Operator 9: exact top-k inner products over a bit-sliced index.

Components become integers, are shifted to be non-negative, and each bit of
each attribute is one bitmap over a block's rows.  A query's score is a sum of
its attributes' slices, shifted by the binary digits of its own integers, less
such a sum for its negative integers.  Carry-save adders over bitmaps reduce all
those slices to one bitmap per bit of the score, and the top rows are selected
from the most significant bitmap downward.  Rows tied at the boundary are
resolved by vec_id.  Nothing is rounded or capped, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch

#: Rows per block of the index; a block's bitmaps stay in a processor's cache.
BLOCK_ROWS = 16_384
#: Bytes of queries in one broadcast; further queries are answered in further passes.
QUERY_BYTES = 32 << 20
#: Integers below this magnitude are handled as machine integers, others as Python's.
MACHINE = 1 << 62


def usable(vectors: DataFrame) -> DataFrame:
    """row, vec_id, x array<double>: one row per vector that takes part, numbered.

    Null ids, null or empty vectors, and vectors that hold null or non-finite
    components take no part.  Rows of one vec_id all count.  The numbers stay
    the same only once the table is written.
    """
    fine = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    return rows.where(fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").alias("x"))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where all fit, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not x.size or np.abs(scaled).max() < MACHINE:
        return scaled.astype(np.int64)
    # a double so large that its multiple overflows is an integer itself
    whole = [int(s) if np.isfinite(s) else int(v) * scale for s, v in zip(scaled.ravel().tolist(), x.ravel().tolist(), strict=True)]
    out = np.empty(x.size, dtype=object)
    out[:] = whole
    return out.reshape(x.shape)


class BitSliced:
    """Bitmaps of a block's rows; ``x`` are the integers [rows, attributes]."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.numbers, self.ids, x = rows[order], ids[order], x[order]
        self.rows = len(ids)
        self.words = -(-self.rows // 64)
        self.low: list[int] = []
        #: for each attribute (bit, bitmap) of the bits that any row has
        self.slices: list[list[tuple[int, np.ndarray]]] = []
        for j in range(x.shape[1]):
            column = x[:, j]
            low, high = int(column.min()), int(column.max())
            self.low.append(low)
            if high - low < 1 << 63:
                shifted = (column - low).astype("<u8") if column.dtype == object else column.astype(np.uint64) - np.uint64(low % 2**64)
                raw = shifted.astype("<u8").view(np.uint8).reshape(self.rows, 8)
            else:
                size = ((high - low).bit_length() + 7) // 8
                raw = np.frombuffer(b"".join((int(v) - low).to_bytes(size, "little") for v in column), dtype=np.uint8).reshape(self.rows, size)
            raw = raw[:, : ((high - low).bit_length() + 7) // 8]
            bits = np.unpackbits(raw, axis=1, bitorder="little").T
            self.slices.append([(b, self._pack(bits[b : b + 1])) for b in np.flatnonzero(bits.any(axis=1)).tolist()])
        self.all = self._pack(np.ones((1, self.rows), dtype=np.uint8))[0]

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flags), self.words * 64), dtype=np.uint8)
        out[:, : self.rows] = flags
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def _added(self, columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
        """One bitmap per bit of the sum, least first, of bitmaps by bit."""
        out: list[np.ndarray] = []
        carry: list[np.ndarray] = []
        last = max(columns, default=-1)
        k = 0
        while k <= last or carry:
            parts = carry + columns.get(k, [])
            now = np.concatenate(parts) if parts else np.zeros((1, self.words), dtype=np.uint64)
            carry = []
            while len(now) > 1:
                if len(now) == 2:
                    carry.append(now[:1] & now[1:])
                    now = now[:1] ^ now[1:]
                else:
                    m = len(now) // 3
                    a, b, c = now[:m], now[m : 2 * m], now[2 * m : 3 * m]
                    both = a ^ b
                    carry.append((a & b) | (c & both))
                    now = np.concatenate((both ^ c, now[3 * m :]))
            out.append(now[0])
            k += 1
        return out

    def sums(self, weights: list[int]) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the score's bits, least first, and the constant to add."""
        more: dict[int, list[np.ndarray]] = {}
        less: dict[int, list[np.ndarray]] = {}
        constant = 0
        for w, low, slices in zip(weights, self.low, self.slices, strict=True):
            constant += w * low
            columns, w = (less if w < 0 else more), abs(w)
            while w:
                k = (w & -w).bit_length() - 1
                w &= w - 1
                for b, bitmap in slices:
                    columns.setdefault(k + b, []).append(bitmap)
        if not less:
            return self._added(more), constant
        # a - b = a + (top - b) - top, where top - b is the complement of b
        taken = self._added(less)
        for k, bitmap in enumerate(taken):
            more.setdefault(k, []).append(~bitmap[None])
        return self._added(more), constant - ((1 << len(taken)) - 1)

    def top(self, weights: list[int], k: int, own: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but the one numbered ``own``, ties to smaller ids, in no order."""
        sums, constant = self.sums(weights)
        rest = self.all.copy()
        for at in np.flatnonzero(self.numbers == own).tolist():
            rest[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        sure = np.zeros_like(rest)
        n_sure = 0
        for level in reversed(sums):
            high = rest & level
            n = int(np.bitwise_count(high).sum())
            if n_sure + n <= k:
                sure |= high
                n_sure += n
                rest &= ~level
                if n_sure == k:
                    break
            else:
                rest = high
        rows = self._rows(sure)
        if n_sure < k:  # all that are left are equal: the smallest ids are the first rows
            rows = np.concatenate((rows, self._rows(rest)[: k - n_sure]))
        out = []
        for r in rows.tolist():
            w, b = r >> 6, np.uint64(r & 63)
            score = sum(int(level[w] >> b & np.uint64(1)) << j for j, level in enumerate(sums)) + constant
            out.append((int(self.ids[r]), score))
        return out

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.rows])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows; a shorter one is filled with zeros."""
    out = np.zeros((len(column), width))
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), lengths)
    starts = np.cumsum(lengths) - lengths
    out[rows, np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    return out


def _lists(table: pa.Table) -> pa.Array:
    column = table["x"].combine_chunks() if table.num_rows else pa.array([], type=pa.list_(pa.float64()))
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id long, rank int, vec_id long, score long; see ``usable`` for what takes part.

    Queries are the rows whose vec_id is divisible by ``every``; candidates
    are all rows but the query's own, so that rows of one vec_id meet each
    other.  Vectors of different lengths are compared as if the shorter one
    ended in zeros.  Ties go to the smaller vec_id; a query with fewer
    candidates than ``k`` has fewer rows.  A score among a query's ``k`` best
    that no long can hold is an error when the rows are read.  An empty table
    gives no rows.

    The driver holds one pass's queries, at most ``QUERY_BYTES`` of them.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.table(usable(vectors), "rows")
    width, n_queries = rows.agg(F.max(F.size("x")), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    width = width or 1
    per_pass = max(1, QUERY_BYTES // (8 * width + 16))
    passes = max(1, -(-n_queries // per_pass))
    queries = rows.where(F.col("vec_id") % every == 0)
    out = None
    for i in range(passes):
        mine = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == i)
        # hashing spreads the queries evenly, so a pass collects about per_pass rows
        held = mine.toArrow()
        packed = vectors.sparkSession.sparkContext.broadcast((held["row"].to_numpy(), held["vec_id"].to_numpy(), _matrix(_lists(held), width)))
        best = rows.mapInArrow(_searcher(packed, width, k, scale), "row long, query_id long, vec_id long, over int, score long")
        out = best if out is None else out.unionByName(best)
    order = Window.partitionBy("row").orderBy(F.col("over").desc(), F.col("score").desc(), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score among the best doesn't fit a long")).cast("long"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))


def _searcher(packed, width: int, k: int, scale: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, vectors = packed.value
        weights = [[int(w) for w in row] for row in integers(vectors, scale)]
        waiting: list[pa.RecordBatch] = []

        def search() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            index = BitSliced(table["row"].to_numpy(), table["vec_id"].to_numpy(), integers(_matrix(_lists(table), width), scale))
            found = [(n, q, v, s) for n, q, w in zip(numbers.tolist(), ids.tolist(), weights, strict=True) for v, s in index.top(w, k, n)]
            over = [(s >= 1 << 63) - (s < -(1 << 63)) for *_, s in found]
            made = [pa.array([f[i] for f in found], type=pa.int64()) for i in range(3)]
            made += [pa.array(over, type=pa.int32()), pa.array([0 if o else f[3] for f, o in zip(found, over, strict=True)], type=pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["row", "query_id", "vec_id", "over", "score"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                waiting.append(batch.slice(at, BLOCK_ROWS))
                if sum(b.num_rows for b in waiting) >= BLOCK_ROWS:
                    yield from search()
        if waiting and sum(b.num_rows for b in waiting):
            yield from search()

    return run


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), e AS (SELECT vec_id, unnest(range(1, CAST(len(x) + 1 AS BIGINT))) AS j, unnest(x) AS c FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.c * c.c) AS BIGINT) AS score
  FROM e q JOIN e c ON q.j = c.j AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
