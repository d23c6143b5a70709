"""Vectors as arrays: cosines, best matches, thresholds, votes, and a weighted probe."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.guards import GuardError


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


#: Queries, rows of the pool of one step, and rows whose scores with the step's queries are held at once; candidates that are scored exactly at once.
STEP_QUERIES, STEP_ROWS, SCORE_ROWS, STEP_EXACT = 1024, 4096, 512, 1 << 16
#: Pairs of a task, about a minute's work; smaller jobs have a task per core.
TASK_PAIRS = 20_000_000_000


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed from the first component to the last, as ``dot`` and DuckDB do."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _nine_places(x: np.ndarray) -> np.ndarray:
    y = np.abs(x) * 1e9
    whole = np.floor(y)
    return np.copysign((whole + (y - whole >= 0.5)) / 1e9, x) + 0.0


def _units(ids: pa.Array, lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: ids and unit vectors, as ``unit`` makes them."""
    ids, offsets = ids.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    flat, starts, widths = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False), offsets[:-1] - offsets[0], np.diff(offsets)
    out = {}
    with np.errstate(all="ignore"):
        for w in np.unique(widths).tolist():
            at = np.flatnonzero(widths == w)
            x = flat[starts[at][:, None] + np.arange(w)]
            n = np.sqrt(_dots(x, x))[:, None]
            out[w] = ids[at], np.where(n == 0, x, x / n)
    return out


class _Single:
    """Vectors in single precision; which of them hold what isn't a number, they are zeros here; the greatest length."""

    def __init__(self, x: np.ndarray):
        self.odd = ~np.isfinite(x).all(axis=1)
        self.any_odd = bool(self.odd.any())
        fine = np.where(self.odd[:, None], 0.0, x)
        self.x, self.length = fine.astype(np.float32), math.sqrt(np.einsum("ij,ij->i", fine, fine).max(initial=0.0))


class _Best:
    """The k best rows of one pool for each of a block of queries of one width.

    Scores come from matrix products in single precision; what is within their
    error of a query's k best is scored again in ``dot``'s order, so that the
    rows and ties are exact.  A score that isn't a number comes first, as in
    Spark's order.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: float):
        self.ids, self.x, self.k, self.floor = ids, x, k, floor
        self.single = _Single(x)
        #: No more than the score of a query's k-th best.
        self.least = np.full(len(ids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * -(-len(ids) // STEP_QUERIES)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        if x.shape[1] and len(ids) > self.k + 1:
            # of equal vectors only the k + 1 of the smallest ids can be among a query's k best: itself and k others
            keys = np.ascontiguousarray(x).view(np.dtype((np.void, 8 * x.shape[1]))).ravel()
            _, group = np.unique(keys, return_inverse=True)
            few = self._first(group, self.k + 1)
            ids, x = ids[few], x[few]
        single = _Single(x)
        for i in range(len(self.found)):
            self._step(i, ids, x, single)

    @staticmethod
    def _first(group: np.ndarray, n: int) -> np.ndarray:
        """Places of the first n of each group, in order."""
        order = np.argsort(group, kind="stable")
        edge = np.flatnonzero(np.diff(group[order], prepend=-1))
        place = np.arange(len(group)) - np.repeat(edge, np.diff(np.append(edge, len(group))))
        return np.sort(order[place < n])

    def _scores(self, mine: slice, pool: _Single, a: int, b: int) -> np.ndarray:
        """Scores of queries with the rows from a to b, in single precision."""
        scores = self.single.x[mine] @ pool.x[a:b].T
        if pool.any_odd:
            scores[:, pool.odd[a:b]] = np.inf
        if self.single.any_odd:
            # all rows of the pool are equal to a query that isn't numbers, the first ids do
            scores[self.single.odd[mine]] = np.where(np.arange(a, b) <= self.k, np.inf, -np.inf)
        return scores

    def _step(self, i: int, ids: np.ndarray, x: np.ndarray, pool: _Single) -> None:
        mine = slice(i * STEP_QUERIES, (i + 1) * STEP_QUERIES)
        own, q, least = self.ids[mine], self.x[mine], self.least[mine]
        # of components rounded to single precision, their products and the sums of these
        error = 1.01 * (x.shape[1] + 8) * 2.0**-24 * self.single.length * pool.length
        if len(ids) > self.k + 1 and np.isneginf(least).any():
            least[:] = np.maximum(least, np.partition(self._scores(mine, pool, 0, len(ids)), -(self.k + 1), axis=1)[:, -(self.k + 1)].astype(np.float64) - error)
        # nine places as well
        bound = np.nextafter((np.maximum(least, self.floor) - error - 2e-9).astype(np.float32), np.float32(-np.inf))
        near = []
        for a in range(0, len(ids), SCORE_ROWS):
            scores = self._scores(mine, pool, a, min(a + SCORE_ROWS, len(ids)))
            some = np.flatnonzero(scores.max(axis=1) >= bound)
            if len(some):
                row, at = np.nonzero(scores[some] >= bound[some, None])
                near.append((some[row], at + a))
        if not near:
            return
        row, at = (np.concatenate(z) for z in zip(*near, strict=True))
        other = own[row] != ids[at]
        row, at = row[other], at[other]
        if not len(row):
            return
        with np.errstate(all="ignore"):
            exact = np.concatenate([_nine_places(_dots(q[row[a : a + STEP_EXACT]], x[at[a : a + STEP_EXACT]])) for a in range(0, len(row), STEP_EXACT)])
        exact[np.isnan(exact)] = np.inf
        fine = exact >= np.maximum(least[row] - 1e-9, self.floor)
        row, score, found = row[fine], exact[fine], ids[at[fine]]
        if not len(row):
            return
        rest = None
        if self.found[i] is not None:
            anew = np.isin(self.found[i][0], row)
            rest = [z[~anew] for z in self.found[i]]
            row, score, found = (np.concatenate((z[anew], new)) for z, new in zip(self.found[i], (row, score, found), strict=True))
        place = np.unique(found, return_inverse=True)[1]
        order = np.lexsort((place, -score, row))
        order = order[self._first(row[order], self.k)]
        row, score, found = row[order], score[order], found[order]
        full = np.flatnonzero(np.bincount(row, minlength=len(own)) >= self.k)
        least[full] = score[np.searchsorted(row, full, side="right") - 1]
        self.found[i] = (row, score, found) if rest is None else tuple(np.concatenate(z) for z in zip(rest, (row, score, found), strict=True))

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, id, cosine), a step's queries at a time."""
        for i, found in enumerate(self.found):
            if found is not None:
                row, score, ids = found
                yield self.ids[i * STEP_QUERIES + row], ids, np.where(np.isinf(score), np.nan, score)


def _searcher(packed, k: int, floor: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, queries = packed.value
        best = {w: _Best(ids, x, k, floor) for w, (ids, x) in queries.items()}
        of = None
        for batch in batches:
            of = batch.schema.field("id").type
            for a in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(a, STEP_ROWS)
                for w, (ids, x) in _units(part.column("id"), part.column("v")).items():
                    if w in best:
                        best[w].add(ids, x)
        for one in best.values():
            for query, ids, cosine in one.rows():
                yield pa.RecordBatch.from_arrays([pa.array(query, kind), pa.array(ids, of), pa.array(cosine)], names=["query", "id", "cosine"])

    return run


def best_matches(queries: DataFrame, pool: DataFrame, k: int = 1, floor: float = -2.0, block_bytes: int = 32 << 20) -> DataFrame:
    """query, id, cosine, rank: the k best of (id, v) for each query (id, v), by nine-place cosines, ties to smaller ids.

    Query ids are distinct.  Vectors that are null or hold nulls take no part,
    and vectors of different lengths don't meet.  The stated query set is
    broadcast in blocks of about ``block_bytes``, dealt by hash; the driver
    holds one block at a time.  The pool is dealt out over the cores and
    compared with each block as matrices, and each task keeps k rows per query.
    """
    spark = pool.sparkSession
    # what has no more than single precision is dealt and sent as it is
    usable = [d.select("id", (F.col("v") if d.schema["v"].dataType.simpleString() == "array<float>" else F.col("v").cast("array<double>")).alias("v")).where(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull())) for d in (queries, pool)]
    n, width = usable[0].agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * (8 * (width or 0) + 64) // block_bytes))
    tasks = max(spark.sparkContext.defaultParallelism, -(-n * usable[1].count() // (blocks * TASK_PAIRS)))
    dealt = usable[1].repartition(tasks)
    schema = f"query {queries.schema['id'].dataType.simpleString()}, id {pool.schema['id'].dataType.simpleString()}, cosine double"
    scored = None
    for i in range(blocks):
        held = usable[0].where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        parts = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (held["id"], held["v"])]
        packed = spark.sparkContext.broadcast((held.schema.field("id").type, _units(*parts)))
        found = dealt.mapInArrow(_searcher(packed, k, floor), schema)
        scored = found if scored is None else scored.unionByName(found)
    order = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vote(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """query, vote: the commonest label (id, label) among the matches, ties to the smaller."""
    counts = matches.join(labels, "id").groupBy("query", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("query").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("vote"))


#: Rows among which a percentile's value is picked on the driver; more are narrowed down first.
RANGE_ROWS = 100_000
#: One in so many rows is a sketch's error of rank.
ACCURACY = 10_000


class _Rank:
    """Where the value of a rank (from 0) of a column lies: between ``low`` and ``high``, both excluded, None for no bound.

    ``below`` values aren't above ``low``, ``end`` are below ``high``.
    """

    def __init__(self, rank: int, n: int):
        self.rank, self.low, self.high, self.below, self.end = rank, None, None, 0, n
        self.value: float | None = None

    def wide(self) -> bool:
        return self.value is None and self.end - self.below > RANGE_ROWS

    def inside(self, v: Column) -> Column:
        return (F.lit(True) if self.low is None else v > self.low) & (F.lit(True) if self.high is None else v < self.high)

    def shares(self) -> list[float]:
        """Shares of the range a little below and a little above the value looked for."""
        at, slack = (self.rank - self.below) / (self.end - self.below), 2 / ACCURACY
        return [max(0.0, at - slack), min(1.0, at + slack)]

    def narrow(self, cut: float, less: int, upto: int) -> None:
        """``less`` values are below the cut, ``upto`` aren't above it."""
        if self.rank >= upto:
            if upto > self.below:
                self.low, self.below = cut, upto
        elif self.rank >= less:
            self.value = cut
        elif less < self.end:
            self.high, self.end = cut, less

    def pick(self, values: np.ndarray, counts: np.ndarray) -> float:
        """The value, given all sorted values of the range with their counts, and maybe others."""
        if self.value is None:
            a = 0 if self.low is None else np.searchsorted(values, self.low, side="right")
            b = len(values) if self.high is None else np.searchsorted(values, self.high)
            self.value = float(values[a + np.searchsorted(np.cumsum(counts[a:b]), self.rank - self.below, side="right")])
        return self.value


def quantiles(df: DataFrame, column: str, points: tuple[float, ...] = (0.01, 0.5, 0.99)) -> DataFrame:
    """Exact, interpolated percentiles; null where no value is.

    No task holds the column's distinct values.  A sketch of bounded size gives
    two cuts around each value looked for, and how many values are below the
    cuts is counted; that is repeated until at most ``RANGE_ROWS`` values are
    left between two cuts, whatever the sketch's error, and these are counted
    by value and reach the driver.
    """
    v = F.col("v")
    values = df.select(F.col(column).cast("double").alias("v")).where(v.isNotNull())
    n = values.count()
    at = [(n - 1) * p for p in points]
    ranks = {r: _Rank(r, n) for x in at for r in (math.floor(x), math.ceil(x))} if n else {}
    while wide := [r for r in ranks.values() if r.wide()]:
        ranges: dict[tuple[int, int], list[_Rank]] = {}
        for r in wide:
            ranges.setdefault((r.below, r.end), []).append(r)
        # one sketch a range
        sketches = [F.percentile_approx(F.when(same[0].inside(v), v), [x for r in same for x in r.shares()], ACCURACY).alias(f"c{i}") for i, same in enumerate(ranges.values())]
        cuts = sorted({c for found in values.agg(*sketches).first() for c in found})
        counted = values.agg(*[F.count(F.when(test, 1)).alias(f"n{i}{k}") for i, c in enumerate(cuts) for k, test in enumerate((v < c, v <= c))]).first()
        for r in wide:
            for c, less, upto in zip(cuts, counted[::2], counted[1::2], strict=True):
                r.narrow(c, less, upto)
    left = [r.inside(v) for r in ranks.values() if r.value is None]
    found = values.where(reduce(lambda a, b: a | b, left)).groupBy("v").agg(F.count("*").alias("n")).toArrow().sort_by("v") if left else None
    seen = (found["v"].to_numpy(), found["n"].to_numpy()) if found else (np.zeros(0), np.zeros(0))
    out = []
    for p, x in zip(points, at, strict=True):
        value = None
        if n:
            low, high = (ranks[r(x)].pick(*seen) for r in (math.floor, math.ceil))
            value = low if low == high or math.isnan(high) and math.isnan(low) else (math.ceil(x) - x) * low + (x - math.floor(x)) * high
        out.append(F.lit(value).cast("double").alias(f"p{round(p * 100):02d}"))
    return df.sparkSession.range(1).select(*out)


def bootstrap_auc(scored: DataFrame, rounds: int = 1000, seed: int = 20260901, most: int = 200_000) -> tuple[float, float]:
    """2.5 and 97.5 % points of the AUC over resamples of at most ``most`` (score, positive) rows."""
    if scored.limit(most + 1).count() > most:
        raise GuardError(f"more than {most} rows to resample")
    pdf = scored.toPandas()
    pos, neg = (np.sort(pdf.loc[pdf["positive"] == flag, "score"].to_numpy()) for flag in (True, False))
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rounds):
        p, n = rng.choice(pos, len(pos)), np.sort(rng.choice(neg, len(neg)))
        out.append((np.searchsorted(n, p, "left") + np.searchsorted(n, p, "right")).sum() / (2 * len(p) * len(n)))
    out.sort()
    return out[int(0.025 * rounds)], out[int(0.975 * rounds)]


def probe(rows: DataFrame, folds: int = 5) -> DataFrame:
    """id, label, score of (id, v, label 0/1): a weighted logistic model, each row scored by the model of the other folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from tidemark.operators.audit import fold_of

    data = rows.select("id", "label", array_to_vector(unit(F.col("v"))).alias("features"), fold_of(F.col("id"), folds).alias("fold")).cache()
    share = data.agg(F.avg("label")).first()[0]
    data = data.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    out = None
    for f in range(folds):
        model = LogisticRegression(weightCol="weight", regParam=1e-3, standardization=False, maxIter=100).fit(data.where(F.col("fold") != f))
        part = model.transform(data.where(F.col("fold") == f)).select("id", "label", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
