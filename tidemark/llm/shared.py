"""What the operators of this package share: scratch tables, batches of texts, vectorised word hashes.

Word and shingle hashes are 64-bit.  A hash decides equality only inside one
pair of documents or after grouping, so a wrong answer needs two different
sequences among the compared ones to collide (about n*n / 2**65).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- scratch tables


_temporary: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; below a temporary one only where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir() or _temporary.get(spark.sparkContext.applicationId)
    if not base:
        base = _temporary[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


#: Rows per batch between Spark and Python while a table is written; texts may be long.
BATCH_ROWS = 2000


class Scratch:
    """Tables written below ``spark.checkpoint.dir``: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, scratch_dir(spark)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        key, own = "spark.sql.execution.arrow.maxRecordsPerBatch", self.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        self.spark.conf.set(key, str(min(int(own), BATCH_ROWS)) if int(own) > 0 else str(BATCH_ROWS))
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(key, own)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of documents that no classifier here learns from."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows (doc_id, text, label) that may be learnt from.

    Rows come in the order of a hash of doc_id, so the sample is the same on
    every run.  A document labelled twice has its largest label; null ids,
    texts and labels are left out.  The sample's ids are broadcast: their
    number is bounded by ``limit``.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")


# --------------------------------------------------------------------------- batches of texts


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null becomes empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores as it takes to be none of the taken ones, whatever their case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


_held: dict[str, Callable[[], None]] = {}


def hold(module: str, clear: Callable[[], None]) -> None:
    """Note that a module keeps words or models in this worker, and how to let them go."""
    _held[module] = clear


def release(but: str) -> None:
    """Let go what other modules keep: a worker serves one operator after another."""
    for module in [m for m in _held if m != but]:
        _held.pop(module)()


def map_texts(docs: DataFrame, fn, fields: str, *carry: str, module: str | None = None) -> DataFrame:
    """One row per document: the columns ``carry`` unchanged, then ``fields`` from ``fn``.

    ``fn`` takes a list of texts (null is empty) and returns one Arrow array
    per field.  Batches are cut so that about 2 MB of text are in work at once.
    ``module`` is the operator whose words and models the worker keeps, by
    default the one that ``fn`` is of.
    """
    source = docs.select(*carry, F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carry] + [fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(but=module or fn.__module__)
        for batch in batches:
            for part in cut(batch):
                made = fn(part.column("text").to_pylist())
                arrays = [part.column(c) for c in carry] + list(made)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    return source.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text; a longer text has a slice of its own."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, end - start)
        start = end


def struct_lists(rows: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Lists of tuples as an Arrow list<struct<...>> array."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    flat = [x for row in rows for x in row]
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(fields)
    struct = pa.StructArray.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(offsets), struct)


# --------------------------------------------------------------------------- vectorised word hashes

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
#: Space and \t \n \v \f \r.
SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]


@lru_cache(1)
def _byte_values() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, the same with A-Z lower-cased, and which bytes part words."""
    values = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
    lower = values.copy()
    lower[65:91] = values[97:123]
    gap = np.zeros(256, dtype=bool)
    gap[SPACES] = True
    return values, lower, gap


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if size <= 1 << 22:  # a longer one serves a single text
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (in bytes) of the words of a UTF-8 text: runs without ASCII white space."""
    values, lowered, gap = _byte_values()
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap[data], [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((lowered if lower else values)[data] * _power(_STEP, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * _power(_BACK, len(data))[start]), start, end


def string_hashes(column: pa.Array) -> np.ndarray:
    """A hash of each string of an Arrow array; equal strings have equal hashes in every process."""
    offsets, data = buffers(column)
    if not len(column):
        return np.zeros(0, dtype=np.uint64)
    offsets = offsets.astype(np.int64)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[0][data] * _power(_STEP, len(data)), out=total[1:])
    back = np.append(_power(_BACK, len(data)), np.uint64(0))
    return mix((total[offsets[1:]] - total[offsets[:-1]]) * back[offsets[:-1]])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, given the words' hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return words[:0]
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(_STEP) + words[j : j + n]
    return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string or large binary array, without copies."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)


# --------------------------------------------------------------------------- documents, ids and copies

#: Rows of ids that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Bytes of per-document notes that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Let the executors' JVMs return the heap that a finished stage used and the next may not need.

    A heap grows to its limit over a long job, and stays so, beside the memory
    of the Python workers.  A full collection shrinks it to what is in use;
    one short task per core reaches every executor with free cores.
    """
    sweep(spark)
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table, marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def unique_ids(docs: DataFrame, scratch: Scratch):
    """``docs`` as (doc_id, text) with one row per id, a function that turns results back, and the numbering.

    Where every doc_id is there and occurs once, nothing changes.  Else
    documents are told apart by doc_id and text and numbered in the order of
    doc_id (null last) and a hash of the text; the function gives each row of
    ``docs`` its result, and columns of numbers their doc_ids.  The numbering
    (doc_id, key, copies, number) is None where nothing changed; ``key`` is the
    text's md5.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs, lambda result, *ids: result, None
    keyed = docs.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    groups = keyed.groupBy("doc_id", "key").agg(F.count("*").cast("int").alias("copies"), F.first("text").alias("text"))
    ordered = scratch.table(groups.orderBy(F.col("doc_id").asc_nulls_last(), "key"), "ordered")
    numbered = ordered.select("doc_id", "key", "copies").orderBy(F.col("doc_id").asc_nulls_last(), "key").rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    numbers = scratch.table(docs.sparkSession.createDataFrame(numbered, "doc_id long, key string, copies int, number long"), "numbers")
    same = ordered["doc_id"].eqNullSafe(numbers["doc_id"]) & (ordered["key"] == numbers["key"])
    new = scratch.table(ordered.join(numbers, same).select(numbers["number"].alias("doc_id"), "text"), "numbered")

    def restore(result: DataFrame, *ids: str) -> DataFrame:
        columns = result.columns
        for c in ("doc_id", *ids):
            named = numbers.select(F.col("number").alias("tidemark_number"), F.col("doc_id").alias("tidemark_id"), F.col("copies").alias("tidemark_copies"))
            result = result.join(named, result[c] == named["tidemark_number"]).withColumn(c, F.col("tidemark_id"))
            if c == "doc_id":
                result = result.withColumn("tidemark_copy", F.explode(F.sequence(F.lit(1), F.col("tidemark_copies")))).drop("tidemark_copy")
            result = result.select(*columns)
        return result

    return new, restore, numbers


def copies_of(keys: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, first): every document of a group equal in ``by`` but the one of the smallest doc_id.

    Group sizes are summed before the shuffle, and the join back is between
    two written tables, so that Spark can split a large group.
    """
    groups = scratch.table(keys.groupBy(*by).agg(F.min("doc_id").alias("first"), F.count("*").alias("tidemark_n")).where("tidemark_n > 1").drop("tidemark_n"), f"{name}_groups")
    return scratch.table(keys.join(groups, by).where("doc_id <> first").select("doc_id", "first"), name)
