"""Incremental ingest and event windows on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery


def stream_documents(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """New files of a folder of Parquet documents; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest_documents(stream: DataFrame, store: str, today: str, checkpoint: str) -> StreamingQuery:
    """Make documents of new rows and append what the store lacks, dated and quarantined apart.

    A batch that is run again finds its own ids in the store, so nothing is
    written twice.
    """
    from tidemark.operators.store import first_wins, make_documents

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = first_wins(make_documents(batch, today), ["doc_id"], F.col("url")).withColumn("quarantined", F.col("published_at").isNull())
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(store).select("doc_id"), "doc_id", "left_anti")
        new.write.mode("append").partitionBy("quarantined").parquet(store)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on ``ts``, which has to be a timestamp with a zone; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, length: str, step: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; watermarked where the source is a stream."""
    source = watermarked(events, late)
    return source.groupBy(F.window("ts", length, step or length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    source = watermarked(events, late)
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def distinct_ids(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each id once, remembered no longer than the watermark."""
    return watermarked(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def breaker(events: DataFrame, limit: int) -> DataFrame:
    """user_id, failures whenever a key's run of failures reaches the limit; state is one counter per key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        opened = []
        for frame in frames:
            for failed in frame.sort_values(["ts", "event_id"])["failed"]:
                run = run + 1 if failed else 0
                if run == limit:
                    opened.append(run)
        state.update((run,))
        yield pd.DataFrame({"user_id": [key[0]] * len(opened), "failures": opened})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, failures long", "run long", "append", GroupStateTimeout.NoTimeout)
