"""Connected components of records that share keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ready(spark: SparkSession) -> None:
    """A checkpoint folder: the cluster's, or a temporary one where it names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(base or tempfile.mkdtemp(prefix="tidemark-"))


def components(members: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) from (node, key): the smallest node that shared keys reach.

    Each round gives a key the least label of its nodes, a node the least of
    its keys, and then the label's own label, which halves long chains.  A
    large key is reduced before its shuffle and never gathered in one row.
    """
    ready(members.sparkSession)
    members = members.where("node is not null and key is not null").select("node", "key").distinct().checkpoint()
    labels = members.select("node").distinct().withColumn("label", F.col("node")).checkpoint()
    for _ in range(rounds):
        of_key = members.join(labels, "node").groupBy("key").agg(F.min("label").alias("label"))
        least = members.join(of_key, "key").groupBy("node").agg(F.min("label").alias("next"))
        jump = least.select(F.col("node").alias("next"), F.col("next").alias("further"))
        new = least.join(jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("label")).checkpoint()
        changed = new.withColumnRenamed("label", "now").join(labels, "node").where("now <> label").limit(1).count()
        labels = new
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")
