"""Exact, order-independent samples: rows are ordered by a hash of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def allocation(counts: DataFrame, size: int) -> DataFrame:
    """label, take: shares of ``size`` by largest remainder (ties to the smaller label) from (label, n)."""
    total = counts.agg(F.sum("n").alias("total"))
    exact = F.col("n") * F.lit(size) / F.col("total")
    parts = counts.crossJoin(F.broadcast(total)).withColumns({"floor": F.floor(exact), "rest": F.round(exact - F.floor(exact), 9)})
    # one row per label: bounded by the number of classes
    spare = F.lit(size) - F.sum("floor").over(Window.partitionBy())
    nth = F.row_number().over(Window.partitionBy().orderBy(F.col("rest").desc(), "label"))
    take = F.col("floor") + F.when(nth <= spare, 1).otherwise(0)
    return parts.select("label", F.when(F.lit(size) >= F.col("total"), F.col("n")).when(F.lit(size <= 0), 0).otherwise(take).cast("long").alias("take"))


def stratified(rows: DataFrame, size: int, seed: int, key: str = "id", label: str = "label") -> DataFrame:
    """Exactly ``size`` rows (all, if there are fewer), in proportion to the classes."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    quota = allocation(counts, size).withColumnRenamed("label", "quota_label")
    order = Window.partitionBy(label).orderBy(hash_order(seed, F.col(key)), key)
    ranked = rows.join(F.broadcast(quota), F.col(label).eqNullSafe(F.col("quota_label"))).withColumn("nth", F.row_number().over(order))
    return ranked.where("nth <= take").select(*rows.columns)


def first_by_hash(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    return rows.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def scaled(months: DataFrame, share: float) -> DataFrame:
    """month, want of (month, n): a share of each, at least one."""
    return months.select("month", F.greatest(F.lit(1), F.round(F.col("n") * share)).cast("long").alias("want"))
