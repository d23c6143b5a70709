"""Assets of records: status, choice among sources, usability, copies within and across corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.guards import expect_empty

# Fixed values.
MISSING = ("placeholder", "furniture", "blank", "verdict")
REMOVED = (*MISSING, "wrong_image")
SOURCES = ("origin", "origin_retry", "wayback", "alternate", "ledger", "match")


def with_status(files: DataFrame, registry: DataFrame, rejections: DataFrame) -> DataFrame:
    """Adds ``status`` to (dataset, path, loads, sha256): undecodable, then a registered status, then wrong_image, else usable.

    Spark broadcasts the registry and the rejections where their sizes allow.
    """
    known = registry.select("sha256", F.col("status").alias("registered")).where(F.col("registered").isin(*MISSING))
    wrong = rejections.select("dataset", "sha256").distinct().withColumn("rejected", F.lit(True))
    out = files.join(known, "sha256", "left").join(wrong, ["dataset", "sha256"], "left")
    status = F.when(~F.coalesce("loads", F.lit(False)), "undecodable").otherwise(F.coalesce("registered", F.when(F.col("rejected"), "wrong_image"), F.lit("usable")))
    return out.withColumn("status", status).drop("registered", "rejected")


def resolve(candidates: DataFrame) -> DataFrame:
    """item, path, source of the first usable candidate (item, source, path, status) in the order of SOURCES."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    return candidates.where("status = 'usable'").groupBy("item").agg(F.min_by(F.struct("path", "source"), F.struct(rank, F.col("path"))).alias("r")).select("item", "r.path", "r.source")


def missing_required(slots: Column) -> Column:
    """Slots (role, status) that aren't usable, but for evidence that was removed."""
    return F.size(F.filter(slots, lambda s: (s["status"] != "usable") & ~((s["role"] == "evidence") & s["status"].isin(*REMOVED))))


def modality(text: Column, images: Column) -> Column:
    has = F.length(F.trim(F.coalesce(text, F.lit("")))) > 0
    return F.when(has & (images > 0), "text+image").when(has, "text_only").when(images > 0, "image_only").otherwise("none")


def usable_reason(label: Column, conflict: Column, text: Column, missing: Column) -> Column:
    """What stands against a row, joined by semicolons; null if nothing does."""
    blank = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
    out = F.concat_ws(";", F.when(label.isNull() & ~conflict, "no_label"), F.when(conflict, "label_conflict"), F.when(blank, "no_text"), F.when(missing > 0, F.concat(F.lit("images_missing:"), missing.cast("string"))))
    return F.nullif(out, F.lit(""))


def copies(files: DataFrame) -> DataFrame:
    """sha256, copies, datasets, owner (the first dataset by name) of usable files."""
    return files.groupBy("sha256").agg(F.count("*").alias("copies"), F.count_distinct("dataset").alias("datasets"), F.min("dataset").alias("owner"))


def cross_corpus(files: DataFrame) -> DataFrame:
    """sha256, datasets, members of content that several corpora hold, from (sha256, dataset, record_id)."""
    per = files.groupBy("sha256", "dataset").agg(F.array_sort(F.collect_set("record_id")).alias("record_ids"))
    out = per.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("dataset", "record_ids"))).alias("members"))
    return out.where(F.size("members") > 1).select("sha256", F.transform("members", lambda m: m["dataset"]).alias("datasets"), "members")


def excluded_ids(pairs: DataFrame, train: str, evaluation: str) -> DataFrame:
    """record_id of the evaluation corpus that share content with the training corpus."""
    m = pairs.select("sha256", F.explode("members").alias("m")).select("sha256", "m.dataset", "m.record_ids")
    a, b = m.where(F.col("dataset") == train).select("sha256"), m.where(F.col("dataset") == evaluation)
    return b.join(a, "sha256", "left_semi").select(F.explode("record_ids").alias("record_id")).distinct()


def assert_no_overlap(evaluated: DataFrame, excluded: DataFrame) -> None:
    expect_empty(evaluated.join(excluded, "record_id"), "evaluation records that the training corpus holds too")


def image_kind(head: Column) -> Column:
    """The format that a file's first bytes tell, or null; no decoding."""
    h = F.hex(F.substring(head, 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("47494638"), "gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp").when(h.startswith("424D"), "bmp")
    )


def reexamine(now: DataFrame, before: DataFrame) -> DataFrame:
    """The files (path, bytes, mtime) that an index lacks or has with another size or time."""
    return now.join(before.select("path", "bytes", "mtime"), ["path", "bytes", "mtime"], "left_anti")


def error_words(text: Column, pattern: str = r"(?i)\b(error|not found|unavailable|removed|deleted|expired|denied)\b") -> Column:
    """Sorted distinct words of failure that a recognised text holds."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)), lambda w: F.lower(w))))
