"""Labels of several corpora to reason codes, and the rules on what may supervise what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.guards import expect_empty

# Codes, and (dataset, label, code).
SUPERVISED = ("content_refuted", "content_unverified", "media_mismatch", "wrong_image", "none")
UNMAPPED = "unmapped"
CODES = (
    ("verite", "out-of-context", "media_mismatch"), ("verite", "miscaptioned", "wrong_image"), ("verite", "true", "none"),
    ("mocheg", "refuted", "content_refuted"), ("mocheg", "NEI", "content_unverified"), ("mocheg", "supported", "none"),
    ("averitec", "Refuted", "content_refuted"), ("averitec", "Not Enough Evidence", "content_unverified"), ("averitec", "Supported", "none"),
    ("averimatec", "Refuted", "content_refuted"), ("averimatec", "Not Enough Evidence", "content_unverified"), ("averimatec", "Supported", "none"),
    ("m4fc", "false", "content_refuted"), ("m4fc", "not enough information", "content_unverified"), ("m4fc", "true", "none"),
    ("factify2", "Refute", "content_refuted"), ("factify2", "Insufficient_Text", "content_unverified"), ("factify2", "Insufficient_Multimodal", "content_unverified"),
    ("factify2", "Support_Text", "none"), ("factify2", "Support_Multimodal", "none"),
)
UNMAPPED_DATASETS = ("welfake", "liar", "fakenewsnet", "fakeddit", "isot", "dgm4")
NO_CLEAN_CODE = (("averitec", "Conflicting Evidence/Cherrypicking"), ("averimatec", "Conflicting Evidence/Cherrypicking"))
EVALUATION_ONLY = ("averimatec", "verite")
WEAK_DATASETS = ("dgm4",)
EXCLUDED_META = (("fakeddit", "subreddit", ("fakehistoryporn",)),)
EVIDENCE = (("factify2", "Support_Text", "text"), ("factify2", "Support_Multimodal", "multimodal"), ("factify2", "Insufficient_Text", "text"), ("factify2", "Insufficient_Multimodal", "multimodal"))


def _lookup(table: tuple, dataset: Column, label: Column) -> Column:
    """A literal map: at most a few dozen entries, so no join."""
    entries = F.create_map(*[x for d, k, v in table for x in (F.lit(f"{d}\x1f{k}"), F.lit(v))])
    return F.try_element_at(entries, F.concat_ws("\x1f", dataset, label))


def reason_code(dataset: Column, label: Column, meta: Column | None = None, unmapped: tuple[str, ...] = UNMAPPED_DATASETS) -> Column:
    """Corpora without reasons first, then rows excluded by a property, then no label, then the map; null if none fits."""
    out = F.when(dataset.isin(*unmapped), UNMAPPED)
    if meta is not None:
        for name, field, values in EXCLUDED_META:
            out = out.when((dataset == name) & F.try_element_at(meta, F.lit(field)).isin(*values), UNMAPPED)
    return out.when(label.isNotNull(), _lookup(CODES, dataset, label))


def swap_code(label: Column, swap_publisher: Column) -> Column:
    """For the face-and-caption corpus, if its audit were passed: captions of the image's own publisher only."""
    return F.when((label == "text_swap") & (swap_publisher == "same"), "media_mismatch").otherwise(UNMAPPED)


def treatment(dataset: Column, label: Column) -> Column:
    clean = F.lit(False)
    for d, k in NO_CLEAN_CODE:
        clean = clean | ((dataset == d) & (label == k))
    return (
        F.when(dataset.isin(*UNMAPPED_DATASETS), "unmapped").when(label.isNull(), "unlabelled")
        .when(_lookup(CODES, dataset, label).isNotNull(), "mapped").when(clean, "no_clean_code").otherwise("unexpected")
    )


def bucket(dataset: Column, label: Column) -> Column:
    return F.coalesce(reason_code(dataset, label), F.concat(F.lit("null:"), treatment(dataset, label)))


def evidence_kind(dataset: Column, label: Column) -> Column:
    return F.when(label.isNotNull(), _lookup(EVIDENCE, dataset, label))


def with_codes(rows: DataFrame) -> DataFrame:
    """Adds reason_code, evaluation_only and weak_supervision to (dataset, label, ...)."""
    d, k = F.col("dataset"), F.col("label")
    code = reason_code(d, k)
    return rows.withColumns({"reason_code": code, "evaluation_only": d.isin(*EVALUATION_ONLY), "weak_supervision": F.coalesce(d.isin(*WEAK_DATASETS) & code.isin(*SUPERVISED), F.lit(False))})


def supervised(rows: DataFrame, purpose: str, split: str) -> DataFrame:
    """The rows that may train or evaluate.  What is left is checked again, on purpose, and a violation fails."""
    if purpose not in ("train", "evaluate"):
        raise ValueError(purpose)
    kept = rows.where((F.col("split") == split) & F.col("reason_code").isin(*SUPERVISED))
    kept = kept.where(~F.col("evaluation_only")) if purpose == "train" else kept.where(~F.col("weak_supervision"))
    bad = F.col("reason_code").isNull() | (F.col("reason_code") == UNMAPPED) | (F.col("split") != split)
    bad = bad | (F.col("evaluation_only") if purpose == "train" else F.col("weak_supervision"))
    expect_empty(kept.where(bad).select("dataset", "reason_code", "split"), "rows without supervision")
    return kept


def distribution(rows: DataFrame) -> DataFrame:
    """dataset, bucket, n, and dataset totals (bucket null)."""
    out = rows.withColumn("bucket", bucket(F.col("dataset"), F.col("label"))).rollup("dataset", "bucket").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return out.where("g < 3").select("dataset", F.when(F.col("g") == 0, F.col("bucket")).alias("bucket"), "n")
