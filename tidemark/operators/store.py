"""The dated evidence store: documents, quarantine, first-wins ingest, and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text, urls


def make_documents(rows: DataFrame, today: str) -> DataFrame:
    """Documents from (url, title, text, published_at, date_source, date_confidence), implausible dates refused and kept aside."""
    verdict = dates.verdict(F.col("published_at"), today)
    refused = verdict.isin("sentinel", "out_of_window")
    return rows.withColumns({"verdict": verdict, "raw_date_rejected": F.when(refused, F.col("published_at"))}).select(
        F.sha2("url", 256).alias("doc_id"), "url", F.trim("title").alias("title"), F.trim("text").alias("text"),
        F.when(~refused, F.col("published_at")).alias("published_at"),
        F.when(refused, "implausible_date").otherwise(F.col("date_source")).alias("date_source"),
        F.when(refused, "none").otherwise(F.col("date_confidence")).alias("date_confidence"),
        urls.host(F.col("url")).alias("source_domain"), F.sha2(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), 256).alias("content_sha256"),
        "raw_date_rejected", "verdict",
    )


def page_documents(pages: DataFrame, today: str, parser: bool = False, minimum: int = 200, longest: int = 20_000) -> DataFrame:
    """Pages (url, html[, last_modified]) to documents.  The cheap test comes before any extraction."""
    last = F.col("last_modified") if "last_modified" in pages.columns else F.lit(None).cast("string")
    kept = pages.where(text.may_be_article(F.col("html")))
    found = dates.page_date(F.col("html"), last, F.col("url"))
    body = text.html_to_text("html") if parser else text.strip_tags(F.col("html"))
    rows = kept.select("url", text.title_of(F.col("html")).alias("title"), F.substring(body, 1, longest).alias("text"), found.alias("d"))
    rows = rows.where(F.length("text") >= minimum).select("url", "title", "text", F.col("d.date").alias("published_at"), F.col("d.source").alias("date_source"), F.col("d.confidence").alias("date_confidence"))
    return make_documents(rows, today)


def first_wins(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The first row per key in the order of ingest.  Only the least order per key is kept before the shuffle."""
    least = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), order).alias("row"))
    return least.select("row.*")


def ingest(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(indexed, quarantined, skipped) of new documents; what the store has is never overwritten."""
    fresh = new.join(old.select("doc_id"), "doc_id", "left_anti")
    skipped = new.join(old.select("doc_id"), "doc_id", "left_semi")
    return fresh.where("published_at is not null"), fresh.where("published_at is null"), skipped


def report(docs: DataFrame) -> DataFrame:
    """Counts by source, confidence and domain, and by source with confidence, in one pass: dimension, a, b, n."""
    sets = docs.groupingSets([["date_source"], ["date_confidence"], ["source_domain"], ["date_source", "date_confidence"], []], "date_source", "date_confidence", "source_domain")
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    name = F.when(F.col("g") == 3, "source").when(F.col("g") == 5, "confidence").when(F.col("g") == 6, "domain").when(F.col("g") == 1, "source_confidence").otherwise("all")
    return out.select(name.alias("dimension"), F.coalesce("date_source", "source_domain", "date_confidence").alias("a"), F.when(F.col("g") == 1, F.col("date_confidence")).alias("b"), "n")


def by_year(docs: DataFrame) -> DataFrame:
    return docs.where("published_at is not null").groupBy(F.substring("published_at", 1, 4).alias("year")).agg(F.count("*").alias("n"))


def occurrence_suffix(df: DataFrame, key: str, order: str) -> DataFrame:
    """Column ``record_id``: the key, and -2, -3 ... for its repetitions in order of appearance."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("record_id", F.when(n > 1, F.concat(F.col(key), F.lit("-"), n.cast("string"))).otherwise(F.col(key)))
