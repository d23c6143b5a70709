"""Append-only ledgers of attempts: last results, breakers, throttles, budgets, and why a row is final."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.guards import expect_empty


def last_per(ledger: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row per key; reduced before the shuffle."""
    return ledger.groupBy(*key).agg(F.max_by(F.struct(*ledger.columns), order).alias("r")).select("r.*")


def merge_failures(old: DataFrame, new: DataFrame, recovered: DataFrame, key: str = "key") -> DataFrame:
    """Old and new failures, new ones first, without what was recovered."""
    kept = old.join(new.select(key), key, "left_anti").unionByName(new)
    return kept.join(recovered.select(key), key, "left_anti")


def failure_runs(events: DataFrame, host: str, order: list, failed: Column) -> DataFrame:
    """host, run, length: maximal runs of consecutive failures; a success ends a run."""
    w = Window.partitionBy(host).orderBy(*order)
    marked = events.withColumn("failed", failed).withColumn("run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    return marked.where("failed").groupBy(host, "run").agg(F.count("*").alias("length"))


def open_hosts(events: DataFrame, host: str, order: list, failed: Column, limit: int) -> DataFrame:
    """Hosts whose last run of failures has reached the limit."""
    w = Window.partitionBy(host).orderBy(*order)
    marked = events.withColumn("failed", failed).withColumn("run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    tail = marked.groupBy(host).agg(F.max("run").alias("run"))
    return marked.where("failed").join(tail, [host, "run"]).groupBy(host).agg(F.count("*").alias("failures")).where(F.col("failures") >= limit)


def too_close(events: DataFrame, host: str, seconds: Column, least: float) -> DataFrame:
    """Starts that follow another of their host too soon."""
    w = Window.partitionBy(host).orderBy(seconds)
    return events.withColumn("gap", seconds - F.lag(seconds).over(w)).where(F.col("gap") < least)


def schedule(units: DataFrame, host: str, order: list, delay: float = 5.0) -> DataFrame:
    """Column ``not_before``: seconds from the start at which each request of a host may begin."""
    return units.withColumn("not_before", (F.row_number().over(Window.partitionBy(host).orderBy(*order)) - 1) * F.lit(delay))


def running_total(transfers: DataFrame, group: str, order: list, size: str) -> DataFrame:
    return transfers.withColumn("total", F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def assert_budget(transfers: DataFrame, group: str, order: list, size: str, cap: float) -> None:
    expect_empty(running_total(transfers, group, order, size).where(F.col("total") > cap).select(group, "total"), f"transfers beyond {cap}")


def retryable(status: Column) -> Column:
    return status.isNull() | status.isin(408, 425, 429) | status.between(500, 599)


def transport_error(text: Column) -> Column:
    """A failed transfer's kind, from its message."""
    t = F.lower(text)

    def has(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | t.contains(p)
        return out

    return (
        F.when(has("getaddrinfo", "name or service not known", "nameresolution", "failed to resolve", "no address associated", "nodename nor servname"), "dns_failure")
        .when(has("ssl", "certificate"), "ssl_error").when(has("timed out", "timeout"), "timeout").when(has("toomanyredirects"), "too_many_redirects")
        .when(has("connection", "reset", "refused"), "connection_error").otherwise(F.split_part(t, F.lit(":"), F.lit(1)))
    )


def origin_category(reason: Column, status: Column) -> Column:
    """Why a source's own address can't serve an asset."""
    r = F.lower(F.coalesce(reason, F.lit("")))
    return (
        F.when(r == "", "not_attempted").when(r.contains("redirect_to_removed"), "removed_by_host").when(r.startswith("placeholder_image"), "host_serves_placeholder")
        .when(r.isin("not_an_image", "empty_body") | r.rlike("^(undecodable|verify:|load:)"), "host_serves_non_image").when(r == "dns_failure", "dns_failure")
        .when(r.isin("timeout", "connection_error", "ssl_error", "too_many_redirects", "body_too_large"), F.concat(F.lit("unreachable_"), r))
        .when(status.isin(404, 410), F.concat(F.lit("gone_"), status.cast("string"))).when(status.isin(401, 403, 451), F.concat(F.lit("blocked_"), status.cast("string")))
        .when(status.between(500, 599), "server_error_5xx").when(status.isNotNull(), F.concat(F.lit("refused_http_"), status.cast("string")))
        .otherwise(F.concat(F.lit("other_"), F.substring(r, 1, 40)))
    )


def archive_category(reason: Column) -> Column:
    """Why an archive can't."""
    r = F.coalesce(reason, F.lit(""))
    return (
        F.when(r == "", "not_attempted").when(r == "no_snapshot", "no_snapshot").when(r.startswith("cdx_unavailable") & r.endswith("cdx_http_404"), "archive_refuses_host_404")
        .when(r.startswith("cdx_unavailable"), "archive_index_unavailable").when(r.contains("placeholder"), "snapshots_are_placeholders")
        .when(r.contains("not_an_image") | r.contains("undecodable"), "snapshots_not_images").otherwise("snapshots_failed")
    )


def choose_snapshots(captures: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` captures (url, year, timestamp, original, mimetype, digest) per url: the exact query first, then the nearest year, one per digest."""
    kept = captures.where(~F.col("mimetype").startswith("text/"))
    far = F.abs(F.substring("timestamp", 1, 4).try_cast("int") - F.col("year"))
    order = F.struct(F.when(F.col("original") == F.col("url"), 0).otherwise(1).alias("inexact"), far.alias("far"), F.col("timestamp"))
    one = kept.withColumn("o", order).groupBy("url", "digest").agg(F.min("o").alias("o"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy("o", "digest")))
    return ranked.where(F.col("rank") <= most).select("url", "rank", F.col("o.timestamp").alias("timestamp"), "digest")


def recovery_report(rows: DataFrame) -> DataFrame:
    """label, items, ok, rate of (label, ok), and all labels together (null); refuses rows without a class."""
    expect_empty(rows.where("label is null"), "rows without a class")
    out = rows.rollup("label").agg(F.count("*").alias("items"), F.count_if("ok").alias("ok"))
    return out.select("label", "items", "ok", F.round(F.col("ok") / F.col("items"), 4).alias("rate"))
