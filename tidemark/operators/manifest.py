"""Integrity: manifests, tree hashes, register audits, and what may be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import glob_regex, globs_overlap
from tidemark.operators.guards import GuardError

# What a public repository may not hold.
PRIVATE_PREFIXES = ("data/raw/", "data/interim/", "data/processed/")
DATA_SUFFIXES = (".parquet", ".jsonl", ".jsonl.gz", ".npy", ".tsv", ".zip")
LABEL_FIELDS = ("label", "labels", "verdict", "rating", "reason_code")
URL_FIELDS = ("url", "image_url", "link")
METHODS = ("hf", "git", "direct", "kaggle", "zenodo", "gdrive")
REQUIRED = ("name", "method", "url", "licence", "redistributable", "est_gb", "enabled", "forbidden_patterns")


def diff(listed: DataFrame, found: DataFrame) -> DataFrame:
    """path, state (MISSING, CHANGED, UNTRACKED) of two (path, sha256) tables."""
    a, b = listed.select("path", F.col("sha256").alias("a")), found.select("path", F.col("sha256").alias("b"))
    state = F.when(F.col("b").isNull(), "MISSING").when(F.col("a").isNull(), "UNTRACKED").when(F.col("a") != F.col("b"), "CHANGED")
    return a.join(b, "path", "full").select("path", state.alias("state")).where("state is not null")


def update(listed: DataFrame, fresh: DataFrame, prefixes: list[str]) -> DataFrame:
    """The manifest with the rows below the prefixes replaced."""
    own = F.lit(False)
    for p in prefixes:
        own = own | F.col("path").startswith(p)
    return listed.where(~own).unionByName(fresh.where(own))


def tree_hashes(files: DataFrame, group: str) -> DataFrame:
    """group, tree, files, bytes: a digest of the sorted ``path:sha256`` lines of each group (group, path, sha256, bytes).

    Digests are of hex blocks: first of each folder's lines, then of the
    sorted folder digests, so that no row holds all files of a group.
    """
    lines = files.withColumn("folder", F.regexp_replace("path", "[^/]*$", ""))
    per = lines.groupBy(group, "folder").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit(":"), "sha256"))), "\n"), 256).alias("h"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return per.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("folder", F.lit(":"), "h"))), "\n"), 256).alias("tree"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def forbidden(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """path, pattern of every hit."""
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike(glob_regex(p)), F.lit(p)) for p in patterns])) if patterns else F.array().cast("array<string>")
    return paths.select("path", F.explode(hits).alias("pattern"))


def guard_paths(paths: DataFrame, patterns: list[str]) -> None:
    from tidemark.operators.guards import expect_empty

    expect_empty(forbidden(paths, patterns), "forbidden paths")


def register_problems(entries: list[dict]) -> list[str]:
    """What is wrong with a register of sources: keys, methods, names, and includes that reach what is forbidden."""
    out, names = [], set()
    for e in entries:
        name = e.get("name", "?")
        out += [f"{name}: lacks {k}" for k in REQUIRED if k not in e]
        if e.get("method") not in METHODS:
            out.append(f"{name}: unknown method {e.get('method')}")
        if name in names:
            out.append(f"{name}: listed twice")
        names.add(name)
        banned = e.get("forbidden_patterns")
        if banned is None:
            out.append(f"{name}: forbidden_patterns may be empty, not null")
            continue
        include = e.get("include_patterns") or []
        if banned and not include and e.get("enabled"):
            out.append(f"{name}: fetches all, but forbids some")
        out += [f"{name}: include {i} reaches forbidden {f}" for i in include for f in banned if globs_overlap(i, f)]
        expected = e.get("expected")
        if expected is not None and not all(isinstance(k, str) and isinstance(v, int) and v > 0 for k, v in expected.items()):
            out.append(f"{name}: expected counts must be positive")
    return out


def audit_register(entries: list[dict]) -> None:
    if problems := register_problems(entries):
        raise GuardError("; ".join(problems))


def disk_projection(entries: DataFrame, raw_gb: float, reserve_gb: float, cap_gb: float) -> DataFrame:
    """projected, fits of (est_gb, on_disk_gb) of what is still to come."""
    total = F.lit(raw_gb) + F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("est_gb") - F.col("on_disk_gb"))), F.lit(0.0)) + F.lit(reserve_gb)
    return entries.agg(total.alias("projected")).select("projected", (F.col("projected") <= cap_gb).alias("fits"))


def publish_refusals(files: DataFrame) -> DataFrame:
    """path, reason of (path, header array<string>) that may not be published."""
    p = F.lower("path")
    starts = F.lit(False)
    for x in PRIVATE_PREFIXES:
        starts = starts | p.startswith(x)
    ends = F.lit(False)
    for x in DATA_SUFFIXES:
        ends = ends | p.endswith(x)
    header = F.transform(F.coalesce("header", F.array().cast("array<string>")), lambda c: F.lower(F.trim(c)))

    def any_of(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(header, F.array(*map(F.lit, names)))

    reason = F.when(starts, "private folder").when(ends, "data file").when(any_of(LABEL_FIELDS), "label column").when(any_of(URL_FIELDS), "url column")
    return files.select("path", reason.alias("reason")).where("reason is not null")


def compare_expected(expected: DataFrame, measured: DataFrame) -> DataFrame:
    """dataset, key, expected, measured, difference; a missing measure stays missing."""
    e = expected.select("dataset", F.explode("expected").alias("key", "expected"))
    return e.join(measured, ["dataset", "key"], "left").withColumn("difference", F.col("measured") - F.col("expected"))
