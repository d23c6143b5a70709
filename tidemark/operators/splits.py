"""Leakage-free splits: purity, placement of whole components, reconciliation, and their checks."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.guards import GuardError, expect_empty

# Fixed values.
SPLITS = ("train", "val", "test")
HELD_OUT_FIRST = ("test", "val", "train")
RATIOS = (0.70, 0.15, 0.15)
PURITY, THIN_SHARE, MIN_COPIES = 0.90, 0.25, 5


def held_out_rank(split):
    """0 for the most held-out split."""
    return F.array_position(F.array(*map(F.lit, HELD_OUT_FIRST)), split)


def domain_purity(pairs: DataFrame) -> DataFrame:
    """domain, records, top_label, purity (rounded to 4 places, as it is compared) from (domain, label)."""
    counts = pairs.groupBy("domain", "label").agg(F.count("*").alias("n"))
    top = counts.groupBy("domain").agg(F.sum("n").alias("records"), F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), F.col("label"))).alias("top"))
    return top.select("domain", "records", F.col("top.label").alias("top_label"), F.round(F.col("top.n") / F.col("records"), 4).alias("purity"))


def constrained(purity: DataFrame, mode: str = "predictive", threshold: float = PURITY) -> DataFrame:
    """The domains that may not be in two splits."""
    if mode not in ("predictive", "strict", "none"):
        raise GuardError(f"unknown mode {mode}")
    return purity.where({"predictive": F.col("purity") >= threshold, "strict": F.lit(True), "none": F.lit(False)}[mode])


class Greedy:
    """The sequential rule of placement: each component to the split that it overfills least.

    Ties: more room, then the more held-out split.
    """

    def __init__(self, totals: dict, ratios: tuple[float, ...] = RATIOS):
        self.room = {s: q * sum(totals.values()) for s, q in zip(SPLITS, ratios, strict=True)}
        self.left = {s: {c: q * n for c, n in totals.items()} for s, q in zip(SPLITS, ratios, strict=True)}

    def add(self, classes: dict, pin: str | None = None) -> str:
        """The split of the next component, given its class counts."""
        room, left = self.room, self.left
        split = pin or min(SPLITS, key=lambda s: (sum(max(0.0, n - left[s][k]) for k, n in classes.items()), -room[s], HELD_OUT_FIRST.index(s)))
        room[split] -= sum(classes.values())
        for k, n in classes.items():
            left[split][k] -= n
        return split


def place(components: DataFrame, ratios: tuple[float, ...] = RATIOS, pins: dict | None = None, most: int = 1_000_000) -> DataFrame:
    """(component, split) from (component, label, n): components by size, each to the split that it overfills least.

    The rule is sequential over components, so their class counts, not the
    records, come to the driver, all at once, hence the refusal beyond
    ``most``; ``placed_counts`` has no such bound.  Order: pinned ones, then
    size, then the smallest component.
    """
    spark = components.sparkSession
    if components.select("component").distinct().limit(most + 1).count() > most:
        raise GuardError(f"more than {most} components")
    counts: dict = {}
    for r in components.collect():
        counts.setdefault(r["component"], Counter())[r["label"]] += r["n"]
    pins = pins or {}
    rule = Greedy(sum(counts.values(), Counter()), ratios)
    order = sorted(counts, key=lambda c: (c not in pins, -sum(counts[c].values()), c))
    placed = [(c, rule.add(counts[c], pins.get(c))) for c in order]
    kind = components.schema["component"].dataType.simpleString()
    return spark.createDataFrame(placed, f"component {kind}, split string")


def placed_counts(components: DataFrame, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """(split, label, n) of ``place`` without pins, from (component, label, n), for any number of components.

    Spark sorts the components; their class counts pass through the driver
    one partition at a time, each component is placed by itself, and only the
    sums by split and label are kept.
    """
    spark = components.sparkSession
    rule = Greedy({r["label"]: r["n"] for r in components.groupBy("label").agg(F.sum("n").alias("n")).collect()}, ratios)
    one = components.groupBy("component", "label").agg(F.sum("n").alias("n"))
    one = one.groupBy("component").agg(F.sum("n").alias("size"), F.collect_list(F.struct("label", "n")).alias("classes"))
    sums: Counter = Counter()
    for (classes,) in one.orderBy(F.desc("size"), "component").select("classes").toLocalIterator(prefetchPartitions=True):
        split = rule.add(dict(classes))
        for label, n in classes:
            sums[split, label] += n
    kind = components.schema["label"].dataType.simpleString()
    return spark.createDataFrame([(s, k, n) for (s, k), n in sums.items()], f"split string, label {kind}, n long")


def leakage(records: DataFrame, threshold: float = PURITY) -> DataFrame:
    """Domains of at least the purity that are in two splits, from (domain, label, split)."""
    pure = constrained(domain_purity(records.select("domain", "label")), "predictive", threshold)
    spread = records.groupBy("domain").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return spread.where(F.size("splits") > 1).join(pure, "domain")


def assert_no_leakage(records: DataFrame, mode: str = "predictive", threshold: float = PURITY) -> None:
    if mode != "none":
        expect_empty(leakage(records, threshold), "domains that tell the label are in several splits")


def assert_feasible(components: DataFrame, ratios: tuple[float, ...] = RATIOS) -> None:
    """Refuse a corpus that is empty or whose largest component no split can hold."""
    sizes = components.groupBy("component").agg(F.sum("n").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if not sizes[1]:
        raise GuardError("an empty corpus can't be split")
    if sizes[0] > max(ratios) * sizes[1]:
        raise GuardError(f"the largest component has {sizes[0]} of {sizes[1]} records")


def constraint_groups(hashes: DataFrame, copies: DataFrame | None = None, least: int = MIN_COPIES) -> DataFrame:
    """(node, key) of records that must share a split, from (dataset, record_id, hash): many copies, or several datasets."""
    node = F.concat_ws("\x1f", "dataset", "record_id")
    groups = hashes.groupBy("hash").agg(F.count_distinct(node).alias("nodes"), F.count_distinct("dataset").alias("datasets"), F.count("*").alias("seen"))
    if copies is not None:
        groups = groups.join(copies, "hash", "left").withColumn("seen", F.coalesce("copies", "nodes"))
    kept = groups.where((F.col("nodes") > 1) & ((F.col("seen") >= least) | (F.col("datasets") > 1)))
    return hashes.join(kept.select("hash"), "hash").select(node.alias("node"), F.col("hash").alias("key")).distinct()


def reconcile(groups: DataFrame) -> DataFrame:
    """(node, split, target) from (group, node, split, pin, preferred): one split for each group.

    A pin decides, the most held-out of several; else the one split of the
    preferred records, if they have one; else the most held-out present.
    """
    rank = held_out_rank(F.col("split"))
    pinned = groups.where("pin is not null").groupBy("group").agg(F.min_by("pin", held_out_rank(F.col("pin"))).alias("by_pin"))
    rest = groups.groupBy("group").agg(F.min_by("split", rank).alias("most"), F.collect_set(F.when(F.col("preferred"), F.col("split"))).alias("kinds"))
    target = F.coalesce("by_pin", F.when(F.size("kinds") == 1, F.element_at("kinds", 1)), "most")
    return groups.join(rest.join(pinned, "group", "left").select("group", target.alias("target")), "group").select("group", "node", "split", "target")


def assert_atomic(placed: DataFrame) -> None:
    """Fail if a group (group, split) is in two splits."""
    expect_empty(placed.groupBy("group").agg(F.count_distinct("split").alias("n")).where("n > 1"), "groups in several splits")


def thin_classes(records: DataFrame, ratios: tuple[float, ...] = RATIOS, share: float = THIN_SHARE) -> DataFrame:
    """split, label, n, expected where a class has less than ``share`` of what its split should have; absent ones too."""
    spark = records.sparkSession
    want = spark.createDataFrame(list(zip(SPLITS, ratios, strict=True)), "split string, ratio double")
    totals = records.groupBy("label").agg(F.count("*").alias("total"))
    have = records.groupBy("split", "label").agg(F.count("*").alias("n"))
    grid = totals.crossJoin(F.broadcast(want)).join(have, ["split", "label"], "left")
    expected = F.col("total") * F.col("ratio")
    return grid.select("split", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), expected.alias("expected")).where(F.col("n") < F.col("expected") * share)


def host_baseline(records: DataFrame) -> DataFrame:
    """accuracy, majority, unseen of guessing the label of test rows from the domain alone, from (domain, label, split)."""
    from tidemark.operators.audit import fallback, majority_map

    train, test = records.where("split = 'train'"), records.where("split = 'test'")
    known, common = majority_map(train.select(F.col("domain").alias("key"), "label")), fallback(train)
    guessed = test.join(known, test["domain"] == known["key"], "left").crossJoin(F.broadcast(common))
    guess = F.coalesce("top_label", "common")
    return guessed.agg(
        F.avg((guess == F.col("label")).cast("double")).alias("accuracy"), F.avg((F.col("common") == F.col("label")).cast("double")).alias("majority"),
        F.avg(F.col("top_label").isNull().cast("double")).alias("unseen"), F.count("*").alias("n"),
    )


def size_histogram(components: DataFrame) -> DataFrame:
    """size, n of (node, component)."""
    return components.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def first_rank(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
