"""Shortcuts: how much a label can be told from what should not tell it.

Held-out figures come from one pass: counts are additive, so a model without
fold f is the total minus f's own counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import graph

FOLDS, SEED = 5, 20260901


def fold_of(key: Column, folds: int = FOLDS, seed: int = SEED) -> Column:
    """A fold by hash: the same wherever the row is."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(folds))


def majority_map(pairs: DataFrame) -> DataFrame:
    """key, top_label of (key, label); ties to the smaller label."""
    counts = pairs.groupBy("key", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("key").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("top_label"))


def fallback(pairs: DataFrame) -> DataFrame:
    """One row: the commonest label."""
    counts = pairs.groupBy("label").agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("common"))


def resubstitution(pairs: DataFrame) -> DataFrame:
    """accuracy of the majority map on its own pairs, and of the commonest label; from counts alone."""
    counts = pairs.groupBy("key", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("key").agg(F.max("n").alias("hit"), F.sum("n").alias("n")).agg((F.sum("hit") / F.sum("n")).alias("accuracy"))
    base = counts.groupBy("label").agg(F.sum("n").alias("n")).agg((F.max("n") / F.sum("n")).alias("baseline"))
    return best.crossJoin(base)


def held_out_accuracy(rows: DataFrame) -> DataFrame:
    """accuracy of majority maps fitted without each row's fold, from (key, label, fold); unseen keys get the commonest label."""
    counts = rows.groupBy("key", "label", "fold").agg(F.count("*").alias("n"))
    folds = rows.select("fold").distinct().withColumnRenamed("fold", "out")
    total = counts.groupBy("key", "label").agg(F.sum("n").alias("total"))
    own = counts.select("key", "label", F.col("fold").alias("out"), "n")
    # the few folds are broadcast; every key meets each of them once
    without = total.crossJoin(F.broadcast(folds)).join(own, ["key", "label", "out"], "left").select("key", "label", "out", (F.col("total") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    best = without.groupBy("key", "out").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("guess"))
    common = without.groupBy("out", "label").agg(F.sum("n").alias("n")).groupBy("out").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("common"))
    scored = own.join(best, ["key", "out"], "left").join(F.broadcast(common), "out")
    hit = F.sum(F.when(F.coalesce("guess", "common") == F.col("label"), F.col("n")).otherwise(0))
    return scored.agg((hit / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


def information(pairs: DataFrame) -> DataFrame:
    """h_x, h_y, mi, nmi_sqrt, nmi_mean (natural logs) of (x, y); 0 for nothing."""
    joint = pairs.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    marginal = joint.groupingSets([["x"], ["y"], []], "x", "y").agg(F.grouping_id().alias("g"), F.sum("n").alias("m"))
    total = marginal.where("g = 3").select(F.col("m").alias("t"))
    px, py = marginal.where("g = 1").select("x", F.col("m").alias("mx")), marginal.where("g = 2").select("y", F.col("m").alias("my"))
    mi = joint.join(px, "x").join(py, "y").crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("mx") * F.col("my")))).alias("mi"))
    hx = px.crossJoin(F.broadcast(total)).agg(F.sum(-F.col("mx") / F.col("t") * F.ln(F.col("mx") / F.col("t"))).alias("h_x"))
    hy = py.crossJoin(F.broadcast(total)).agg(F.sum(-F.col("my") / F.col("t") * F.ln(F.col("my") / F.col("t"))).alias("h_y"))
    zero = F.lit(0.0)
    one = hx.crossJoin(hy).crossJoin(mi).select(F.coalesce("h_x", zero).alias("h_x"), F.coalesce("h_y", zero).alias("h_y"), F.greatest(zero, F.coalesce("mi", zero)).alias("mi"))

    def share(by: Column) -> Column:
        return F.when(by > 1e-12, F.col("mi") / by).otherwise(zero)

    return one.select("*", share(F.sqrt(F.col("h_x") * F.col("h_y"))).alias("nmi_sqrt"), share((F.col("h_x") + F.col("h_y")) / 2).alias("nmi_mean"))


def auc(scored: DataFrame, n_before: DataFrame | None = None) -> DataFrame:
    """auc, n_pos, n_neg of (score, positive): equal scores share their mean rank.

    Scores are reduced to counts per distinct value, and ranks are running
    sums over ranges of values: no single task sorts all rows.
    """
    per = scored.groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.count("*").alias("n"))
    ranged = per.repartitionByRange("score").withColumn("part", F.spark_partition_id()).checkpoint() if n_before is None else n_before
    sums = ranged.groupBy("part").agg(F.sum("n").alias("m"))
    before = sums.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))
    run = F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    rank = F.col("before") + F.coalesce(run, F.lit(0)) + (F.col("n") + 1) / 2
    ranked = ranged.join(F.broadcast(before), "part").select("p", "n", rank.alias("rank"))
    out = ranked.agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("n_pos"), F.sum(F.col("n") - F.col("p")).alias("n_neg"))
    return out.select(((F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def class_scores(predicted: DataFrame) -> DataFrame:
    """label, support, precision, recall of (label, pred)."""
    counts = predicted.groupBy("label", "pred").agg(F.count("*").alias("n"))
    real = counts.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    said = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said"))
    out = real.join(said, "label", "full")
    return out.select("label", F.coalesce("support", F.lit(0)).alias("support"), F.try_divide(F.coalesce("tp", F.lit(0)), "said").alias("precision"), F.try_divide("tp", "support").alias("recall"))


def naive_bayes_held_out(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """id, label, pred of (id, label, text): multinomial, Laplace 1, tokens unseen in training skipped, ties to the smaller label.

    Counts of a fold's training part are what the other folds hold, so all
    folds are scored in one plan over one table of tokens.  A token adds
    k * ln(c + 1) to the classes that know it and k to what the document's
    known tokens are, which takes k * ln(denominator) from every class.  Rows
    without a label are left out; a text that is null or empty has no tokens
    and gets the likeliest class.
    """
    data = rows.where("label is not null").select("id", "label", "text", fold_of(F.col("id"), folds).alias("fold"))
    # texts are shuffled, not their tokens; the scan's partition splits an id that many rows share
    texts = data.withColumn("part", F.spark_partition_id()).repartition("id", "part")
    tokens = texts.select("id", "part", "label", "fold", F.explode(T.grams(F.col("text"))).alias("w")).where("w is not null").groupBy("id", "part", "label", "fold", "w").agg(F.count("*").alias("k"))
    graph.ready(rows.sparkSession)
    tokens = tokens.drop("part").checkpoint()

    def without(column: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("fold") != f, F.col(column)).otherwise(0)) for f in range(folds)])

    # per token a row for each class and one, of no class, for all of them
    known = tokens.groupingSets([["w", "label"], ["w"]], "w", "label").agg(without("k").alias("rest")).withColumnRenamed("label", "cls").checkpoint()
    c = F.element_at("rest", (F.col("fold") + 1).cast("int"))
    gain = F.when(F.col("cls").isNull(), F.col("k")).otherwise(F.col("k") * F.ln(c + 1))
    sums = tokens.select("id", "fold", "w", "k").join(known, "w").where(c > 0).groupBy("id", "cls").agg(F.sum(gain).alias("s"))
    # as many entries as there are classes
    per_id = sums.groupBy("id").agg(F.sum(F.when(F.col("cls").isNull(), F.col("s"))).alias("seen"), F.map_from_entries(F.collect_list(F.when(F.col("cls").isNotNull(), F.struct("cls", "s")))).alias("gains"))

    # a handful of rows per label and fold from here on
    def by_out(array: Column) -> Column:
        return F.posexplode(array).alias("out", "x")

    totals = known.groupBy("cls").agg(F.array(*[F.sum(F.col("rest")[f]) for f in range(folds)]).alias("mass"), F.array(*[F.count_if(F.col("rest")[f] > 0) for f in range(folds)]).alias("words"))
    mass = totals.where("cls is not null").select("cls", by_out(F.col("mass"))).withColumnRenamed("x", "mass")
    vocabulary = totals.where("cls is null").select(by_out(F.col("words"))).withColumnRenamed("x", "v")
    train = data.groupBy("label", "fold").agg(F.count("*").alias("n")).groupBy(F.col("label").alias("cls")).agg(without("n").alias("n")).select("cls", by_out(F.col("n"))).where("x > 0")
    documents = train.groupBy("out").agg(F.sum("x").alias("documents"))
    prior = train.join(documents, "out").join(mass, ["cls", "out"], "left").join(vocabulary, "out", "left")
    prior = prior.select("cls", "out", F.ln(F.col("x") / F.col("documents")).alias("prior"), F.ln(F.coalesce("mass", F.lit(0)) + F.col("v")).alias("ln_den"))
    everyone = data.select("id", "label", F.col("fold").alias("out")).join(per_id, "id", "left").join(F.broadcast(prior), "out")
    score = F.col("prior") + F.when(F.col("seen") > 0, F.coalesce(F.try_element_at("gains", F.col("cls")), F.lit(0.0)) - F.col("seen") * F.col("ln_den")).otherwise(0.0)
    return everyone.groupBy("id", "label").agg(F.min_by("cls", F.struct(-F.round(score, 6), F.col("cls"))).alias("pred"))


def complete_cases(items: DataFrame) -> DataFrame:
    """label, records, complete of (record, label, present): records all of whose items are there."""
    per = items.groupBy("record", "label").agg(F.bool_and("present").alias("whole"))
    return per.groupBy("label").agg(F.count("*").alias("records"), F.count_if("whole").alias("complete"))
