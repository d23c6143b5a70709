"""Time-filtered ranked search over an inverted index.

A document may answer a question dated D only if it is dated and not after D.
That condition stands inside the query, below ranking and limit, so that k
results are k admissible results.  Statistics are those of the whole index.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.guards import GuardError, expect_empty

# Fixed values of the ranking formula.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def as_of_date(value: str) -> str:
    if not isinstance(value, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        raise GuardError(f"as_of must be YYYY-MM-DD, not {value!r}")
    return value


def query_terms(query: str, stem: bool = False) -> list[str]:
    """Distinct terms of a query; anything but letters and digits only parts them."""
    words = T.fold(query) if stem else re.findall(r"[a-z0-9]+", query.lower())
    if not words:
        raise GuardError("the query has no terms")
    return sorted({T.porter(w) if stem else w for w in words})


def admissible(published: Column, as_of: str) -> Column:
    return published.isNotNull() & (published <= as_of_date(as_of))


def build_index(docs: DataFrame, stem: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings: term, doc_id, tf), (stats: doc_id, published_at, length) of dated documents (doc_id, title, text, published_at)."""
    body = F.concat_ws(" ", "title", "text")
    terms = T.stemmed_terms(body) if stem else T.search_terms(body)
    indexed = docs.where("published_at is not null").select("doc_id", "published_at", terms.alias("terms"))
    stats = indexed.select("doc_id", "published_at", F.size("terms").cast("long").alias("length"))
    postings = indexed.select("doc_id", F.explode("terms").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return postings, stats


def scores(postings: DataFrame, stats: DataFrame, terms: list[str], as_of: str, scope: str = "index") -> DataFrame:
    """doc_id, published_at, score of every admissible document that has a term; the best scores are the least.

    ``scope`` is "index", or "asof" for statistics of admissible documents only.
    """
    base = stats if scope == "index" else stats.where(admissible(F.col("published_at"), as_of))
    matched = postings.where(F.col("term").isin(terms))
    counted = matched if scope == "index" else matched.join(base.select("doc_id"), "doc_id", "left_semi")
    frequency = counted.groupBy("term").agg(F.count("*").alias("n"))
    totals = base.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    candidates = stats.where(admissible(F.col("published_at"), as_of))
    idf = F.greatest(F.lit(IDF_FLOOR), F.ln((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    idf = F.when((F.col("docs") - F.col("n") + 0.5) <= (F.col("n") + 0.5), F.lit(IDF_FLOOR)).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # one row per query term and one row of totals: bounded by the query
    joined = matched.join(F.broadcast(frequency), "term").join(candidates, "doc_id").crossJoin(F.broadcast(totals))
    return joined.groupBy("doc_id", "published_at").agg((-F.sum(part)).alias("score"))


def search(postings: DataFrame, stats: DataFrame, query: str, as_of: str, k: int = 10, stem: bool = False, scope: str = "index") -> DataFrame:
    """The k best admissible documents: doc_id, published_at, score; ties by doc_id."""
    return scores(postings, stats, query_terms(query, stem), as_of, scope).orderBy("score", "doc_id").limit(k)


def red_test(docs: DataFrame, query: str, as_of: str, before: str, after: str, ks: tuple[int, ...] = (1, 5, 1_000_000)) -> None:
    """Plant a past, a future and an undated document that match best, and fail if the wrong ones are found."""
    spark = docs.sparkSession
    body = " ".join([query] * 50)
    planted = spark.createDataFrame([(-1, "", body, before), (-2, "", body, after), (-3, "", body, None)], "doc_id long, title string, text string, published_at string")
    postings, stats = build_index(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "text", "published_at").unionByName(planted))
    for k in ks:
        found = search(postings, stats, query, as_of, k)
        expect_empty(found.where(F.col("doc_id").isin(-2, -3) | ~admissible(F.col("published_at"), as_of)), f"inadmissible documents at k={k}")
        if not found.where("doc_id = -1").count():
            raise GuardError(f"the admissible planted document is missing at k={k}")
