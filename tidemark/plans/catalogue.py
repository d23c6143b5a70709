"""The registered queries: each operator on the driver's tables, with the same in DuckDB's SQL.

No table has a publication date, an image or a corpus name, so fixed stand-ins
are derived from ids; both engines use the same expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text, urls
from tidemark.operators import assets, audit, graph, labels, ledger, manifest, retrieval, sampling, splits, store, vectors
from tidemark.registry import query
from tidemark.streaming import ingest

TODAY, AS_OF, QUERY = "2026-09-11", "2019-06-15", "license released idiot scum"
DATASETS = ("verite", "mocheg", "averitec", "averimatec", "m4fc", "factify2", "liar", "dgm4")
LABELS = ("Refuted", "Supported", "Not Enough Evidence", "true", "false", "refuted", "NEI", "Support_Text", "Conflicting Evidence/Cherrypicking", "miscaptioned")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def published(key: str = "doc_id") -> Column:
    k = F.col(key)
    day = F.date_format(F.date_add(F.lit("2016-01-01").cast("date"), (k * 37 % 2900).cast("int")), "yyyy-MM-dd")
    return F.when(k % 50 == 0, None).when(k % 50 == 1, "1970-01-01").when(k % 50 == 2, "1395-06-03").otherwise(day)


DAY = "CASE doc_id % 50 WHEN 0 THEN NULL WHEN 1 THEN '1970-01-01' WHEN 2 THEN '1395-06-03' ELSE strftime(DATE '2016-01-01' + CAST(doc_id * 37 % 2900 AS INTEGER), '%Y-%m-%d') END"
VERDICT = f"""CASE WHEN published_at IS NULL THEN 'ok' WHEN CAST(substr(published_at, 1, 4) AS INTEGER) BETWEEN 1300 AND 1450 OR CAST(substr(published_at, 1, 4) AS INTEGER) BETWEEN 2400 AND 2600 THEN 'non_gregorian'
 WHEN published_at IN ('1969-12-31', '1970-01-01', '1970-01-02', '1901-12-13', '1901-12-14') THEN 'sentinel' WHEN published_at < '1900-01-01' OR published_at > '{TODAY}' THEN 'out_of_window' ELSE 'ok' END"""
DATED = f"raw AS (SELECT *, {DAY} AS published_at FROM documents), dated AS (SELECT * EXCLUDE (published_at), CASE WHEN {VERDICT} IN ('ok', 'non_gregorian') THEN published_at END AS published_at, {VERDICT} AS verdict FROM raw)"


def dated(spark: SparkSession, sf: str) -> DataFrame:
    """documents with the stand-in date, implausible ones refused."""
    docs = table(spark, sf, "documents").withColumn("raw_at", published())
    return docs.withColumns({"published_at": dates.kept_date(F.col("raw_at"), TODAY), "verdict": dates.verdict(F.col("raw_at"), TODAY)})


def marked(spark: SparkSession, sf: str) -> DataFrame:
    """documents with their labels."""
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "text").join(table(spark, sf, "labels"), "doc_id")


def quoted(values) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in row) + ")" for row in values)


# --------------------------------------------------------------------------- retrieval

_TERMS = f"""terms AS (SELECT doc_id, published_at, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM dated WHERE published_at IS NOT NULL),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM terms) WHERE term IN ({", ".join(f"'{t}'" for t in QUERY.split())}) GROUP BY doc_id, term)"""


def _index(spark, sf):
    return retrieval.build_index(dated(spark, sf).withColumn("title", F.lit("")))


def _bm25(scope: str) -> str:
    base = "terms" if scope == "index" else f"(SELECT * FROM terms WHERE published_at <= '{AS_OF}')"
    counted = "post" if scope == "index" else f"(SELECT post.* FROM post JOIN terms USING (doc_id) WHERE published_at <= '{AS_OF}')"
    return f"""WITH {DATED}, {_TERMS}, tot AS (SELECT count(*) AS d, avg(len(ws)) AS mean FROM {base}), df AS (SELECT term, count(*) AS n FROM {counted} GROUP BY term)
SELECT doc_id, published_at, round(-sum((CASE WHEN d - n + 0.5 <= n + 0.5 THEN 1e-6 ELSE greatest(1e-6, ln((d - n + 0.5) / (n + 0.5))) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))), 9) AS score
FROM post JOIN df USING (term) JOIN terms USING (doc_id) CROSS JOIN tot WHERE published_at <= '{AS_OF}' GROUP BY doc_id, published_at ORDER BY score, doc_id LIMIT 10"""


@query(_bm25("index"))
def bm25_asof_topk(spark, sf):
    found = retrieval.scores(*_index(spark, sf), retrieval.query_terms(QUERY), AS_OF)
    return found.withColumn("score", F.round("score", 9)).orderBy("score", "doc_id").limit(10)


@query(_bm25("asof"))
def bm25_asof_statistics(spark, sf):
    found = retrieval.scores(*_index(spark, sf), retrieval.query_terms(QUERY), AS_OF, scope="asof")
    return found.withColumn("score", F.round("score", 9)).orderBy("score", "doc_id").limit(10)


@query()
def bm25_stemmed_topk(spark, sf):
    docs = dated(spark, sf).withColumn("title", F.lit(""))
    return retrieval.search(*retrieval.build_index(docs, stem=True), QUERY, AS_OF, 10, stem=True)


@query(f"WITH {DATED}, {_TERMS} SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences FROM post GROUP BY term")
def bm25_term_stats(spark, sf):
    postings, _ = _index(spark, sf)
    return postings.where(F.col("term").isin(*QUERY.split())).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@query(f"WITH {DATED} SELECT count(*) AS n, count(*) FILTER (published_at IS NULL) AS undated, count(*) FILTER (published_at > '{AS_OF}') AS later, count(*) FILTER (published_at <= '{AS_OF}') AS admissible FROM dated")
def asof_excluded_counts(spark, sf):
    at = F.col("published_at")
    return dated(spark, sf).agg(F.count("*").alias("n"), F.count_if(at.isNull()).alias("undated"), F.count_if(at > AS_OF).alias("later"), F.count_if(retrieval.admissible(at, AS_OF)).alias("admissible"))


# --------------------------------------------------------------------------- dates and URLs


@query(f"WITH {DATED} SELECT verdict, count(*) AS n FROM dated GROUP BY verdict")
def date_classify_counts(spark, sf):
    return dated(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


ISO = (
    ("2023-03-17", "2023-03-17"), ("2019-07-01T10:00:00Z", "2019-07-01"), ("on 2020-02-30 or 17 March 2023", None), ("17 March 2023", "2023-03-17"), ("5 may 1999", "1999-05-05"),
    ("25-8-2020", "2020-08-25"), ("8-25-2020", None), ("1500000000", "2017-07-14"), ("1500000000.5", "2017-07-14"), ("12345", None), ("2019-07-011", None), ("nan", None), ("", None), ("-", None), ("31 Foo 2020", None), ("x 2019-07-01", "2019-07-01"),
)


@query(f"SELECT v AS value, d AS date FROM (VALUES {quoted(ISO)}) AS t(v, d)")
def iso_date_vectors(spark, sf):
    return spark.createDataFrame([(v,) for v, _ in ISO], "value string").select("value", dates.iso_date(F.col("value")).alias("date"))


URL_DATES = (
    ("https://a.ex/2019-05-03/x", "2019-05-03", "url_path"), ("https://a.ex/2019/05/03/", "2019-05-03", "url_path"), ("https://web.archive.org/web/20210412093000/https://a.ex/2019/05/03/x", "2019-05-03", "url_path"),
    ("https://web.archive.org/web/20210412093000/https://a.ex/x", "2021-04-12", "wayback_capture"), ("https://a.ex/2019/13/03/", None, "none"), ("https://a.ex/x", None, "none"), (None, None, "none"),
)


@query(f"SELECT u AS url, d AS date, s AS source FROM (VALUES {quoted(URL_DATES)}) AS t(u, d, s)")
def url_date_vectors(spark, sf):
    return spark.createDataFrame([(u,) for u, _, _ in URL_DATES], "url string").withColumn("d", dates.url_date(F.col("url"))).select("url", "d.date", "d.source")


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]+)', 1)), '^www\.', '')"


@query(f"SELECT CASE WHEN {_HOST} = '' THEN 'unknown' ELSE {_HOST} END AS domain, count(*) AS n FROM pages GROUP BY 1")
def domain_of_pages(spark, sf):
    return table(spark, sf, "pages").groupBy(urls.host(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


_VARIANTS = "(SELECT url FROM pages UNION ALL SELECT replace(url, 'https://', 'http://www.') || '#top' FROM pages)"


@query(rf"""SELECT {_HOST} || regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', ''), '^[^/?]*', '') AS url, count(*) AS n FROM {_VARIANTS} AS v GROUP BY 1 HAVING count(*) > 1""")
def norm_url_dupes(spark, sf):
    pages = table(spark, sf, "pages").select("url")
    other = pages.select(F.concat(F.replace("url", F.lit("https://"), F.lit("http://www.")), F.lit("#top")).alias("url"))
    return pages.unionAll(other).select(urls.comparable(F.col("url")).alias("url")).groupBy("url").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT page_id, sha256(url) AS id FROM pages")
def content_hash_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("url", 256).alias("id"))


# --------------------------------------------------------------------------- pages to text

_BODY = "html"
for _tag in text.CHROME:
    _BODY = rf"regexp_replace({_BODY}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_BODY = rf"trim(regexp_replace(regexp_replace({_BODY}, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({_BODY}) AS n, md5({_BODY}) AS digest FROM pages")
def html_strip_stats(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages")
def title_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.title_of(F.col("html")).alias("title"))


_MARKED = " OR ".join(f"contains(lower(substr(html, 1, 4096)), '{m}')" for m in text.MARKERS)


@query(f"SELECT strlen(html) >= 1500 AND ({_MARKED}) AS kept, count(*) AS n FROM pages GROUP BY 1")
def prefilter_counts(spark, sf):
    return table(spark, sf, "pages").groupBy(text.may_be_article(F.col("html")).alias("kept")).agg(F.count("*").alias("n"))


@query()
def page_documents(spark, sf):
    return store.page_documents(table(spark, sf, "pages"), TODAY).select("doc_id", "title", "published_at", "date_source", "source_domain", "content_sha256")


@query()
def html_parser_lengths(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(text.html_to_text("html")).alias("n"))


@query("SELECT page_id, 'none' AS source, 'none' AS confidence FROM pages")
def page_date_sources(spark, sf):
    return table(spark, sf, "pages").select("page_id", dates.page_date(F.col("html"), F.lit(None).cast("string"), F.col("url")).alias("d")).select("page_id", "d.source", "d.confidence")


# --------------------------------------------------------------------------- store

_STORE = f"{DATED}, s AS (SELECT CASE WHEN verdict IN ('sentinel', 'out_of_window') THEN 'implausible_date' WHEN published_at IS NULL THEN 'none' ELSE 'explicit_field' END AS date_source, CASE WHEN published_at IS NULL THEN 'none' ELSE 'high' END AS date_confidence, source AS source_domain, published_at FROM dated)"


def _store(spark, sf):
    source = F.when(F.col("verdict").isin("sentinel", "out_of_window"), "implausible_date").when(F.col("published_at").isNull(), "none").otherwise("explicit_field")
    return dated(spark, sf).select(source.alias("date_source"), F.when(F.col("published_at").isNull(), "none").otherwise("high").alias("date_confidence"), F.col("source").alias("source_domain"), "published_at")


@query(f"WITH {_STORE} SELECT 'source' AS dimension, date_source AS a, NULL AS b, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'confidence', date_confidence, NULL, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'domain', source_domain, NULL, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'source_confidence', date_source, date_confidence, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'all', NULL, NULL, count(*) FROM s")
def store_report(spark, sf):
    return store.report(_store(spark, sf))


@query(f"WITH {_STORE} SELECT substr(published_at, 1, 4) AS year, count(*) AS n FROM s WHERE published_at IS NOT NULL GROUP BY 1")
def store_by_year(spark, sf):
    return store.by_year(_store(spark, sf))


@query(f"WITH {DATED} SELECT source, count(*) AS docs, count(published_at) AS indexed, min(published_at) AS first, max(published_at) AS last, round(avg(CASE WHEN published_at <= '{AS_OF}' THEN 1.0 WHEN published_at IS NOT NULL THEN 0.0 END), 4) AS predates FROM dated GROUP BY source")
def store_report_by_source(spark, sf):
    at = F.col("published_at")
    return dated(spark, sf).groupBy("source").agg(F.count("*").alias("docs"), F.count("published_at").alias("indexed"), F.min(at).alias("first"), F.max(at).alias("last"), F.round(F.avg((at <= AS_OF).cast("double")), 4).alias("predates"))


@query("SELECT md5(text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_first_wins(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5("text").alias("key"), "doc_id")
    return store.first_wins(docs, ["key"], F.col("doc_id")).select("key", "doc_id")


@query("SELECT doc_id, k || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS record_id FROM (SELECT doc_id, substr(md5(text), 1, 16) AS k, row_number() OVER (PARTITION BY substr(md5(text), 1, 16) ORDER BY doc_id) AS n FROM documents)")
def occurrence_suffix(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.substring(F.md5("text"), 1, 16).alias("k"))
    return store.occurrence_suffix(docs, "k", "doc_id").select("doc_id", "record_id")


@query("SELECT count(*) FILTER (doc_id % 3 = 0) AS skipped, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 50 NOT IN (0, 1)) AS indexed, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 50 IN (0, 1)) AS quarantined FROM documents")
def ingest_counts(spark, sf):
    docs = dated(spark, sf).select("doc_id", "published_at")
    parts = store.ingest(docs, docs.where("doc_id % 3 = 0"))
    counted = [p.agg(F.count("*").alias(n)) for p, n in zip(parts, ("indexed", "quarantined", "skipped"), strict=True)]
    return counted[2].crossJoin(counted[0]).crossJoin(counted[1])


# --------------------------------------------------------------------------- copies and corpora


def _files(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("record_id"), F.sha2("text", 256).alias("sha256"), "doc_id")


@query("SELECT sha256(text) AS sha256, count(*) AS copies, count(DISTINCT source) AS datasets, min(source) AS owner FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups_copies(spark, sf):
    return assets.copies(_files(spark, sf)).where("copies > 1")


@query("SELECT source AS dataset, count(*) FILTER (c = 1) AS single, count(*) FILTER (c BETWEEN 2 AND 4 AND source = owner) AS few FROM (SELECT source, count(*) OVER (PARTITION BY md5(text)) AS c, min(source) OVER (PARTITION BY md5(text)) AS owner FROM documents) GROUP BY source")
def single_and_few_copy(spark, sf):
    files = _files(spark, sf)
    # the counts are joined back, so that a large group of copies isn't one window
    c = assets.copies(files).select("sha256", "copies", "owner")
    return files.join(c, "sha256").groupBy("dataset").agg(F.count_if(F.col("copies") == 1).alias("single"), F.count_if(F.col("copies").between(2, 4) & (F.col("dataset") == F.col("owner"))).alias("few"))


@query("SELECT sha256, array_to_string(list_sort(list(DISTINCT source)), ',') AS datasets, count(*) AS records FROM (SELECT sha256(text) AS sha256, source FROM documents) GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_corpus_hashes(spark, sf):
    out = assets.cross_corpus(_files(spark, sf))
    return out.select("sha256", F.array_join("datasets", ",").alias("datasets"), F.aggregate("members", F.lit(0), lambda s, m: s + F.size(m["record_ids"])).cast("long").alias("records"))


@query("SELECT DISTINCT CAST(b.doc_id AS VARCHAR) AS record_id FROM documents b JOIN documents a ON md5(a.text) = md5(b.text) WHERE a.source = 'src1' AND b.source = 'src2'")
def excluded_keys(spark, sf):
    return assets.excluded_ids(assets.cross_corpus(_files(spark, sf)), "src1", "src2")


@query("SELECT doc_id FROM documents WHERE source = 'src2' AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src1')")
def excluded_keys_antijoin(spark, sf):
    files = _files(spark, sf)
    shared = assets.excluded_ids(assets.cross_corpus(files), "src1", "src2")
    return files.where("dataset = 'src2'").join(shared, "record_id", "left_anti").select("doc_id")


@query("SELECT text, count(*) AS uses FROM conversations GROUP BY text HAVING count(*) >= 2")
def caption_reuse(spark, sf):
    return table(spark, sf, "conversations").groupBy("text").agg(F.count("*").alias("uses")).where("uses >= 2")


@query("SELECT md5(text) AS h FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT md5(text) FROM documents WHERE doc_id % 3 <> 0")
def straddle_intersect(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return docs.where("doc_id % 3 = 0").select("h").intersect(docs.where("doc_id % 3 <> 0").select("h"))


# --------------------------------------------------------------------------- purity, confounds, classifiers

_MARKED_SQL = "m AS (SELECT d.doc_id, d.lang, d.source, d.text, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"
_FOLD = "CAST(('0x' || substr(md5('20260901|' || {}), 1, 8)) AS BIGINT) % 5"
_TOP = "SELECT {k} AS k, quality AS label, count(*) AS n FROM m GROUP BY 1, 2"
_PURITY = "c AS (SELECT source AS domain, quality AS label, count(*) AS n FROM m GROUP BY 1, 2), p AS (SELECT domain, CAST(sum(n) AS BIGINT) AS records, first(label ORDER BY n DESC, label) AS top_label, round(max(n) / sum(n), 4) AS purity FROM c GROUP BY domain)"


def _pairs(spark, sf, key: str = "source"):
    return marked(spark, sf).select(F.col(key).alias("key"), F.col("quality").alias("label"), "doc_id")


def _domains(spark, sf):
    return marked(spark, sf).select(F.col("source").alias("domain"), F.col("quality").alias("label"), "doc_id")


@query(f"WITH {_MARKED_SQL}, {_PURITY} SELECT * FROM p")
def domain_purity(spark, sf):
    return splits.domain_purity(_domains(spark, sf))


@query(f"WITH {_MARKED_SQL}, {_PURITY} SELECT domain FROM p WHERE purity >= 0.9")
def constrained_domains(spark, sf):
    return splits.constrained(splits.domain_purity(_domains(spark, sf))).select("domain")


@query(f"WITH {_MARKED_SQL}, c AS ({_TOP.format(k='lang')}) SELECT k AS key, first(label ORDER BY n DESC, label) AS top_label FROM c GROUP BY k")
def majority_map(spark, sf):
    return audit.majority_map(_pairs(spark, sf, "lang"))


@query(f"WITH {_MARKED_SQL}, c AS ({_TOP.format(k='source')}) SELECT round((SELECT sum(b) FROM (SELECT max(n) AS b FROM c GROUP BY k)) / (SELECT sum(n) FROM c), 6) AS accuracy, round((SELECT max(b) FROM (SELECT sum(n) AS b FROM c GROUP BY label)) / (SELECT sum(n) FROM c), 6) AS baseline")
def resubstitution_accuracy(spark, sf):
    return audit.resubstitution(_pairs(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"), F.round("baseline", 6).alias("baseline"))


def _held_out(fold: str) -> str:
    return f"""WITH {_MARKED_SQL}, r AS (SELECT source AS k, quality AS label, {fold} AS f FROM m), folds AS (SELECT DISTINCT f AS o FROM r),
t AS (SELECT o, k, label, count(*) AS n FROM r JOIN folds ON r.f <> folds.o GROUP BY ALL), best AS (SELECT o, k, first(label ORDER BY n DESC, label) AS g FROM t GROUP BY o, k),
common AS (SELECT o, first(label ORDER BY n DESC, label) AS g FROM (SELECT o, label, sum(n) AS n FROM t GROUP BY ALL) GROUP BY o)
SELECT round(avg(CASE WHEN coalesce(best.g, common.g) = r.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM r JOIN common ON r.f = common.o LEFT JOIN best ON best.o = r.f AND best.k = r.k"""


@query(_held_out(_FOLD.format("doc_id")))
def heldout_accuracy(spark, sf):
    return audit.held_out_accuracy(_pairs(spark, sf).withColumn("fold", audit.fold_of(F.col("doc_id")))).select(F.round("accuracy", 6).alias("accuracy"), "n")


@query(_held_out(_FOLD.format("md5(text)")))
def grouped_heldout_accuracy(spark, sf):
    rows = marked(spark, sf).select(F.col("source").alias("key"), F.col("quality").alias("label"), audit.fold_of(F.md5("text")).alias("fold"))
    return audit.held_out_accuracy(rows).select(F.round("accuracy", 6).alias("accuracy"), "n")


@query(f"""WITH {_MARKED_SQL}, j AS (SELECT source AS x, quality AS y, CAST(count(*) AS DOUBLE) AS n FROM m GROUP BY ALL), t AS (SELECT sum(n) AS t FROM j), px AS (SELECT x, sum(n) AS mx FROM j GROUP BY x), py AS (SELECT y, sum(n) AS my FROM j GROUP BY y),
h AS (SELECT (SELECT sum(-mx / t * ln(mx / t)) FROM px, t) AS h_x, (SELECT sum(-my / t * ln(my / t)) FROM py, t) AS h_y, (SELECT greatest(0, sum(n / t * ln(n * t / (mx * my)))) FROM j JOIN px USING (x) JOIN py USING (y) CROSS JOIN t) AS mi)
SELECT round(h_x, 9) AS h_x, round(h_y, 9) AS h_y, round(mi, 9) AS mi, round(mi / sqrt(h_x * h_y), 9) AS nmi_sqrt, round(mi / ((h_x + h_y) / 2), 9) AS nmi_mean FROM h""")
def entropy_mi_nmi(spark, sf):
    out = audit.information(marked(spark, sf).select(F.col("source").alias("x"), F.col("quality").alias("y")))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


_SPLIT = "CASE WHEN {k} % 20 < 14 THEN 'train' WHEN {k} % 20 < 17 THEN 'val' ELSE 'test' END"


def split_of(key: str = "doc_id") -> Column:
    k = F.col(key) % 20
    return F.when(k < 14, "train").when(k < 17, "val").otherwise("test")


@query(f"""WITH {_MARKED_SQL}, r AS (SELECT source AS k, quality AS label, {_SPLIT.format(k='doc_id')} AS split FROM m), c AS (SELECT k, label, count(*) AS n FROM r WHERE split = 'train' GROUP BY ALL),
best AS (SELECT k, first(label ORDER BY n DESC, label) AS g FROM c GROUP BY k), common AS (SELECT first(label ORDER BY n DESC, label) AS g FROM (SELECT label, sum(n) AS n FROM c GROUP BY label))
SELECT round(avg(CAST(coalesce(best.g, common.g) = label AS INTEGER)), 6) AS accuracy, round(avg(CAST(common.g = label AS INTEGER)), 6) AS majority, round(avg(CAST(best.g IS NULL AS INTEGER)), 6) AS unseen, count(*) AS n FROM r LEFT JOIN best USING (k) CROSS JOIN common WHERE split = 'test'""")
def hostname_baseline(spark, sf):
    out = splits.host_baseline(_domains(spark, sf).withColumn("split", split_of()))
    return out.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "majority", "unseen")], "n")


@query("SELECT role AS label, count(*) AS records, count(*) FILTER (whole) AS complete FROM (SELECT conv_id, role, bool_and(text IS NOT NULL AND length(text) >= 40) AS whole FROM conversations GROUP BY ALL) GROUP BY role")
def complete_cases(spark, sf):
    items = table(spark, sf, "conversations").select(F.col("conv_id").alias("record"), F.col("role").alias("label"), F.coalesce(F.length("text") >= 40, F.lit(False)).alias("present"))
    return audit.complete_cases(items)


@query(f"WITH {_MARKED_SQL}, c AS (SELECT quality AS label, source, count(*) AS n FROM m GROUP BY ALL) SELECT label, first(source ORDER BY n DESC, source) AS top, max(n) AS n, round(max(n) / sum(n), 6) AS share FROM c GROUP BY label")
def per_class_top_domain(spark, sf):
    counts = marked(spark, sf).groupBy(F.col("quality").alias("label"), "source").agg(F.count("*").alias("c"))
    return counts.groupBy("label").agg(F.min_by("source", F.struct(-F.col("c"), F.col("source"))).alias("top"), F.max("c").alias("n"), F.round(F.max("c") / F.sum("c"), 6).alias("share"))


@query(f"WITH {_MARKED_SQL} SELECT source, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1 FROM m GROUP BY source")
def crosstab_class_source(spark, sf):
    return marked(spark, sf).groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("q0"), F.count_if(F.col("quality") == 1).alias("q1"))


@query(f"WITH {_MARKED_SQL}, {_PURITY}, s AS (SELECT source AS domain, array_to_string(list_sort(list(DISTINCT {_SPLIT.format(k='doc_id')})), ',') AS splits, count(DISTINCT {_SPLIT.format(k='doc_id')}) AS k FROM m GROUP BY source) SELECT domain, splits, purity FROM s JOIN p USING (domain) WHERE k > 1 AND purity >= 0.85")
def leakage_violations(spark, sf):
    found = splits.leakage(_domains(spark, sf).withColumn("split", split_of()), 0.85)
    return found.select("domain", F.array_join("splits", ",").alias("splits"), "purity")


@query(f"WITH {_MARKED_SQL}, t AS (SELECT quality AS label, count(*) AS total FROM m GROUP BY 1), w AS (SELECT * FROM (VALUES ('train', 0.70), ('val', 0.15), ('test', 0.15)) AS v(split, ratio)), h AS (SELECT quality AS label, CASE WHEN doc_id % 20 < 17 THEN 'train' WHEN doc_id % 20 < 19 OR quality = 1 THEN 'test' ELSE 'val' END AS split, count(*) AS n FROM m GROUP BY ALL) SELECT split, label, coalesce(n, 0) AS n, round(CAST(total AS DOUBLE) * CAST(ratio AS DOUBLE), 6) AS expected FROM t CROSS JOIN w LEFT JOIN h USING (split, label) WHERE coalesce(n, 0) < total * ratio * 0.25")
def thin_classes(spark, sf):
    k = F.col("doc_id") % 20
    rows = _domains(spark, sf).withColumn("split", F.when(k < 17, "train").when((k < 19) | (F.col("label") == 1), "test").otherwise("val"))
    return splits.thin_classes(rows).withColumn("expected", F.round("expected", 6))


_RECURSIVE = "k AS (SELECT doc_id, md5(text) AS key FROM documents UNION SELECT doc_id, 'p' || md5(substr(text, 1, 80)) FROM documents), e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b USING (key)), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"


def _components(spark, sf):
    docs = table(spark, sf, "documents")
    keys = docs.select(F.col("doc_id").alias("node"), F.explode(F.array(F.md5("text"), F.concat(F.lit("p"), F.md5(F.substring("text", 1, 80))))).alias("key"))
    return graph.components(keys)


@query(f"WITH RECURSIVE {_RECURSIVE} SELECT size, count(*) AS n FROM (SELECT component, count(*) AS size FROM comp GROUP BY component) GROUP BY size")
def components_histogram(spark, sf):
    return splits.size_histogram(_components(spark, sf))


@query(f"WITH RECURSIVE {_RECURSIVE} SELECT node, component FROM comp")
def record_components(spark, sf):
    return _components(spark, sf)


@query()
def greedy_split_sizes(spark, sf):
    """Whole components to splits, each by itself; their class counts pass through the driver in the order of placement."""
    rows = _components(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("node"), F.col("quality").alias("label")), "node")
    return splits.placed_counts(rows.groupBy("component", "label").agg(F.count("*").alias("n")))


@query(f"""WITH g AS (SELECT md5(text) AS grp, doc_id, CASE WHEN source = 'src1' THEN 'test' ELSE {_SPLIT.format(k='doc_id')} END AS split, CASE WHEN source = 'src1' THEN 'test' WHEN source = 'src2' THEN 'val' END AS pin, source = 'src0' AS preferred FROM documents),
r AS (SELECT grp, min(CASE pin WHEN 'test' THEN 1 WHEN 'val' THEN 2 END) AS p, min(CASE split WHEN 'test' THEN 1 WHEN 'val' THEN 2 ELSE 3 END) AS m, count(DISTINCT split) FILTER (preferred) AS k, min(split) FILTER (preferred) AS one FROM g GROUP BY grp),
t AS (SELECT g.doc_id, g.split, coalesce(CASE p WHEN 1 THEN 'test' WHEN 2 THEN 'val' END, CASE WHEN k = 1 THEN one END, CASE m WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END) AS target FROM g JOIN r USING (grp))
SELECT split, target, count(*) AS n FROM t GROUP BY ALL""")
def reconcile_groups(spark, sf):
    docs = table(spark, sf, "documents")
    pin = F.when(F.col("source") == "src1", "test").when(F.col("source") == "src2", "val")
    rows = docs.select(F.md5("text").alias("group"), F.col("doc_id").alias("node"), F.when(F.col("source") == "src1", "test").otherwise(split_of()).alias("split"), pin.alias("pin"), (F.col("source") == "src0").alias("preferred"))
    return splits.reconcile(rows).groupBy("split", "target").agg(F.count("*").alias("n"))


@query("SELECT source || chr(31) || CAST(doc_id AS VARCHAR) AS node, h AS key FROM (SELECT source, doc_id, md5(text) AS h, count(*) OVER (PARTITION BY md5(text)) AS c FROM documents) WHERE c > 1 AND (c >= 5 OR (SELECT count(DISTINCT d.source) FROM documents d WHERE md5(d.text) = h) > 1)")
def constraint_groups(spark, sf):
    return splits.constraint_groups(table(spark, sf, "documents").select(F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("record_id"), F.md5("text").alias("hash")))


# --------------------------------------------------------------------------- labels and usability

CODED = tuple((d, k, c) for d, k, c in labels.CODES) + (("liar", "true", "unmapped"), ("dgm4", "text_swap", "unmapped"), ("averitec", "Conflicting Evidence/Cherrypicking", None), ("verite", "odd", None), ("mocheg", None, None))


@query(f"SELECT * FROM (VALUES {quoted(CODED)}) AS t(dataset, label, reason_code)")
def reason_code_map(spark, sf):
    rows = spark.createDataFrame([(d, k) for d, k, _ in CODED], "dataset string, label string")
    return rows.withColumn("reason_code", labels.reason_code(F.col("dataset"), F.col("label")))


_PICK = "list_value({})[CAST({} % {} AS INTEGER) + 1]"
_ROWS_SQL = f"r AS (SELECT doc_id, {_PICK.format(', '.join(repr(d) for d in DATASETS), 'doc_id', len(DATASETS))} AS dataset, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {_PICK.format(', '.join(repr(d) for d in LABELS), '(doc_id // 8)', len(LABELS))} END AS label, {_SPLIT.format(k='doc_id')} AS split FROM documents), codes(dataset, label, code) AS (VALUES {quoted(labels.CODES)}), coded AS (SELECT r.*, CASE WHEN dataset IN ('welfake', 'liar', 'fakenewsnet', 'fakeddit', 'isot', 'dgm4') THEN 'unmapped' ELSE code END AS reason_code FROM r LEFT JOIN codes USING (dataset, label))"


def _labelled(spark, sf):
    k = F.col("doc_id")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names)).cast("int") + 1)
    return table(spark, sf, "documents").select("doc_id", pick(DATASETS, k).alias("dataset"), F.when(k % 17 == 0, None).otherwise(pick(LABELS, F.floor(k / 8))).alias("label"), split_of().alias("split"))


@query(f"""WITH {_ROWS_SQL}, b AS (SELECT dataset, coalesce(reason_code, 'null:' || CASE WHEN label IS NULL THEN 'unlabelled' WHEN dataset IN ('averitec', 'averimatec') AND label = 'Conflicting Evidence/Cherrypicking' THEN 'no_clean_code' ELSE 'unexpected' END) AS bucket FROM coded)
SELECT dataset, bucket, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT dataset, NULL, count(*) FROM b GROUP BY dataset""")
def reason_distribution(spark, sf):
    return labels.distribution(_labelled(spark, sf))


@query(f"WITH {_ROWS_SQL} SELECT doc_id, dataset, reason_code FROM coded WHERE split = 'train' AND reason_code IN ('content_refuted', 'content_unverified', 'media_mismatch', 'wrong_image', 'none') AND dataset NOT IN ('averimatec', 'verite')")
def supervised_rows(spark, sf):
    return labels.supervised(labels.with_codes(_labelled(spark, sf)), "train", "train").select("doc_id", "dataset", "reason_code")


_SLOTS = "CASE WHEN doc_id % 7 = 0 THEN 'placeholder' WHEN doc_id % 5 = 0 THEN 'undecodable' ELSE 'usable' END"
_USE_SQL = f"u AS (SELECT doc_id, lang, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'x' END AS label, doc_id % 13 = 0 AS conflict, CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE text END AS text, CAST(({_SLOTS} <> 'usable') AS INTEGER) + CAST((doc_id % 3 = 0 AND {_SLOTS} = 'undecodable') AS INTEGER) AS missing, CASE WHEN {_SLOTS} = 'usable' THEN 1 ELSE 0 END AS images FROM documents)"


def _usable(spark, sf):
    k = F.col("doc_id")
    status = F.when(k % 7 == 0, "placeholder").when(k % 5 == 0, "undecodable").otherwise("usable")
    slots = F.concat(F.array(F.struct(F.lit("claim").alias("role"), status.alias("status"))), F.when(k % 3 == 0, F.array(F.struct(F.lit("evidence").alias("role"), status.alias("status")))).otherwise(F.array().cast("array<struct<role:string,status:string>>")))
    return table(spark, sf, "documents").select("doc_id", "lang", F.when(k % 11 == 0, None).otherwise("x").alias("label"), (k % 13 == 0).alias("conflict"), F.when(k % 9 == 0, "  ").otherwise(F.col("text")).alias("text"), assets.missing_required(slots).alias("missing"), (status == "usable").cast("int").alias("images"))


@query(f"WITH {_USE_SQL} SELECT nullif(concat_ws(';', CASE WHEN label IS NULL AND NOT conflict THEN 'no_label' END, CASE WHEN conflict THEN 'label_conflict' END, CASE WHEN length(trim(text)) = 0 THEN 'no_text' END, CASE WHEN missing > 0 THEN 'images_missing:' || missing END), '') AS reason, count(*) AS n FROM u GROUP BY 1")
def usability_reasons(spark, sf):
    return _usable(spark, sf).groupBy(assets.usable_reason(F.col("label"), F.col("conflict"), F.col("text"), F.col("missing")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {_USE_SQL} SELECT CASE WHEN length(trim(text)) > 0 AND images > 0 THEN 'text+image' WHEN length(trim(text)) > 0 THEN 'text_only' WHEN images > 0 THEN 'image_only' ELSE 'none' END AS modality, count(*) AS n FROM u GROUP BY 1")
def modality_counts(spark, sf):
    return _usable(spark, sf).groupBy(assets.modality(F.col("text"), F.col("images")).alias("modality")).agg(F.count("*").alias("n"))


@query(f"WITH {_USE_SQL} SELECT lang, images, count(*) AS n, count(*) FILTER (missing = 0) AS complete FROM u GROUP BY GROUPING SETS ((lang, images), (lang), ())")
def processed_summary_rollup(spark, sf):
    return _usable(spark, sf).rollup("lang", "images").agg(F.count("*").alias("n"), F.count_if(F.col("missing") == 0).alias("complete"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'undecodable' WHEN substr(md5(text), 1, 1) IN ('0', '1') THEN 'placeholder' WHEN source = 'src1' AND substr(md5(text), 1, 1) IN ('2', '3', '4', '5') THEN 'wrong_image' ELSE 'usable' END AS status FROM documents")
def status_precedence(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset"), (F.col("doc_id") % 4 != 0).alias("loads"), F.md5("text").alias("sha256"))
    first = F.substring("sha256", 1, 1)
    registry = files.where(first.isin("0", "1")).select("sha256").distinct().withColumn("status", F.lit("placeholder"))
    return assets.with_status(files, registry, files.where(first.isin("2", "3", "4", "5") & (F.col("dataset") == "src1"))).select("doc_id", "status")


_RANK = "CASE source WHEN 'origin' THEN 1 WHEN 'origin_retry' THEN 2 WHEN 'wayback' THEN 3 ELSE 4 END"


@query(f"WITH c AS (SELECT o_custkey AS item, {_PICK.format(repr('origin') + ', ' + repr('origin_retry') + ', ' + repr('wayback') + ', ' + repr('alternate'), 'o_orderkey', 4)} AS source, CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderstatus <> 'F') SELECT item, first(path ORDER BY {_RANK}, path) AS path, first(source ORDER BY {_RANK}, path) AS source FROM c GROUP BY item")
def priority_resolve(spark, sf):
    source = F.element_at(F.array(*map(F.lit, ("origin", "origin_retry", "wayback", "alternate"))), (F.col("o_orderkey") % 4).cast("int") + 1)
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("item"), source.alias("source"), F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderstatus") != "F", "usable").otherwise("undecodable").alias("status"))
    return assets.resolve(rows)


@query("WITH e(dataset, key, expected) AS (VALUES ('en', '1', 10), ('en', '0', 60), ('fr', '1', 80), ('xx', '1', 5)), g AS (SELECT lang AS dataset, CAST(quality AS VARCHAR) AS key, count(*) AS measured FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT e.dataset, e.key, CAST(expected AS BIGINT) AS expected, measured, measured - expected AS difference FROM e LEFT JOIN g USING (dataset, key)")
def expected_vs_measured(spark, sf):
    expected = spark.createDataFrame([("en", {"1": 10, "0": 60}), ("fr", {"1": 80}), ("xx", {"1": 5})], "dataset string, expected map<string,bigint>")
    measured = marked(spark, sf).groupBy(F.col("lang").alias("dataset"), F.col("quality").cast("string").alias("key")).agg(F.count("*").alias("measured"))
    return manifest.compare_expected(expected, measured)


# --------------------------------------------------------------------------- sampling


@query("""WITH c AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1), a AS (SELECT label, n, n * 100 / sum(n) OVER () AS x FROM c), f AS (SELECT label, n, floor(x) AS fl, round(x - floor(x), 9) AS r FROM a),
q AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY r DESC, label) <= 100 - sum(fl) OVER () THEN 1 ELSE 0 END AS take FROM f),
o AS (SELECT c_custkey AS id, c_mktsegment AS label, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7|' || c_custkey), c_custkey) AS k FROM customer) SELECT id, label FROM o JOIN q USING (label) WHERE k <= take""")
def stratified_sample_exact(spark, sf):
    return sampling.stratified(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label")), 100, 7)


@query(f"SELECT doc_id, {_FOLD.format('doc_id')} AS fold FROM documents")
def fold_assignment(spark, sf):
    return table(spark, sf, "documents").select("doc_id", audit.fold_of(F.col("doc_id")).alias("fold"))


@query("SELECT c_custkey AS id FROM customer ORDER BY md5('11|' || c_custkey), c_custkey LIMIT 25")
def first_by_hash(spark, sf):
    return sampling.first_by_hash(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), 25, 11)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, greatest(1, CAST(round(count(*) * 0.01) AS BIGINT)) AS want FROM orders GROUP BY 1")
def allocation_scaling(spark, sf):
    months = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return sampling.scaled(months, 0.01)


# --------------------------------------------------------------------------- scores


@query("WITH r AS (SELECT s_acctbal AS s, s_nationkey % 2 = 0 AS p FROM supplier UNION ALL SELECT round(c_acctbal, -1), c_mktsegment = 'BUILDING' FROM customer), k AS (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM r) SELECT round((sum(rk) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (CAST(count(*) FILTER (p) AS DOUBLE) * count(*) FILTER (NOT p)), 9) AS auc, count(*) FILTER (p) AS n_pos, count(*) FILTER (NOT p) AS n_neg FROM k")
def auc_avg_rank(spark, sf):
    graph.ready(spark)
    rows = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("score"), (F.col("s_nationkey") % 2 == 0).alias("positive"))
    rows = rows.unionAll(table(spark, sf, "customer").select(F.round("c_acctbal", -1), F.col("c_mktsegment") == "BUILDING"))
    return audit.auc(rows).withColumn("auc", F.round("auc", 9))


@query("WITH p AS (SELECT o_orderstatus AS label, CASE WHEN o_totalprice > 200000 THEN 'O' WHEN o_totalprice > 100000 THEN 'F' ELSE 'P' END AS pred FROM orders), t AS (SELECT label, count(*) AS support, count(*) FILTER (label = pred) AS tp FROM p GROUP BY label), q AS (SELECT pred AS label, count(*) AS said FROM p GROUP BY 1) SELECT label, coalesce(support, 0) AS support, round(CAST(coalesce(tp, 0) AS DOUBLE) / said, 6) AS precision, round(CAST(tp AS DOUBLE) / support, 6) AS recall FROM t FULL JOIN q USING (label)")
def precision_recall(spark, sf):
    price = F.col("o_totalprice")
    out = audit.class_scores(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("label"), F.when(price > 200000, "O").when(price > 100000, "F").otherwise("P").alias("pred")))
    return out.select("label", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""WITH m AS (SELECT doc_id AS id, lang AS label, text, CAST('0x' || substr(md5('20260901|' || doc_id), 1, 8) AS BIGINT) % 5 AS fold FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL),
ws AS (SELECT id, label, fold, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM m),
grams AS (SELECT id, label, fold, unnest(w) AS g FROM ws UNION ALL SELECT id, label, fold, w[i] || '_' || w[i + 1] FROM (SELECT *, unnest(range(1, CAST(len(w) AS BIGINT))) AS i FROM ws)),
t AS (SELECT id, label, fold, g, count(*) AS k FROM grams GROUP BY ALL), f AS (SELECT unnest(range(5)) AS out),
c AS (SELECT g, label AS cls, out, sum(k) AS c FROM t JOIN f ON fold <> out GROUP BY ALL), known AS (SELECT DISTINCT g, out FROM c),
v AS (SELECT out, count(*) AS v FROM known GROUP BY out), mass AS (SELECT cls, out, sum(c) AS mass FROM c GROUP BY ALL),
n AS (SELECT label AS cls, out, count(*) AS n FROM m JOIN f ON fold <> out GROUP BY ALL), p AS (SELECT cls, out, ln(n / sum(n) OVER (PARTITION BY out)) AS prior, coalesce(mass, 0) + v AS den FROM n LEFT JOIN mass USING (cls, out) LEFT JOIN v USING (out)),
s AS (SELECT t.id, p.cls, sum(t.k * ln((coalesce(c.c, 0) + 1) / p.den)) AS s FROM t JOIN known ON known.g = t.g AND known.out = t.fold JOIN p ON p.out = t.fold LEFT JOIN c ON c.g = t.g AND c.out = t.fold AND c.cls = p.cls GROUP BY ALL),
r AS (SELECT m.id, m.label, p.cls, round(p.prior + coalesce(s.s, 0), 6) AS score FROM (SELECT DISTINCT id, label, fold FROM m) m JOIN p ON p.out = m.fold LEFT JOIN s ON s.id = m.id AND s.cls = p.cls)
SELECT id, label, cls AS pred FROM r QUALIFY row_number() OVER (PARTITION BY id, label ORDER BY score DESC, cls) = 1""")
def nb_text_label(spark, sf):
    """Held-out Naive Bayes over unigrams and bigrams."""
    return audit.naive_bayes_held_out(marked(spark, sf).select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"))


@query(f"WITH {_MARKED_SQL} SELECT quality AS label, round(avg(CAST(list_contains(regexp_extract_all(lower(text), '[a-z0-9'']+'), 'license') AS INTEGER)), 6) AS share FROM m GROUP BY 1")
def token_share(spark, sf):
    has = F.array_contains(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9']+)"), F.lit(1)), "license")
    return marked(spark, sf).groupBy(F.col("quality").alias("label")).agg(F.round(F.avg(has.cast("int")), 6).alias("share"))


@query("WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM benchmark), g AS (SELECT unnest(w) AS gram FROM w UNION ALL SELECT w[i] || '_' || w[i + 1] FROM (SELECT w, unnest(range(1, CAST(len(w) AS BIGINT))) AS i FROM w)) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def bigram_counts(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode(text.grams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), g AS (SELECT lang, first(source ORDER BY n DESC, source) AS guess FROM c GROUP BY lang) SELECT lang, count(*) AS n, round(avg(CAST(source <> guess AS INTEGER)), 6) AS mismatch FROM documents JOIN g USING (lang) GROUP BY lang")
def style_mismatch_rate(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "source")
    guess = audit.majority_map(docs.select(F.col("lang").alias("key"), F.col("source").alias("label")))
    return docs.join(guess, docs["lang"] == guess["key"]).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("source") != F.col("top_label")).cast("int")), 6).alias("mismatch"))


# --------------------------------------------------------------------------- vectors

_UNIT = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)"
_COS = f"{_UNIT}, s AS (SELECT q.vec_id AS query, p.vec_id AS id, round(list_dot_product(q.e, p.e), 9) AS cosine FROM u q JOIN u p ON q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM s)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _nearest(spark, sf, k):
    rows = _vectors(spark, sf)
    return vectors.best_matches(rows.where("id % 20 = 0"), rows, k)


@query(f"WITH {_COS} SELECT query, id, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def cosine_topk(spark, sf):
    return _nearest(spark, sf, 5).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {_COS} SELECT query, id, round(cosine, 6) AS cosine FROM r WHERE rank = 1 AND cosine >= 0.2")
def cosine_best_other(spark, sf):
    return _nearest(spark, sf, 1).where("cosine >= 0.2").select("query", "id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_COS}, c AS (SELECT query, label, count(*) AS n FROM r JOIN u ON u.vec_id = r.id WHERE rank <= 5 GROUP BY ALL) SELECT query, first(label ORDER BY n DESC, label) AS vote FROM c GROUP BY query")
def knn_vote(spark, sf):
    return vectors.vote(_nearest(spark, sf, 5).select("query", "id"), _vectors(spark, sf).select("id", "label"))


@query("SELECT round(quantile_cont(l_extendedprice, 0.01), 6) AS p01, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem")
def percentile_calibration(spark, sf):
    out = vectors.quantiles(table(spark, sf, "lineitem"), "l_extendedprice")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query()
def probe_scores(spark, sf):
    rows = _vectors(spark, sf).select("id", "v", (F.col("label") == 0).cast("int").alias("label"))
    return vectors.probe(rows).withColumn("score", F.round("score", 4))


# --------------------------------------------------------------------------- ledgers, budgets, manifests


@query("SELECT event_type AS label, count(*) AS items, count(*) FILTER (value > 10) AS ok, round(count(*) FILTER (value > 10) / count(*), 4) AS rate FROM events GROUP BY ROLLUP (event_type)")
def recovery_report(spark, sf):
    return ledger.recovery_report(table(spark, sf, "events").select(F.col("event_type").alias("label"), (F.col("value") > 10).alias("ok")))


REASONS = (
    (None, None, "not_attempted"), ("redirect_to_removed:x", 200, "removed_by_host"), ("placeholder_image:a", 200, "host_serves_placeholder"), ("empty_body", 200, "host_serves_non_image"), ("verify:bad", 200, "host_serves_non_image"),
    ("dns_failure", None, "dns_failure"), ("timeout", None, "unreachable_timeout"), ("http_404", 404, "gone_404"), ("http_403", 403, "blocked_403"), ("http_503", 503, "server_error_5xx"), ("http_418", 418, "refused_http_418"), ("odd", None, "other_odd"),
)


@query(f"SELECT reason, CAST(status AS INTEGER) AS status, category FROM (VALUES {quoted(REASONS)}) AS t(reason, status, category)")
def terminal_reasons(spark, sf):
    rows = spark.createDataFrame([r[:2] for r in REASONS], "reason string, status int")
    return rows.withColumn("category", ledger.origin_category(F.col("reason"), F.col("status")))


_ROUTE = "CASE WHEN event_type IN ('view', 'click') THEN 'origin' ELSE 'wayback' END"


@query(f"SELECT user_id, {_ROUTE} AS route, last(event_type ORDER BY ts, event_id) AS outcome FROM events GROUP BY 1, 2")
def last_route_result(spark, sf):
    rows = table(spark, sf, "events").withColumn("route", F.when(F.col("event_type").isin("view", "click"), "origin").otherwise("wayback"))
    return ledger.last_per(rows.select("user_id", "route", "event_type", "ts", "event_id"), ["user_id", "route"], F.struct("ts", "event_id")).select("user_id", "route", F.col("event_type").alias("outcome"))


_RUNS = "e AS (SELECT user_id, event_type IN ('error', 'signup') AS bad, sum(CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)"


@query(f"WITH {_RUNS} SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS length FROM e WHERE bad GROUP BY ALL HAVING count(*) >= 3")
def circuit_breaker_islands(spark, sf):
    return ledger.failure_runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "signup")).where("length >= 3")


@query(f"WITH {_RUNS} SELECT user_id, count(*) AS failures FROM (SELECT *, max(run) OVER (PARTITION BY user_id) AS last FROM e) WHERE bad AND run = last GROUP BY user_id HAVING count(*) >= 2")
def circuit_breaker_open(spark, sf):
    return ledger.open_hosts(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "signup"), 2)


@query("SELECT event_id FROM (SELECT event_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) WHERE gap < 600")
def throttle_gaps(spark, sf):
    return ledger.too_close(table(spark, sf, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 600).select("event_id")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * CAST(5 AS DOUBLE) AS not_before FROM events")
def request_schedule(spark, sf):
    return ledger.schedule(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("event_id", "not_before")


@query("SELECT o_custkey, o_orderkey, CAST(sum(o_orderkey % 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM orders")
def budget_running_sum(spark, sf):
    rows = table(spark, sf, "orders").withColumn("bytes", F.col("o_orderkey") % 1000)
    return ledger.running_total(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "bytes").select("o_custkey", "o_orderkey", "total")


@query("WITH o AS (SELECT o_orderkey AS key, 'old' AS reason FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT o_orderkey AS key, 'new' AS reason FROM orders WHERE o_orderkey % 5 = 0) SELECT coalesce(n.key, o.key) AS key, coalesce(n.reason, o.reason) AS reason FROM o FULL JOIN n ON o.key = n.key WHERE coalesce(n.key, o.key) % 7 <> 0")
def failure_merge(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    return ledger.merge_failures(keys.where("key % 3 = 0").withColumn("reason", F.lit("old")), keys.where("key % 5 = 0").withColumn("reason", F.lit("new")), keys.where("key % 7 = 0"))


@query("""WITH c AS (SELECT l_orderkey AS url, 1995 AS year, strftime(l_shipdate, '%Y%m%d') AS ts, l_linenumber = 1 AS exact, l_returnflag || CAST(l_partkey % 3 AS VARCHAR) AS digest FROM lineitem WHERE l_linestatus = 'O'),
d AS (SELECT url, digest, min(struct_pack(i := CASE WHEN exact THEN 0 ELSE 1 END, f := abs(CAST(substr(ts, 1, 4) AS INTEGER) - year), t := ts)) AS o FROM c GROUP BY ALL), r AS (SELECT url, o.t AS timestamp, digest, CAST(row_number() OVER (PARTITION BY url ORDER BY o, digest) AS INTEGER) AS rank FROM d) SELECT * FROM r WHERE rank <= 3""")
def snapshot_choice(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("url"), F.lit(1995).alias("year"), F.date_format("l_shipdate", "yyyyMMdd").alias("timestamp"), F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("original"), F.lit("image/png").alias("mimetype"), F.concat("l_returnflag", (F.col("l_partkey") % 3).cast("string")).alias("digest"))
    return ledger.choose_snapshots(rows)


@query("WITH a AS (SELECT o_orderkey AS k, md5(o_orderstatus) AS h FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, md5(CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE o_orderstatus END) AS h FROM orders WHERE o_orderkey % 17 <> 0) SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS path, CASE WHEN b.k IS NULL THEN 'MISSING' WHEN a.k IS NULL THEN 'UNTRACKED' ELSE 'CHANGED' END AS state FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.h <> b.h")
def manifest_full_outer(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("path"), "o_orderstatus")
    a = rows.where("k % 11 <> 0").select("path", F.md5("o_orderstatus").alias("sha256"))
    b = rows.where("k % 17 <> 0").select("path", F.md5(F.when(F.col("k") % 13 == 0, "x").otherwise(F.col("o_orderstatus"))).alias("sha256"))
    return manifest.diff(a, b)


@query("WITH f AS (SELECT source AS dataset, source || '/' || lang || '/' || doc_id AS path, sha256(text) AS h, n_chars AS bytes FROM documents), d AS (SELECT dataset, regexp_replace(path, '[^/]*$', '') AS folder, sha256(string_agg(path || ':' || h, chr(10) ORDER BY path || ':' || h)) AS h, count(*) AS files, sum(bytes) AS bytes FROM f GROUP BY 1, 2) SELECT dataset, sha256(string_agg(folder || ':' || h, chr(10) ORDER BY folder || ':' || h)) AS tree, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM d GROUP BY dataset")
def tree_hash(spark, sf):
    files = table(spark, sf, "documents").select(F.col("source").alias("dataset"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"))
    return manifest.tree_hashes(files, "dataset")


GLOBS = (("data/*", "data/test/*"), ("data/train/*", "data/test/*"), ("store/", "store/test/*"), ("a/b.json", "a/*.json"), ("*.csv", "*.tsv"), ("./x/*", "x/*"))


@query(f"SELECT a, b, overlap FROM (VALUES {quoted([('data/*', 'data/test/*', 'true'), ('data/train/*', 'data/test/*', 'false'), ('store/', 'store/test/*', 'true'), ('a/b.json', 'a/*.json', 'true'), ('*.csv', '*.tsv', 'false'), ('./x/*', 'x/*', 'true')])}) AS t(a, b, overlap)")
def glob_leak_pairs(spark, sf):
    return spark.createDataFrame([(a, b, str(urls.globs_overlap(a, b)).lower()) for a, b in GLOBS], "a string, b string, overlap string")


@query(r"SELECT path, pattern FROM (SELECT source || '/' || lang || '/' || doc_id || '.json' AS path FROM documents) JOIN (VALUES ('src1/*'), ('*/fr/?.json')) AS p(pattern) ON path GLOB pattern")
def forbidden_paths(spark, sf):
    paths = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"))
    return manifest.forbidden(paths, ["src1/*", "*/fr/?.json"])


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\b(error|not found|unavailable|removed|deleted|expired|denied)\b'))), ',') AS words FROM documents WHERE regexp_matches(lower(text), '\b(error|not found|unavailable|removed|deleted|expired|denied)\b')")
def ocr_error_words(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", assets.error_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return found.select("doc_id", F.array_join("w", ",").alias("words"))


PUBLISH = (("data/raw/x.txt", ["a"], "private folder"), ("out/t.parquet", None, "data file"), ("out/t.csv", ["id", " Label "], "label column"), ("out/u.csv", ["id", "URL"], "url column"), ("out/ok.csv", ["id", "split"], None))


@query(f"SELECT path, reason FROM (VALUES {quoted([(p, r) for p, _, r in PUBLISH if r])}) AS t(path, reason)")
def publish_guard_columns(spark, sf):
    return manifest.publish_refusals(spark.createDataFrame([(p, h) for p, h, _ in PUBLISH], "path string, header array<string>"))


@query("SELECT round(12.5 + sum(greatest(0.0, s_acctbal / 1000 - s_nationkey)) + 50, 6) AS projected, 12.5 + sum(greatest(0.0, s_acctbal / 1000 - s_nationkey)) + 50 <= 140 AS fits FROM supplier")
def disk_projection(spark, sf):
    rows = table(spark, sf, "supplier").select((F.col("s_acctbal") / 1000).alias("est_gb"), F.col("s_nationkey").cast("double").alias("on_disk_gb"))
    return manifest.disk_projection(rows, 12.5, 50, 140).withColumn("projected", F.round("projected", 6))


# --------------------------------------------------------------------------- profiles


@query("SELECT lang AS dataset, count(*) AS n, count(DISTINCT source) AS sources, min(n_chars) AS shortest, max(n_chars) AS longest, count(*) FILTER (contains(substr(text, 1, 400), '(Reuters)')) AS tagged, count(*) FILTER (length(trim(text)) = 0) AS blank FROM documents GROUP BY lang")
def corpus_profile(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset")).agg(
        F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"),
        F.count_if(F.substring("text", 1, 400).contains("(Reuters)")).alias("tagged"), F.count_if(F.length(F.trim("text")) == 0).alias("blank"),
    )


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("k"))


@query("SELECT c_mktsegment, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((c_mktsegment, n_name), (c_mktsegment), ())")
def rollup_report(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).rollup("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) SELECT lang, source, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS k FROM c) WHERE k <= 3")
def top_sources_per_language(spark, sf):
    counts = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "source"))).where("k <= 3").drop("k")


# --------------------------------------------------------------------------- event windows (beyond the reference)


def _out(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), *[c for c in df.columns if c != "w"])


@query("SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    return _out(ingest.windowed(table(spark, sf, "events"), "6 hours")).withColumn("total", F.round("total", 4))


@query("SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '6 hours', '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) AS s(k) GROUP BY 1, 2")
def events_sliding(spark, sf):
    return _out(ingest.windowed(table(spark, sf, "events"), "12 hours", "6 hours")).withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def events_session(spark, sf):
    return _out(ingest.sessions(table(spark, sf, "events"), "2 hours"))
