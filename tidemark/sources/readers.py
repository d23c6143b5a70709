"""Readers and writers for the formats that records come in, and a registry of loaders."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.guards import GuardError

#: A record of any corpus.
RECORD = "dataset string, record_id string, text string, label string, official_split string, images array<struct<role:string,kind:string,ref:string,url:string>>, evidence_text string, meta map<string,string>"
SPLIT_NAMES = {"training": "train", "train": "train", "valid": "val", "validate": "val", "validation": "val", "dev": "val", "val": "val", "test": "test"}

LOADERS: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str):
    """Name a loader, a function of (spark, path, **options) that returns rows of RECORD."""

    def take(f):
        LOADERS[name] = f
        return f

    return take


def load(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    if name not in LOADERS:
        raise GuardError(f"no loader {name}; there are {sorted(LOADERS)}")
    return LOADERS[name](spark, path, **options)


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table whose first line decides between tabs and commas, whatever its name says; all columns strings, blank headers dropped."""
    first = spark.read.text(path).limit(1).collect()
    head = first[0][0] if first else ""
    sep = "\t" if head.count("\t") > head.count(",") else ","
    df = spark.read.option("sep", sep).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    return df.select(*[c for c in df.columns if c.strip() and not c.startswith("_c")])


def plain_tsv(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """A headerless table in which quotes are ordinary characters; rows of fewer than ``least`` columns dropped."""
    cells = spark.read.text(path).select(F.split("value", "\t").alias("cells"))
    return cells.where(F.size("cells") >= least)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON, plain or compressed; unreadable ones become null rows and are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of one JSON document per file; unreadable files are skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def wiki_dump(spark: SparkSession, path: str, minimum: int = 120) -> DataFrame:
    """title, text of the articles (namespace 0) of an XML dump, compressed or not."""
    from tidemark.functions.text import strip_wikitext

    schema = "title string, ns string, revision struct<text:struct<_VALUE:string>>"
    raw = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    if not raw.where("revision.text._VALUE is not null").limit(1).count():
        raw = spark.read.format("xml").option("rowTag", "page").schema("title string, ns string, revision struct<text:string>").load(path)
        text = F.col("revision.text")
    else:
        text = F.col("revision.text._VALUE")
    pages = raw.where("ns = '0'").select("title", text.alias("markup"))
    return pages.select("title", "markup", strip_wikitext(F.col("markup")).alias("text")).where(F.length("text") >= minimum)


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for m in sorted(z.infolist(), key=lambda m: m.filename):
                    if not m.is_dir():
                        yield pa.RecordBatch.from_pydict({"path": [path], "member": [m.filename], "bytes": [m.file_size], "body": [z.read(m)]}, schema=_MEMBER)


_MEMBER = pa.schema([("path", pa.string()), ("member", pa.string()), ("bytes", pa.int64()), ("body", pa.binary())])


def zip_members(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """path, member, bytes, body of the files in archives; with ``first``, that many per archive by name."""
    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_members, "path string, member string, bytes long, body binary")
    if first is None:
        return df
    from pyspark.sql import Window

    return df.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("member"))).where(F.col("nth") <= first).drop("nth")


def zip_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts of lines that aren't JSON objects per archive) of archives of JSON lines."""
    lines = zip_members(spark, path).select("path", "member", F.explode(F.split(F.decode("body", "UTF-8"), "\n")).alias("line")).where(F.trim("line") != "")
    parsed = lines.withColumn("row", F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("row._corrupt_record").isNotNull() | ~F.trim("line").startswith("{")
    return parsed.where(~bad).select("path", "member", "row.*").drop("_corrupt_record"), parsed.groupBy("path").agg(F.count_if(bad).alias("bad"))


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            f = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
            while line := f.readline():
                if not line.startswith(b"WARC/"):
                    continue
                headers = {}
                while (line := f.readline().strip()):
                    name, _, value = line.decode("utf-8", "replace").partition(":")
                    headers[name.strip()] = value.strip()
                body = f.read(int(headers.get("Content-Length", 0)))
                yield pa.RecordBatch.from_pydict({"path": [path], "headers": [list(headers.items())], "body": [body]}, schema=_WARC)


_WARC = pa.schema([("path", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """path, headers, body of each record; one task reads one archive."""
    return spark.read.format("binaryFile").load(path).select("path", "content").repartition(F.col("path")).mapInArrow(_records, "path string, headers map<string,string>, body binary")


def warc_pages(spark: SparkSession, path: str) -> DataFrame:
    """url, html, last_modified, warc_date of the response records."""
    rows = warc_records(spark, path).where(F.col("headers")["WARC-Type"] == "response")
    text = F.decode("body", "UTF-8")
    cut = F.instr(text, "\r\n\r\n")
    head = F.substring(text, F.lit(1), cut)
    return rows.select(F.col("headers")["WARC-Target-URI"].alias("url"), F.substring(text, cut + 4, F.length(text)).alias("html"), F.nullif(F.regexp_extract(head, r"(?im)^Last-Modified:\s*(.*?)\s*$", 1), F.lit("")).alias("last_modified"), F.col("headers")["WARC-Date"].alias("warc_date"))


def files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """path, bytes, mtime (and sha256) of all files below a folder but those of tools."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    df = df.where(~F.col("path").rlike(r"/(\.git|\.cache|__pycache__)/") & ~F.col("path").endswith(".part"))
    kept = [F.col("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")]
    return df.select(*kept, *([F.sha2("content", 256).alias("sha256")] if content else []))


def register(spark: SparkSession, path: str) -> DataFrame:
    """The register of sources, a YAML mapping of names to entries, audited before it is used."""
    import yaml

    from tidemark.operators.manifest import audit_register

    with open(path, encoding="utf-8") as f:
        entries = [{"name": k, **(v or {})} for k, v in (yaml.safe_load(f) or {}).items()]
    audit_register(entries)
    schema = "name string, method string, url string, licence string, redistributable boolean, est_gb double, enabled boolean, forbidden_patterns array<string>, include_patterns array<string>, expected map<string,bigint>, notes string"
    fields = [p.strip().split()[0] for p in schema.split(", ")]
    return spark.createDataFrame([tuple(float(e[f]) if f == "est_gb" else e.get(f) for f in fields) for e in entries], schema)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# --------------------------------------------------------------------------- loaders


def _official(split) -> str:
    table = F.create_map(*[F.lit(x) for kv in SPLIT_NAMES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(split)))


@register_source("statements_tsv")
def load_statements(spark: SparkSession, path: str, split: str | None = None, dataset: str = "statements") -> DataFrame:
    """Headerless TSV: id, label, statement, ..."""
    cells = plain_tsv(spark, path)
    return cells.select(F.lit(dataset).alias("dataset"), F.col("cells")[0].alias("record_id"), F.col("cells")[2].alias("text"), F.col("cells")[1].alias("label"), F.lit(SPLIT_NAMES.get(split or "")).alias("official_split"))


@register_source("articles_csv")
def load_articles(spark: SparkSession, path: str, dataset: str = "articles", title: str = "title", text: str = "text", label: str = "label") -> DataFrame:
    """Delimited articles; the id is a digest of the row's fields, its repetitions numbered in a fixed order."""
    from tidemark.operators.store import occurrence_suffix

    df = delimited(spark, path)
    body = F.concat_ws("\n\n", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(text), F.lit("")))
    key = F.substring(F.sha1(F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in df.columns])), 1, 16)
    # rows of one digest are equal, so any order among them gives the same records
    rows = df.select(F.lit(dataset).alias("dataset"), body.alias("text"), F.col(label).alias("label"), key.alias("digest"))
    return occurrence_suffix(rows, "digest", "text").drop("digest")


@register_source("claims_json")
def load_claims(spark: SparkSession, path: str, dataset: str = "claims", split: str | None = None) -> DataFrame:
    """A JSON array of claims (claim, label, claim_date); ids are <file>_<index>."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), F.from_json("value", "array<struct<claim:string,label:string,claim_date:string>>").alias("rows"))
    rows = raw.select("stem", F.posexplode("rows").alias("i", "r"))
    return rows.select(F.lit(dataset).alias("dataset"), F.concat("stem", F.lit("_"), F.col("i").cast("string")).alias("record_id"), F.col("r.claim").alias("text"), F.col("r.label").alias("label"), F.lit(SPLIT_NAMES.get(split or "")).alias("official_split"), F.create_map(F.lit("claim_date"), F.col("r.claim_date")).alias("meta"))


@register_source("records_jsonl")
def load_records(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, RECORD)


# --------------------------------------------------------------------------- writers


def write_records(df: DataFrame, path: str) -> None:
    """Records by dataset, ordered by id within it; Spark's committer publishes all or nothing."""
    df.repartition("dataset").sortWithinPartitions("dataset", "record_id").write.mode("overwrite").partitionBy("dataset").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """record_id and split, nothing else."""
    df.select("record_id", "split").write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def compressed_json(rows: list[dict], path: str) -> None:
    """Small reports, written by the driver through Python."""
    with bz2.open(path, "wt", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n")
