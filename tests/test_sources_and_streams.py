"""Readers on files written here, incremental ingest, and the registered queries."""

import bz2
import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators.guards import GuardError
from tidemark.sources import readers
from tidemark.streaming import ingest


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_delimiter_is_sniffed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id\ttext, more\t\n1\t"a, ""b""\nc"\tx\n')
    (tmp_path / "b.csv").write_text('id,text\n1,"x\ty"\n')
    assert rows(readers.delimited(spark, str(tmp_path / "a.csv"))) == [("1", 'a, "b"\nc')]
    assert rows(readers.delimited(spark, str(tmp_path / "b.csv"))) == [("1", "x\ty")]


def test_quotes_are_ordinary_in_plain_tables(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('1\ttrue\t"open\n2\tfalse\tx\n3\tshort\n')
    got = readers.load(spark, "statements_tsv", str(tmp_path / "s.tsv"), split="valid")
    assert rows(got, "record_id", "label", "text", "official_split") == [("1", "true", '"open', "val"), ("2", "false", "x", "val")]
    with pytest.raises(GuardError):
        readers.load(spark, "nothing", "x")


def test_json_claims_and_lines(spark, tmp_path):
    (tmp_path / "dev.json").write_text(json.dumps([{"claim": "a", "label": "x", "claim_date": "25-8-2020"}, {"claim": "b", "label": None}], indent=1))
    assert rows(readers.load(spark, "claims_json", str(tmp_path / "dev.json")), "record_id", "text", "label") == [("dev_0", "a", "x"), ("dev_1", "b", None)]
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write('{"dataset": "d", "record_id": "1"}\nbroken\n')
    assert rows(readers.load(spark, "records_jsonl", str(tmp_path / "r.jsonl.gz")), "dataset", "record_id") == [("d", "1")]


def test_articles_have_digest_ids(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,text,label\nT,x,0\nT,x,0\n,y,1\n")
    got = rows(readers.load(spark, "articles_csv", str(tmp_path / "a.csv")), "text", "record_id")
    assert [t for t, _ in got] == ["T\n\nx", "T\n\nx", "y"] and got[1][1] == f"{got[0][1]}-2"


def test_zip_members_and_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.jsonl", '{"k": 1}\nnot json\n[1]\n')
        z.writestr("a.jsonl", '{"k": 2}\n')
    assert rows(readers.zip_members(spark, str(tmp_path / "a.zip"), first=1), "member") == [("a.jsonl",)]
    good, bad = readers.zip_json_lines(spark, str(tmp_path / "a.zip"), "k int")
    assert rows(good, "k") == [(1,), (2,)] and bad.first()["bad"] == 2


def test_warc(spark, tmp_path):
    def record(kind, uri, body):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2020-01-02T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    body = b"HTTP/1.1 200 OK\r\nLast-Modified: Wed, 21 Oct 2015\r\n\r\n<p>WARC/1.0 inside\n</p>"
    with gzip.open(tmp_path / "x.warc.gz", "wb") as f:
        f.write(record("warcinfo", "", b"x") + record("response", "https://a.ex/", body))
    got = readers.warc_pages(spark, str(tmp_path / "x.warc.gz")).collect()
    assert [(r["url"], r["html"], r["last_modified"]) for r in got] == [("https://a.ex/", "<p>WARC/1.0 inside\n</p>", "Wed, 21 Oct 2015")]
    assert readers.warc_records(spark, str(tmp_path / "x.warc.gz")).count() == 2


def test_wiki_dump(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns><revision><text{}>{}</text></revision></page>"
    long = "'''Word''' [[Paris|city]] " * 20
    xml = "<mediawiki>" + page.format("A", 0, ' bytes="9"', long) + page.format("Talk", 1, ' bytes="9"', long) + page.format("Short", 0, ' bytes="9"', "x") + "</mediawiki>"
    with bz2.open(tmp_path / "d.xml.bz2", "wt") as f:
        f.write(xml)
    got = readers.wiki_dump(spark, str(tmp_path / "d.xml.bz2"))
    assert rows(got, "title") == [("A",)] and got.first()["text"].startswith("Word city Word")


def test_files_and_writers(spark, tmp_path):
    (tmp_path / "f/.git").mkdir(parents=True)
    (tmp_path / "f/a.txt").write_text("x")
    (tmp_path / "f/.git/b").write_text("x")
    (tmp_path / "f/c.part").write_text("x")
    got = readers.files(spark, str(tmp_path / "f"), content=True).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["a.txt"] and len(got[0]["sha256"]) == 64
    df = spark.createDataFrame([("d1", "2", "train"), ("d1", "1", "test"), ("d2", "1", "val")], "dataset string, record_id string, split string")
    readers.write_records(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    readers.replace_partition(df.where("dataset = 'd2'"), str(tmp_path / "out"), "dataset")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    readers.write_splits(df, str(tmp_path / "s"))
    assert readers.delimited(spark, str(tmp_path / "s")).columns == ["record_id", "split"]
    assert readers.union_all([df, df.drop("split")]).count() == 6


def test_register(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("a:\n  method: hf\n  url: u\n  licence: l\n  redistributable: false\n  est_gb: 1\n  enabled: true\n  forbidden_patterns: [test/*]\n  include_patterns: [train/*]\n  expected: {rows: 5}\n")
    assert rows(readers.register(spark, str(tmp_path / "r.yaml")), "name", "est_gb") == [("a", 1.0)]
    (tmp_path / "r.yaml").write_text("a:\n  method: hf\n")
    with pytest.raises(GuardError):
        readers.register(spark, str(tmp_path / "r.yaml"))


def test_incremental_ingest_is_idempotent(spark, tmp_path):
    schema = "url string, title string, text string, published_at string, date_source string, date_confidence string"
    make = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: ingest.ingest_documents(ingest.stream_documents(spark, str(tmp_path / "in"), schema), str(tmp_path / "store"), "2026-09-11", str(tmp_path / "cp")).awaitTermination()
    make([("u1", "t", "x", "2020-01-01", "jsonld", "high"), ("u2", "t", "x", "1970-01-01", "jsonld", "high"), ("u1", "t", "y", "2020-01-01", "jsonld", "high")])
    go()
    make([("u2", "t", "x", "2020-01-01", "jsonld", "high"), ("u3", "t", "x", "2020-01-01", "jsonld", "high")])
    go()
    go()
    assert rows(spark.read.parquet(str(tmp_path / "store")), "url", "quarantined") == [("u1", "false"), ("u2", "true"), ("u3", "false")]


def test_streamed_windows_and_breaker(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    q = ingest.windowed(stream, "6 hours").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("windows").select("w.start", "event_type", "n")) == rows(ingest.windowed(events, "6 hours").select("w.start", "event_type", "n"))
    q = ingest.distinct_ids(stream).writeStream.outputMode("append").format("memory").queryName("distinct").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("distinct").count() == events.select("event_id").distinct().count()
    marked = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*").select("user_id", "ts", "event_id", F.col("event_type").isin("error", "signup").alias("failed"))
    q = ingest.breaker(marked, 3).writeStream.outputMode("append").format("memory").queryName("opened").start()
    q.processAllAvailable()
    q.stop()
    from tidemark.operators import ledger

    runs = ledger.failure_runs(events, "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "signup")).where("length >= 3")
    assert rows(spark.table("opened"), "user_id") == rows(runs, "user_id")


def test_registered_queries_equal_their_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from tidemark import registry

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    same = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    wrong = []
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, sf)
        columns = sorted(got.columns)
        want = con.sql(f"select {', '.join(columns)} from ({sql})").fetchall()
        if sorted(tuple(map(same, r)) for r in want) != sorted(tuple(same(r[c]) for c in columns) for r in got.collect()):
            wrong.append(name)
    assert not wrong


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
