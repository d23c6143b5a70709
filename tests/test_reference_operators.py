"""The rules of the evidence store, splits, labels and ledgers on small literal inputs."""

import math
import random
import sqlite3
from functools import reduce

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text, urls
from tidemark.operators import assets, audit, graph, labels, ledger, manifest, retrieval, sampling, splits, store, vectors
from tidemark.operators.guards import GuardError, expect_columns, first_column, safe_member
from tidemark.plans import catalogue

TODAY = "2026-09-11"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ search


def index(spark, data):
    return retrieval.build_index(spark.createDataFrame(data, "doc_id string, title string, text string, published_at string"))


def test_as_of_is_inclusive_and_excludes_future_and_undated(spark):
    parts = index(spark, [("a", "", "flood news", "2019-12-31"), ("b", "", "flood news", "2020-01-01"), ("c", "", "flood news", "2020-01-02"), ("d", "", "flood news", "2031-06-06"), ("e", "", "flood news", None), ("z", "", "other", "2000-01-01")])
    assert [r["doc_id"] for r in retrieval.search(*parts, "flood", "2020-01-01", 100).collect()] == ["a", "b"]


def test_k_counts_admissible_results_only(spark):
    parts = index(spark, [("f1", "", "flood flood flood", "2030-01-01"), ("f2", "", "flood flood", "2030-01-01"), ("p1", "", "flood in a long long text", "2010-01-01"), ("p2", "x flood", "in a long long long text", "2010-01-01"), ("o", "", "none", "2010-01-01")])
    assert {r["doc_id"] for r in retrieval.search(*parts, "flood", "2020-01-01", 2).collect()} == {"p1", "p2"}


@pytest.mark.parametrize("bad", ["2020-1-1", "20200101", "2020-01-01T00", None, 20200101, "abcd-ef-gh"])
def test_malformed_as_of(spark, bad):
    with pytest.raises(GuardError):
        retrieval.search(*index(spark, [("a", "", "x", "2020-01-01")]), "x", bad)


def test_query_is_only_terms():
    assert retrieval.query_terms('flood" OR 1=1 --') == ["1", "flood", "or"]
    with pytest.raises(GuardError):
        retrieval.query_terms('"; --')


def test_red_test_passes(spark):
    docs = spark.createDataFrame([(i, "", f"flood report {i}", "2019-01-01") for i in range(20)] + [(99, "", "calm", "2019-01-01")], "doc_id long, title string, text string, published_at string")
    retrieval.red_test(docs, "xyzzy flood", "2020-06-15", "2020-06-14", "2020-06-16")


def test_stemmed_scores_equal_the_full_text_engine(spark):
    data = [(i, f"Title {w}", body, "2020-01-01") for i, (w, body) in enumerate([("Floods", "rivers flooding cities relational"), ("Café", "the cafés were hopping and running"), ("Running", "runner runs happily"), ("Other", "nothing here at all"), ("Ponies", "ponies caresses agreed plastered motoring conflated troubled")])]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, title, text, tokenize='porter unicode61')")
    db.executemany("insert into f values (?, ?, ?)", [d[:3] for d in data])
    docs = spark.createDataFrame(data, "doc_id long, title string, text string, published_at string")
    parts = retrieval.build_index(docs, stem=True)
    for q in ("flood", "cafe run", "pony motor", "happily relational"):
        match = " OR ".join(f'"{w}"' for w in q.split())
        expected = dict(db.execute("select id, bm25(f) from f where f match ?", (match,)).fetchall())
        got = {r["doc_id"]: r["score"] for r in retrieval.search(*parts, q, "2021-01-01", 100, stem=True).collect()}
        assert got.keys() == expected.keys()
        assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_filter_stands_below_the_limit(spark, capsys):
    retrieval.search(*index(spark, [("a", "", "flood", "2020-01-01")]), "flood", "2020-01-01").explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan


# ------------------------------------------------------------------ dates, urls, text


@pytest.mark.parametrize(
    ("value", "verdict"),
    [("2020-01-01", "ok"), (None, "ok"), ("1900-01-01", "ok"), ("1899-12-31", "out_of_window"), (TODAY, "ok"), ("2026-09-12", "out_of_window"), ("1970-01-01", "sentinel"), ("1969-12-31", "sentinel"), ("1970-01-02", "sentinel"), ("1970-01-03", "ok"), ("1901-12-13", "sentinel"), ("1395-06-03", "non_gregorian"), ("2562-01-01", "non_gregorian"), ("abcd", "out_of_window")],
)
def test_date_verdicts(spark, value, verdict):
    df = spark.createDataFrame([(value,)], "d string").select(dates.verdict(F.col("d"), TODAY).alias("v"), dates.kept_date(F.col("d"), TODAY).alias("k"))
    assert rows(df) == [(verdict, value if verdict in ("ok", "non_gregorian") else None)]


def test_page_date_order(spark):
    pages = [
        ('<script>{"datePublished": "2020-03-04T05:06"}</script><meta property="article:published_time" content="2019-01-01">', None, "https://a.ex/2018/01/01/x", ("2020-03-04", "jsonld", "high")),
        ('<meta property="article:published_time" content="2019-01-01T00:00:00Z">', None, "https://a.ex/2018/01/01/x", ("2019-01-01", "meta_published", "high")),
        ('<meta content="2019-01-02" itemprop="datePublished">', None, "https://a.ex/", ("2019-01-02", "meta_published", "high")),
        ('<time class="x" datetime="2019-01-03">', None, "https://a.ex/", ("2019-01-03", "meta_published", "high")),
        ('<script>{"datePublished": "not a date"}</script>', None, "https://a.ex/2018/01/01/x", ("2018-01-01", "url_path", "low")),
        ("<p>x", "Wed, 21 Oct 2015 07:28:00 GMT", "https://a.ex/x", (None, "http_last_modified", "none")),
        (None, None, None, (None, "none", "none")),
    ]
    df = spark.createDataFrame([p[:3] for p in pages], "html string, last string, url string")
    got = df.select(dates.page_date(F.col("html"), F.col("last"), F.col("url")).alias("d")).collect()
    assert [tuple(r["d"]) for r in got] == [p[3] for p in pages]


def test_hosts(spark):
    cases = [("https://www.A.ex/x", "a.ex"), ("http://u:p@b.ex:80/x", "b.ex"), ("https://www.www.c.ex", "www.c.ex"), ("https://x.ex/a b.jpg", "x.ex"), ("nothing", "unknown"), (None, "unknown")]
    df = spark.createDataFrame([(u,) for u, _ in cases], "u string")
    assert [r[0] for r in df.select(urls.host(F.col("u"))).collect()] == [h for _, h in cases]
    keys = spark.createDataFrame([("https://www.a.ex/x%20y+z?q=1#f",)], "u string").select(urls.path_key(F.col("u")), urls.comparable(F.col("u"))).first()
    assert tuple(keys) == ("a.ex/x y+z", "a.ex/x%20y+z?q=1")


def test_globs():
    for a, b in (("data/*", "data/test/*"), ("store/", "store/test/*"), ("a/b.json", "a/*.json"), ("x", "./x"), ("a/*.csv", "a/b*"), ("a/[xy]z", "a/?z/c"), ("*", "a")):
        assert urls.globs_overlap(a, b) and urls.globs_overlap(b, a)
    for a, b in (("data/train/*", "data/test/*"), ("*.csv", "*.tsv"), ("a/b", "a/bc"), ("a/?", "a/bc")):
        assert not urls.globs_overlap(a, b)


@pytest.mark.parametrize(("glob", "path", "hit"), [("a/*.json", "a/b/c.json", True), ("a/?.json", "a/bb.json", False), ("a/[!x]*", "a/y1", True), ("a/[!x]*", "a/x1", False), ("a.b", "axb", False), ("[ab].c", "b.c", True)])
def test_glob_regex(spark, glob, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(urls.matches_any(F.col("p"), [glob])).first()[0] is hit
    assert spark.range(1).select(urls.matches_any(F.lit(path), [])).first()[0] is True


def test_article_text():
    page = "<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><p>One &amp; two</p><h2>Head</h2><footer>foot</footer></body>"
    assert "One & two" in text.article_text(page) and "menu" not in text.article_text(page)
    for broken in (None, "", "<", "<p><p", "<div <p>a</x>", "\x00<p>a", "<!--"):
        assert isinstance(text.article_text(broken), str)


def test_wikitext(spark):
    raw = "{{date|May 3, 2019}} '''Bold''' [[File:x.jpg|thumb]] [[Paris|the city]] and [[Rome]] <ref>x</ref> [[Category:May 3, 2019]]"
    assert spark.createDataFrame([(raw,)], "t string").select(text.strip_wikitext(F.col("t"))).first()[0] == "Bold the city and Rome x"


def test_porter_known_words():
    for w, s in (("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("adoption", "adopt"), ("controlling", "control"), ("rate", "rate")):
        assert text.porter(w) == s


# ------------------------------------------------------------------ store


def test_make_documents_and_ingest(spark):
    raw = [("https://a.ex/1", " T ", "x", "2020-01-01", "jsonld", "high"), ("https://a.ex/2", "T", "x", "1970-01-01", "url_path", "low"), ("https://a.ex/3", None, None, None, "none", "none")]
    docs = store.make_documents(spark.createDataFrame(raw, "url string, title string, text string, published_at string, date_source string, date_confidence string"), TODAY)
    got = {r["url"][-1]: r for r in docs.collect()}
    assert got["1"]["published_at"] == "2020-01-01" and got["1"]["title"] == "T" and got["1"]["source_domain"] == "a.ex"
    assert (got["2"]["published_at"], got["2"]["date_source"], got["2"]["date_confidence"], got["2"]["raw_date_rejected"]) == (None, "implausible_date", "none", "1970-01-01")
    indexed, undated, skipped = store.ingest(docs, docs.where("url like '%1'"))
    assert (indexed.count(), undated.count(), skipped.count()) == (0, 2, 1)


def test_first_wins_and_suffix(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "k string, seq int, v string")
    assert rows(store.first_wins(df, ["k"], F.col("seq"))) == [("a", 1, "x"), ("b", 3, "z")]
    assert rows(store.occurrence_suffix(df, "k", "seq"), "record_id", "v") == [("a", "x"), ("a-2", "y"), ("b", "z")]


# ------------------------------------------------------------------ graph and splits


def test_components(spark):
    data = [(f"r{i}", f"k{i}") for i in range(20)] + [(f"r{i + 1}", f"k{i}") for i in range(19)] + [("x", "only"), ("y", "p"), ("z", "p"), ("w", None)]
    got = dict(rows(graph.components(spark.createDataFrame(data, "node string, key string"))))
    assert {got[f"r{i}"] for i in range(20)} == {"r0"} and got["x"] == "x" and got["y"] == got["z"] == "y"
    assert graph.components(spark.createDataFrame([], "node string, key string")).count() == 0


def test_purity_is_rounded_before_the_threshold(spark):
    data = [("d", "a")] * 89996 + [("d", "b")] * 10004
    pairs = spark.createDataFrame([("d", "a", 89996), ("d", "b", 10004), ("e", "b", 1), ("e", "a", 1)], "domain string, label string, n int").select("domain", "label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).drop("i")
    assert len(data) == 100_000
    got = rows(splits.domain_purity(pairs))
    assert got == [("d", 100_000, "a", 0.9), ("e", 2, "a", 0.5)]
    assert rows(splits.constrained(splits.domain_purity(pairs)), "domain") == [("d",)]
    with pytest.raises(GuardError):
        splits.constrained(pairs, "odd")


def test_greedy_placement_keeps_components_and_classes(spark):
    counts = [(i, "rare" if i < 6 else "common", 10) for i in range(60)] + [(100, "rare", 3), (101, "common", 1)]
    df = spark.createDataFrame(counts, "component int, label string, n int")
    placed = dict(rows(splits.place(df, pins={101: "test"})))
    assert placed[101] == "test" and len(placed) == 62
    per = {s: {"rare": 0, "common": 0} for s in splits.SPLITS}
    for c, k, n in counts:
        per[placed[c]][k] += n
    assert all(per[s]["rare"] > 0 for s in splits.SPLITS)
    assert dict(rows(splits.place(df, pins={101: "test"}))) == placed
    with pytest.raises(GuardError):
        splits.place(df, most=3)
    with pytest.raises(GuardError):
        splits.assert_feasible(spark.createDataFrame([(1, "a", 95), (2, "a", 5)], "component int, label string, n int"))


def test_placed_counts_equal_placement_by_component(spark):
    counts = [(i, "abc"[i * i % 7 % 3], 1) for i in range(400)] + [(i, k, 1 + i % 4) for i in range(400, 440) for k in "ab"]
    df = spark.createDataFrame(counts, "component int, label string, n int")
    placed = df.join(splits.place(df), "component").groupBy("split", "label").agg(F.sum("n").alias("n"))
    assert rows(splits.placed_counts(df), "split", "label", "n") == rows(placed, "split", "label", "n")
    assert splits.placed_counts(df.limit(0)).count() == 0


def test_greedy_split_sizes_place_each_component(spark, tmp_path):
    docs = [(i, f"text {i}") for i in range(2990)] + [(i, f"copy {i % 3}") for i in range(2990, 3000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i, _ in docs], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    component = {i: 2990 + (i - 2990) % 3 if i >= 2990 else i for i, _ in docs}
    counts = spark.createDataFrame([(component[i], int(i % 9 == 0), 1) for i, _ in docs], "component long, label int, n int")
    placed = counts.join(splits.place(counts), "component").groupBy("split", "label").agg(F.sum("n").alias("n"))
    assert rows(catalogue.greedy_split_sizes(spark, str(tmp_path)), "split", "label", "n") == rows(placed, "split", "label", "n")


def test_leakage_guard(spark):
    clean = [("a.ex", "x", "train"), ("b.ex", "y", "test"), ("hub", "x", "train"), ("hub", "y", "test")]
    make = lambda data: spark.createDataFrame(data, "domain string, label string, split string")
    splits.assert_no_leakage(make(clean))
    with pytest.raises(GuardError, match="a.ex"):
        splits.assert_no_leakage(make([*clean, ("a.ex", "x", "test")]))
    splits.assert_no_leakage(make([*clean, ("a.ex", "x", "test")]), "none")


def test_constraint_groups_and_reconciliation(spark):
    data = [("d1", "1", "h1"), ("d2", "2", "h1"), ("d1", "3", "h2"), ("d1", "4", "h2"), ("d1", "5", "h3")] + [("d1", f"m{i}", "h4") for i in range(5)]
    hashes = spark.createDataFrame(data, "dataset string, record_id string, hash string")
    assert {r["key"] for r in splits.constraint_groups(hashes).collect()} == {"h1", "h4"}
    copies = spark.createDataFrame([("h2", 7)], "hash string, copies long")
    assert {r["key"] for r in splits.constraint_groups(hashes, copies).collect()} == {"h1", "h2", "h4"}
    groups = [("p", "a", "train", "test", False), ("p", "b", "val", None, True), ("q", "c", "val", None, True), ("q", "d", "train", None, False), ("r", "e", "train", None, False), ("r", "f", "val", None, False), ("s", "g", "train", "val", False), ("s", "h", "train", "test", False)]
    got = splits.reconcile(spark.createDataFrame(groups, "group string, node string, split string, pin string, preferred boolean"))
    assert {r["group"]: r["target"] for r in got.collect()} == {"p": "test", "q": "val", "r": "val", "s": "test"}
    splits.assert_atomic(got.select("group", F.col("target").alias("split")))
    with pytest.raises(GuardError):
        splits.assert_atomic(got.select("group", "split"))


def test_thin_classes_name_absent_ones(spark):
    data = [("train", "a")] * 70 + [("val", "a")] * 15 + [("test", "a")] * 15 + [("train", "b")] * 100
    got = splits.thin_classes(spark.createDataFrame(data, "split string, label string"))
    assert rows(got, "split", "label", "n") == [("test", "b", 0), ("val", "b", 0)]


# ------------------------------------------------------------------ audits


def test_information_extremes(spark):
    same = spark.createDataFrame([(str(i % 4), i % 4) for i in range(100)], "x string, y int")
    assert audit.information(same).first()["nmi_sqrt"] == pytest.approx(1)
    free = spark.createDataFrame([(str(i % 4), (i // 4) % 5) for i in range(100)], "x string, y int")
    assert audit.information(free).first()["nmi_sqrt"] == pytest.approx(0, abs=1e-9)
    assert audit.information(same.limit(0)).first()["nmi_sqrt"] == 0


def test_singletons_look_better_than_they_are(spark):
    pairs = spark.createDataFrame([(f"d{i}", i % 2, i) for i in range(100)], "key string, label int, id int")
    assert audit.resubstitution(pairs).first()["accuracy"] == 1
    held = audit.held_out_accuracy(pairs.withColumn("fold", audit.fold_of(F.col("id")))).first()["accuracy"]
    assert held < 0.7


def test_majority_ties_take_the_smaller_label(spark):
    assert rows(audit.majority_map(spark.createDataFrame([("k", "b"), ("k", "a")], "key string, label string"))) == [("k", "a")]


def test_auc_with_ties(spark):
    data = [(0.1, False), (0.4, True), (0.4, False), (0.4, False), (0.9, True), (0.2, True)]
    pos, neg = [s for s, p in data if p], [s for s, p in data if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / 9
    graph.ready(spark)
    df = spark.createDataFrame(data, "score double, positive boolean")
    assert audit.auc(df).first()["auc"] == pytest.approx(want)
    low, high = vectors.bootstrap_auc(df, rounds=200)
    assert low <= want <= high


def test_naive_bayes_equals_a_plain_one(spark):
    import math
    import re
    from collections import Counter

    data = [(i, "en" if i % 3 else "fr", f"{'the of' if i % 3 else 'le de'} w{i % 7} x{i % 5} {'the' if i % 11 == 0 else ''}") for i in range(60)]
    df = spark.createDataFrame(data, "id long, label string, text string")
    fold = {r["id"]: r["f"] for r in df.select("id", audit.fold_of(F.col("id")).alias("f")).collect()}
    plain = {}
    grams = lambda t: (w := re.findall("[a-z0-9']+", t.lower())) + [f"{a}_{b}" for a, b in zip(w, w[1:], strict=False)]
    for f in range(5):
        counts = {k: Counter(g for i, k2, t in data if k2 == k and fold[i] != f for g in grams(t)) for k in ("en", "fr")}
        n = Counter(k for i, k, _ in data if fold[i] != f)
        vocabulary = set().union(*counts.values())
        for i, _, t in data:
            if fold[i] == f:
                score = {k: math.log(n[k] / sum(n.values())) + sum(math.log((c[g] + 1) / (sum(c.values()) + len(vocabulary))) for g in grams(t) if g in vocabulary) for k, c in counts.items()}
                plain[i] = min(score, key=lambda k: (-round(score[k], 9), k))
    assert {r["id"]: r["pred"] for r in audit.naive_bayes_held_out(df).collect()} == plain


# ------------------------------------------------------------------ labels, assets


def test_reason_codes(spark):
    cases = [("verite", "miscaptioned", "wrong_image"), ("mocheg", "NEI", "content_unverified"), ("fakeddit", "2", "unmapped"), ("dgm4", "text_swap", "unmapped"), ("averitec", "Conflicting Evidence/Cherrypicking", None), ("verite", None, None), ("isot", None, "unmapped")]
    df = spark.createDataFrame([c[:2] for c in cases], "dataset string, label string")
    got = df.select(labels.reason_code(F.col("dataset"), F.col("label")).alias("c"), labels.treatment(F.col("dataset"), F.col("label")).alias("t"), labels.bucket(F.col("dataset"), F.col("label")).alias("b")).collect()
    assert [r["c"] for r in got] == [c[2] for c in cases]
    assert [r["t"] for r in got][2:] == ["unmapped", "unmapped", "no_clean_code", "unlabelled", "unmapped"]
    assert got[4]["b"] == "null:no_clean_code"
    assert spark.createDataFrame([("text_swap", "same"), ("text_swap", "cross")], "l string, p string").select(labels.swap_code(F.col("l"), F.col("p"))).collect()[0][0] == "media_mismatch"


def test_supervision_rules(spark):
    df = labels.with_codes(spark.createDataFrame([("mocheg", "refuted", "train"), ("averimatec", "Refuted", "train"), ("liar", "true", "train"), ("mocheg", "refuted", "test")], "dataset string, label string, split string"))
    assert rows(labels.supervised(df, "train", "train"), "dataset") == [("mocheg",)]
    assert labels.supervised(df, "evaluate", "test").count() == 1
    with pytest.raises(ValueError):
        labels.supervised(df, "other", "train")


def test_slots_and_usability(spark):
    df = spark.createDataFrame([([("claim", "usable"), ("evidence", "wrong_image"), ("evidence", "undecodable"), ("claim", "placeholder")],)], "s array<struct<role:string,status:string>>")
    assert df.select(assets.missing_required(F.col("s"))).first()[0] == 2
    reason = spark.createDataFrame([(None, False, " ", 2), ("x", False, "t", 0), (None, True, "t", 0)], "l string, c boolean, t string, m int").select(assets.usable_reason(F.col("l"), F.col("c"), F.col("t"), F.col("m"))).collect()
    assert [r[0] for r in reason] == ["no_label;no_text;images_missing:2", None, "label_conflict"]


def test_status_precedence_and_scope(spark):
    files = spark.createDataFrame([("d1", "p", True, "a"), ("d2", "q", True, "a"), ("d1", "r", False, "b"), ("d1", "s", True, "b"), ("d1", "t", True, "c")], "dataset string, path string, loads boolean, sha256 string")
    registry = spark.createDataFrame([("b", "furniture"), ("c", "real")], "sha256 string, status string")
    wrong = spark.createDataFrame([("d1", "a"), ("d1", "b")], "dataset string, sha256 string")
    assert rows(assets.with_status(files, registry, wrong), "path", "status") == [("p", "wrong_image"), ("q", "usable"), ("r", "undecodable"), ("s", "furniture"), ("t", "usable")]


def test_cross_corpus_guard(spark):
    files = spark.createDataFrame([("h", "train_c", "1"), ("h", "eval_c", "9"), ("g", "eval_c", "8")], "sha256 string, dataset string, record_id string")
    excluded = assets.excluded_ids(assets.cross_corpus(files), "train_c", "eval_c")
    assert rows(excluded) == [("9",)]
    with pytest.raises(GuardError):
        assets.assert_no_overlap(spark.createDataFrame([("9",)], "record_id string"), excluded)
    assets.assert_no_overlap(spark.createDataFrame([("8",)], "record_id string"), excluded)


def test_image_kinds(spark):
    data = [(bytearray.fromhex("ffd8ffe0"), "jpeg"), (bytearray.fromhex("89504e470d0a1a0a"), "png"), (bytearray(b"GIF89a"), "gif"), (bytearray(b"RIFF1234WEBP"), "webp"), (bytearray(b"<html>"), None)]
    assert [r[0] for r in spark.createDataFrame([(d,) for d, _ in data], "b binary").select(assets.image_kind(F.col("b"))).collect()] == [k for _, k in data]


# ------------------------------------------------------------------ samples, ledgers, manifests


@pytest.mark.parametrize("size", [0, 1, 7, 50, 100, 500])
def test_stratified_sample_is_exact(spark, size):
    df = spark.createDataFrame([(i, "abc"[min(2, i % 10 // 5 + i % 2)]) for i in range(100)], "id int, label string")
    got = sampling.stratified(df, size, 3)
    assert got.count() == min(size, 100)
    assert rows(got) == rows(sampling.stratified(df.orderBy(F.rand(1)), size, 3))
    if size == 50:
        assert rows(got) != rows(sampling.stratified(df, size, 4))
        share = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
        assert all(abs(r["count"] - share[r["label"]] / 2) < 1 for r in got.groupBy("label").count().collect())


def test_breaker_and_budget(spark):
    seq = [("h", i, ok) for i, ok in enumerate([0, 0, 0, 1, 0, 0])] + [("g", i, 0) for i in range(3)]
    df = spark.createDataFrame(seq, "host string, t int, ok int")
    assert rows(ledger.failure_runs(df, "host", ["t"], F.col("ok") == 0), "host", "length") == [("g", 3), ("h", 2), ("h", 3)]
    assert rows(ledger.open_hosts(df, "host", ["t"], F.col("ok") == 0, 3)) == [("g", 3)]
    sizes = spark.createDataFrame([("a", 1, 40), ("a", 2, 70)], "g string, t int, bytes int")
    ledger.assert_budget(sizes, "g", ["t"], "bytes", 110)
    with pytest.raises(GuardError):
        ledger.assert_budget(sizes, "g", ["t"], "bytes", 100)


def test_snapshots_and_reasons(spark):
    data = [("u", 2019, "20150101", "u", "image/png", "A"), ("u", 2019, "20190101", "v", "image/png", "B"), ("u", 2019, "20180101", "v", "image/png", "B"), ("u", 2019, "20190101", "u", "text/html", "C")]
    got = ledger.choose_snapshots(spark.createDataFrame(data, "url string, year int, timestamp string, original string, mimetype string, digest string"))
    assert rows(got, "rank", "digest", "timestamp") == [(1, "A", "20150101"), (2, "B", "20190101")]
    why = [("no_snapshot", "no_snapshot"), ("cdx_unavailable:cdx_http_404", "archive_refuses_host_404"), ("cdx_unavailable:timeout", "archive_index_unavailable"), ("x placeholder", "snapshots_are_placeholders"), ("undecodable", "snapshots_not_images"), ("odd", "snapshots_failed"), (None, "not_attempted")]
    assert [r[0] for r in spark.createDataFrame([(w,) for w, _ in why], "r string").select(ledger.archive_category(F.col("r"))).collect()] == [k for _, k in why]
    errors = [("SSLError: bad certificate", "ssl_error"), ("ConnectTimeout: timed out", "timeout"), ("gaierror: getaddrinfo failed", "dns_failure"), ("ConnectionError: reset", "connection_error"), ("ValueError: x", "valueerror")]
    assert [r[0] for r in spark.createDataFrame([(w,) for w, _ in errors], "r string").select(ledger.transport_error(F.col("r"))).collect()] == [k for _, k in errors]


def test_recovery_report_refuses_rows_without_a_class(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "label string, ok boolean")
    assert rows(ledger.recovery_report(df)) == sorted([(None, 3, 2, 0.6667), ("a", 2, 1, 0.5), ("b", 1, 1, 1.0)], key=repr)
    with pytest.raises(GuardError):
        ledger.recovery_report(spark.createDataFrame([(None, True)], "label string, ok boolean"))


def test_manifest(spark):
    make = lambda d: spark.createDataFrame(d, "path string, sha256 string")
    a, b = make([("x", "1"), ("y", "2"), ("z", "3")]), make([("x", "1"), ("y", "9"), ("w", "4")])
    assert rows(manifest.diff(a, b)) == [("w", "UNTRACKED"), ("y", "CHANGED"), ("z", "MISSING")]
    assert rows(manifest.update(make([("d1/a", "1"), ("d2/b", "2")]), make([("d1/c", "3"), ("d3/q", "1")]), ["d1/"])) == [("d1/c", "3"), ("d2/b", "2")]
    tree = lambda d: manifest.tree_hashes(spark.createDataFrame(d, "g string, path string, sha256 string, bytes long"), "g").first()["tree"]
    assert tree([("g", "a/1", "x", 1), ("g", "b/2", "y", 1)]) == tree([("g", "b/2", "y", 1), ("g", "a/1", "x", 1)]) != tree([("g", "a/1", "y", 1), ("g", "b/2", "x", 1)])
    assert rows(manifest.publish_refusals(spark.createDataFrame([("data/raw/a", None), ("o/a.csv", ["Label"]), ("o/b.csv", ["id"])], "path string, header array<string>"))) == [("data/raw/a", "private folder"), ("o/a.csv", "label column")]


def test_register_audit(spark):
    good = {"name": "a", "method": "hf", "url": "u", "licence": "x", "redistributable": False, "est_gb": 1.0, "enabled": True, "forbidden_patterns": ["test/*"], "include_patterns": ["train/*"]}
    manifest.audit_register([good])
    for change in ({"method": "ftp"}, {"include_patterns": ["*"]}, {"include_patterns": []}, {"forbidden_patterns": None}, {"expected": {"a": 0}}):
        with pytest.raises(GuardError):
            manifest.audit_register([good | change])
    with pytest.raises(GuardError):
        manifest.audit_register([good, good])
    with pytest.raises(GuardError):
        manifest.guard_paths(spark.createDataFrame([("test/x",), ("train/x",)], "path string"), ["test/*"])
    assert safe_member("a/b") and not safe_member("../a") and not safe_member("/a") and not safe_member("a/../../b")
    assert first_column(spark.range(1), ["x", "id"]) == "id"
    with pytest.raises(GuardError):
        expect_columns(spark.range(1), "label")


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [0.9, 0.1], "a"), (2, [0.0, 1.0], "b"), (3, [0.0, 0.0], "b")], "id long, v array<float>, label string")
    best = vectors.best_matches(df.where("id = 0"), df, 2)
    assert rows(best, "id", "rank") == [(1, 1), (2, 2)]
    assert rows(vectors.vote(best, df.select("id", "label"))) == [(0, "a")]
    whole, parts = (rows(vectors.best_matches(df, df, 2, block_bytes=size), "query", "id", "cosine", "rank") for size in (32 << 20, 200))
    assert whole and parts == whole
    assert vectors.best_matches(df.limit(0), df, 2).count() == 0


def _brute(queries, pool, k):
    """(query, id, cosine, rank) by loops over lists, in the order of ``dot``."""

    def units(v):
        n = reduce(lambda t, x: t + x * x, v, 0.0) ** 0.5
        return [x / n if n else x for x in v]

    out = []
    for q, v in queries:
        found = []
        for i, w in pool:
            if q is not None and i is not None and q != i and v is not None and w is not None and len(v) == len(w) and None not in (*v, *w):
                s = reduce(lambda t, z: t + z[0] * z[1], zip(units(v), units(w), strict=True), 0.0)
                found.append((math.inf if math.isnan(s) else round(s, 9) + 0.0, i))
        found.sort(key=lambda x: (-x[0], x[1]))
        out += [(q, i, s, r) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_best_matches_as_matrices(spark):
    """Copies, ties, own rows, odd vectors and lengths, over several steps; no pair of vectors is a row of the plan."""
    rng = random.Random(5)
    pool = [(i, [rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(3)]) for i in range(400)] + [(400 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(400)]
    pool += [(800 + i, [0.25, 0.5, -0.5]) for i in range(60)]
    pool += [(900, None), (901, [1.0, None, 0.0]), (902, []), (903, [1.0]), (904, [math.nan, 0.0, 1.0]), (905, [math.inf, 0.0, 1.0]), (906, []), (907, [2.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    queries = [p for p in pool if p[0] is None or p[0] % 7 == 0 or p[0] >= 900]
    frames = [spark.createDataFrame(x, "id long, v array<double>") for x in (queries, pool)]
    best = vectors.best_matches(*frames, 4)
    assert "NestedLoop" not in best._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["query"], r["id"], math.inf if math.isnan(r["cosine"]) else r["cosine"], r["rank"]) for r in best.collect())
    want = _brute(queries, pool, 4)
    assert got == want and len(want) > 450
    few = vectors.best_matches(*frames, 4, floor=0.9).collect()
    assert sorted((r["query"], r["id"]) for r in few) == sorted((q, i) for q, i, s, _ in want if s >= 0.9)


def test_best_matches_in_steps(spark, monkeypatch):
    """Any size of step and any kind of id give the same rows."""
    rng = random.Random(6)
    pool = [(f"{i % 41:02d}é{i}", [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame(pool, "id string, v array<float>")
    want = _brute(pool, pool, 3)
    for step in (1000, 7):
        best = vectors._Best(*vectors._units(pa.array([p[0] for p in pool]), pa.array([p[1] for p in pool], pa.list_(pa.float64())))[4], 3, -2.0)
        monkeypatch.setattr(vectors, "STEP_QUERIES", step)
        best = vectors._Best(best.ids, best.x, 3, -2.0)
        for a in range(0, 150, step):
            best.add(best.ids[a : a + step], best.x[a : a + step])
        assert sorted((q, i, s) for part in best.rows() for q, i, s in zip(*(x.tolist() for x in part), strict=True)) == [w[:3] for w in want]
    assert sorted(rows(vectors.best_matches(df, df, 3), "query", "id", "cosine", "rank")) == want


@pytest.mark.parametrize("k", [1, 5])
def test_best_rows_from_single_precision(monkeypatch, k):
    """Products are of single precision; scores that are equal in it, odd vectors and any lengths still give the exact rows."""
    rng = random.Random(7)
    near = [rng.gauss(0, 1) for _ in range(5)]
    pool = [(i, [x + rng.choice((0, 1e-8, 3e-8, -2e-8, 5e-7)) * rng.random() for x in near]) for i in range(150)] + [(150 + i, [1e3 * rng.gauss(0, 1) for _ in range(5)]) for i in range(150)]
    pool += [(300, [math.nan] * 5), (301, [math.inf, 0.0, 1.0, 2.0, 3.0]), (302, [0.0] * 5), (303, [1e-160] * 5), (304, [2e-162, 1e-170, 1.5e-162, 1.5e-162, 1.5e-162]), (305, [1e200] * 5), (306, [-1e-39, 1e-45, 1.0, 0.0, 1e-8])]
    rng.shuffle(pool)
    queries = [p for p in pool if p[0] % 4 == 0 or p[0] >= 300]
    monkeypatch.setattr(vectors, "SCORE_ROWS", 23)
    monkeypatch.setattr(vectors, "STEP_QUERIES", 50)
    units = [vectors._units(pa.array([i for i, _ in x]), pa.array([v for _, v in x], pa.list_(pa.float64())))[5] for x in (queries, pool)]
    best = vectors._Best(*units[0], k, -2.0)
    assert best._scores(slice(0, 9), vectors._Single(units[1][1]), 0, 7).dtype == "float32"
    for a in range(0, len(pool), 70):
        best.add(units[1][0][a : a + 70], units[1][1][a : a + 70])
    got = sorted((q, i, math.inf if math.isnan(s) else s) for part in best.rows() for q, i, s in zip(*(x.tolist() for x in part), strict=True))
    assert got == [w[:3] for w in _brute(queries, pool, k)]


def test_cosine_best_other_has_no_pairs_as_rows(spark, sf):
    df = catalogue.cosine_best_other(spark, sf)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() <= spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()


def test_knn_vote_has_no_pairs_as_rows(spark, sf):
    df = catalogue.knn_vote(spark, sf)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()


def test_knn_vote_deals_vectors_as_they_are(spark, sf):
    """Vectors of single precision are shuffled and sent so; types beside it give the same matches."""
    assert "as array<double>" not in catalogue.knn_vote(spark, sf)._jdf.queryExecution().executedPlan().toString()
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    both = [vectors.best_matches(x.where("id % 20 = 0"), x, 5) for x in (vecs, vecs.select("id", F.col("v").cast("array<double>")))]
    assert "as array<double>" not in both[0]._jdf.queryExecution().executedPlan().toString()
    assert rows(both[0], "query", "id", "cosine", "rank") == rows(both[1], "query", "id", "cosine", "rank")
    whole = spark.createDataFrame([(1, [3, 4]), (2, [4, 3]), (3, None)], "id long, v array<int>")
    assert rows(vectors.best_matches(whole, whole), "query", "id", "cosine") == [(1, 2, 0.96), (2, 1, 0.96)]


def test_quantiles_without_all_distinct_values_in_one_task(spark, sf, monkeypatch):
    """The same for any number of values picked on the driver; the plan aggregates no column into one row's buffer."""
    import numpy as np

    rng = random.Random(7)
    many = [rng.gauss(0, 1) for _ in range(2000)] + [0.25] * 1500 + [-0.0, 0.0, 1e300, -1e300]
    for data, points in ((many, (0.0, 0.01, 0.3, 0.5, 0.61, 0.99, 1.0)), ([3.0] * 50, (0.0, 0.5)), ([1.0, 2.0], (0.0, 0.25, 1.0)), ([5.0], (0.5,))):
        df = spark.createDataFrame([(x,) for x in [*data, None]], "x double")
        for most in (100_000, 40, 1):
            monkeypatch.setattr(vectors, "RANGE_ROWS", most)
            out = vectors.quantiles(df, "x", points)
            assert list(out.first()) == pytest.approx(np.quantile(data, points).tolist(), rel=1e-12, abs=1e-12)
    odd = spark.createDataFrame([(x,) for x in (1.0, 2.0, math.inf, math.nan, math.nan)], "x double")
    low, middle, high = vectors.quantiles(odd, "x", (0.25, 0.5, 1.0)).first()
    assert (low, middle) == (2.0, math.inf) and math.isnan(high)
    assert list(vectors.quantiles(odd.limit(0), "x").first()) == [None] * 3
    assert "percentile" not in catalogue.percentile_calibration(spark, sf)._jdf.queryExecution().executedPlan().toString()
