"""Archive addresses, stored names, and wiki dates."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import archive, dates


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).first()[0]


def test_index_query_does_not_encode_twice(spark):
    got = one(spark, "https://a.ex/x%20y,z (1).jpg?q=1", lambda c: archive.index_query(c, prefix=True, limit=5))
    assert got.startswith("https://web.archive.org/cdx/search/cdx?url=a.ex/x%20y,z%20%281%29.jpg&output=json") and got.endswith("&limit=5&matchType=prefix")


def test_parse_index(spark):
    assert one(spark, '[["timestamp","digest"],["2019","A"],["2020","B"]]', archive.parse_index) == [{"timestamp": "2019", "digest": "A"}, {"timestamp": "2020", "digest": "B"}]
    assert one(spark, "[]", archive.parse_index) == [] and one(spark, "", archive.parse_index) == []


def test_addresses(spark):
    assert one(spark, "https://web.archive.org/web/20200101000000im_/https://a.ex/x", archive.raw_snapshot) == "https://web.archive.org/web/20200101000000id_/https://a.ex/x"
    assert one(spark, "https://a.ex/x", archive.raw_snapshot) == "https://a.ex/x"
    assert one(spark, "https://www.snopes.com/tachyon/2019/05/f.jpg?w=1", archive.media_equivalent) == "https://media.snopes.com/2019/05/f.jpg"
    assert one(spark, "https://a.ex/tachyon/2019/05/f.jpg", archive.media_equivalent) is None
    assert one(spark, "https://mediaproxy.snopes.com/width/600/https://m.ex/f.jpg", archive.proxied_url) == "https://m.ex/f.jpg"
    assert one(spark, "https://www.a.ex/x/y/z.jpg?q", lambda c: archive.directory_key(c, ("a.ex",))) == "a.ex/x/y/"
    assert one(spark, "https://a.ex/z.jpg", lambda c: archive.directory_key(c, ("a.ex",))) is None


def test_names(spark):
    assert one(spark, "a b/ü*1", lambda c: archive.file_name(c, F.lit("https://a.ex/x.PNG?y=.gif"))) == "a_b_ü_1.png"
    assert one(spark, "k", lambda c: archive.file_name(c, F.lit("https://a.ex/x.php"))) == "k.jpg"
    from urllib.parse import unquote

    for name in ("1*Ii?.png", "a%b", "end.", "end ", 'x<>:"|', "plain", "tab\t"):
        got = one(spark, name, archive.portable_name)
        assert unquote(got) == name and not set(got) & set('<>:"\\|?*\t') and not got.endswith((".", " "))


@pytest.mark.parametrize(("name", "size", "kept"), [("d/x.json", 10**9, True), ("d/a.txt", 5, True), ("d/images/a.txt", 5, False), ("d/a.txt", 500, False)])
def test_kept_members(spark, name, size, kept):
    assert one(spark, name, lambda c: archive.kept_member(c, F.lit(size), ["*.json"], 100)) is kept


def test_scope_changes_with_patterns():
    a = {"method": "hf", "url": "u", "include_patterns": ["b", "a"], "forbidden_patterns": []}
    assert archive.scope_fingerprint(a) == archive.scope_fingerprint(a | {"include_patterns": ["a", "b"]}) != archive.scope_fingerprint(a | {"include_patterns": ["a"]})


@pytest.mark.parametrize(("markup", "date"), [("{{date|May 3, 2019}}", "2019-05-03"), ("{{Date | 2019-05-04 }}", "2019-05-04"), ("x [[Category:June 5, 2018]]", "2018-06-05"), ("{{date|Feb 30}} [[Category:June 5, 2018]]", "2018-06-05"), ("{{date|February 30, 2019}}", None), ("none", None)])
def test_wiki_date(spark, markup, date):
    assert one(spark, markup, dates.wiki_date) == date


def test_removed_by_redirect(spark):
    df = spark.createDataFrame([(["https://a.ex/x", "https://i.ex/removed.png"],), (["https://a.ex/x", None],)], "c array<string>")
    assert [r[0] for r in df.select(archive.redirected_to_removed(F.col("c"))).collect()] == [True, False]
