"""Operator 4: n-gram Jaccard join by filtering under several global token orders.

Two sets of at least 80 % Jaccard similarity share a token among the first
n - ceil(0.8 n) + 1 of each, under any order of all tokens.  Three orders are
used: rarest first with ties by one hash, rarest first with ties by another,
and plainly by a third hash.  A pair is a candidate only if it shares a prefix
token under all three; only candidates are verified, on whole sets.

Rarity is counted on a fixed class of tokens (three in ten by hash), which come
first in the orders by rarity; a prefix rarely needs more.  A document whose
prefix consists of tokens that no other document has can be linked to nothing
and is done with after that count.

Documents of equal sets are one class, represented by its smallest doc_id.  The
documents that share a prefix token of the first order form a group, and groups
with the same leader (the member of least hash) a family.  A family is cut into
blocks of bounded size, by set size and then by hash; pairs of blocks whose
sizes allow links are compared as incidence matrices, each in one task of
bounded memory.  There the filters of all orders are intersected, what is left
is verified, and only a spanning forest of the links leaves the task.  So no
pair is ever a row of a table, no two different sets that link are missed, and
the components of the forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.repeats import _lists, _words
from tidemark.llm.shared import Scratch, copies_of, give_back, gram_hashes, map_texts, mix, small, unique_ids

#: Share of the tokens, by hash, whose rarity is counted.
COUNTED = 0.3
#: Tokens of the documents of one block, small documents counting as LEAST tokens.
BLOCK_TOKENS, LEAST = 300_000, 300
#: Incidences in one step of a comparison.
STEP = 4_000_000


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    # the length goes in, so that a short text's sequence isn't taken for a shingle
    return np.unique(gram_hashes(words, min(n, len(words))) ^ mix(np.array([min(n, len(words))], dtype=np.uint64)))


def prefix_size(n: Column) -> Column:
    """n - ceil(0.8 n) + 1."""
    return n - F.floor((4 * n + 4) / 5) + 1


def _sketch(n: int):
    limit = np.uint64(int(COUNTED * 2**64))

    def run(texts: list[str]) -> list[pa.Array]:
        sizes, sums, mixed, counted, tails = [], [], [], [], []
        for words in _words(texts, lower=True):
            s = shingles(words, n)
            order = mix(s ^ np.uint64(0xD1B54A32D192ED03))
            mine = order < limit
            prefix = len(s) - -(-4 * len(s) // 5) + 1 if len(s) else 0
            rest = s[~mine]
            tails.append(rest[np.argsort(order[~mine])[: max(0, prefix - int(mine.sum()))]].view(np.int64))
            counted.append(s[mine].view(np.int64))
            sizes.append(len(s))
            sums.append(int(s.sum(dtype=np.uint64).view(np.int64)))
            mixed.append(int(order.sum(dtype=np.uint64).view(np.int64)))
        return [pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(mixed, pa.int64()), _lists(counted, pa.int64()), _lists(tails, pa.int64())]

    return run


def _sets(n: int):
    def run(texts: list[str]) -> list[pa.Array]:
        return [_lists([shingles(w, n).view(np.int64) for w in _words(texts, lower=True)], pa.int64())]

    return run


def _marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each token of a set a byte that tells in which orders' prefixes it is."""
    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("set", "p1", "p2", "p3")]
        views = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False).view(np.uint64)) for c in columns]
        for i in range(batch.num_rows):
            tokens, *prefixes = (v[o[i] : o[i + 1]] for o, v in views)
            marks = np.zeros(len(tokens), dtype=np.uint8)
            for k, p in enumerate(prefixes):
                marks[np.searchsorted(tokens, p)] |= 1 << k
            out.append(marks.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("set"), pa.array(out, pa.binary())], names=["doc_id", "set", "marks"])


def _common(owner: np.ndarray, token: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of common tokens of each left and each right document, from (document, token) incidences."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    edge = np.flatnonzero(np.diff(token, prepend=-1))
    often = np.diff(np.append(edge, len(token))) > 1
    keep = np.repeat(often, np.diff(np.append(edge, len(token))))
    owner, token = owner[keep], token[keep]
    if not len(token):
        return out
    column = np.cumsum(np.diff(token, prepend=token[0]) != 0)
    place = [np.full(max(left.max(), right.max()) + 1, -1) for _ in range(2)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    width = max(1, STEP // (len(left) + len(right)))
    for low in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [low, low + width])
        here = []
        for k, side in enumerate((left, right)):
            x = np.zeros((len(side), min(width, int(column[-1]) + 1 - low)), dtype=np.float32)
            row = place[k][owner[a:b]]
            x[row[row >= 0], column[a:b][row >= 0] - low] = 1
            here.append(x)
        out += here[0] @ here[1].T
    return out


def compare(table: pa.Table) -> pa.Table:
    """A spanning forest (a, b) of the links between two blocks (side 0 and 1), or within one (side 0 alone)."""
    table = table.combine_chunks()
    n = table.num_rows
    ids, side = table["doc_id"].to_numpy(), table["side"].to_numpy()
    sets = table["set"].chunk(0)
    sizes = np.diff(sets.offsets.to_numpy())
    _, token = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    marks = np.frombuffer(b"".join(table["marks"].to_pylist()), dtype=np.uint8)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (1 if side.any() else 0))
    if not len(left) or not len(right):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    passed = 5 * np.minimum.outer(sizes[left], sizes[right]) >= 4 * np.maximum.outer(sizes[left], sizes[right])
    for k in range(3):
        has = marks & (1 << k) > 0
        passed &= _common(owner[has], token[has], left, right) > 0
    linked = np.zeros((n, n), dtype=bool)
    if passed.any():
        both = _common(owner, token, left, right)
        passed &= 100 * both >= 80 * (np.add.outer(sizes[left], sizes[right]) - both)
        linked[np.ix_(left, right)] = passed
        linked |= linked.T
    # the smallest row number that each row can reach
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(n))
    return pa.table({"a": pa.array(ids[far], pa.int64()), "b": pa.array(ids[label[far]], pa.int64())})


class _Coalesced:
    """Writes scratch tables in at most so many files."""

    def __init__(self, scratch: Scratch, parts: int):
        self.scratch, self.parts, self.drop = scratch, parts, scratch.drop

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.table(df.coalesce(self.parts), name)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, root): the smallest id that each end of the edges (a, b) can reach.

    Alternates two steps on the edge list: every vertex points its larger
    neighbours at its smallest one, then its smaller ones.  It ends when all
    edges point at a root; edges never grow in number beyond vertices plus
    edges, and no step gathers a vertex's neighbours in one row.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    now = scratch.table(ends, f"{name}_0")
    # few edges need few tasks; many keep the session's number of partitions
    parts = max(1, -(-now.count() // 100_000))
    scratch = _Coalesced(scratch, parts)
    for i in range(1, 200):
        # larger neighbours to the smallest of the neighbourhood
        both = now.select("v", "u").unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = scratch.table(both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("x"), F.least("v", "m").alias("m")), f"{name}_least_{i}")
        large = now.join(least, now["u"] == least["x"]).select("v", F.col("m").alias("u")).where("v <> u")
        # each vertex and its smaller neighbours to the smallest of them
        large = scratch.table(large.distinct(), f"{name}_large_{i}")
        down = scratch.table(large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("x"), "m"), f"{name}_down_{i}")
        met = large.join(down, large["v"] == down["x"])
        new = met.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").unionByName(down.select(F.col("x").alias("v"), F.col("m").alias("u"))).distinct()
        new = scratch.table(new, f"{name}_{i}")
        scratch.drop(f"{name}_{i - 1}", f"{name}_least_{i}", f"{name}_large_{i}", f"{name}_down_{i}")
        # done when every vertex has one parent and no parent has one itself
        now = new
        parents = now.select(F.col("u").alias("p")).distinct()
        open_ = now.join(parents, now["v"] == parents["p"], "left_semi").select("v")
        torn = now.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
        if not open_.unionByName(torn).limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("doc_id"), "root")


def link(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles long, component_id long: one row per row of ``docs`` (doc_id, text).

    Words are lower-cased (A-Z) runs without ASCII white space; a document's
    set are its distinct n-word shingles, or its whole sequence if it has
    fewer words.  Documents link at 100 * intersection >= 80 * union;
    component_id is the smallest doc_id reachable by links, itself included.
    Null and empty texts have no shingles and link with nothing.  A null
    doc_id comes after all others, and is its own component's id only where
    the component has no other; documents of one doc_id but different texts
    are told apart; rows equal in both are one document and each has its
    result.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    docs, restore, _ = unique_ids(docs, scratch)
    return restore(_link(docs, n, scratch), "component_id")


def keep_one(docs: DataFrame, n: int = 5) -> DataFrame:
    """``docs`` with one document of each component of links: that of the smallest doc_id; columns unchanged.

    Documents without words stay.  Of rows equal in doc_id and text one stays.
    """
    scratch = Scratch(docs.sparkSession)
    plain, _, numbers = unique_ids(docs, scratch)
    drop = scratch.table(_link(plain, n, scratch).where("component_id <> doc_id").select("doc_id"), "drop")
    if numbers is None:
        gone = small(drop).withColumnRenamed("doc_id", "tidemark_id")
        return docs.join(gone, docs["doc_id"] == gone["tidemark_id"], "left_anti")
    stay = scratch.table(numbers.join(drop.withColumnRenamed("doc_id", "number"), "number", "left_anti").select(F.col("doc_id").alias("tidemark_id"), F.col("key").alias("tidemark_key")), "stay")
    keyed = docs.withColumn("tidemark_md5", F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "tidemark_md5"])
    return keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["tidemark_id"]) & (keyed["tidemark_md5"] == stay["tidemark_key"]), "left_semi").select(*docs.columns)


def _link(docs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``link`` where every doc_id occurs once."""
    spark = docs.sparkSession
    fields = "n long, total long, mixed long, counted array<long>, tail array<long>"
    sketch = scratch.table(map_texts(docs, _sketch(n), fields, "doc_id"), "sketch")
    copies = copies_of(sketch.where("n > 0").select("doc_id", "n", "total", "mixed"), ["n", "total", "mixed"], scratch, "copies")
    firsts = sketch.where("n > 0").join(small(copies.select("doc_id")), "doc_id", "left_anti")
    common = firsts.select(F.explode("counted").alias("t")).groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    common = scratch.table(common, "common")
    give_back(spark)

    shared = firsts.select("doc_id", F.explode("counted").alias("t")).join(common, "t")
    seen = shared.groupBy("doc_id").agg(F.collect_list(F.struct("df", "t")).alias("seen"))
    own = firsts.select("doc_id", "n", "counted", "tail").join(seen, "doc_id", "left")
    seen = F.coalesce("seen", F.array().cast("array<struct<df:bigint,t:bigint>>"))
    size = prefix_size(F.col("n")).cast("int")

    def rarest(seed: int) -> Column:
        """Prefix tokens that others have too, rarest first; those of this document alone come before."""
        ordered = F.transform(F.array_sort(F.transform(seen, lambda x: F.struct(x["df"].alias("df"), F.xxhash64(x["t"], F.lit(seed)).alias("h"), x["t"].alias("t")))), lambda x: x["t"])
        alone = F.size("counted") - F.size(seen)
        need = F.greatest(F.lit(0), size - alone)
        return F.concat(F.slice(ordered, 1, need), "tail")

    hashed = F.transform(F.array_sort(F.transform("counted", lambda t: F.struct(F.xxhash64(t, F.lit(3)).alias("h"), t.alias("t")))), lambda x: x["t"])
    third = F.concat(F.array_intersect(F.slice(hashed, 1, size), F.transform(seen, lambda x: x["t"])), "tail")
    prefixes = own.select("doc_id", "n", rarest(1).alias("p1"), rarest(2).alias("p2"), third.alias("p3")).where("size(p1) > 0 and size(p2) > 0 and size(p3) > 0")
    prefixes = scratch.table(prefixes, "prefixes")
    sizes = scratch.table(sketch.select("doc_id", "n"), "sizes")
    each = prefixes.select("doc_id", "n", F.explode("p1").alias("t"))
    groups = scratch.table(each.groupBy("t").agg(F.count("*").alias("m")).where("m > 1").select("t"), "groups")
    posts = scratch.table(each.join(groups, "t").select("t", "doc_id", "n"), "posts")
    scratch.drop("sketch", "common")
    give_back(spark)

    leads = scratch.table(posts.groupBy("t").agg(F.min(F.xxhash64("doc_id")).alias("lead")), "leads")
    family = posts.join(leads, "t").select("lead", "doc_id", "n").distinct()
    weight = F.col("n") + LEAST
    # a link reaches 1.25 times the size, so the next class at most
    family = scratch.table(family.withColumn("class", F.floor(F.ln("n") / F.ln(F.lit(1.26))).cast("int")), "family")
    total = family.groupBy("lead").agg(F.count("*").alias("m"), F.sum(weight).alias("weight")).where("m > 1")
    cells = family.groupBy("lead", "class").agg(F.sum(weight).alias("own")).join(total, "lead")
    whole = F.col("weight") <= BLOCK_TOKENS
    cells = scratch.table(cells.select("lead", "class", whole.alias("whole"), F.ceil(F.col("own") / BLOCK_TOKENS).cast("int").alias("blocks")), "cells")
    # a small family is compared at once; in others each block meets its own class's later blocks and the next class's
    parted = cells.where("not whole")
    above = parted.select("lead", (F.col("class") - 1).alias("class"), F.col("blocks").alias("next"))
    first = parted.select("lead", "class", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    own_pairs = first.select("lead", "class", "i", F.col("class").alias("class2"), F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
    next_pairs = first.join(above, ["lead", "class"]).select("lead", "class", "i", (F.col("class") + 1).alias("class2"), F.explode(F.sequence(F.lit(0), F.col("next") - 1)).alias("j"))
    pairs = own_pairs.unionByName(next_pairs)
    one = pairs.select("lead", "class", F.col("i").alias("block"), F.struct("class", "i", "class2", "j").alias("pair"), F.lit(0).alias("side"))
    two = pairs.where("class <> class2 or i <> j").select("lead", F.col("class2").alias("class"), F.col("j").alias("block"), F.struct("class", "i", "class2", "j").alias("pair"), F.lit(1).alias("side"))
    meets = scratch.table(one.unionByName(two), "meets")
    placed = family.join(cells, ["lead", "class"])
    alone = placed.where("whole").select("lead", "doc_id", F.struct(F.lit(-1).alias("class"), F.lit(0).alias("i"), F.lit(-1).alias("class2"), F.lit(0).alias("j")).alias("pair"), F.lit(0).alias("side"))
    placed = placed.where("not whole").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    spread = placed.join(meets, ["lead", "class", "block"]).select("lead", "doc_id", "pair", "side")
    work = scratch.table(alone.unionByName(spread), "work")

    active = scratch.table(work.select("doc_id").distinct(), "active")
    texts = docs.join(small(active), "doc_id", "left_semi")
    sets = scratch.table(map_texts(texts, _sets(n), "set array<long>", "doc_id"), "sets")
    marked = sets.join(prefixes.select("doc_id", "p1", "p2", "p3"), "doc_id").select("doc_id", "set", "p1", "p2", "p3")
    marked = scratch.table(marked.mapInArrow(_marked, "doc_id long, set array<long>, marks binary"), "marked")
    scratch.drop("sets", "prefixes", "posts", "family")
    give_back(spark)
    tasks = work.join(marked, "doc_id").select("lead", "pair", "side", "doc_id", "set", "marks")
    links = scratch.table(tasks.groupBy("lead", "pair").applyInArrow(compare, "a long, b long"), "links")
    scratch.drop("marked", "work")
    give_back(spark)
    labels = components(links, scratch, "all").select("doc_id", F.col("root").alias("label"))

    roots = labels.where("doc_id <> label").select("doc_id", F.col("label").alias("root"))
    known = sizes.join(copies, "doc_id", "left").select("doc_id", "n", F.coalesce("first", "doc_id").alias("first"))
    named = known.join(roots.select(F.col("doc_id").alias("first"), "root"), "first", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "first").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + 4], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, CAST(len(w) - 3 AS BIGINT)))) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), root AS (SELECT a AS doc_id, min(b) AS r FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN root ON d.doc_id = root.doc_id
"""
