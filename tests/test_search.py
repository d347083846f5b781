"""Words, the index and its life, query trees and vectors, against plain Python."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import query_tree as Q
from lexiloom.operators import retrieval as R
from lexiloom.operators.search_index import IndexConflict, SearchIndex, write_index
from lexiloom.operators.vector_index import VectorIndex

FIELDS = (("title", 3.0), ("content", 1.0))


def test_words(spark):
    cases = {
        "合同条款 Contract No.5": ["合", "同", "条", "款", "contract", "no", "5"],
        "can't e.g. 3.14 1,000 foo_bar a:b 1:2 x.1 1.x": ["can't", "e.g", "3.14", "1,000", "foo_bar", "a:b", "1", "2", "x", "1", "1", "x"],
        "ひらカタカナabcカ ラーメン": ["ひ", "ら", "カタカナ", "abc", "カ", "ラーメン"],
        "a_カ カ_a __ _a b_": ["a_カ", "カ_a", "_a", "b_"],
        "'quoted' the's a,b 1;2 -3-": ["quoted", "the's", "a", "b", "1;2", "3"],
        "한국어 МОСКВА é": ["한국어", "москва", "é"],
        "②²Ⅷ": ["ⅷ"],
        "漢:字 漢a1": ["漢", "字", "漢", "a1"],
        "x" * 600: ["x" * 255, "x" * 255, "x" * 90],
        "": [],
        "。！？": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.tokens("t").alias("w")).collect()
    assert {r.t: r.w for r in rows} == cases
    deep = spark.createDataFrame([("a" + ".a" * 50_000 + " 漢" * 50_000,)], "t string").select(F.size(T.tokens("t"))).first()[0]
    assert deep == math.ceil(100_001 / 255) + 50_000
    assert spark.range(1).select(T.tokens(F.lit(None).cast("string"))).first()[0] is None


def test_words_never_begin_with_what_joins_others(spark):
    """A mark with nothing before it is no word's beginning, nor what stands behind it."""
    cases = {"\u0301'1é": ["1é"], "\u0301.\uff12": ["\uff12"], "漢\u0301.a": ["漢\u0301", "a"], "a\u0301.b _\u0301 _": ["a\u0301.b"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.tokens("t").alias("w")).collect()
    assert {r.t: r.w for r in rows} == cases
    deep = spark.createDataFrame([("1,1" * 30_000,), ("_" * 40_000 + "a",), ("\u0301" * 40_000 + "a",)], "t string").select(F.size(T.tokens("t"))).collect()
    assert [r[0] for r in deep] == [math.ceil(90_000 / 255), math.ceil(40_001 / 255), 1]


def collection(seed=1, n=40):
    rng = random.Random(seed)
    words = ["甲", "乙", "合同", "red", "fox", "hen", "blue"]
    return [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3]))), " ".join(rng.choices(words, k=rng.choice([0, 2, 9, 30]))), rng.choice(["en", "zh", None]), rng.choice(["a", "b", "c"])) for i in range(n)]


def said(text):
    return [t for w in (text or "").split() for t in (w if unicodedata.name(w[0]).startswith("CJK") else [w])]


def plain_bm25(docs, words, fields=FIELDS):
    """{key: score} by the formula, each field's score summed over words; the best field counts."""
    out = {}
    for f, boost in fields:
        texts = {d[0]: said(d[1 if f == "title" else 2]) for d in docs}
        mean = sum(map(len, texts.values())) / len(texts) or 1.0
        for w in words:
            df = sum(w in t for t in texts.values())
            for k, t in texts.items():
                if w in t:
                    out.setdefault(k, {}).setdefault(f, 0.0)
                    out[k][f] += boost * math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
    return {k: max(s.values()) for k, s in out.items()}


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, title string, content string, lang string, source string")


def same(found, want):
    got = {r[0]: r[1] for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got), (got, want)


def test_chinese_words_are_found(spark):
    docs = [(1, "合同", "本合同由甲方与乙方签订。", "zh", "a"), (2, "章程", "公司章程", "zh", "a"), (3, "x", "nothing", "en", "b")]
    index = write_index(frame(spark, docs), ["title", "content"])
    words = R.analyzed(spark, "合同章程")
    assert words == ["合", "同", "章", "程"]
    assert {r.doc_id for r in R.bm25(index, words, R.BOOSTS).collect()} == {1, 2}
    assert [r.key for r in index.postings(["甲"]).collect()] == [1]


def test_index_written_again_deleted_backfilled_compacted(spark, tmp_path):
    docs = collection()
    path = str(tmp_path / "index")
    index = write_index(frame(spark, docs).repartition(3), ["title", "content"], path, attributes=["lang", "source"])
    words = ["红", "red", "甲", "合", "red"]
    query = lambda ix: R.bm25(ix, words, R.BOOSTS)
    same(query(index), plain_bm25(docs, words))
    again = [(i, "red red", "甲 fox", "zh", "a") for i in (3, 5, 100)]
    index, n = index.add(frame(spark, [*again, (None, "x", "y", None, None)]), ["title", "content"], attributes=["lang", "source"])
    live = [d for d in docs if d[0] not in (3, 5)] + again
    assert n == {"written": 3, "replaced": 2, "rejected": 1}
    same(query(index), plain_bm25(live, words))
    old = index
    index, n = index.delete(spark.createDataFrame([(i,) for i in (0, 5, 7, 7, 999)], "doc_id long"))
    live = [d for d in live if d[0] not in (0, 5, 7)]
    assert n == {"total": 3, "deleted": 3}
    same(query(index), plain_bm25(live, words))
    assert index.delete(spark.createDataFrame([(999,)], "doc_id long"))[1] == {"total": 0, "deleted": 0}
    with pytest.raises(IndexConflict):
        old.delete(spark.createDataFrame([(1,)], "doc_id long"))  # another writer has been there
    with pytest.raises(IndexConflict):
        index.backfill("owner", F.when(F.col("key") != 1, "me"))  # one would stay empty
    index, n = index.backfill("lang", F.concat(F.lit("of:"), F.col("key").cast("string")))
    assert n["updated"] == sum(d[3] is None for d in docs + again if d[0] is not None)
    index, n = index.backfill("owner", F.lit("me"))
    assert {(r.key, r.lang, r.owner) for r in index.docs().collect()} == {(d[0], d[3] or f"of:{d[0]}", "me") for d in live}
    small = index.compact()
    assert len(small.segments) == 1 and small.dead is None
    same(query(SearchIndex.open(spark, path)), plain_bm25(live, words))
    assert {tuple(r) for r in small.postings().drop("segment").collect()} == {tuple(r) for r in index.postings().drop("segment").collect()}
    back, _ = small.add(frame(spark, [(0, "甲", "", None, None)]), ["title", "content"])
    same(query(back), plain_bm25([*live, (0, "甲", "")], words))


def test_one_exchange_and_frequent_words_are_split(spark):
    """Words are counted before the exchange, and one word's directory is written by several tasks where it is large."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("the the the").alias("content"))
        index = write_index(docs.repartition(8), ["content"])
        rows = index.postings(["the"])
        assert rows.agg(F.sum("tf"), F.count("*")).first() == (180_000, 60_000) and len(rows.inputFiles()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def evaluated(docs, node):
    """{key: score} of a tree, document by document."""
    at = {"lang": 3, "source": 4}
    everything = {d[0]: 1.0 for d in docs}
    if isinstance(node, Q.MatchAll):
        return everything
    if isinstance(node, Q.MatchNone):
        return {}
    if isinstance(node, Q.Exists):
        return {d[0]: 1.0 for d in docs if d[at[node.attribute]] is not None}
    if isinstance(node, Q.Terms):
        return {d[0]: 1.0 for d in docs if d[at[node.attribute]] in node.values and d[at[node.attribute]] is not None}
    if isinstance(node, Q.Term):
        held = [d[0] for d in docs if d[at[node.attribute]] == node.value]
        n = sum(d[at[node.attribute]] is not None for d in docs)
        return dict.fromkeys(held, math.log(1 + (n - len(held) + 0.5) / (len(held) + 0.5)))
    if isinstance(node, Q.Match):
        found = plain_bm25(docs, node.words, node.fields)
        if node.every:
            every = {d[0] for d in docs if any(set(node.words) <= set(said(d[1 if f == "title" else 2])) for f, _ in node.fields)}
            found = {k: s for k, s in found.items() if k in every}
        return found
    parts = {kind: [evaluated(docs, c) for c in getattr(node, kind)] for kind in ("must", "should", "must_not", "filter")}
    out = {}
    for k in everything:
        if all(k in p for p in parts["must"] + parts["filter"]) and not any(k in p for p in parts["must_not"]) and sum(k in p for p in parts["should"]) >= node.needed:
            scores = [p[k] for p in parts["must"] + parts["should"] if k in p]
            out[k] = sum(scores) if any(parts.values()) else 1.0
    return out


def trees():
    rng = random.Random(8)
    words = ["甲", "合", "red", "fox", "none"]

    def leaf():
        return rng.choice([
            Q.Match(tuple(rng.choices(words, k=2)), FIELDS), Q.Match(tuple(rng.sample(words, 2)), FIELDS[1:], True), Q.Match((rng.choice(words),), FIELDS[:1]),
            Q.Term("lang", rng.choice(["en", "zh", "xx"])), Q.Terms("source", tuple(rng.sample("abc", 2))), Q.Exists("lang"), Q.MatchAll(), Q.MatchNone(),
        ])

    def tree(depth):
        some = lambda most: tuple(leaf() if depth == 0 or rng.random() < 0.7 else tree(depth - 1) for _ in range(rng.randint(0, most)))
        return Q.Bool(some(2), some(3), some(1), some(1), rng.choice([None, None, 1, 2, -1, "50%", "-50%"]))

    return [Q.Bool(), Q.Bool(must_not=(Q.Exists("lang"),)), Q.Bool(filter=(Q.Exists("nowhere"),)), Q.Bool(should=(Q.MatchAll(),), minimum_should_match=2)][:4] + [tree(1) for _ in range(20)]


def test_query_trees(spark):
    docs = collection(5)
    index = write_index(frame(spark, docs), ["title", "content"], attributes=["lang", "source"])
    for tree in trees():
        if tree.filter == (Q.Exists("nowhere"),):
            assert Q.hits(index, tree).count() == 0
            continue
        same(Q.hits(index, tree), evaluated(docs, tree))


def test_scope_holds_before_the_cut(spark):
    """Two hundred better documents outside leave the one inside to be found."""
    docs = [(i, "red", "red red", "en", "a") for i in range(200)] + [(500, "x", "x x x x red", "zh", "b")]
    index = write_index(frame(spark, docs), ["title", "content"])
    vectors = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(200)] + [(500, [-1.0, 0.1])], "vec_id long, embedding array<double>")
    inside = spark.createDataFrame([(500,)], "doc_id long")
    assert [r.doc_id for r in R.scoped(index, vectors, ["red"], 0, inside).collect()] == [500]


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 32))
    v = centres[rng.integers(0, 20, 2000)] + 0.7 * rng.standard_normal((2000, 32))
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)] + [(5000, None, "x"), (5001, [0.0] * 32, "x"), (5002, [1.0] * 31, "x"), (5003, [float("nan")] * 32, "x"), (None, [1.0] * 32, "x")]
    index = VectorIndex.write(spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket string").repartition(4), str(tmp_path / "v"), 32)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = wanted = near = 0
    for q in range(0, 2000, 250):
        best = np.lexsort((np.arange(2000), -(unit @ unit[q])))[:10]
        got = [r.vec_id for r in index.nearest(v[q].tolist(), 10).collect()]
        near += len(set(best.tolist()) & {r.vec_id for r in index.nearest(v[q].tolist(), 10, probes=24).collect()})
        found, wanted = found + len(set(best.tolist()) & set(got)), wanted + 10
        assert got[0] == q
    assert found / wanted >= 0.9 and near / wanted >= 0.7
    inside = spark.createDataFrame([(i,) for i in range(7, 2000, 40)], "id long")
    got = [r.vec_id for r in index.nearest(v[0].tolist(), 10, inside=inside).collect()]  # all 50 are verified: exact
    assert got == sorted(range(7, 2000, 40), key=lambda i: -(unit[i] @ unit[0]))[:10]
    plan = index.candidates(v[0].tolist(), inside=inside)._jdf.queryExecution().toString()
    assert "vector" not in re.sub(r"v/|vectors", "", plan.split("== Physical Plan ==")[1].split("Location")[0])
