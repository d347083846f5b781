"""Queries on retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import query_tree as Q
from lexiloom.operators import retrieval as R
from lexiloom.operators.search_index import SearchIndex, write_index
from lexiloom.operators.vector_index import VectorIndex
from lexiloom.sources.scratch import new_path
from lexiloom.sources.tables import line_blocks, table

from .base import BLOCKS, query

TERMS, VECTOR, QUESTION = ["thanedble", "attion", "eux", "src7"], 7, "the thanedble attion"

# Word-break classes: letters of scripts written with blanks, ideographs and Hiragana, Katakana, digits, connectors, marks.
_A, _H, _K, _N, _E, _M = r"(?:[^\P{L}\p{Han}\p{Hiragana}\p{Katakana}ーｰ]|\p{Nl})", r"[\p{Han}\p{Hiragana}]", r"[\p{Katakana}ーｰ]", r"\p{Nd}", r"\p{Pc}", r"\p{M}"
_EITHER = ".''‘’․﹒＇．"
_LETTERS = rf"{_A}(?:{_A}|{_M})*(?:[{_EITHER}:··՟״‧︓﹕：]{_A}(?:{_A}|{_M})*)*"
_DIGITS = rf"{_N}(?:{_N}|{_M})*(?:[{_EITHER},;;։،؍٬߸⁄︐︔﹐﹔，；]{_N}(?:{_N}|{_M})*)*"
_RUN = rf"(?:(?:{_LETTERS}|{_DIGITS})+|(?:{_K}{_M}*)+)"
_WORD = rf"{_H}{_M}*|(?:{_E}{_M}*)*{_RUN}(?:(?:{_E}{_M}*)+{_RUN})*(?:{_E}{_M}*)*"


def words_sql(c: str) -> str:
    """The words of a text by the rule itself: one pattern for a whole word; over 255 characters it is cut."""
    return f"flatten(list_transform(regexp_extract_all(lower({c}), '{_WORD}'), lambda w: list_transform(range(0, (length(w) + 254) // 255), lambda i: substring(w, i * 255 + 1, 255))))"


_FIELD = """
f_{f} AS (SELECT doc_id, {tk} AS tk FROM {table}),
c_{f} AS (SELECT doc_id, len(tk) AS dl, t, len(list_filter(tk, lambda x: x = t)) AS tf FROM f_{f}, q),
d_{f} AS (SELECT t, count(*) FILTER (WHERE tf > 0) AS df FROM c_{f} GROUP BY t),
a_{f} AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM f_{f}),
s_{f} AS (SELECT doc_id, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS s FROM c_{f} JOIN d_{f} USING (t), a_{f} GROUP BY doc_id)"""


def bm25_sql(terms: list[str], title: str = "source", content: str = "text", table: str = "documents") -> str:
    """``bm``: doc_id and score of every text with one of the terms."""
    fields = ",".join(_FIELD.format(f=f, tk=words_sql(c), table=table) for f, c in (("t", title), ("c", content)))
    return f"q AS (SELECT unnest({terms!r}) AS t),{fields},\nbm AS (SELECT doc_id, greatest(3.0 * s_t.s, s_c.s) AS score FROM s_t JOIN s_c USING (doc_id) WHERE greatest(3.0 * s_t.s, s_c.s) > 0)"


_BM25 = bm25_sql(TERMS)
_KNN = "kn AS (SELECT e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"


def _rrf(k: int, wide: int, near: int, inside: str = "TRUE") -> str:
    """``inside``: a condition on documents, before anything is ranked."""
    return f"""WITH {_BM25}, {_KNN},
bl AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r, 0 AS l FROM bm WHERE {inside} QUALIFY r < {wide}),
kl AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r, 1 AS l FROM kn WHERE {inside} QUALIFY r < {near}),
u AS (SELECT * FROM bl UNION ALL SELECT * FROM kl),
g AS (SELECT doc_id, sum(1.0::DOUBLE / (61 + r)) AS s, min(l * 1000 + r) AS o FROM u GROUP BY doc_id ORDER BY s DESC, o LIMIT {k})"""


_indexes: dict[tuple, tuple[tuple, object]] = {}


def state_of(rows) -> tuple:
    """What tells whether a table's files have changed: their names, times and sizes."""
    files = rows.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
    return tuple(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("file_path", "file_modification_time", "file_size"))).first())


def kept_for(spark, d, name: str, source: str, build):
    """What ``build`` writes from a folder's table: once in a session, and again when the table has changed."""
    rows = table(spark, d, source)
    at, state = (spark.conf.get("spark.app.id", ""), d, name), state_of(rows)
    if at not in _indexes or _indexes[at][0] != state:
        _indexes[at] = state, build(rows)
    return _indexes[at][1]


def _searched(docs):
    return docs.select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"), "lang", "source")


def search_index(spark, d) -> SearchIndex:
    """The index of a folder's documents that every question reads."""
    return kept_for(spark, d, "documents", "documents", lambda rows: write_index(_searched(rows), list(R.BOOSTS), attributes=["lang", "source"]))


_POSTINGS = f"""t AS (SELECT doc_id, 'title' AS field, {words_sql("source")} AS tk FROM documents UNION ALL SELECT doc_id, 'content', {words_sql("text")} FROM documents),
p AS (SELECT doc_id, field, len(tk) AS n, term, count(*) AS tf FROM (SELECT doc_id, field, tk, unnest(tk) AS term FROM t) GROUP BY ALL)"""


@query("snk_index_bulk", f"WITH {_POSTINGS} SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS tf, min(doc_id) AS first_doc, max(n)::BIGINT AS longest FROM p GROUP BY ALL")
def snk_index_bulk(spark, d):
    rows = search_index(spark, d).postings()
    return rows.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("tf"), F.min("key").alias("first_doc"), F.max("len").cast("long").alias("longest"))


@query("topk_bm25", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def topk_bm25(spark, d):
    return R.ranked(R.bm25(search_index(spark, d), TERMS, R.BOOSTS), "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@query("topk_knn", f"WITH {_KNN} SELECT doc_id AS vec_id, round(score, 5) AS score FROM kn ORDER BY kn.score DESC, doc_id LIMIT 10")
def topk_knn(spark, d):
    return R.ranked(R.cosine(table(spark, d, "embeddings"), VECTOR), "vec_id", 10).select("vec_id", F.round("score", 5).alias("score"))


def _fused(spark, d, k):
    docs = table(spark, d, "documents")
    best = R.hybrid(search_index(spark, d), table(spark, d, "embeddings"), TERMS, VECTOR, k)
    return best.join(docs.select("doc_id", "lang", "source", F.left("text", F.lit(120)).alias("snippet")), "doc_id", "left").select("doc_id", F.round("score", 6).alias("score"), "lang", "source", "snippet")


_SHOW = " SELECT g.doc_id, round(s, 6) AS score, lang, source, left(text, 120) AS snippet FROM g LEFT JOIN documents USING (doc_id)"


@query("topk_rrf", _rrf(10, 20, 10) + _SHOW)
def topk_rrf(spark, d):
    return _fused(spark, d, 10)


@query("topk_parallel", _rrf(15, 30, 15) + _SHOW)
def topk_parallel(spark, d):
    return _fused(spark, d, 15)


_NARROW = "lang = 'de' AND source = 'src2'"


@query("topk_scope", _rrf(6, 12, 6, f"doc_id IN (SELECT doc_id FROM documents WHERE {_NARROW})") + " SELECT doc_id, round(s, 6) AS score FROM g")
def topk_scope(spark, d):
    inside = table(spark, d, "documents").where(_NARROW).select("doc_id")
    return R.scoped(search_index(spark, d), table(spark, d, "embeddings"), TERMS, VECTOR, inside).select("doc_id", F.round("score", 6).alias("score"))


# Documents with ideographs: vowels stand as such, so a text mixes both kinds of words.
_FROM, _TO, _ASKED = "aeiou", "合同条款章", "合同 th 条款 nd"


@query("topk_ideographs", f"WITH {bm25_sql(['合', '同', 'th', '条', '款', 'nd'], table=f'(SELECT doc_id, source, translate(text, {_FROM!r}, {_TO!r}) AS text FROM documents)')} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def topk_ideographs(spark, d):
    index = kept_for(spark, d, "ideographs", "documents", lambda rows: write_index(_searched(rows.withColumn("text", F.translate("text", _FROM, _TO))), list(R.BOOSTS)))
    return R.ranked(R.bm25(index, R.analyzed(spark, _ASKED), R.BOOSTS), "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


_BOTH = tuple(R.BOOSTS.items())
TREES = {
    "filtered": Q.Bool(must=(Q.Match(("attion", "eux"), _BOTH),), filter=(Q.Term("lang", "en"),), must_not=(Q.Terms("source", ("src1", "src2")),)),
    "rare value": Q.Bool(must=(Q.Term("lang", "de"), Q.Match(("src7", "der"), _BOTH))),
    "two of three": Q.Bool(should=(Q.Match(("attion",), _BOTH), Q.Match(("the",), _BOTH), Q.Terms("source", ("src3", "src4"))), minimum_should_match=2),
    "all but a third": Q.Bool(should=(Q.Match(("eux",), _BOTH), Q.Terms("lang", ("fr",)), Q.Exists("source")), minimum_should_match="-34%"),
    "none": Q.Bool(must=(Q.MatchNone(),), should=(Q.Match(("the",), _BOTH),)),
    "nested": Q.Bool(filter=(Q.Bool(should=(Q.Term("lang", "fr"), Q.Bool(must=(Q.Term("lang", "es"), Q.Term("source", "src5"))))),), should=(Q.Match(("eux", "los"), _BOTH),)),
    "every word": Q.Bool(must=(Q.Match(("is", "the"), (("content", 1.0),), True),), must_not=(Q.Match(("thanedble",), _BOTH),)),
    "outside": Q.Bool(must_not=(Q.Exists("lang"), Q.Terms("source", ("src0", "src1", "src2", "src3")))),
}


def _hits_sql(words: list[str], name: str) -> str:
    """Like ``bm25_sql`` on tokens taken once: ``name`` (doc_id, score)."""
    part = lambda f: f"SELECT doc_id, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) ELSE 0 END) AS s FROM (SELECT doc_id, len({f}) AS dl, t, len(list_filter({f}, lambda x: x = t)) AS tf, count(*) FILTER (WHERE list_contains({f}, t)) OVER (PARTITION BY t) AS df FROM tk, (SELECT unnest({words!r}) AS t)), (SELECT count(*) AS n, avg(len({f})) AS mean FROM tk) GROUP BY doc_id"
    return f"{name} AS (SELECT doc_id, greatest(3.0 * a.s, b.s) AS score FROM ({part('title')}) a JOIN ({part('content')}) b USING (doc_id) WHERE greatest(3.0 * a.s, b.s) > 0)"


_WEIGHT = "SELECT ln(1 + (count({a}) - count(*) FILTER ({a} = '{v}') + 0.5) / (count(*) FILTER ({a} = '{v}') + 0.5)) FROM documents"
_de, _fr, _es = (_WEIGHT.format(a="lang", v=v) for v in ("de", "fr", "es"))


@query(
    "qry_bool",
    f"""WITH tk AS (SELECT doc_id, {words_sql("source")} AS title, {words_sql("text")} AS content FROM documents),
{_hits_sql(["attion", "eux"], "m1")}, {_hits_sql(["src7", "der"], "m2")}, {_hits_sql(["attion"], "m3")}, {_hits_sql(["the"], "m4")}, {_hits_sql(["eux"], "m5")}, {_hits_sql(["eux", "los"], "m6")}, {_hits_sql(["thanedble"], "m8")},
m7 AS (SELECT doc_id, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) ELSE 0 END) AS score, bool_and(tf > 0) AS every FROM (SELECT doc_id, len(content) AS dl, len(list_filter(content, lambda x: x = t)) AS tf, count(*) FILTER (WHERE list_contains(content, t)) OVER (PARTITION BY t) AS df FROM tk, (SELECT unnest(['is', 'the']) AS t)), (SELECT count(*) AS n, avg(len(content)) AS mean FROM tk) GROUP BY doc_id),
r AS (
SELECT 'filtered' AS tree, doc_id, score FROM m1 JOIN documents USING (doc_id) WHERE lang = 'en' AND source NOT IN ('src1', 'src2')
UNION ALL SELECT 'rare value', doc_id, score + ({_de}) FROM m2 JOIN documents USING (doc_id) WHERE lang = 'de'
UNION ALL SELECT 'two of three', doc_id, coalesce(m3.score, 0) + coalesce(m4.score, 0) + (source IN ('src3', 'src4'))::INT FROM documents LEFT JOIN m3 USING (doc_id) LEFT JOIN m4 USING (doc_id) WHERE (m3.score IS NOT NULL)::INT + (m4.score IS NOT NULL)::INT + (source IN ('src3', 'src4'))::INT >= 2
UNION ALL SELECT 'all but a third', doc_id, coalesce(m5.score, 0) + (lang = 'fr')::INT + 1 FROM documents LEFT JOIN m5 USING (doc_id) WHERE (m5.score IS NOT NULL)::INT + (lang = 'fr')::INT + (source IS NOT NULL)::INT >= 2
UNION ALL SELECT 'nested', doc_id, coalesce(m6.score, 0) FROM documents LEFT JOIN m6 USING (doc_id) WHERE lang = 'fr' OR (lang = 'es' AND source = 'src5')
UNION ALL SELECT 'every word', doc_id, score FROM m7 WHERE every AND doc_id NOT IN (SELECT doc_id FROM m8)
UNION ALL SELECT 'outside', doc_id, 0 FROM documents WHERE lang IS NULL AND (source IS NULL OR source NOT IN ('src0', 'src1', 'src2', 'src3')))
SELECT tree, doc_id, round(score, 5) AS score FROM r""",
)
def qry_bool(spark, d):
    index = search_index(spark, d)
    found = [Q.hits(index, tree).select(F.lit(name).alias("tree"), F.col("key").alias("doc_id"), F.round("score", 5).alias("score")) for name, tree in TREES.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


# Documents in three writes: two thirds, the rest with every fifth again and changed, every seventh deleted.
_LIVE = "(SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN text || ' thanedble ' || lang ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"


@query(
    "snk_index_rewrite",
    f"""WITH {bm25_sql(TERMS, table=_LIVE)}, n AS (SELECT count(*) FILTER (doc_id % 3 = 0 OR doc_id % 5 = 0) AS written, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 = 0) AS replaced, count(*) FILTER (doc_id % 7 = 0) AS deleted, count(*) FILTER (doc_id % 7 <> 0) AS live FROM documents)
SELECT doc_id, round(score, 6) AS score, written, replaced, deleted, live FROM bm, n""",
)
def snk_index_rewrite(spark, d):
    docs, i = table(spark, d, "documents"), F.col("doc_id")

    def build(_):
        index = write_index(_searched(docs.where(i % 3 != 0)), list(R.BOOSTS))
        changed = F.when(i % 5 == 0, F.concat("text", F.lit(" thanedble "), "lang")).otherwise(F.col("text"))
        index, n = index.add(_searched(docs.where((i % 3 == 0) | (i % 5 == 0)).withColumn("text", changed)), list(R.BOOSTS))
        index, gone = index.delete(docs.where(i % 7 == 0))
        return index, n | gone

    index, n = kept_for(spark, d, "rewritten", "documents", build)
    scores = R.bm25(index, TERMS, R.BOOSTS).select("doc_id", F.round("score", 6).alias("score"))
    return scores.select("*", *[F.lit(n[c]).cast("long").alias(c) for c in ("written", "replaced", "deleted")], F.lit(index.docs().count()).cast("long").alias("live"))


_QUERY_VECTORS = (7, 77, 177)


@query(
    "topk_knn_scope",
    f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN {_QUERY_VECTORS}),
s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE vec_id % 11 = 3 AND vec_id < 1000)
SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, vec_id) - 1)::INT AS rank, round(s.score, 5) AS score FROM s QUALIFY rank < 10""",
)
def topk_knn_scope(spark, d):
    """Neighbours among few vectors, by the index: the filter leaves fewer than are verified, so the answer is exact."""
    index, vectors = _vector_index(spark, d), table(spark, d, "embeddings")
    inside = vectors.where("vec_id % 11 = 3 AND vec_id < 1000").select(F.col("vec_id").alias("id"))
    asked = vectors.where(F.col("vec_id").isin(*_QUERY_VECTORS)).select("vec_id", "embedding").collect()  # three rows
    found = [index.nearest(r.embedding, 10, inside=inside).select(F.lit(r.vec_id).cast("long").alias("query_id"), "vec_id", "rank", F.round("score", 5).alias("score")) for r in asked]
    return reduce(lambda a, b: a.unionByName(b), found)


def _vector_index(spark, d) -> VectorIndex:
    def build(rows):
        size = rows.select(F.size("embedding").alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").first()
        return VectorIndex.write(rows, new_path(spark, "vectors"), size.n if size else 1)

    return kept_for(spark, d, "vectors", "embeddings", build)


@query("topk_knn_index")
def topk_knn_index(spark, d):
    """Neighbours by the index among all vectors; recall is measured in the tests."""
    index = _vector_index(spark, d)
    asked = table(spark, d, "embeddings").where(F.col("vec_id").isin(*_QUERY_VECTORS)).select("vec_id", "embedding").collect()
    found = [index.nearest(r.embedding, 10).select(F.lit(r.vec_id).cast("long").alias("query_id"), "vec_id", "rank", "score") for r in asked]
    return reduce(lambda a, b: a.unionByName(b), found)


_GRAMS = sorted({QUESTION[i : i + n] for n in (2, 3, 4) for i in range(len(QUESTION) - n + 1) if QUESTION[i : i + n].strip()})
_IDF = f"""WITH {BLOCKS}, g AS (SELECT unnest({_GRAMS!r}) AS g), n AS (SELECT count(*) AS n FROM blocks),
df AS (SELECT g, count(*) AS df FROM g, blocks WHERE contains(lower(text), g) GROUP BY g),
s AS (SELECT doc_id, block_index, any_value(text) AS text, sum(length(g) * length(g) * (1 + ln(n / df))) AS s FROM blocks JOIN df ON contains(lower(text), g), n GROUP BY ALL)
SELECT doc_id, block_index, round(score, 5) AS score FROM (
  SELECT doc_id, block_index, s / sqrt(least(greatest(length(text), 20), 300)) * CASE WHEN length(text) BETWEEN 20 AND 300 THEN 1.2 ELSE 1.0 END AS score FROM s
) ORDER BY round(score, 9) DESC, doc_id, block_index LIMIT 20"""


@query("topk_substring_idf", _IDF)
def topk_substring_idf(spark, d):
    blocks = line_blocks(table(spark, d, "documents").select("doc_id", "text"))
    return R.substring_idf(blocks, QUESTION, 20, ["doc_id", "block_index"]).select("doc_id", "block_index", F.round("score", 5).alias("score"))


@query(
    "agg_df",
    f"WITH {BLOCKS} SELECT g AS gram, count(*)::BIGINT AS df FROM (SELECT unnest({_GRAMS!r}) AS g), blocks WHERE contains(lower(text), g) GROUP BY g",
)
def agg_df(spark, d):
    low = line_blocks(table(spark, d, "documents").select("doc_id", "text")).select(F.lower("text").alias("low"))
    sums = low.agg(*[F.sum(F.contains(F.col("low"), F.lit(g)).cast("long")).alias(f"g{i}") for i, g in enumerate(_GRAMS)])
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("gram"), F.col(f"g{i}").alias("df")) for i, g in enumerate(_GRAMS)])).alias("p")
    return sums.select(pairs).select("p.gram", "p.df").where("df > 0")


@query(
    "agg_bm25_stats",
    f"SELECT t AS term, count(*)::BIGINT AS tf, count(DISTINCT doc_id)::BIGINT AS df FROM (SELECT doc_id, unnest({words_sql('text')}) AS t FROM documents) GROUP BY t",
)
def agg_bm25_stats(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(T.tokens("text")).alias("term"))
    # Counted within documents first: the second aggregate is free of distinct sets.
    return words.groupBy("term", "doc_id").count().groupBy("term").agg(F.sum("count").alias("tf"), F.count(F.lit(1)).alias("df"))


@query("set_query_char_overlap", "WITH " + BLOCKS + r""" SELECT doc_id, block_index, len(list_intersect(list_distinct(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g'), '')), list_distinct(string_split('thethanedbleattion', ''))))::INT AS overlap FROM blocks""")
def set_query_char_overlap(spark, d):
    blocks = line_blocks(table(spark, d, "documents").select("doc_id", "text"))
    return blocks.select("doc_id", "block_index", T.char_overlap("text", F.lit(QUESTION)).alias("overlap"))


_SNIP_GRAMS = [QUESTION[i : i + n] for n in range(8, 1, -1) for i in range(len(QUESTION) - n + 1)]
_SNIP_GRAMS = list(dict.fromkeys(_SNIP_GRAMS))


@query(
    "scr_snippet",
    f"""WITH h AS (SELECT doc_id, text, list_filter({_SNIP_GRAMS!r}, lambda g: contains(text, g))[1] AS hit FROM documents),
p AS (SELECT *, position(hit IN text)::INT AS pos FROM h), r AS (SELECT *, greatest(1, pos - 600)::INT AS b, least(length(text), pos + length(hit) - 1 + 600)::INT AS e FROM p)
SELECT doc_id, CASE WHEN hit IS NULL THEN left(text, 1800) ELSE (CASE WHEN b > 1 THEN '…' ELSE '' END) || substring(text, b, e - b + 1) || (CASE WHEN e < length(text) THEN '…' ELSE '' END) END AS snippet FROM r""",
)
def scr_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet("text", QUESTION).alias("snippet"))


@query(
    "scr_citation",
    "SELECT doc_id, q AS quote, (position(q IN text) - 1)::INT AS quote_start, (position(q IN text) - 1 + length(q))::INT AS quote_end FROM (SELECT doc_id, text, substring(text, 11, 20) AS q FROM documents)",
)
def scr_citation(spark, d):
    hits = table(spark, d, "documents").select("doc_id", "text", F.substring("text", 11, 20).alias("quote"))
    return R.cited(hits, "quote", "text").select("doc_id", "quote", "quote_start", "quote_end")
