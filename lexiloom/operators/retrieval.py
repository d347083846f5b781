"""Hybrid retrieval: BM25 over fields, cosine neighbours, reciprocal rank fusion, evidence ranking."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.sources.scratch import written

from .search_index import SearchIndex

K1, B, RRF = 1.2, 0.75, 60
BOOSTS = {"title": 3.0, "content": 1.0}
SNIPPET_CHARS = 120


def analyzed(spark: SparkSession, question: str) -> list[str]:
    """The words of a question, as its texts' words are taken."""
    return spark.range(1).select(T.tokens(F.lit(question)).alias("t")).first().t


def bm25(index: SearchIndex, terms: list[str], boosts: dict[str, float], within: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id and score of every text with a query term; the best of the boosted fields counts. Reads the terms' postings and nothing else.

    ``within`` restricts rows by their ``key``: it is applied to postings before scores are summed. How rare a
    term is counts all live texts.
    """
    asked = list(dict.fromkeys(terms)) or [""]
    weights = F.create_map(*[F.lit(x) for f, w in boosts.items() for x in (f, float(w))])
    stat = lambda k: F.create_map(*[F.lit(x) for f in boosts for x in (f, float(index.stat(f)[k]))])[F.col("field")]
    found = index.postings(asked, list(boosts))
    held = found.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))  # a row for each term and field
    idf = F.log(1 + (stat(0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    repeated = F.create_map(*[F.lit(x) for t in asked for x in (t, terms.count(t))])[F.col("term")]
    part = repeated * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / stat(1)))
    rows = found if within is None else within(found)
    scores = rows.join(F.broadcast(held), ["term", "field"]).groupBy("key", "field").agg((F.sum(part) * F.first(weights[F.col("field")])).alias("score"))
    return scores.groupBy(F.col("key").alias("doc_id")).agg(F.max("score").alias("score")).where("score > 0")


def cosine(vectors: DataFrame, query_id: int | None, id_col: str = "vec_id", vector_col: str = "embedding", within: Callable[[DataFrame], DataFrame] | None = None, query: DataFrame | None = None) -> DataFrame:
    """Cosine of every vector, of those that ``within`` leaves, with one query vector, given by id or as a table of one row."""
    wide = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("v"))
    one = wide.where(F.col(id_col) == query_id).select(F.col("v").alias("q")) if query is None else query.select(F.col(vector_col).alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q"))
    rows = wide if within is None else within(wide)
    return rows.crossJoin(F.broadcast(one)).select(F.col(id_col), score.alias("score"))


def ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best with 0-based ranks; ties to the smaller key. A top-k first, so the window has k rows."""
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)


def fused(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion; ties keep the earlier list, then the better rank."""
    rows = reduce(DataFrame.unionByName, [x.select(F.col(key), F.col("rank"), F.lit(n).alias("list")) for n, x in enumerate(lists)])
    parts = rows.groupBy(key).agg(F.sum(1.0 / (RRF + 1 + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return parts.orderBy(F.desc("score"), "first.list", "first.rank").limit(k).select(key, "score", F.col("first.list").alias("first_list"), F.col("first.rank").alias("first_rank"))


def hybrid(index: SearchIndex, vectors: DataFrame, terms: list[str], query_id: int, k: int = 10) -> DataFrame:
    """BM25 (2k candidates, title three times content) and cosine (k) lists fused."""
    words = ranked(bm25(index, terms, BOOSTS), "doc_id", 2 * k)
    near = ranked(cosine(vectors, query_id).withColumnRenamed("vec_id", "doc_id"), "doc_id", k)
    return fused([words, near], "doc_id", k)


def scoped(index: SearchIndex, vectors: DataFrame, terms: list[str], query_id: int, inside: DataFrame, k: int = 6) -> DataFrame:
    """Document search inside a scope (doc_ids in ``inside``): both searches see nothing else, so a narrow scope is answered in full."""
    keys = inside.select(F.col("doc_id").alias("key"))
    words = ranked(bm25(index, terms, BOOSTS, lambda rows: rows.join(keys, "key", "left_semi")), "doc_id", 2 * k)
    near = ranked(cosine(vectors, query_id, within=lambda rows: rows.join(keys, rows["vec_id"] == keys["key"], "left_semi")).withColumnRenamed("vec_id", "doc_id"), "doc_id", k)
    return fused([words, near], "doc_id", k)


def substring_idf(blocks: DataFrame, question: str, k: int, order: list[str]) -> DataFrame:
    """Blocks by the weights of the question's 2- to 4-character substrings that they hold.

    A substring weighs its length squared times 1 + ln(N / df); the sum is divided by the root of the
    block's length within [20, 300] and raised by a fifth for lengths in that range.
    """
    grams = sorted({question[i : i + n].lower() for n in (2, 3, 4) for i in range(len(question) - n + 1) if question[i : i + n].strip()})
    low = F.lower("text")
    # One pass over the texts: which substrings a block holds, 60 to an integer; statistics and scores read that table alone.
    words = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.contains(low, F.lit(g)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, g in enumerate(grams[at : at + 60])]) for at in range(0, len(grams), 60)]
    held = written(blocks.select(*order, F.length("text").alias("size"), F.array(*words).alias("held")), "grams")
    has = lambda i: F.shiftright(F.col("held")[i // 60], i % 60).bitwiseAND(F.lit(1))
    n, *df = held.agg(F.count(F.lit(1)), *[F.sum(has(i)) for i in range(len(grams))]).first()
    total = reduce(lambda a, b: a + b, [has(i) * F.lit(len(g) ** 2 * (1 + math.log(n / df[i]))) for i, g in enumerate(grams) if df[i]], F.lit(0.0))
    size = F.col("size")
    score = total / F.sqrt(F.least(F.greatest(size, F.lit(20)), F.lit(300)).cast("double")) * F.when((size >= 20) & (size <= 300), 1.2).otherwise(1.0)
    return held.where(F.exists("held", lambda x: x != 0)).withColumn("score", score).where("score > 0").orderBy(F.desc("score"), *order).limit(k).select(*order, "score")


def cited(hits: DataFrame, quote_col: str, text_col: str) -> DataFrame:
    """Exact citations: 0-based offsets of the quote in the block's text; rows without it are rejected."""
    at = F.position(F.col(quote_col), F.col(text_col))
    return hits.withColumn("quote_start", F.when(at > 0, at - 1)).withColumn("quote_end", F.col("quote_start") + F.length(quote_col))
