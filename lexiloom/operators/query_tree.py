"""A small query algebra over an index: leaves find documents, ``Bool`` combines them.

Filters and excluded clauses become semi and anti joins that restrict every scoring clause's postings before
anything is summed, let alone cut; the scores of ``must`` and ``should`` clauses meet in one aggregate by key.
A term's weight counts all live documents, whatever the filters leave, as a search engine's does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import bm25
from .search_index import SearchIndex

Within = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class MatchAll:
    """Every document, score 1."""


@dataclass(frozen=True)
class MatchNone:
    """No document."""


@dataclass(frozen=True)
class Match:
    """Words in text fields with their boosts; the best field counts (``best_fields``). Any word will do, or all of them in one field (``every``)."""

    words: tuple[str, ...]
    fields: tuple[tuple[str, float], ...]
    every: bool = False


@dataclass(frozen=True)
class Term:
    """An attribute that equals a value; weighs as much as the value is rare."""

    attribute: str
    value: object


@dataclass(frozen=True)
class Terms:
    """An attribute that equals one of the values, score 1."""

    attribute: str
    values: tuple


@dataclass(frozen=True)
class Exists:
    """An attribute that is there, score 1."""

    attribute: str


@dataclass(frozen=True)
class Bool:
    """All of ``must`` and ``filter``, none of ``must_not``, and of ``should`` as many as asked for.

    Without a number one of ``should`` is needed where nothing else is, else none. Negative numbers and
    percentages say how many may be missing and what share, rounded down.
    """

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    filter: tuple = ()
    minimum_should_match: int | str | None = None
    needed: int = field(init=False, default=0)

    def __post_init__(self):
        asked, n = self.minimum_should_match, len(self.should)
        if asked is None:
            needed = int(bool(n) and not self.must and not self.filter)
        elif isinstance(asked, str) and asked.endswith("%"):
            share = int(asked[:-1])
            needed = n * share // 100 if share >= 0 else n - n * -share // 100
        else:
            needed = int(asked) if int(asked) >= 0 else n + int(asked)
        object.__setattr__(self, "needed", max(0, needed))


def _everything(rows: DataFrame) -> DataFrame:
    return rows


def _of(index: SearchIndex, condition: Column, within: Within, score: Column | float = 1.0) -> DataFrame:
    rows = within(index.docs().where(condition).select("key")).distinct()
    return rows.select("key", (F.lit(score) if isinstance(score, float) else score).alias("score"))


def _column(index: SearchIndex, name: str) -> Column:
    """An attribute that no segment has is null everywhere."""
    return F.col(name) if name in index.attributes else F.lit(None).cast("string")


def hits(index: SearchIndex, node, within: Within = _everything) -> DataFrame:
    """``key`` and ``score`` of each document that the tree finds; one row a document."""
    if isinstance(node, MatchNone) or isinstance(node, Terms) and not node.values:
        return index.docs().select("key", F.lit(0.0).alias("score")).limit(0)
    if isinstance(node, MatchAll):
        return _of(index, F.lit(True), within)
    if isinstance(node, Exists):
        return _of(index, _column(index, node.attribute).isNotNull(), within)
    if isinstance(node, Terms):
        return _of(index, _column(index, node.attribute).isin(list(node.values)), within)
    if isinstance(node, Term):
        column = _column(index, node.attribute)
        n, df = index.docs().agg(F.count(column), F.count(F.when(column == node.value, 1))).first()
        return _of(index, column == node.value, within, F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5))))
    if isinstance(node, Match):
        found = bm25(index, list(node.words), dict(node.fields), within)
        return found.select(F.col("doc_id").alias("key"), "score") if not node.every else _all_words(index, node, found)
    return _bool(index, node, within)


def _all_words(index: SearchIndex, node: Match, found: DataFrame) -> DataFrame:
    words = list(dict.fromkeys(node.words))
    rows = index.postings(words, [f for f, _ in node.fields]).groupBy("key", "field").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(words))
    return found.select(F.col("doc_id").alias("key"), "score").join(rows.select("key"), "key", "left_semi")


def _bool(index: SearchIndex, node: Bool, within: Within) -> DataFrame:
    inside = [hits(index, c, within).select("key") for c in node.filter]
    outside = [hits(index, c, within).select("key") for c in node.must_not]

    def restricted(rows: DataFrame) -> DataFrame:
        rows = within(rows)
        for keys in inside:
            rows = rows.join(keys, "key", "left_semi")
        for keys in outside:
            rows = rows.join(keys, "key", "left_anti")
        return rows

    scoring = [(c, "must") for c in node.must] + [(c, "should") for c in node.should]
    needs = len(node.must) or node.needed
    if node.needed > len(node.should):
        return hits(index, MatchNone())
    parts = [hits(index, c, restricted).select("key", "score", F.lit(kind).alias("kind")) for c, kind in scoring]
    if not needs:  # nothing scoring is asked for: the filters find, a query of no clauses finds all
        plain = 0.0 if node.filter or node.must_not or node.should else 1.0
        parts.append((inside[0] if node.filter else index.docs().select("key")).transform(restricted).distinct().select("key", F.lit(plain).alias("score"), F.lit("all").alias("kind")))
    if not parts:
        return hits(index, MatchNone())
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    rows = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("score").alias("score"), count("must").alias("must"), count("should").alias("should"))
    return rows.where((F.col("must") == len(node.must)) & (F.col("should") >= node.needed)).select("key", "score")
