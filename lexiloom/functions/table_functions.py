"""Table functions for SQL: chunks of a text beside its row, rules over a document's blocks in order.

``register(spark)`` makes them known::

    SELECT d.doc_id, c.* FROM docs d, LATERAL chunk_text(d.text, 384, 46) c
    SELECT * FROM rule_hits(TABLE(blocks), '[{"rule_id": "r", "text_pattern": ["x"]}]')
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as t
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from lexiloom.operators import chunking, rule_sets


@udtf
class ChunkText:
    """Sentence windows of a text, numbered from 0; the most characters and the overlap are constants of the query."""

    @staticmethod
    def analyze(text: AnalyzeArgument, most: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not (most.isConstantExpression and overlap.isConstantExpression) or not 0 <= (overlap.value or 0) < (most.value or 0):
            raise ValueError("chunk_text(text, most, overlap) takes two constants, 0 <= overlap < most")
        return AnalyzeResult(t.StructType().add("chunk_id", t.IntegerType()).add("chunk", t.StringType()))

    def eval(self, text: str, most: int, overlap: int) -> Iterator[tuple]:
        yield from enumerate(chunking.sentence_windows(text or "", most, overlap))


@udtf
class RuleHits:
    """Hits of JSON rules over a table of doc_id, block_index, type, text and, if there, section_path.

    It asks for its own partitioning and order, so the query gives none, and keeps a document's nearest heading alone.
    """

    def __init__(self):
        self.rules, self.document, self.heading, self.at = None, object(), "", None

    @staticmethod
    def analyze(blocks: AnalyzeArgument, rules: AnalyzeArgument) -> AnalyzeResult:
        if not blocks.isTable or not rules.isConstantExpression:
            raise ValueError("rule_hits(TABLE(blocks), rules) takes a table and constant rules")
        known = {f.name: f.dataType for f in blocks.dataType.fields}
        missing = {"doc_id", "block_index", "type", "text"} - set(known)
        if missing:
            raise ValueError(f"blocks without {', '.join(sorted(missing))}")
        rule_sets.RuleSet(json.loads(rules.value))  # an invalid rule is an error of the query
        schema = t.StructType().add("doc_id", known["doc_id"]).add("block_index", known["block_index"])
        for name, kind in (("rule_id", t.StringType()), ("matcher", t.StringType()), ("pattern", t.StringType()), ("start", t.IntegerType()), ("end", t.IntegerType()), ("quote", t.StringType())):
            schema = schema.add(name, kind)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("block_index")])

    def eval(self, block: t.Row, rules: str) -> Iterator[tuple]:
        self.rules = self.rules or rule_sets.RuleSet(json.loads(rules))
        if block["doc_id"] != self.document:
            self.document, self.heading, self.at = block["doc_id"], "", None
        if block["type"] == "heading":
            self.heading, self.at = block["text"] or "", block["block_index"]
        section = block["section_path"] if "section_path" in block.__fields__ else None
        distance = None if self.at is None else block["block_index"] - self.at
        for hit in self.rules.block(block["text"] or "", section or "", self.heading, distance):
            yield block["doc_id"], block["block_index"], *hit


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("rule_hits", RuleHits)
