"""The training-data pipeline: stages in order, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns documents: rejected documents go (toxicity, near
duplicates, contaminated texts), texts lose repeated passages (line dedup; a document that loses all
of its lines goes, one that was empty before stays) and the last stage returns the encoded corpus.

Toxic and contaminated rows go by id and text, so a clean row that shares its doc_id stays. Rows of one
doc_id are one document for near duplicates: they stay or go together. Null ids and texts, repeated rows
and extra columns pass; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, decontam, line_dedup, near_dup, toxicity
from lexiloom.llm.common import TABLES, counted, emptied, packed, sized, table, written
from lexiloom.llm.queries import word_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier, fitted on the labelled documents, predicts to be toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model)
    return scored.where("predicted = 0").select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs).where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_lines") == 0))
    return out.select(*[F.col("kept_text").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays."""
    found = near_dup.near_duplicates(docs.select("doc_id", "text"))
    gone, n = counted(found.where("NOT kept").select(F.col("id").alias("doc_id")).distinct())
    return docs.join(sized(gone, n), "doc_id", "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", *decontam.question_answer())
    found = decontam.decontaminate(docs.select("doc_id", "text"), items)
    gone, n = counted(found.select(F.col("_row.doc_id").alias("_gone_id"), F.md5(F.col("_row.text").cast("binary")).alias("_gone_text")).distinct())
    held = docs.select(packed(docs))  # as one column, so that no other name can clash
    return held.join(sized(gone, n), F.col("_row.doc_id").eqNullSafe(F.col("_gone_id")) & (F.md5(F.col("_row.text").cast("binary")) == F.col("_gone_text")), "left_anti").select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.bpe(docs.select("doc_id", "text"), word_vocabulary(), keep=["doc_id"], cached_runs=40_000)  # other stages' workers share the memory
    return out.select("_row.doc_id", F.expr("length(ids) div 4").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: Compression distance and byte-pair encoding have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote for itself, and what it read, is emptied once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), len(TABLES)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
            emptied(spark, TABLES[before:-1])
    return docs
