"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, conversations, ctw, decontam, knn, licenses, line_dedup, near_dup, pii, sharding, substring_dedup, toxicity
from .common import crc_of_id, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_of_id("doc_id") % 5 != 0)
    model = toxicity.train(docs, labels)
    return toxicity.toxicity(docs, model, keep=["doc_id"]).select("_row.doc_id", (crc_of_id("_row.doc_id") % 5 == 0).alias("held_out"), "score", "predicted")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = bpe.bpe(docs, word_vocabulary(), keep=["doc_id"])
    return out.select("_row.doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ctw.train(docs.where(crc_of_id("doc_id") % 10 != 0))
    out = ctw.score(docs, model, keep=["doc_id"])
    return out.select("_row.doc_id", (crc_of_id("_row.doc_id") % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", *decontam.question_answer())
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), items, keep=["doc_id"])
    rounded = [F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")]
    return out.select("_row.doc_id", "item_id", *rounded)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("_row.doc_id", "kept_text", "n_lines", "n_removed")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    names = F.array(*[F.lit(k) for k in pii.KINDS])
    said = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    return out.select("_row.doc_id", *[count(k) for k in range(4)], F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("_row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.Repair(conversations.damaged(table(spark, sf_dir, "conversations"))).summary()


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    out = alignment.align(table(spark, sf_dir, "documents"), a, b, keep=["doc_id"])
    return out.select("_row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("_row.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.col("spans").cast("string").alias("spans"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_bpe": op2_bpe, "op3_nearest": op3_nearest, "op4_ctw": op4_ctw, "op5_near_dup": op5_near_dup, "op6_decontamination": op6_decontamination, "op7_line_dedup": op7_line_dedup, "op8_sharding": op8_sharding, "op9_personal_data": op9_personal_data, "op10_substrings": op10_substrings, "op11_conversation_repair": op11_conversation_repair, "op12_token_alignment": op12_token_alignment, "op13_license_scan": op13_license_scan}
SQL = {"op5_near_dup": near_dup.SQL, "op6_decontamination": decontam.SQL, "op7_line_dedup": line_dedup.SQL, "op10_substrings": substring_dedup.SQL, "op11_conversation_repair": conversations.SQL}
