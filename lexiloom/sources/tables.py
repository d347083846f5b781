"""Reading tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADING_CHARS = 40


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_blocks(docs: DataFrame, text_col: str = "text", heading_chars: int = HEADING_CHARS) -> DataFrame:
    """One block for each line: block_index, block_id (``b1`` first), type by length and the line's text."""
    rest = [c for c in docs.columns if c != text_col]
    lines = docs.select(*rest, F.posexplode(F.split(text_col, "\n", -1)).alias("block_index", "text"))
    return lines.withColumns(
        {
            "block_id": F.concat(F.lit("b"), (F.col("block_index") + 1).cast("string")),
            "type": F.when(F.length("text") <= heading_chars, "heading").otherwise("paragraph"),
        }
    )


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every non-empty text file of a folder: doc_id (file name), title and text."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("doc_id"), F.col("value").alias("text")).where(F.col("text").rlike(r"(?U)\S")).withColumn("title", title_of("doc_id"))


def title_of(name: str):
    """A title from a file name: without extension, and without a leading number's part up to the first hyphen."""
    stem = F.regexp_replace(name, r"\.(txt|pdf|docx)$", "")
    return F.when(stem.rlike(r"^\d[^-]*-"), F.regexp_replace(stem, r"^\d[^-]*-", "")).otherwise(stem)


def json_folder(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON files below a folder, one record or list each; unreadable files are left out."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def upload_verdict(name: str, size: str, limit: int = 50 * 1024 * 1024):
    """Why an upload is refused, or null."""
    lower = F.lower(F.col(name))
    return (
        F.when(lower.endswith(".doc"), "legacy_format")
        .when(~lower.rlike(r"\.(pdf|docx)$"), "unsupported_format")
        .when(F.col(size) <= 0, "empty")
        .when(F.col(size) > limit, "too_large")
    )


def safe_name(name: str):
    return F.left(F.regexp_replace(name, r"(?U)[^\w一-鿿.\-()（）\[\] ]", "_"), F.lit(180))


def named(spark: SparkSession, d: str) -> DataFrame:
    """Documents under short names, their first words, as rows of key, group and name."""
    key = F.col("doc_id")
    return table(spark, d, "documents").select(key.alias("n_nationkey"), (key % 40).alias("n_regionkey"), F.regexp_extract("text", "[A-Za-z]+", 0).alias("n_name"))
