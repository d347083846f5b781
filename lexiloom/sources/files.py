"""Documents from files: word-processor and layout formats, predictions in several JSON shapes; manifests and partitioned sinks."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.scratch import written

LINE_GAP = 2.0
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ISSUE = "struct<rule_id: string, severity: string, text: string, doc_id: string, doc_type: string>"


def _read_docx(raw: bytes) -> list[tuple]:
    """(type, level, text) of a word-processor file's body in order; tables as piped lines."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            level = int(name[7:]) if name.lower().startswith("heading") and name[7:].isdigit() else None
            out.append(("heading" if level else "paragraph", level, said(node)))
        elif node.tag == f"{_W}tbl":
            rows = [[" ".join(said(c).split()) for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            out.append(("table", None, "\n".join("| " + " | ".join(r) + " |" for r in rows)))
    return [x for x in out if x[2].strip()]


def docx_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of every .docx file of a folder: doc_id (file name), block_index, locator, type, level and text."""
    return blocks_of_docx(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content"))


def blocks_of_docx(files: DataFrame) -> DataFrame:
    """The same of a table of files (path, content)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(name.rsplit("/", 1)[-1], i, f"docx-p-{i:06d}", *b) for name, raw in zip(part.path, part.content) for i, b in enumerate(_read_docx(raw))]
            yield pd.DataFrame(rows, columns=["doc_id", "block_index", "locator", "type", "level", "text"])

    return files.mapInPandas(read, "doc_id string, block_index int, locator string, type string, level int, text string")


def word_lines(words: Column, gap: float = LINE_GAP) -> Column:
    """Words (top, x0, text) of a page as lines: a line goes on while its words start within ``gap`` of its first one."""
    none = F.array().cast("array<struct<top: double, text: string>>")

    def step(lines, w):
        last = F.element_at(lines, F.lit(-1))
        grown = F.struct(last["top"].alias("top"), F.concat_ws(" ", last["text"], w["text"]).alias("text"))
        joins = (F.size(lines) > 0) & (F.abs(w["top"] - F.try_element_at(lines, F.lit(-1))["top"]) <= gap)
        return F.when(joins, F.concat(F.slice(lines, 1, F.greatest(F.lit(0), F.size(lines) - 1)), F.array(grown))).otherwise(F.concat(lines, F.array(F.struct(w["top"].alias("top"), w["text"].alias("text")))))

    return F.transform(F.aggregate(F.array_sort(words), none, step), lambda line: line["text"])


def payload(c) -> Column:
    """A layout service's JSON list as (markdown, pages): texts in order, pages counted from the largest index."""
    items = F.from_json(c, "array<struct<text: string, page_idx: int>>")
    shown = F.array_join(F.transform(F.filter(items, lambda i: F.trim(i["text"]) != ""), lambda i: i["text"]), "\n\n")
    return F.struct(shown.alias("markdown"), (F.array_max(F.transform(items, lambda i: i["page_idx"])) + 1).alias("pages"))


def predictions(c) -> Column:
    """Issues from any of the shapes in use: a list; an object with findings, issues or predictions; documents with findings, which inherit id and type."""
    c = F.col(c) if isinstance(c, str) else c
    body = F.from_json(c, f"findings array<{ISSUE}>, issues array<{ISSUE}>, predictions array<{ISSUE}>, documents array<struct<doc_id: string, doc_type: string, findings: array<{ISSUE}>>>")
    own = lambda i, d: F.struct(i["rule_id"].alias("rule_id"), i["severity"].alias("severity"), i["text"].alias("text"), F.coalesce(i["doc_id"], d["doc_id"]).alias("doc_id"), F.coalesce(i["doc_type"], d["doc_type"]).alias("doc_type"))
    nested = F.flatten(F.transform(body["documents"], lambda d: F.transform(d["findings"], lambda i: own(i, d))))
    return F.when(F.ltrim(c).startswith("["), F.from_json(c, f"array<{ISSUE}>")).otherwise(F.coalesce(body["findings"], body["issues"], body["predictions"], nested))


def manifest(files: DataFrame, name: str, content: str) -> DataFrame:
    """name, sha256 and bytes of each file."""
    raw = F.col(content).cast("binary")
    return files.select(name, F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("bytes"))


def verified(listed: DataFrame, there: DataFrame, name: str) -> DataFrame:
    """Each listed file as ok, changed or missing, each other one as extra."""
    both = listed.select(name, F.col("sha256").alias("a")).join(there.select(name, F.col("sha256").alias("b")), name, "full")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "ok").otherwise("changed")
    return both.select(name, state.alias("state"))


def write_index(df: DataFrame, path: str, keys: list[str]) -> int:
    """Writes chunks by partition, so that writing a document again replaces only itself, and checks the number of rows."""
    df.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    wrote = df.count()
    stored = df.sparkSession.read.parquet(path).join(df.select(*keys).distinct(), keys, "left_semi").count()
    if stored != wrote:
        raise RuntimeError(f"{wrote} rows were to be written, {stored} are there")
    return wrote


def publish_versions(rows: DataFrame, path: str, keys: list[str], content: str) -> DataFrame:
    """Writes versions that are not there yet and changes none that is: ``verdict`` is written, replayed (the same content) or conflict (another one).

    Spark's committer makes the new files appear together or not at all.
    """
    spark, digest = rows.sparkSession, F.sha2(F.col(content).cast("binary"), 256)
    try:
        there = spark.read.parquet(path).select(*keys, digest.alias("_there"))
    except AnalysisException:  # nothing has been published
        there = rows.limit(0).select(*keys, digest.alias("_there"))
    verdict = F.when(F.col("_there").isNull(), "written").when(F.col("_there") == digest, "replayed").otherwise("conflict")
    judged = written(rows.join(there, keys, "left").withColumn("verdict", verdict).drop("_there"), "verdicts")
    judged.where("verdict = 'written'").drop("verdict").write.mode("append").parquet(path)
    return judged.select(*keys, "verdict")


def back_up(files: DataFrame, path: str, name: str, content: str) -> DataFrame:
    """Writes files with their digests as one archive and returns its manifest."""
    raw = F.col(content).cast("binary")
    files.select(F.col(name).alias("name"), raw.alias("content"), F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("bytes")).write.parquet(path)
    return files.sparkSession.read.parquet(path).select("name", "sha256", "bytes")


def restorable(archive: DataFrame, listed: DataFrame) -> DataFrame:
    """Each file of an archive (name, content) as ok, unsafe_path, unlisted or changed; nothing but ok files may be restored."""
    unsafe = F.col("name").rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|\z)") | (F.col("name") == "")
    both = archive.join(listed.select("name", F.col("sha256").alias("_listed")), "name", "left")
    state = F.when(unsafe, "unsafe_path").when(F.col("_listed").isNull(), "unlisted").when(F.sha2("content", 256) != F.col("_listed"), "changed").otherwise("ok")
    return both.select("name", state.alias("state"))


def embedded(texts: DataFrame, text: str, embed, batch: int = 100, retries: int = 2, wait: float = 1.0) -> DataFrame:
    """Adds ``vector`` from a service: ``embed(list of texts)`` gives a vector for each.

    Equal texts are asked for once, ``batch`` at a time; a batch that fails is tried again after ``wait``,
    then twice as long, ``retries`` times in all, before the task fails.
    """

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                own = part.iloc[i : i + batch]
                for attempt in range(retries + 1):
                    try:
                        vectors = embed(own["said"].tolist())
                        break
                    except Exception:
                        if attempt == retries:
                            raise
                        time.sleep(wait * 2**attempt)
                yield pd.DataFrame({"key": own["key"], "vector": [[float(x) for x in v] for v in vectors]})

    key = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    asked = texts.groupBy(key.alias("key")).agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("said"))
    known = written(asked.mapInPandas(ask, "key string, vector array<double>"), "vectors")
    return texts.withColumn("_key", key).join(known.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
