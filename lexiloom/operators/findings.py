"""Findings from rules and models: gates, persistence shapes, decisions, suggestions, prompts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T

REPORT_HEAD = "# Review of "


def refusal(count: Column, score: Column, refused: Column, answer: Column, refs: Column, known: Column) -> Column:
    """Why an answer is withheld, first reason first; null if it stands. ``known``: whether all references are known."""
    return (
        F.when((count == 0) | (score <= 0), "no_evidence")
        .when(refused, "model_no_evidence")
        .when((F.trim(answer) == "") | (refs == 0), "unverified_answer")
        .when(~known, "invalid_citation")
    )


def resolved_quotes(issues: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Issues with the first block of their document that holds the quote and its offsets there, or nulls.

    False positives go. Only blocks of the issue's own document are compared, by an equi-join on the key.
    """
    real = issues.withColumn("quote", F.trim("quote")).where(T.false_positive_reason("quote").isNull())
    held = real.select(key, "quote").distinct().join(blocks.select(key, "block_index", "text"), key).where(F.contains("text", "quote"))
    first = held.groupBy(key, "quote").agg(F.min(F.struct("block_index", (F.position("quote", "text") - 1).alias("start"))).alias("at"))
    both = real.join(first, [key, "quote"], "left")
    return both.select(*real.columns, F.col("at.block_index").alias("block_index"), F.col("at.start").alias("start"), (F.col("at.start") + F.length("quote")).alias("end"))


def absolute_block(start: Column, size: Column, relative: Column) -> Column:
    """A model's paragraph number within its chunk, or already absolute, as a block index."""
    return F.when((relative >= 0) & (relative < size), start + relative).when(relative >= start, relative)


def stored(findings: DataFrame, mode: str) -> DataFrame:
    """The persisted shape: with ``high_only`` all but high severities are kept but suppressed."""
    return findings.withColumn("suppressed", (F.lit(mode) == "high_only") & (F.col("severity") != "high"))


def with_decisions(findings: DataFrame, decisions: DataFrame, key: str, revision: str) -> DataFrame:
    """Each finding with its latest decision, if any."""
    last = decisions.groupBy(key).agg(F.max_by("decision", revision).alias("decision"))
    return findings.join(last, key, "left")


def with_suggestions(findings: DataFrame, items: DataFrame, key: str, order: str) -> DataFrame:
    """The last suggestion for each finding where it has text; the rule's own otherwise."""
    last = items.groupBy(key).agg(F.max_by("suggestion", order).alias("_s"))
    said = F.when(F.col("_s") != "", F.col("_s"))
    return findings.join(last, key, "left").select(*findings.columns, said.alias("suggestion"), F.when(said.isNotNull(), "model").otherwise("rule").alias("suggestion_source"))


def prompts(blocks: DataFrame, system: str, size: int, key: str = "doc_id") -> DataFrame:
    """One prompt for each chunk of ``size`` blocks: the system text and numbered lines."""
    parts = blocks.groupBy(key, F.floor(F.col("block_index") / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("block_index", "text"))).alias("b"))
    line = lambda b: F.concat(F.lit("["), (b["block_index"] % size).cast("string"), F.lit("]"), b["text"])
    return parts.select(key, "chunk", F.concat(F.lit(system + "\n"), F.array_join(F.transform("b", line), "\n")).alias("prompt"))


def report(findings: DataFrame, order: list[str], key: str = "doc_id") -> DataFrame:
    """A Markdown report for each document: head line, then numbered findings in order."""
    rows = findings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "severity", "quote"))).alias("f"))
    line = lambda f, i: F.concat((i + 1).cast("string"), F.lit(". ["), f["severity"], F.lit("] "), f["rule_id"], F.lit(": "), f["quote"])
    return rows.select(key, F.concat(F.lit(REPORT_HEAD), F.col(key).cast("string"), F.lit("\n\n"), F.array_join(F.transform("f", line), "\n")).alias("report"))


def preview(blocks: DataFrame, level: Column, key: str = "doc_id") -> DataFrame:
    """Blocks as Markdown, headings one level deeper."""
    shown = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), level + 1), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    rows = blocks.withColumn("_shown", shown).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_index", "_shown"))).alias("b"))
    return rows.select(key, F.array_join(F.transform("b", lambda b: b["_shown"]), "\n\n").alias("markdown"))


def outline(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headings in order and the number of tables."""
    heads = F.array_sort(F.collect_list(F.when(F.col("type") == "heading", F.struct("block_index", "text"))))
    rows = blocks.groupBy(key).agg(heads.alias("h"), F.count(F.when(F.col("type") == "table", 1)).alias("tables"))
    return rows.select(key, F.transform("h", lambda h: h["text"]).alias("outline"), "tables")


def evidence_blocks(hits: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits with their block: by id, else the document's first usable block whose text the hit's content holds."""
    usable = blocks.where(T.is_usable("text"))
    by_id = hits.join(usable.select(key, "block_id", "block_index"), [key, "block_id"], "left")
    found = by_id.where("block_index IS NOT NULL").select("hit_id", key, "block_index")
    rest = hits.join(found.select("hit_id"), "hit_id", "left_anti").select("hit_id", key, "content")
    inside = rest.join(usable.select(key, "block_index", "text"), key).where(F.contains("content", "text"))
    return found.unionByName(inside.groupBy("hit_id", key).agg(F.min("block_index").alias("block_index")))


def recommended(questions: Column, templates: list[str], least: int = 3, most: int = 5) -> Column:
    """Up to ``most`` distinct questions without case, filled up to ``least`` from templates."""
    own = F.slice(F.array_distinct(F.transform(questions, F.lower)), 1, most)
    more = F.array_except(F.array(*[F.lit(t) for t in templates]), own)
    return F.when(F.size(own) >= least, own).otherwise(F.slice(F.concat(own, more), 1, least))


def best_spans(quotes: DataFrame, spans: DataFrame, key: str, least: int = 8) -> DataFrame:
    """For each quote the span with the longest common prefix (at least ``least``), or that it holds; first span on ties."""
    both = quotes.join(spans, key)
    lcp = T.common_prefix("quote", "span_text")
    near = both.withColumn("lcp", lcp).where((F.col("lcp") >= least) | (F.contains("quote", "span_text") & (F.length("span_text") >= 4)))
    ranked = Window.partitionBy(key, "quote_id").orderBy(F.desc("lcp"), "span_id")
    return near.withColumn("_n", F.row_number().over(ranked)).where("_n = 1").select(key, "quote_id", "span_id", "lcp")
