"""Blocks from Markdown, layout lists and raw parser output, and tables that run across blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import grids as G


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """heading, table and paragraph blocks: neighbouring lines of one kind are an island, headings stand alone."""
    trimmed = F.trim("text")
    kind = F.when(trimmed == "", "blank").when(trimmed.startswith("#"), "heading").when(trimmed.startswith("|"), "table").otherwise("paragraph")
    return _islands(_lines(docs, key, text_col).withColumn("type", kind), key, r"^\s*(#+)")


def strict_markdown_blocks(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As above, but a heading needs one to six marks and a blank, a table a separator below its first line; a paragraph's lines are joined by blanks."""
    order = Window.partitionBy(key).orderBy("line")
    piped = F.contains(F.col("text"), F.lit("|"))
    lines = _lines(docs, key, text_col).withColumn("piped", piped)
    after = F.lead("text").over(order)
    lines = lines.withColumn("start", F.col("piped") & F.coalesce(F.contains(after, F.lit("|")) & G.is_separator(F.trim(after)), F.lit(False)))
    run = F.sum((~F.col("piped")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    begun = F.max("start").over(Window.partitionBy(key, "run").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("run", run).withColumn("in_table", F.col("piped") & begun)
    kind = F.when(F.col("in_table"), "table").when(F.trim("text") == "", "blank").when(F.col("text").rlike(r"^#{1,6}\s+"), "heading").otherwise("paragraph")
    out = _islands(lines.withColumn("type", kind).select(key, "line", "text", "type"), key, r"^(#{1,6})\s")
    return out.withColumn("text", F.when(F.col("type") == "paragraph", F.regexp_replace("text", "\n", " ")).otherwise(F.col("text")))


def _lines(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "text"))


def _islands(lines: DataFrame, key: str, marks: str) -> DataFrame:
    """Neighbouring lines of one type as one block; headings stand alone and lose their marks."""
    order = Window.partitionBy(key).orderBy("line")
    marked = lines.withColumn("new", ((F.col("type") == "heading") | ~F.col("type").eqNullSafe(F.lag("type").over(order))).cast("int"))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    grouped = marked.withColumn("island", island).where("type <> 'blank'").groupBy(key, "island", "type").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    blocks = grouped.select(key, "type", F.array_join("l.text", "\n").alias("raw"), F.get("l", F.lit(0))["line"].alias("line"))
    text = F.when(F.col("type") == "heading", F.trim(F.regexp_replace("raw", r"^\s*#+", ""))).otherwise(F.col("raw"))
    level = F.when(F.col("type") == "heading", F.length(F.regexp_extract("raw", marks, 1)))
    return blocks.select(key, "line", "type", level.alias("level"), text.alias("text"))


def normalized_blocks(raw: DataFrame, key: str = "doc_id") -> DataFrame:
    """Typed blocks without page headers and footers; ids count empty blocks too, which then go, so they can have gaps."""
    kept = raw.where(~F.lower("type").isin("header", "footer", "page_header", "page_footer"))
    kind = F.lower("type")
    typed = F.when(kind.isin("title", "heading"), "heading").when(kind == "table", "table").when(kind.isin("list", "list_item"), "list").otherwise("paragraph")
    n = F.row_number().over(Window.partitionBy(key).orderBy("position"))
    out = kept.withColumn("n", n).withColumn("block_id", F.coalesce(F.nullif("block_id", F.lit("")), F.concat(F.lit("b"), F.col("n").cast("string"))))
    return out.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(key, "position", "block_id", typed.alias("type"), "text")


def content_list_blocks(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Layout items (type, text, table_body, text_level, page_idx) as blocks with 1-based pages."""
    body = F.coalesce(F.nullif("table_body", F.lit("")), F.nullif("text", F.lit("")))
    kind = F.when(F.col("type") == "table", "table").when((F.col("type") == "header") | (F.col("text_level") > 0), "heading").when(F.col("type") == "list", "list").otherwise("paragraph")
    return items.select(key, "position", kind.alias("type"), body.alias("text"), (F.col("page_idx") + 1).alias("page_number")).where("text IS NOT NULL")


def merged_tables(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Neighbouring Markdown tables of equal width become one: each later one loses its header, whatever it says, if a separator stands below it. No other row goes."""
    w = Window.partitionBy(key).orderBy("block_index")
    lines = F.split(F.trim("text"), "\n", -1)
    second = F.trim(F.get(lines, F.lit(1)))
    wide = (
        blocks.withColumn("grid", F.when(F.col("type") == "table", G.markdown_grid("text")))
        .withColumn("width", F.size(F.get("grid", F.lit(0))))
        .withColumn("headed", F.coalesce(second.startswith("|") & G.is_separator(second), F.lit(False)))
    )
    same = (F.lag("width").over(w) == F.col("width")) & (F.lag("type").over(w) == "table") & (F.col("type") == "table")
    islands = wide.withColumn("island", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = islands.groupBy(key, "island").agg(F.min("block_index").alias("block_index"), F.first("type").alias("type"), F.array_sort(F.collect_list(F.struct("block_index", "grid", "headed", "text"))).alias("p"))
    rows = F.flatten(F.transform("p", lambda x, i: F.when((i > 0) & x["headed"], F.slice(x["grid"], 2, F.greatest(F.size(x["grid"]), F.lit(1)))).otherwise(x["grid"])))
    found = F.get(F.get("p", F.lit(0))["grid"], F.lit(0)).isNotNull()
    return parts.select(key, "block_index", "type", F.size("p").alias("merged"), F.when((F.size("p") > 1) & found, G.grid_markdown(rows)).otherwise(F.get("p", F.lit(0))["text"]).alias("text"))
