"""Queries on tables in texts, geometry, chunks and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import geometry as Geo
from lexiloom.functions import grids as G
from lexiloom.operators import blocks as Bl
from lexiloom.operators import chunking as C
from lexiloom.sources.tables import line_blocks, named, table
from lexiloom.streaming import events as Ev

from .base import query


@query("tbl_is_html", "SELECT page_id, regexp_matches(html, '(?i)<\\s*/?\\s*table\\b') AS has_table FROM pages")
def tbl_is_html(spark, d):
    return table(spark, d, "pages").select("page_id", G.has_html_table("html").alias("has_table"))


_MD = "m AS (SELECT n_nationkey, '| key | name |' || chr(10) || '| --- | :---: |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10) || '|  | |' || chr(10) || '| x |' AS md FROM named)"


def _markdown(spark, d):
    md = F.concat(F.lit("| key | name |\n| --- | :---: |\n| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |\n|  | |\n| x |"))
    return named(spark, d).select("n_nationkey", "n_name", md.alias("md"))


@query("tbl_md_to_grid", "SELECT n_nationkey, 'key,name;' || n_nationkey || ',' || n_name || ';x,' AS grid, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10) || '| x |  |' AS markdown FROM named")
def tbl_md_to_grid(spark, d):
    rows = _markdown(spark, d).withColumn("g", G.markdown_grid("md"))
    return rows.select("n_nationkey", F.array_join(F.transform("g", lambda r: F.array_join(r, ",")), ";").alias("grid"), G.grid_markdown("g").alias("markdown"))


@query("tbl_is_md", "SELECT n_nationkey, true AS table_like, NOT true AS plain_like FROM named")
def tbl_is_md(spark, d):
    return _markdown(spark, d).select("n_nationkey", G.has_markdown_table("md").alias("table_like"), G.has_markdown_table("n_name").alias("plain_like"))


@query("tbl_html_to_grid", "SELECT n_nationkey, 'key,name;' || n_nationkey || ',' || n_name AS grid, '<table><thead><tr><th>key</th><th>name</th></tr></thead><tbody><tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr></tbody></table>' AS html FROM named")
def tbl_html_to_grid(spark, d):
    raw = F.concat(F.lit("<p>x</p><TABLE><tr><th>key</th><th> name</th></tr><tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td><b>"), "n_name", F.lit("</b></td></tr></TABLE>"))
    rows = named(spark, d).select("n_nationkey", G.html_grid(raw).alias("g"))
    return rows.select("n_nationkey", F.array_join(F.transform("g", lambda r: F.array_join(r, ",")), ";").alias("grid"), G.grid_html("g").alias("html"))


@query("tbl_valid", "SELECT c_custkey, c_custkey % 4 >= 2 AND c_custkey // 4 % 4 - (c_custkey % 7 = 0)::INT >= 2 AS valid FROM customer")
def tbl_valid(spark, d):
    rows, cells = (F.col("c_custkey") % 4).cast("int"), (F.floor(F.col("c_custkey") / 4) % 4).cast("int")
    short = (F.col("c_custkey") % 7 == 0).cast("int")
    row = lambda n: F.array_repeat(F.lit("x"), F.greatest(n, F.lit(0)))
    grid = F.transform(F.array_repeat(F.lit(0), rows), lambda _, i: row(F.when(i == rows - 1, cells - short).otherwise(cells)))
    return table(spark, d, "customer").select("c_custkey", G.is_grid(grid).alias("valid"))


def _box(x, y):
    x, y = F.col(x).cast("double"), F.col(y).cast("double")
    return Geo.normalized_rect(x, y, x + 100, y + 20, F.lit(612.0), F.lit(792.0))


_GEO = """g AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE * 14 AS x, l_linenumber::DOUBLE * 100 AS y FROM lineitem),
n AS (SELECT *, least(greatest(x / 612 * 1000, 0), 1000) AS x0, least(greatest(y / 792 * 1000, 0), 1000) AS y0, least(greatest((x + 100) / 612 * 1000, 0), 1000) AS x1, least(greatest((y + 20) / 792 * 1000, 0), 1000) AS y1 FROM g)"""


def _boxes(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") * 14).alias("x"), (F.col("l_linenumber").cast("double") * 100).alias("y"))
    return rows.select("l_orderkey", "l_linenumber", _box("x", "y").alias("b"))


@query("geo_norm_rect", f"WITH {_GEO} SELECT l_orderkey, l_linenumber, round(x0, 6) AS x0, round(1000 - y0, 6) AS top, x1 > x0 AND y1 > y0 AS on_page FROM n WHERE x1 > x0 AND y1 > y0 UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL, false FROM n WHERE NOT (x1 > x0 AND y1 > y0)")
def geo_norm_rect(spark, d):
    return _boxes(spark, d).select("l_orderkey", "l_linenumber", F.round("b.x0", 6).alias("x0"), F.round(F.get(Geo.quad_points(F.col("b")), F.lit(1)), 6).alias("top"), F.col("b").isNotNull().alias("on_page"))


@query(
    "geo_iou",
    f"""WITH {_GEO}, w AS (SELECT *, least(x1, 700) - greatest(x0, 200) AS a, least(y1, 500) - greatest(y0, 100) AS h FROM n WHERE x1 > x0 AND y1 > y0)
SELECT l_orderkey, l_linenumber, round(CASE WHEN a > 0 AND h > 0 THEN a * h / ((x1 - x0) * (y1 - y0) + 200000 - a * h) ELSE 0 END, 6) AS iou, dx <= (x1 - x0) * 0.5 AND dy <= (y1 - y0) * 0.5 AND (dx * (y1 - y0) + dy * (x1 - x0)) / ((x1 - x0) * (y1 - y0)) <= 0.2 AS inside FROM (SELECT *, greatest(0, 200 - x0) + greatest(0, x1 - 700) AS dx, greatest(0, 100 - y0) + greatest(0, y1 - 500) AS dy FROM w)""",
)
def geo_iou(spark, d):
    frame = F.struct(F.lit(200.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(700.0).alias("x1"), F.lit(500.0).alias("y1"))
    return _boxes(spark, d).where("b IS NOT NULL").select("l_orderkey", "l_linenumber", F.round(Geo.iou(F.col("b"), frame), 6).alias("iou"), Geo.within(F.col("b"), frame).alias("inside"))


@query("scr_structure_chunk")
def scr_structure_chunk(spark, d):
    blocks = line_blocks(table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), "text")).withColumn("section", F.lit(""))
    return C.structured(blocks)


@query("scr_recursive_split")
def scr_recursive_split(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(C.recursive(F.col("text"))).alias("chunk_id", "chunk"))


@query("scr_split_clauses", "SELECT n_nationkey, 'head|第一条' || n_name || '|第2条end' AS parts FROM named")
def scr_split_clauses(spark, d):
    text = F.concat(F.lit("head第一条"), "n_name", F.lit("第2条end"))
    return named(spark, d).select("n_nationkey", F.array_join(C.clauses(text), "|").alias("parts"))


@query(
    "src_md_blocks",
    """WITH m AS (SELECT n_nationkey AS doc_id, n_name FROM named)
SELECT doc_id, 0 AS line, 'heading' AS type, 2 AS level, n_name AS text FROM m UNION ALL
SELECT doc_id, 1, 'paragraph', NULL, 'one' || chr(10) || 'two' FROM m UNION ALL SELECT doc_id, 4, 'table', NULL, '| a | b |' || chr(10) || '| --- | --- |' FROM m""",
)
def src_md_blocks(spark, d):
    text = F.concat(F.lit("## "), "n_name", F.lit("\none\ntwo\n\n| a | b |\n| --- | --- |"))
    return Bl.markdown_blocks(named(spark, d).select(F.col("n_nationkey").alias("doc_id"), text.alias("text")))


@query("evt_tumbling", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def evt_tumbling(spark, d):
    ev = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return Ev.tumbling(ev).select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "evt_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def evt_sessions(spark, d):
    ev = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return Ev.sessions(ev).select("user_id", F.unix_micros("start").alias("start"), "n")
