"""Queries on single functions and steps that larger operators use, each on its own."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lexiloom.functions import geometry as Geo
from lexiloom.functions import grids as G
from lexiloom.functions import text as T
from lexiloom.operators import blocks as Bl
from lexiloom.operators import evaluate as E
from lexiloom.operators import findings as Fd
from lexiloom.operators import retrieval as Re
from lexiloom.operators import rules as R
from lexiloom.operators import state as S
from lexiloom.sources import files as Fi
from lexiloom.sources.tables import line_blocks, named, table

from .base import BLOCKS, query
from .evaluate import _OUT, _SCORED, _outcomes
from .retrieval import _IDF, _KNN, QUESTION
from .structure import _GEO, _boxes


def _docs(spark, d, *columns):
    return table(spark, d, "documents").select(*columns)


@query("flt_scope", "SELECT o.o_orderkey FROM orders o JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderkey % 3 <> 0")
def flt_scope(spark, d):
    inside = table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").where("o_orderkey % 3 <> 0").join(inside, "o_custkey", "left_semi").select("o_orderkey")


@query("agg_by_severity", f"WITH {_OUT}, g AS (SELECT severity, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM o GROUP BY severity) SELECT * FROM g")
def agg_by_severity(spark, d):
    return E.confusion(_outcomes(spark, d), ["rule_id", "severity"]).where("level = 2").select("severity", "tp", "fp", "fn")


@query("agg_overall", f"WITH {_OUT} SELECT count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM o")
def agg_overall(spark, d):
    return E.confusion(_outcomes(spark, d), ["rule_id", "severity"]).where("level = 3").select("tp", "fp", "fn")


@query(
    "agg_scores",
    f"""WITH g AS (SELECT c_custkey, c_custkey % 4 AS tp, c_custkey % 3 AS fp, c_custkey % 5 AS fn FROM customer), s AS (SELECT *, {_SCORED} FROM g)
SELECT c_custkey, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM s""",
)
def agg_scores(spark, d):
    i = F.col("c_custkey")
    out = E.with_scores(table(spark, d, "customer").select(i, (i % 4).alias("tp"), (i % 3).alias("fp"), (i % 5).alias("fn")))
    return out.select("c_custkey", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("join_coverage", "SELECT c_custkey AS doc_id, 3::BIGINT AS total, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 4 END AS done FROM customer")
def join_coverage(spark, d):
    i = F.col("c_custkey")
    rules = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    gold = table(spark, d, "customer").select(i.alias("doc_id"), rules.alias("enabled"))
    runs = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(i.alias("doc_id"), F.slice(rules, F.lit(1), (i % 4).cast("int")).alias("executed"))
    return E.coverage(gold, runs).select("doc_id", "total", "done")


@query("join_answers", "SELECT count(*) AS questions, count(*) FILTER (WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0) AS missed_without_answer, count(*) FILTER (WHERE c_custkey % 2 = 1 AND c_custkey % 3 <> 0 AND c_custkey % 5 = 0) AS false_refusals FROM customer")
def join_answers(spark, d):
    i = F.col("c_custkey")
    questions = table(spark, d, "customer").select(i.alias("question_id"), (i % 2 == 0).alias("expected_refusal"), F.lit(True).alias("answerable"))
    answers = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(i.alias("question_id"), ((i % 5 == 0) | (i % 2 == 0)).alias("refused"))
    return E.refusals(questions, answers).select("questions", F.col("missed").alias("missed_without_answer"), "false_refusals")


@query("agg_deletion_pending", "WITH p AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id) SELECT count(*) FILTER (WHERE last IN ('view', 'click')) AS pending, count(*) AS users FROM p")
def agg_deletion_pending(spark, d):
    last = S.latest(table(spark, d, "events"), ["user_id"], "ts", "event_id")
    return last.agg(F.count(F.when(F.col("event_type").isin("view", "click"), 1)).alias("pending"), F.count(F.lit(1)).alias("users"))


@query(
    "win_audit_append",
    """WITH a AS (SELECT n_nationkey, sha256('{"action":"' || n_name || '","previous_hash":"","seq":1}') AS h, n_name FROM named)
SELECT n_nationkey, h AS previous_hash, sha256('{"action":"' || n_name || '","previous_hash":"' || h || '","seq":2}') AS hash FROM a""",
)
def win_audit_append(spark, d):
    rows = named(spark, d).select("n_nationkey", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("seq"), F.col("n_name").alias("action"))
    return S.audit_chain(rows, "n_nationkey").where("seq = 2").select("n_nationkey", "previous_hash", "hash")


@query("lim_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def lim_page(spark, d):
    return S.page(table(spark, d, "orders"), 3, 20, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_orderkey")


@query("scr_unit_matches", "SELECT c_custkey, c_custkey % 4 = 0 AS days, c_custkey % 4 IN (2, 3) AS widgets, true AS anything FROM customer")
def scr_unit_matches(spark, d):
    unit = F.get(F.array(*[F.lit(x) for x in ("day", "cny", "widget", "")]), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, d, "customer").select("c_custkey", R.unit_fits("天", unit).alias("days"), R.unit_fits("Widget", unit).alias("widgets"), R.unit_fits(None, unit).alias("anything"))


@query("scr_first_text", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '' END AS said FROM customer")
def scr_first_text(spark, d):
    i = F.col("c_custkey") % 3
    return table(spark, d, "customer").select("c_custkey", T.first_present(F.when(i == 0, F.concat(F.lit(" "), "c_name")).otherwise("  "), F.when(i == 1, F.col("c_mktsegment"))).alias("said"))


@query("scr_useful_text", "SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g'))::INT AS size, length(regexp_replace(text, '\\s+', '', 'g')) >= 4 AS usable FROM documents")
def scr_useful_text(spark, d):
    return _docs(spark, d, "doc_id", F.length(T.useful("text")).alias("size"), T.is_usable("text").alias("usable"))


@query("scr_substring_idf", _IDF.replace("LIMIT 20", "LIMIT 200"))
def scr_substring_idf(spark, d):
    blocks = line_blocks(_docs(spark, d, "doc_id", "text"))
    return Re.substring_idf(blocks, QUESTION, 200, ["doc_id", "block_index"]).select("doc_id", "block_index", F.round("score", 5).alias("score"))


@query(
    "scr_find_quote_block",
    f"""WITH {BLOCKS}, q AS (SELECT doc_id, trim(substring(text, 11, 30)) AS quote FROM blocks WHERE block_index = 1 AND length(text) >= 60),
m AS (SELECT q.doc_id, q.quote, min(b.block_index) AS block_index FROM q JOIN blocks b ON b.doc_id = q.doc_id AND contains(b.text, q.quote) GROUP BY ALL)
SELECT m.doc_id, m.block_index, (position(quote IN text) - 1)::INT AS start FROM m JOIN blocks b ON b.doc_id = m.doc_id AND b.block_index = m.block_index""",
)
def scr_find_quote_block(spark, d):
    blocks = line_blocks(_docs(spark, d, "doc_id", "text"))
    issues = blocks.where((F.col("block_index") == 1) & (F.length("text") >= 60)).select("doc_id", F.substring("text", 11, 30).alias("quote"))
    return Fd.resolved_quotes(issues, blocks).select("doc_id", "block_index", "start")


@query("scr_heading_level", "SELECT n_nationkey, [1, 2, 3, 2][n_nationkey % 4 + 1] AS level FROM named")
def scr_heading_level(spark, d):
    said = F.get(F.array(*[F.concat(F.lit(x), "n_name") for x in ("第一章", "第12节", "第三十条", "一、")]), (F.col("n_nationkey") % 4).cast("int"))
    return named(spark, d).select("n_nationkey", T.heading_level(said).alias("level"))


@query("scr_redact", "SELECT c_custkey, ['Bearer [REDACTED] x', 'api_key: [REDACTED]', 'password=[REDACTED], y', c_name][c_custkey % 4 + 1] AS text FROM customer")
def scr_redact(spark, d):
    key = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    said = F.get(F.array(F.concat(F.lit("Bearer "), key, F.lit(" x")), F.concat(F.lit("api_key: '"), key, F.lit("'")), F.concat(F.lit("password="), key, F.lit(", y")), F.col("c_name")), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, d, "customer").select("c_custkey", T.redacted(said).alias("text"))


def _customer_grid(spark, d):
    row = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    odd = F.when(F.col("c_custkey") % 2 == 0, "a|b").otherwise("<x> & 'y'")
    return table(spark, d, "customer").select("c_custkey", F.array(row("k", "v"), row(F.col("c_custkey").cast("string"), odd)).alias("g"))


@query(
    "tbl_grid_to_html",
    "SELECT c_custkey, '<table><thead><tr><th>k</th><th>v</th></tr></thead><tbody><tr><td>' || c_custkey || '</td><td>' || CASE WHEN c_custkey % 2 = 0 THEN 'a|b' ELSE '&lt;x&gt; &amp; &#x27;y&#x27;' END || '</td></tr></tbody></table>' AS html FROM customer",
)
def tbl_grid_to_html(spark, d):
    return _customer_grid(spark, d).select("c_custkey", G.grid_html("g").alias("html"))


@query("tbl_grid_to_md", "SELECT c_custkey, '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_custkey || ' | ' || CASE WHEN c_custkey % 2 = 0 THEN 'a' || chr(92) || '|b' ELSE '<x> & ' || chr(39) || 'y' || chr(39) END || ' |' AS markdown FROM customer")
def tbl_grid_to_md(spark, d):
    return _customer_grid(spark, d).select("c_custkey", G.grid_markdown("g").alias("markdown"))


# Parts with and without heads of their own, some with other words, some with rows that say what the first head says.
@query(
    "tbl_merge",
    """SELECT c_custkey AS doc_id, '| k | v |' || chr(10) || '| --- | --- |' || string_agg(CASE WHEN i = 2 THEN chr(10) || '| q | r |' ELSE '' END || CASE WHEN c_custkey % 3 = i THEN chr(10) || '| k | v |' ELSE '' END || chr(10) || '| ' || i || ' | ' || c_name || ' |', '' ORDER BY i) AS text
FROM customer, range(0, 5) r(i) WHERE i <= c_custkey % 4 GROUP BY c_custkey""",
)
def tbl_merge(spark, d):
    i = F.col("block_index")
    parts = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 4).cast("int"))).alias("block_index"))
    head = F.when(i == 1, "| x | y |\n| --- | --- |\n").when(i == 2, "| q | r |\n").otherwise("| k | v |\n| --- | --- |\n")
    same = F.when(F.col("doc_id") % 3 == i, "| k | v |\n").otherwise("")
    text = F.concat(head, same, F.lit("| "), i.cast("string"), F.lit(" | "), "c_name", F.lit(" |"))
    return Bl.merged_tables(parts.select("doc_id", "block_index", F.lit("table").alias("type"), text.alias("text"))).select("doc_id", "text")


@query("geo_quadpoints", f"WITH {_GEO} SELECT l_orderkey, l_linenumber, round(x0, 4) AS left_x, round(1000 - y0, 4) AS top, round(x1, 4) AS right_x, round(1000 - y1, 4) AS bottom FROM n WHERE x1 > x0 AND y1 > y0")
def geo_quadpoints(spark, d):
    rows = _boxes(spark, d).where("b IS NOT NULL").select("l_orderkey", "l_linenumber", Geo.quad_points(F.col("b")).alias("q"))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(F.col("q")[i], 4).alias(n) for i, n in ((4, "left_x"), (1, "top"), (6, "right_x"), (7, "bottom"))])


@query("geo_within", f"WITH {_GEO} SELECT l_orderkey, l_linenumber, greatest(0, x1 - 500) <= 0.2 * (x1 - x0) AS inside FROM n WHERE x1 > x0 AND y1 > y0")
def geo_within(spark, d):
    half = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(500.0).alias("x1"), F.lit(1000.0).alias("y1"))
    return _boxes(spark, d).where("b IS NOT NULL").select("l_orderkey", "l_linenumber", Geo.within(F.col("b"), half).alias("inside"))


@query("mth_rrf", "SELECT c_custkey % 50 AS item, round(sum(1.0::DOUBLE / (61 + c_custkey % 7)), 9) AS score FROM customer GROUP BY 1 ORDER BY score DESC, min(c_custkey % 7), item LIMIT 50")
def mth_rrf(spark, d):
    ranks = table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("item"), (F.col("c_custkey") % 7).alias("rank"))
    return Re.fused([ranks], "item", 50).select("item", F.round("score", 9).alias("score"))


@query("mth_cosine", f"WITH {_KNN} SELECT doc_id AS vec_id, round(score, 4) AS score FROM kn")
def mth_cosine(spark, d):
    return Re.cosine(table(spark, d, "embeddings"), 7).select("vec_id", F.round("score", 4).alias("score"))


@query("mth_ln", "SELECT t AS term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT t, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+')) AS t FROM documents) GROUP BY t), (SELECT count(*) AS n FROM documents)")
def mth_ln(spark, d):
    terms = _docs(spark, d, "doc_id", F.explode(F.array_distinct(T.tokens("source"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = table(spark, d, "documents").count()
    return terms.select("term", F.round(F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query("mth_sqrt", "SELECT doc_id, round(sqrt(least(greatest(length(text), 20), 300)), 9) AS damping FROM documents")
def mth_sqrt(spark, d):
    return _docs(spark, d, "doc_id", F.round(F.sqrt(F.least(F.greatest(F.length("text"), F.lit(20)), F.lit(300)).cast("double")), 9).alias("damping"))


@query("hsh_version", """SELECT doc_id, sha256('{"content_sha256":"' || sha256(text) || '","document_id":"' || doc_id || '"}') AS version_id FROM documents""")
def hsh_version(spark, d):
    return _docs(spark, d, "doc_id", F.sha2(F.to_json(F.struct(F.sha2("text", 256).alias("content_sha256"), F.col("doc_id").cast("string").alias("document_id"))), 256).alias("version_id"))


@query("hsh_stable", """SELECT o_orderkey, left(sha256('{"block_id":"b","document_id":"' || o_custkey || '","quote_hash":"' || sha256(o_orderpriority) || '","rule_id":"r","version_id":"' || o_orderkey || '"}'), 32) AS id FROM orders""")
def hsh_stable(spark, d):
    said = R.finding_id(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit("b"), F.lit("r"), F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", said.alias("id"))


@query("hsh_combined", "SELECT n_regionkey, sha256(string_agg(sha256(n_name), ',' ORDER BY n_nationkey)) AS combined FROM named GROUP BY n_regionkey")
def hsh_combined(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("n_nationkey", F.sha2("n_name", 256).alias("h"))))
    return named(spark, d).groupBy("n_regionkey").agg(parts.alias("p")).select("n_regionkey", F.sha2(F.array_join("p.h", ","), 256).alias("combined"))


def _docx(name: str) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
    cell = lambda x: f"<w:tc><w:p>{run(x)}</w:p></w:tc>"
    head = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{run(name)}</w:p><w:p>{run("one ")}{run(name)}</w:p><w:p/>'
    rows = f"<w:tbl><w:tr>{cell('k')}{cell('v')}</w:tr><w:tr>{cell('1')}{cell(name)}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{head}{rows}</w:body></w:document>")
    return out.getvalue()


@query(
    "src_docx",
    """SELECT n_name || '.docx' AS doc_id, b::INT AS block_index, ['heading', 'paragraph', 'table'][b + 1] AS type, CASE WHEN b = 0 THEN 2 END AS level, CASE b WHEN 0 THEN n_name WHEN 1 THEN 'one ' || n_name ELSE '| k | v |' || chr(10) || '| 1 | ' || n_name || ' |' END AS text FROM nation, range(0, 3) r(b)""",
)
def src_docx(spark, d):
    @F.pandas_udf("binary")
    def packed(names: pd.Series) -> pd.Series:
        return names.map(_docx)

    files = table(spark, d, "nation").select(F.concat(F.lit("folder/"), "n_name", F.lit(".docx")).alias("path"), packed("n_name").alias("content"))
    return Fi.blocks_of_docx(files).select("doc_id", "block_index", "type", "level", "text")
