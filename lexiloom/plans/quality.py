"""Queries on answer quality, gold files, reports, hits' tables, states and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import grids as G
from lexiloom.operators import chunking as C
from lexiloom.operators import evaluate as E
from lexiloom.operators import state as S
from lexiloom.sources.scratch import new_path
from lexiloom.sources.tables import json_folder, table, text_folder

from .base import query

_QA = """c AS (SELECT doc_id, text, doc_id % 4 <> 0 AS answerable, doc_id % 11 = 0 AS missing, doc_id % 6 = 0 AND doc_id % 11 <> 0 AS refused, doc_id % 5 <> 0 AND doc_id % 11 <> 0 AS cited, doc_id % 8 <> 0 AS exact, doc_id % 9 <> 0 AS located,
CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 7 = 0 THEN '~' ELSE text END AS answer, doc_id % 11 <> 0 AND doc_id % 10 <> 0 AND doc_id % 13 <> 0 AS ended FROM documents WHERE length(text) >= 20),
k AS (SELECT *, contains(answer, left(text, 5)) AS correct FROM c)"""
_RATES = f"""WITH {_QA} SELECT count(*) AS cases, round(count(*) FILTER (WHERE answerable AND NOT refused AND correct) / count(*) FILTER (WHERE answerable), 6) AS answer_accuracy,
round(count(*) FILTER (WHERE cited AND exact) / count(*) FILTER (WHERE cited), 6) AS citation_exact_match_rate, round(count(*) FILTER (WHERE cited AND exact AND located) / count(*) FILTER (WHERE cited), 6) AS citation_location_accuracy,
round(count(*) FILTER (WHERE refused) / count(*), 6) AS refusal_rate, round(count(*) FILTER (WHERE NOT answerable AND refused) / count(*) FILTER (WHERE NOT answerable), 6) AS refusal_correct_rate,
round(count(*) FILTER (WHERE answerable AND refused) / count(*) FILTER (WHERE answerable), 6) AS false_refusal_rate, round(count(*) FILTER (WHERE answerable AND NOT refused AND cited) / count(*) FILTER (WHERE answerable AND NOT refused), 6) AS non_refusal_citation_coverage,
round(count(*) FILTER (WHERE ended) / count(*), 6) AS sse_unique_terminal_rate, false AS passed FROM k"""


def _answers(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") >= 20)
    i = F.col("doc_id")
    block = F.struct(F.lit("b1").alias("block_id"), F.col("text"), F.lit("p1").alias("locator"))
    cases = docs.select(i.alias("question_id"), (i % 4 != 0).alias("answerable"), i.cast("string").alias("document_id"), F.lit("v").alias("version_id"), F.array(F.left("text", F.lit(5))).alias("required_facts"), F.array(block).alias("blocks"))
    quote = F.when(i % 8 != 0, F.substring("text", 4, 10)).otherwise("~")
    one = F.struct(F.lit("b1").alias("block_id"), i.cast("string").alias("document_id"), F.lit("v").alias("version_id"), F.lit(3).alias("quote_start"), F.lit(13).alias("quote_end"), quote.alias("quote"), F.when(i % 9 != 0, "p1").otherwise("p2").alias("locator"))
    events = F.when(i % 10 == 0, F.array(F.lit("done"), F.lit("token"))).when(i % 13 == 0, F.array(F.lit("error"), F.lit("done"))).otherwise(F.array(F.lit("token"), F.lit("done")))
    cited = F.when(i % 5 != 0, F.array(one)).otherwise(F.array().cast(f"array<{E.CITATION}>"))
    answers = docs.where("doc_id % 11 <> 0").select(i.alias("question_id"), (i % 6 == 0).alias("refused"), F.when(i % 7 != 0, F.col("text")).otherwise("~").alias("answer"), cited.alias("citations"), events.alias("events"))
    return E.answer_quality(cases, answers)


def _metrics(spark, d):
    out = E.qa_metrics(_answers(spark, d))
    return out.select("cases", *[F.round(c, 6).alias(c) for c in out.columns[1:-1]], "passed")


@query("agg_qa_metrics", _RATES)
def agg_qa_metrics(spark, d):
    return _metrics(spark, d)


@query(
    "agg_qa_failures",
    f"""WITH {_QA}, f AS (SELECT doc_id, list_filter([CASE WHEN answerable AND NOT refused AND NOT correct THEN 'answer_fact_mismatch' END, CASE WHEN answerable AND refused THEN 'false_refusal' END, CASE WHEN NOT ended THEN 'invalid_terminal_count' END,
CASE WHEN cited AND NOT (exact AND located) THEN 'locator_mismatch' END, CASE WHEN NOT answerable AND NOT refused THEN 'missed_refusal' END, CASE WHEN answerable AND NOT refused AND NOT cited THEN 'missing_citation' END, CASE WHEN cited AND NOT exact THEN 'quote_mismatch' END], lambda x: x IS NOT NULL) AS fs FROM k)
SELECT doc_id AS question_id, array_to_string(fs, ',') AS failures FROM f WHERE len(fs) > 0""",
)
def agg_qa_failures(spark, d):
    return _answers(spark, d).where(F.size("failures") > 0).select("question_id", F.concat_ws(",", "failures").alias("failures"))


@query("snk_eval_reports", f"SELECT 'passed' IN ('failed') AS passed, 14 AS lines, round(answer_accuracy, 4) AS answer_accuracy, cases FROM ({_RATES})")
def snk_eval_reports(spark, d):
    path = new_path(spark, "report")
    E.qa_report(_metrics(spark, d), "answers").write.json(path)
    stored = spark.read.schema("report string, markdown string").json(path)
    read = F.from_json("report", "cases long, answer_accuracy double, passed boolean")
    return stored.select(F.col("markdown").endswith("passed").alias("passed"), F.size(F.split("markdown", "\n", -1)).alias("lines"), F.round(read["answer_accuracy"], 4).alias("answer_accuracy"), read["cases"].alias("cases"))


def _gold(spark, d):
    i = F.col("n_nationkey")
    issue = lambda k: F.struct(F.concat(F.lit(f"i{k}-"), i.cast("string")).alias("issue_id"), F.lit(f"r{k}").alias("rule_id"), F.lit("high").alias("severity"), F.col("n_name").alias("text"))
    issues = F.slice(F.array(issue(0), issue(1), issue(2)), 1, (i % 4).cast("int"))
    asked = F.when(i % 2 == 0, F.array(F.struct(F.concat(F.lit("q"), i.cast("string")).alias("question_id"), F.lit("why").alias("question"), F.lit(True).alias("expected_refusal"))))
    doc = F.struct(i.cast("string").alias("doc_id"), F.when(i % 3 != 0, "contract").alias("doc_type"), F.array(F.lit("r0"), F.lit("r1")).alias("enabled_rules"), issues.alias("issues"), asked.alias("refusal_questions"))
    path = new_path(spark, "gold")
    table(spark, d, "nation").select(F.to_json(doc).alias("value")).write.text(path)
    return E.gold_rows(spark.read.text(path))


@query(
    "src_gold",
    """SELECT n_nationkey::VARCHAR AS doc_id, CASE WHEN n_nationkey % 3 <> 0 THEN 'contract' ELSE 'unknown' END AS doc_type, 'issue' AS kind, 'i' || k || '-' || n_nationkey AS id FROM nation, range(0, 3) r(k) WHERE k < n_nationkey % 4
UNION ALL SELECT n_nationkey::VARCHAR, CASE WHEN n_nationkey % 3 <> 0 THEN 'contract' ELSE 'unknown' END, 'question', 'q' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey::VARCHAR, NULL, 'rule', 'r' || k FROM nation, range(0, 2) r(k)""",
)
def src_gold(spark, d):
    gold = _gold(spark, d)
    part = lambda name, kind, c, own: gold[name].select("doc_id", own.alias("doc_type"), F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return part("issues", "issue", "issue_id", F.col("doc_type")).unionByName(part("questions", "question", "question_id", F.col("doc_type"))).unionByName(part("rules", "rule", "rule_id", F.lit(None).cast("string")))


#: Jobs whose keys lie so near each other share a file.
JOBS_PER_FILE = 30_000


@query("src_json_jobs_dir", "SELECT c_custkey AS job, c_name AS name, c_custkey % 5 AS findings FROM customer")
def src_json_jobs_dir(spark, d):
    path = new_path(spark, "jobs")
    job = F.to_json(F.struct(F.col("c_custkey").alias("job"), F.col("c_name").alias("name"), F.array_repeat(F.struct(F.lit("r").alias("rule_id")), (F.col("c_custkey") % 5).cast("int")).alias("findings")))
    # A file holds a list of jobs: a file a job would take longer to list and open than to read.
    jobs = table(spark, d, "customer").select((F.col("c_custkey") % 3).alias("part"), F.floor(F.col("c_custkey") / JOBS_PER_FILE).alias("batch"), job.alias("job"))
    lists = jobs.groupBy("part", "batch").agg(F.concat(F.lit("["), F.array_join(F.collect_list("job"), ","), F.lit("]")).alias("value"))
    lists.select("part", "value").write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)
    return json_folder(spark, path, "job long, name string, findings array<struct<rule_id: string>>").select("job", "name", F.size("findings").cast("long").alias("findings"))


@query("src_dir_scan", "SELECT n_name || chr(10) || n_nationkey AS text FROM nation WHERE n_nationkey % 5 <> 0")
def src_dir_scan(spark, d):
    path = new_path(spark, "texts")
    said = F.when(F.col("n_nationkey") % 5 == 0, "  ").otherwise(F.concat("n_name", F.lit("\n"), F.col("n_nationkey").cast("string")))
    table(spark, d, "nation").select(F.col("n_nationkey").alias("part"), said.alias("value")).write.partitionBy("part").text(path)
    return text_folder(spark, path).select(F.rtrim("text", F.lit("\n")).alias("text"))


_MD = "'| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_partkey % 50 || ' | x |'"


@query(
    "tbl_extract_hits",
    f"""WITH h AS (SELECT p_partkey, p_partkey % 10 AS q, CASE p_partkey % 7 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' ELSE {_MD} END AS md FROM part),
f AS (SELECT q, md, min(p_partkey) AS rank FROM h WHERE md IS NOT NULL GROUP BY ALL) SELECT q, rank, md AS markdown FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY rank) <= 2""",
)
def tbl_extract_hits(spark, d):
    v, n = F.col("p_partkey") % 7, (F.col("p_partkey") % 50).cast("string")
    md = F.concat(F.lit("| a | b |\n| --- | --- |\n| "), n, F.lit(" | x |"))
    page = F.concat(F.lit("[文档] t\n<table><tr><th>a</th><th>b</th></tr><tr><td>"), n, F.lit("</td><td>x</td></tr></table>"))
    content = (
        F.when(v == 0, "nothing").when(v == 1, F.concat(F.lit("[文档] t\n[章节] s\n"), md)).when(v == 2, page).when(v == 3, "plain text").when(v == 4, "| a |\n| --- |\n| 1 |").when(v == 5, "| k | v |\n| --- | --- |\n| 1 | 2 |").otherwise(F.concat(F.lit(" "), md, F.lit(" \n")))
    )
    hits = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("q"), F.col("p_partkey").alias("rank"), F.when(v == 0, "Table").otherwise("text").alias("kind"), content.alias("content"), F.when(v == 0, md).alias("markdown"))
    return G.tables_of_hits(hits, "q", "rank", 2).select("q", "rank", "markdown")


@query(
    "tbl_normalize",
    """SELECT c_custkey, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_custkey || ' | ' || c_name || ' |' AS markdown, '<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>' || c_custkey || '</td><td>' || c_name || '</td></tr></tbody></table>' AS html FROM customer""",
)
def tbl_normalize(spark, d):
    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 5
    md = F.concat(F.lit("| a | b |\n|---|:---:|\n| "), key, F.lit(" | "), "c_name", F.lit(" |"))
    web = F.concat(F.lit("<TABLE><tr><td>a<td>b</td></tr><tr><td>"), key, F.lit("</td><td>"), "c_name", F.lit("</td></tr></TABLE>"))
    web = F.regexp_replace(web, "<td>a<td>", "<td>a</td><td>")
    grid = G.normalized_grid(F.when(k == 0, web), F.when(k == 1, md).when(k == 2, web), F.when(k == 3, md).when(k == 4, web))
    return table(spark, d, "customer").select("c_custkey", grid.alias("g")).select("c_custkey", G.grid_markdown("g").alias("markdown"), G.grid_html("g").alias("html"))


@query(
    "prj_status",
    """SELECT o_orderkey, ['已上传', '排队中', '解析版面', '整理结构', '语义分块', '写入检索', '已入库', '失败', '需 OCR', 'other'][o_orderkey % 10 + 1] AS label, CASE WHEN o_orderkey % 4 = 0 THEN 33 ELSE [65, 65, 70, 74, 80, 90, 100, 0, 70, 65][o_orderkey % 10 + 1] END::INT AS progress,
CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 10 = 7 THEN 'old' END AS error FROM orders""",
)
def prj_status(spark, d):
    i = F.col("o_orderkey")
    status = F.get(F.array(*[F.lit(s) for s in ("uploaded", "queued", "parsing", "normalizing", "chunking", "indexing", "ready", "failed", "needs_ocr", "other")]), (i % 10).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", status.alias("status"), F.when(i % 4 == 0, 33).alias("given"), F.when(i % 3 == 0, "new").alias("error"), F.lit("old").alias("old"))
    return S.with_status(rows, "status", "given", "error", "old").select("o_orderkey", F.col("stage_label").alias("label"), F.col("shown_progress").alias("progress"), F.col("shown_error").alias("error"))


@query(
    "prj_visibility_migrate",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'own' ELSE 'c' || doc_id END AS current_version_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0 THEN NULL ELSE 'i' || doc_id END AS indexed_version_id, NOT (doc_id % 7 = 0 AND doc_id % 3 <> 0) AS visibility_migrated FROM documents""",
)
def prj_visibility_migrate(spark, d):
    docs, i = table(spark, d, "documents").select("doc_id"), F.col("doc_id")
    index = docs.select("doc_id", F.lit("own").alias("current_version_id"), F.lit(None).cast("string").alias("indexed_version_id"), (i % 3 == 0).alias("visibility_migrated"))
    meta = docs.where("doc_id % 21 <> 7").select("doc_id", F.when(i % 4 != 0, F.concat(F.lit("c"), i.cast("string"))).otherwise("").alias("current_version_id"), F.when(i % 5 != 0, F.concat(F.lit("i"), i.cast("string"))).alias("indexed_version_id"))
    return S.migrated_visibility(index, meta, docs.where("doc_id % 7 = 0"))


@query(
    "prj_engine_rule",
    """SELECT n_nationkey AS rule_id, n_nationkey AS rule_version, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'high' ELSE 'medium' END AS risk_level, CASE WHEN n_nationkey % 3 = 0 THEN 'over' ELSE 'own' END AS description, CASE WHEN n_nationkey % 4 = 0 THEN 'fix' ELSE '' END AS suggested_fix, n_nationkey % 5 = 0 AS llm_fallback FROM nation""",
)
def prj_engine_rule(spark, d):
    i = F.col("n_nationkey")
    definition = F.when(i % 4 == 0, F.create_map(F.lit("description"), F.lit("own"), F.lit("suggested_fix"), F.lit("fix"))).otherwise(F.create_map(F.lit("description"), F.lit("own")))
    over = F.when(i % 3 == 0, F.create_map(F.lit("description"), F.lit("over"))).otherwise(F.create_map().cast("map<string,string>"))
    rules = table(spark, d, "nation").select(i.alias("id"), F.col("n_name").alias("name"), F.when(i % 2 == 0, "high").alias("severity"), S.merged_maps(definition, over).alias("d"), F.when(i % 5 == 0, True).alias("llm_fallback"))
    return rules.select(F.col("id").alias("rule_id"), F.col("id").alias("rule_version"), "name", F.coalesce("severity", F.lit("medium")).alias("risk_level"), F.coalesce(F.col("d")["description"], F.lit("")).alias("description"), F.coalesce(F.col("d")["suggested_fix"], F.lit("")).alias("suggested_fix"), F.coalesce("llm_fallback", F.lit(False)).alias("llm_fallback"))


@query("hsh_prompt", """SELECT item_id, sha256('[{"content":"check","role":"system"},{"content":' || to_json(text) || ',"role":"user"}]') AS prompt_hash FROM benchmark""")
def hsh_prompt(spark, d):
    message = lambda text, role: F.struct(text.alias("content"), F.lit(role).alias("role"))
    return table(spark, d, "benchmark").select("item_id", F.sha2(F.to_json(F.array(message(F.lit("check"), "system"), message(F.col("text"), "user"))), 256).alias("prompt_hash"))


@query(
    "scr_merge_short",
    """WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: [x]) AS ps FROM documents),
m AS (SELECT doc_id, list_reduce(ps, lambda acc, x: CASE WHEN acc[-1] = '' THEN x WHEN length(x[1]) < 80 OR length(acc[-1]) + 1 + length(x[1]) <= 200 THEN list_concat(acc[:-2], [acc[-1] || chr(10) || x[1]]) ELSE list_concat(acc, x) END) AS ms FROM p)
SELECT doc_id, CASE WHEN ms = [''] THEN 0 ELSE len(ms) END::INT AS n, sha256(array_to_string(ms, '|')) AS parts FROM m""",
)
def scr_merge_short(spark, d):
    merged = C.merged_short_parts(F.split("text", "\n", -1), 200)
    return table(spark, d, "documents").select("doc_id", merged.alias("m")).select("doc_id", F.size("m").alias("n"), F.sha2(F.array_join("m", "|"), 256).alias("parts"))
