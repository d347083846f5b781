"""Queries on text functions, blocks and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import rules as R
from lexiloom.sources.tables import line_blocks, table

from .base import BLOCKS, query

RULES = [{"rule_id": "r1", "severity": "high", "keyword": "stupid"}, {"rule_id": "r2", "severity": "medium", "keyword": "eux"}, {"rule_id": "r3", "severity": "low", "keyword": "the and"}]
_RULES = "r(rule_id, severity, kw) AS (VALUES ('r1', 'high', 'stupid'), ('r2', 'medium', 'eux'), ('r3', 'low', 'the and'))"
_HITS = f"""{BLOCKS}, {_RULES},
parts AS (SELECT doc_id, block_index, text, rule_id, severity, kw, regexp_split_to_array(text, '(?i)' || kw) AS p FROM blocks, r WHERE regexp_matches(text, '(?i)' || kw)),
hits AS (SELECT doc_id, block_index, text, rule_id, severity, kw, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length(kw))) AS s FROM parts),
first AS (SELECT *, substring(text, (s + 1)::INT, length(kw)::INT) AS quote FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, block_index, rule_id ORDER BY s) = 1),
capped AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY block_index) <= 5)"""


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _blocks(spark, d):
    return line_blocks(_docs(spark, d))


@query("src_line_blocks", f"WITH {BLOCKS} SELECT doc_id, block_index, 'b' || (block_index + 1) AS block_id, type, text FROM blocks")
def src_line_blocks(spark, d):
    return _blocks(spark, d).select("doc_id", "block_index", "block_id", "type", "text")


@query("scr_keyword", f"WITH {_HITS} SELECT doc_id, block_index, rule_id, s AS start, s + length(kw) AS \"end\", substring(text, (s + 1)::INT, length(kw)::INT) AS quote FROM hits")
def scr_keyword(spark, d):
    found = F.array(*[F.struct(F.lit(r["rule_id"]).alias("rule_id"), R.keyword_hits("text", r["keyword"]).alias("hits")) for r in RULES])
    rows = _blocks(spark, d).select("doc_id", "block_index", F.explode(found).alias("f")).select("doc_id", "block_index", "f.rule_id", F.explode("f.hits").alias("h"))
    return rows.select("doc_id", "block_index", "rule_id", "h.start", "h.end", "h.quote")


@query("win_first_hit_per_block", f"WITH {_HITS} SELECT doc_id, block_index, rule_id, severity, s AS start, quote FROM first")
def win_first_hit_per_block(spark, d):
    return R.first_hits(_blocks(spark, d), RULES).select("doc_id", "block_index", "rule_id", "severity", "start", "quote")


@query("win_cap5", f"WITH {_HITS} SELECT doc_id, block_index, rule_id, s AS start FROM capped")
def win_cap5(spark, d):
    return R.capped(R.first_hits(_blocks(spark, d), RULES)).select("doc_id", "block_index", "rule_id", "start")


@query("agg_severity_counts", f"WITH {_HITS} SELECT severity, count(*) AS n FROM capped GROUP BY severity")
def agg_severity_counts(spark, d):
    return R.capped(R.first_hits(_blocks(spark, d), RULES)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("agg_overall_risk", f"WITH {_HITS} SELECT doc_id, CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN '高' WHEN 2 THEN '中' ELSE '低' END AS risk FROM capped GROUP BY doc_id")
def agg_overall_risk(spark, d):
    worst = F.max(F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1))
    out = R.capped(R.first_hits(_blocks(spark, d), RULES)).groupBy("doc_id").agg(worst.alias("w"))
    return out.select("doc_id", F.when(F.col("w") == 3, "高").when(F.col("w") == 2, "中").otherwise("低").alias("risk"))


@query(
    "hsh_finding",
    f"""WITH {_HITS}, v AS (SELECT doc_id, sha256(text) AS version_id FROM documents)
SELECT c.doc_id, block_index, rule_id, left(sha256('{{"block_id":"b' || (block_index + 1) || '","document_id":"' || c.doc_id || '","quote_hash":"' || sha256(quote) || '","rule_id":"' || rule_id || '","version_id":"' || version_id || '"}}'), 32) AS finding_id,
c.doc_id || ':' || lpad((block_index // 32)::VARCHAR, 4, '0') AS chunk_id FROM capped c JOIN v USING (doc_id)""",
)
def hsh_finding(spark, d):
    docs = _docs(spark, d).withColumn("version_id", F.sha2("text", 256))
    hits = R.capped(R.first_hits(line_blocks(docs), RULES))
    doc = F.col("doc_id").cast("string")
    return hits.select("doc_id", "block_index", "rule_id", R.finding_id(doc, F.col("version_id"), F.col("block_id"), F.col("rule_id"), F.col("quote")).alias("finding_id"), R.chunk_id(doc, F.col("block_index")).alias("chunk_id"))


@query("win_chunk32", f"WITH {BLOCKS} SELECT doc_id, block_index // 32 AS chunk, count(*) AS blocks, sum(length(text))::BIGINT AS chars FROM blocks GROUP BY ALL")
def win_chunk32(spark, d):
    return _blocks(spark, d).groupBy("doc_id", F.floor(F.col("block_index") / R.CHUNK_BLOCKS).alias("chunk")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))


_SCOPE = f"""{BLOCKS}, h AS (SELECT *, max(CASE WHEN type = 'heading' THEN block_index END) OVER (PARTITION BY doc_id ORDER BY block_index) AS hi FROM blocks),
sc AS (SELECT h.*, coalesce(regexp_matches(t.text, '(?i)^th') AND h.block_index - h.hi <= 3, false) AS in_scope FROM h LEFT JOIN blocks t ON t.doc_id = h.doc_id AND t.block_index = h.hi)"""


@query("flt_scope_blocks", f"WITH {_SCOPE} SELECT doc_id, block_index FROM sc WHERE in_scope")
def flt_scope_blocks(spark, d):
    return R.in_scope(_blocks(spark, d), "^th", 3).where("in_scope").select("doc_id", "block_index")


_NUMS = "list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: x::DOUBLE)"


@query(
    "rule_status",
    f"""WITH {_SCOPE}, f AS (SELECT doc_id, sum(in_scope::INT) AS a, sum((in_scope AND contains(lower(text), 'on'))::INT) AS b,
sum((in_scope AND contains(lower(text), 'on') AND len(list_filter({_NUMS}, lambda v: v > 100)) > 0)::INT) AS c FROM sc GROUP BY doc_id)
SELECT doc_id, CASE WHEN a = 0 OR b = 0 THEN 'no_match' WHEN c > 0 THEN 'matched' ELSE 'no_match' END AS numeric_status, CASE WHEN a = 0 OR b = 0 THEN 'no_match' ELSE 'indeterminate' END AS missing_status FROM f""",
)
def rule_status(spark, d):
    blocks = _blocks(spark, d)
    numbers = F.transform(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1), lambda x: x.cast("double"))
    one = R.statuses(blocks, "on", {"how": "gt", "threshold": 100.0, "value": numbers}, "^th", 3).withColumnRenamed("status", "numeric_status")
    two = R.statuses(blocks, "on", {"how": "gt", "threshold": None, "value": numbers}, "^th", 3).withColumnRenamed("status", "missing_status")
    return one.join(two, "doc_id")


@query(
    "win_section_path",
    f"""WITH {BLOCKS}, l AS (SELECT *, CASE WHEN type = 'heading' THEN CASE WHEN length(text) <= 12 THEN 1 ELSE 2 END END AS lv FROM blocks),
w AS (SELECT *, max(CASE WHEN lv = 1 THEN block_index END) OVER o AS i1, max(CASE WHEN lv = 2 THEN block_index END) OVER o AS i2 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY block_index))
SELECT w.doc_id, w.block_index, concat_ws(' > ', a.text, CASE WHEN i1 IS NULL OR i2 > i1 THEN b.text END) AS section_path
FROM w LEFT JOIN blocks a ON a.doc_id = w.doc_id AND a.block_index = i1 LEFT JOIN blocks b ON b.doc_id = w.doc_id AND b.block_index = i2""",
)
def win_section_path(spark, d):
    out = R.section_paths(_blocks(spark, d), F.when(F.length("text") <= 12, 1).otherwise(2))
    return out.select("doc_id", "block_index", F.concat_ws(" > ", "section_path").alias("section_path"))


#: Quotes that stand for every reason and for none, with the reason that is expected; the query looks for them beside all blocks.
QUOTES = [
    ("", "empty"), ("　 ", "empty"), ("第三条", "sequence_marker"), ("一千、", "sequence_marker"), ("(a)", "sequence_marker"), ("12.", "sequence_marker"), ("②", "sequence_marker"),
    ("____", "placeholder"), ("_年_月_日", "placeholder"), ("＿ 万元", "placeholder"), ("□ 是", "checkbox_or_option"), ("口 是 口 否", "checkbox_or_option"), ("。，=", "format_marker"),
    ("甲方：", "standard_contract_label"), ("工资结算(月)", "standard_contract_label"), ("甲方：签名", "standard_contract_label"), ("2026年8月15日", "isolated_date"), ("二〇二零.1.2", "isolated_date"),
    ("US$ +3,000.5 万", "isolated_numeric_value"), ("30天", "isolated_numeric_value"), ("甲方应当付款", None), ("入口在左", None), ("30 days", None),
]
_SPACE_ENDS = "regexp_replace(text, '^[\\s\\x{3000}]+|[\\s\\x{3000}]+$', '', 'g')"
_FP = f"CASE WHEN text IS NULL OR {_SPACE_ENDS} = '' THEN 'empty' " + " ".join(f"WHEN regexp_matches({_SPACE_ENDS}, '{rule}') THEN '{name}'" for name, rule in T.FALSE_POSITIVES) + " END"
_EXPECTED = ", ".join("({}, '{}', {})".format(-1 - k, text, "NULL" if reason is None else f"'{reason}'") for k, (text, reason) in enumerate(QUOTES))


@query("flt_false_positive", f"WITH {BLOCKS} SELECT doc_id, block_index, {_FP} AS reason FROM blocks UNION ALL SELECT i, 0, reason FROM (VALUES {_EXPECTED}) v(i, text, reason)")
def flt_false_positive(spark, d):
    planted = spark.createDataFrame([(-1 - k, 0, text) for k, (text, _) in enumerate(QUOTES)], "doc_id long, block_index int, text string")
    return _blocks(spark, d).select("doc_id", "block_index", "text").unionByName(planted).select("doc_id", "block_index", T.false_positive_reason("text").alias("reason"))


@query("flt_usable_block", f"WITH {BLOCKS} SELECT doc_id, block_index, regexp_replace(text, '\\s+', '', 'g') AS useful FROM blocks WHERE length(regexp_replace(text, '\\s+', '', 'g')) >= 4")
def flt_usable_block(spark, d):
    return _blocks(spark, d).where(T.is_usable("text")).select("doc_id", "block_index", T.useful("text").alias("useful"))


@query("scr_normalize_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def scr_normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normalized("text").alias("text"))


@query("scr_clean_text", "SELECT doc_id, regexp_replace(lower(text), '\\s+', '', 'g') AS text FROM documents")
def scr_clean_text(spark, d):
    return _docs(spark, d).select("doc_id", T.useful(F.lower("text")).alias("text"))


@query(
    "prj_redact",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\b(bearer)\s+[A-Za-z0-9._~+/=-]+', '\1 [REDACTED]', 'gi'),
'\b(api[_-]?key|token|password|secret|authorization)\b(\s*[=:]\s*)["'']?[^\s"'',;]+["'']?', '\1\2[REDACTED]', 'gi') AS text FROM documents""",
)
def prj_redact(spark, d):
    return _docs(spark, d).select("doc_id", T.redacted("text").alias("text"))


@query(
    "scr_truncate_embed",
    r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[文档] ' || source || chr(10) || replace(text, '. ', '。') ELSE text END AS t FROM documents),
h AS (SELECT *, regexp_extract(t, '^((?:\[(?:文档|章节)\][^\n]*\n)*)', 1) AS h FROM t),
r AS (SELECT *, substring(t, (length(h) + 1)::INT, greatest(0, 450 - length(h))::INT) AS room FROM h), c AS (SELECT *, regexp_extract(room, '(?s)^(.*[。！？；])', 1) AS cut FROM r)
SELECT doc_id, CASE WHEN length(t) <= 450 THEN t WHEN length(h) >= 450 THEN left(t, 450) ELSE h || CASE WHEN length(cut) > 0 THEN cut ELSE room END END AS text FROM c""",
)
def scr_truncate_embed(spark, d):
    docs = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[文档] "), "source", F.lit("\n"), F.regexp_replace("text", r"\. ", "。"))).otherwise(F.col("text"))
    return docs.select("doc_id", T.truncated_for_embedding(text).alias("text"))


@query("hsh_quote", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def hsh_quote(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("scr_is_complex", "SELECT conv_id, turn, length(text) > 20 AS complex, turn % 8 <> 7 AS short_complex FROM conversations")
def scr_is_complex(spark, d):
    short = F.get(F.array(*[F.lit(x) for x in ("比较甲乙", "有何区别", "各项", "分别是", "所有人", "总结", "请汇总", "对比分析")]), (F.col("turn") % 8).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_complex("text").alias("complex"), T.is_complex(short).alias("short_complex"))


@query("scr_regex")
def scr_regex(spark, d):
    rows = _blocks(spark, d).select("doc_id", "block_index", F.explode(R.pattern_hits("text", r"\w+ouion|ed\b", whole_word=True)).alias("h"))
    return rows.select("doc_id", "block_index", "h.start", "h.end", "h.quote")


@query(
    "scr_numeric_extract",
    "SELECT l_orderkey, l_linenumber, (l_extendedprice::DECIMAL(20,2) * [1, 1, 10000, 100000000, 1][l_orderkey % 5 + 1])::DECIMAL(38,6)::VARCHAR AS value, ['usd', 'usd', 'cny', 'cny', 'percent'][l_orderkey % 5 + 1] AS unit FROM lineitem",
)
def scr_numeric_extract(spark, d):
    forms = [F.format_string(x, F.col("l_extendedprice").cast("decimal(20,2)").cast("string")) for x in ("price $%s due", "price US$%s due", "共 %s 万元整", "人民币 %s亿", "约%s％左右")]
    price = F.get(F.array(*forms), (F.col("l_orderkey") % 5).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(R.amounts(price)).alias("a"))
    return rows.select("l_orderkey", "l_linenumber", F.col("a.value").cast("string").alias("value"), "a.unit")
