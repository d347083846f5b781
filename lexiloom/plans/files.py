"""Queries on names, layout payloads, Markdown, predictions, manifests and stored rows."""

from __future__ import annotations

import hashlib
from collections import Counter

import regex
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import blocks as Bl
from lexiloom.operators import lifecycles as L
from lexiloom.operators import state as S
from lexiloom.operators.search_index import write_index
from lexiloom.sources import files as Fi
from lexiloom.sources import tables as Src
from lexiloom.sources.scratch import new_path

from .base import BLOCKS, query


def _docs(spark, d, *columns):
    return Src.table(spark, d, "documents").select(*columns)


@query(
    "src_title_from_filename",
    r"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id || '-' || source || '.txt' ELSE source || '.pdf' END AS name FROM documents), s AS (SELECT doc_id, regexp_replace(name, '\.(txt|pdf|docx)$', '') AS s FROM n)
SELECT doc_id, CASE WHEN regexp_matches(s, '^\d[^-]*-') THEN regexp_replace(s, '^\d[^-]*-', '') ELSE s END AS title FROM s""",
)
def src_title_from_filename(spark, d):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("-"), "source", F.lit(".txt"))).otherwise(F.concat("source", F.lit(".pdf")))
    return _docs(spark, d, "doc_id", name.alias("name")).select("doc_id", Src.title_of("name").alias("title"))


@query(
    "src_upload",
    r"""WITH u AS (SELECT doc_id, ['a.pdf', 'b.doc', 'c.DOCX', 'd.txt'][doc_id % 4 + 1] AS name, CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN 62914560 ELSE n_chars END AS size FROM documents)
SELECT doc_id, CASE WHEN lower(name) LIKE '%.doc' THEN 'legacy_format' WHEN NOT regexp_matches(lower(name), '\.(pdf|docx)$') THEN 'unsupported_format' WHEN size <= 0 THEN 'empty' WHEN size > 52428800 THEN 'too_large' END AS verdict FROM u""",
)
def src_upload(spark, d):
    name = F.get(F.array(*[F.lit(x) for x in ("a.pdf", "b.doc", "c.DOCX", "d.txt")]), (F.col("doc_id") % 4).cast("int"))
    size = F.when(F.col("doc_id") % 5 == 0, 0).when(F.col("doc_id") % 7 == 0, 62914560).otherwise(F.col("n_chars"))
    return _docs(spark, d, "doc_id", name.alias("name"), size.alias("size")).select("doc_id", Src.upload_verdict("name", "size").alias("verdict"))


@query("src_safe_filename", "SELECT doc_id, source || ' _' || doc_id || '_é(1).pdf' AS name FROM documents")
def src_safe_filename(spark, d):
    raw = F.concat("source", F.lit(" #"), F.col("doc_id").cast("string"), F.lit("/é(1).pdf"))
    return _docs(spark, d, "doc_id", raw.alias("raw")).select("doc_id", Src.safe_name("raw").alias("name"))


@query(
    "src_mineru_content_list",
    f"""WITH {BLOCKS}, i AS (SELECT doc_id, block_index AS position, text, ['header', 'table', 'list', 'text', 'text'][block_index % 5 + 1] AS type FROM blocks)
SELECT doc_id, position, CASE WHEN type = 'table' THEN 'table' WHEN type = 'header' OR position % 7 = 3 THEN 'heading' WHEN type = 'list' THEN 'list' ELSE 'paragraph' END AS type,
CASE WHEN type = 'table' THEN '| ' || text || ' |' ELSE text END AS text, position // 10 + 1 AS page_number FROM i WHERE type = 'table' OR text <> ''""",
)
def src_mineru_content_list(spark, d):
    lines = Src.line_blocks(_docs(spark, d, "doc_id", "text")).select("doc_id", F.col("block_index").alias("position"), "text")
    kind = F.get(F.array(*[F.lit(x) for x in ("header", "table", "list", "text", "text")]), F.col("position") % 5)
    items = lines.withColumns({"type": kind, "text_level": (F.col("position") % 7 == 3).cast("int"), "page_idx": F.floor(F.col("position") / 10)})
    return Bl.content_list_blocks(items.withColumn("table_body", F.when(F.col("type") == "table", F.concat(F.lit("| "), "text", F.lit(" |")))))


@query("src_mineru_payload", f"WITH {BLOCKS} SELECT doc_id, max(block_index) // 10 + 1 AS pages, sha256(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY block_index) FILTER (WHERE trim(text) <> ''), '')) AS markdown_sha256 FROM blocks GROUP BY doc_id")
def src_mineru_payload(spark, d):
    lines = F.split("text", "\n", -1)
    items = F.to_json(F.transform(lines, lambda x, i: F.struct(x.alias("text"), F.floor(i / 10).cast("int").alias("page_idx"))))
    return _docs(spark, d, "doc_id", Fi.payload(items).alias("p")).select("doc_id", "p.pages", F.sha2("p.markdown", 256).alias("markdown_sha256"))


@query(
    "src_md_blocks_strict",
    """WITH m AS (SELECT n_nationkey AS doc_id, n_name FROM named)
SELECT doc_id, 0 AS line, 'heading' AS type, 1 AS level, n_name AS text FROM m UNION ALL SELECT doc_id, 1, 'paragraph', NULL, 'one two' FROM m UNION ALL
SELECT doc_id, 4, 'table', NULL, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || 'end | x' FROM m UNION ALL SELECT doc_id, 8, 'paragraph', NULL, '| not | table |' FROM m""",
)
def src_md_blocks_strict(spark, d):
    text = F.concat(F.lit("# "), "n_name", F.lit("\none\ntwo\n\n| a | b |\n| --- | --- |\nend | x\n\n| not | table |"))
    return Bl.strict_markdown_blocks(Src.named(spark, d).select(F.col("n_nationkey").alias("doc_id"), text.alias("text")))


@query(
    "src_json_predictions",
    "SELECT doc_id, 'r1' AS rule_id, lang AS text, CASE WHEN doc_id % 3 = 2 THEN 'd' || doc_id END AS inner_id, CASE WHEN doc_id % 3 = 2 THEN source END AS doc_type FROM documents",
)
def src_json_predictions(spark, d):
    issue = F.struct(F.lit("r1").alias("rule_id"), F.col("lang").alias("text"))
    many = F.to_json(F.array(issue))
    found = F.to_json(F.struct(F.array(issue).alias("findings")))
    nested = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("source").alias("doc_type"), F.array(issue).alias("findings"))).alias("documents")))
    said = F.when(F.col("doc_id") % 3 == 0, many).when(F.col("doc_id") % 3 == 1, found).otherwise(nested)
    rows = _docs(spark, d, "doc_id", F.explode(Fi.predictions(said)).alias("p"))
    return rows.select("doc_id", "p.rule_id", "p.text", F.col("p.doc_id").alias("inner_id"), "p.doc_type")


@query(
    "src_sql_put",
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT c_custkey + 1000000, 'NEW' FROM customer WHERE c_custkey % 50 = 0",
)
def src_sql_put(spark, d):
    base = Src.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changed = base.where("c_custkey % 5 = 0").select("c_custkey", F.lit("NEW").alias("segment"))
    fresh = base.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("NEW").alias("segment"))
    return S.upserted(base, changed.unionByName(fresh), "c_custkey")


@query("src_sql_list", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 80")
def src_sql_list(spark, d):
    return S.page(Src.table(spark, d, "orders"), 3, 40, F.desc("o_orderdate"), "o_orderkey").select("o_orderkey")


@query("src_sql_get", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def src_sql_get(spark, d):
    return Src.table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@query("src_sql_delete", "SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0")
def src_sql_delete(spark, d):
    keys = Src.table(spark, d, "customer").select("c_custkey")
    return keys.join(keys.where("c_custkey % 4 = 0"), "c_custkey", "left_anti")


@query("src_json_migrate", "SELECT c_mktsegment AS collection, count(*) AS importable FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0 GROUP BY c_mktsegment")
def src_json_migrate(spark, d):
    rows = Src.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("collection"))
    base = rows.where("c_custkey % 2 = 0")
    added = S.inserted_if_absent(base, rows.where("c_custkey % 3 = 0"), "c_custkey").join(base, "c_custkey", "left_anti")
    return added.groupBy("collection").agg(F.count(F.lit(1)).alias("importable"))


# Customers hold their orders, orders their items: records written once by request, lists that replace each other, parents that take their children along.
@query(
    "src_orm",
    """WITH m AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS request, o_orderdate FROM orders),
i AS (SELECT o_orderkey, CASE WHEN request IS NULL THEN o_orderkey ELSE first_value(o_orderkey) OVER w END AS stored_id, request IS NULL OR row_number() OVER w = 1 AS inserted FROM m WINDOW w AS (PARTITION BY o_custkey, request ORDER BY o_orderdate, o_orderkey)),
s AS (SELECT o_orderkey, CASE WHEN o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey) THEN 'active' ELSE 'superseded' END AS status FROM orders)
SELECT o_orderkey, stored_id, inserted, status, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS items FROM i JOIN s USING (o_orderkey) WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 <> 0)""",
)
def src_orm(spark, d):
    orders = Src.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("request"))
    kept = L.superseded(L.inserted_once(orders, ["o_custkey", "request"], ["o_orderdate", "o_orderkey"], "o_orderkey"), "o_custkey", "o_orderdate")
    gone = Src.table(spark, d, "customer").where("c_custkey % 7 = 0").select("c_custkey")
    left = L.cascaded(gone, {"orders": (kept, "o_custkey", "o_orderkey"), "items": (Src.table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", None)})
    items = left["items"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"))
    return left["orders"].join(items, "o_orderkey", "left").select("o_orderkey", "stored_id", "inserted", "status", F.coalesce("items", F.lit(0)).cast("long").alias("items"))


@query(
    "snk_delete_by_query",
    """WITH n AS (SELECT count(*) AS deleted FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), d AS (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))
SELECT source AS term, count(*) AS docs, min(doc_id) AS first_id, any_value(n.deleted) AS total, any_value(n.deleted) AS deleted FROM d, n GROUP BY source""",
)
def snk_delete_by_query(spark, d):
    """What an index holds of each source after the labelled documents have been deleted from it."""
    index = write_index(_docs(spark, d, "doc_id", "source"), ["source"])
    index, n = index.delete(Src.table(spark, d, "labels").where("doc_id IS NOT NULL"))
    rows = index.postings().groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.min("key").alias("first_id"))
    return rows.select("*", *[F.lit(n[c]).cast("long").alias(c) for c in ("total", "deleted")])


@query(
    "snk_backup",
    "SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'unsafe_path' WHEN doc_id % 7 = 0 THEN 'unlisted' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'ok' END AS state FROM documents",
)
def snk_backup(spark, d):
    i = F.col("doc_id")
    name = F.concat(F.when(i % 11 == 0, "a/../").when(i % 13 == 0, "/").otherwise("a/"), i.cast("string"))
    docs, path = _docs(spark, d, "doc_id", "text").withColumn("name", name), new_path(spark, "backup")
    listed = Fi.back_up(docs, path, "name", "text")
    number = F.element_at(F.split("name", "/"), -1).cast("long")
    now = spark.read.parquet(path).withColumn("content", F.when(number % 5 == 0, F.concat("content", F.lit("!").cast("binary"))).otherwise(F.col("content")))
    return Fi.restorable(now, listed.where(number % 7 != 0)).select(number.alias("doc_id"), "state")


@query("snk_manifest_check", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'ok' END AS state FROM documents")
def snk_manifest_check(spark, d):
    docs = _docs(spark, d, "doc_id", "text")
    now = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return Fi.verified(Fi.manifest(docs, "doc_id", "text"), Fi.manifest(now, "doc_id", "text"), "doc_id")


@query(
    "snk_version_artifacts",
    "SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN 'written' WHEN doc_id % 6 = 0 THEN 'conflict' ELSE 'replayed' END AS verdict, CASE WHEN doc_id % 2 <> 0 THEN 'written' ELSE 'replayed' END AS again FROM documents",
)
def snk_version_artifacts(spark, d):
    docs, path = _docs(spark, d, "doc_id", F.lit("v1").alias("version"), "text"), new_path(spark, "versions")
    Fi.publish_versions(docs.where("doc_id % 2 = 0"), path, ["doc_id", "version"], "text")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    second = Fi.publish_versions(changed, path, ["doc_id", "version"], "text")
    third = Fi.publish_versions(docs, path, ["doc_id", "version"], "text").select("doc_id", F.when(F.col("verdict") == "replayed", "replayed").otherwise("lost").alias("third"))
    # What was written once is there unchanged the third time.
    return second.join(third, "doc_id").select("doc_id", "verdict", F.when(F.col("third") != "replayed", F.col("third")).when(F.col("verdict") == "written", "written").otherwise("replayed").alias("again"))


_VECTOR = "list_transform(range(0, 16), lambda k: len(list_filter(x, lambda y: y = k)))"


@query(
    "src_embeddings_api",
    rf"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda t: strpos('0123456789abcdef', left(md5(t), 1)) - 1) AS x FROM documents)
SELECT doc_id, array_to_string({_VECTOR}, ',') AS vector FROM t""",
)
def src_embeddings_api(spark, d):
    def service(texts: list[str]) -> list[list[int]]:
        """Stands in for the outside service: tokens counted by the first digit of their hash."""
        assert len(texts) <= 100
        found = [Counter(int(hashlib.md5(t.encode()).hexdigest()[0], 16) for t in regex.findall(r"[\p{L}\p{N}]+", text.lower())) for text in texts]
        return [[c[k] for k in range(16)] for c in found]

    out = Fi.embedded(_docs(spark, d, "doc_id", "text"), "text", service)
    return out.select("doc_id", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query("hsh_file", r"SELECT doc_id, sha256(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10))) AS digest FROM documents")
def hsh_file(spark, d):
    crlf = F.regexp_replace("text", "\n", "\r\n")
    return _docs(spark, d, "doc_id", F.sha2(F.regexp_replace(crlf, "\r\n", "\n"), 256).alias("digest"))


@query("dat_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN epoch(date_trunc('second', o_orderdate))::BIGINT END AS seconds FROM orders")
def dat_parse(spark, d):
    said = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return Src.table(spark, d, "orders").select("o_orderkey", F.unix_seconds(T.parsed_time(said).cast("timestamp")).alias("seconds"))


@query("jsn_llm", "SELECT doc_id, 'f' || doc_id AS finding_id, lang AS text FROM documents WHERE doc_id % 4 <> 0")
def jsn_llm(spark, d):
    good = F.concat(F.lit('Sure:\n{"items": [{"finding_id": "f'), F.col("doc_id").cast("string"), F.lit('", "text": "'), "lang", F.lit('"}]}\nbye'))
    said = F.when(F.col("doc_id") % 4 == 0, "no items here").otherwise(good)
    return _docs(spark, d, "doc_id", F.explode(T.model_items(said, "struct<finding_id: string, text: string>")).alias("i")).select("doc_id", "i.finding_id", "i.text")


@query("jsn_alias", "SELECT doc_id, lang AS rule_id FROM documents")
def jsn_alias(spark, d):
    said = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("lang").alias("rule_id")))).otherwise(F.to_json(F.struct(F.col("lang").alias("ruleId"))))
    return _docs(spark, d, "doc_id", F.coalesce(F.get_json_object(said, "$.rule_id"), F.get_json_object(said, "$.ruleId")).alias("rule_id"))


@query("seq_doc_locator", f"WITH {BLOCKS} SELECT doc_id, block_index, 'docx-p-' || lpad(block_index::VARCHAR, 6, '0') AS locator FROM blocks")
def seq_doc_locator(spark, d):
    return Src.line_blocks(_docs(spark, d, "doc_id", "text")).select("doc_id", "block_index", F.format_string("docx-p-%06d", "block_index").alias("locator"))


@query(
    "src_pdf_group_words",
    """WITH r AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
p AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey, run ORDER BY l_linenumber) - 1) // 2 AS pair FROM r), n AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY run, pair) - 1 AS line FROM p)
SELECT l_orderkey, line, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_quantity, l_returnflag) AS text FROM lineitem JOIN n USING (l_orderkey, l_linenumber) GROUP BY l_orderkey, line""",
)
def src_pdf_group_words(spark, d):
    word = F.struct((F.col("l_linenumber") * 1.5).cast("double").alias("top"), F.col("l_quantity").alias("x0"), F.col("l_returnflag").alias("text"))
    pages = Src.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(word).alias("words"))
    return pages.select("l_orderkey", F.posexplode(Fi.word_lines(F.col("words"))).alias("line", "text"))
