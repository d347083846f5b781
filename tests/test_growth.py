"""What must not grow with pairs or with rows: files of a jobs folder, partners of an event."""

import glob

import duckdb
from pyspark.sql import functions as F

from lexiloom.functions import grids
from lexiloom.operators import anchors
from lexiloom.plans import quality, registry, state


def test_jobs_share_files(spark, tmp_path, monkeypatch):
    spark.range(0, 90_000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c\"\n"), F.col("id").cast("string")).alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(quality, "new_path", lambda spark, name: f"{tmp_path}/{name}")
    rows = quality.src_json_jobs_dir(spark, str(tmp_path))
    found = rows.agg(F.count("job"), F.countDistinct("job"), F.sum("findings"), F.count(F.when(F.col("name") == F.concat(F.lit("c\"\n"), F.col("job").cast("string")), 1))).first()
    assert tuple(found) == (90_000, 90_000, 180_000, 90_000)
    assert len(glob.glob(f"{tmp_path}/jobs/part=*/*.txt")) == 9


def test_parse_window_of_many_jobs_that_begin_together(spark, tmp_path):
    i = F.col("id")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.hash(i), F.lit(400)) * 600).cast("timestamp_ntz")
    spark.range(0, 9_000).select((i - i % 50).alias("event_id"), (i % 900).alias("user_id"), ts.alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    found = state.join_parse_window(spark, str(tmp_path))
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(tuple(r) for r in found.collect()) == sorted(con.execute(registry.oracle_sql()["join_parse_window"]).fetchall())


def test_tables_of_hits_are_worked_out_once(spark):
    md, web = "| a | b |\n| --- | --- |\n| {} | x |", "[文档] t\n<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x</td></tr></table>"
    rows = [(1, 5, "text", md.format(1), None), (1, 2, "text", web, None), (1, 1, "text", "plain", None), (1, 3, "text", md.format(2) + "\n", ""), (1, 4, "Table", "nothing", md.format(3)), (2, 1, "text", "plain", None), (2, 2, "text", "| a |\n| --- |\n| 1 |", None), (3, 1, None, None, None), (3, 9, "TABLE", md.format(4), None)]
    hits = spark.createDataFrame(rows, "q int, rank int, kind string, content string, markdown string")
    found = grids.tables_of_hits(hits, "q", "rank", 2)
    assert sorted((r.q, r.rank, r.markdown) for r in found.collect()) == [(1, 2, md.format(1)), (1, 3, md.format(2)), (3, 9, md.format(4))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)^") == 1 and plan.count("ArrowEvalPython") + plan.count("PythonUDF") > 0


def test_lines_are_normalized_once_for_both_ways_of_meeting(spark):
    spans = spark.createDataFrame([(1, 0, "a  line of text", 1), (1, 1, "a line of words", 2), (1, 2, "abcd", 3), (2, 0, "é1é2é3é4é5", 4)], "doc_id long, n int, text string, page int")
    blocks = spark.createDataFrame([(1, 0, "a line of wood"), (1, 1, "abcdX"), (1, 2, "abcdX"), (1, 3, "nothing at all"), (2, 0, "é1é2é3é4é6")], "doc_id long, block_index int, text string")
    found = anchors.block_pages(blocks, spans)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 2, 12), (1, 1, 3, 4), (1, 2, 3, 4), (2, 0, 4, 9)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(text") <= 2  # a projection and the filter on it
