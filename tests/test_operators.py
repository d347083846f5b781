"""Fixtures for what the driver's tables do not hold."""

import re

import pandas as pd
from pyspark.sql import functions as F

from lexiloom.functions import grids as G
from lexiloom.functions import text as T
from lexiloom.operators import blocks as Bl
from lexiloom.operators import chunking as C
from lexiloom.operators import evaluate as E
from lexiloom.operators import rules as R
from lexiloom.operators import state as S
from lexiloom.sources import tables as Src
from lexiloom.streaming import events as Ev


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_amounts(spark):
    got = one(spark, R.amounts("t"), "合同金额为 500 万元，期限 12个月，罚金¥1,234.5，比例 30％")
    assert [(float(a.value), a.unit) for a in got] == [(5_000_000, "cny"), (12, "month"), (1234.5, "cny"), (30, "percent")]
    a = one(spark, F.exists(R.amounts("t"), lambda a: R.compared(a["value"], "gt", F.lit(4_000_000)) & R.unit_fits("元", a["unit"])), "金额 500 万元")
    assert a is True


def test_field_near(spark):
    near = lambda t: one(spark, R.field_near(F.col("t"), F.lit(60), F.lit(62), "违约金"), t)
    assert near("x" * 50 + "违约金" + "x" * 20) and near("x" * 80) and not near("违约金" + "x" * 200)


def test_patterns(spark):
    hits = one(spark, R.pattern_hits("t", r"第\d+条", whole_word=False), "见第3条和第12条")
    assert [(h.start, h.end, h.quote) for h in hits] == [(1, 4, "第3条"), (5, 9, "第12条")]
    assert [h.start for h in one(spark, R.keyword_hits("t", "a.b"), "xA.B a.b axb😀a.b")] == [1, 5, 13]
    assert [tuple(h) for h in one(spark, R.keyword_hits("t", "eux"), "İİ eux EUX")] == [(3, 6, "eux"), (7, 10, "EUX")]
    assert [h.start for h in one(spark, R.keyword_hits("t", "eux", whole_word=True), "euxe eux, ёeux")] == [5]
    assert [h.start for h in one(spark, R.keyword_hits("t", "Eux", case_sensitive=True), "eux Eux")] == [4]
    assert one(spark, R.keyword_hits("t", "eux"), None) == [] and one(spark, R.keyword_hits("t", "eux"), "") == []


def test_false_positives(spark):
    cases = {"": "empty", "第三条": "sequence_marker", "____": "placeholder", "□ 是": "checkbox_or_option", "。，": "format_marker", "甲方：": "standard_contract_label", "2026年8月15日": "isolated_date", "3 万元": "isolated_numeric_value", "甲方应当付款": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.false_positive_reason("t").alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases


def test_scope_and_status(spark):
    rows = [(1, 0, "heading", "违约责任"), (1, 1, "paragraph", "甲方违约金"), (1, 2, "paragraph", "其他"), (1, 3, "heading", "附则"), (1, 4, "paragraph", "违约金")]
    blocks = spark.createDataFrame(rows, "doc_id long, block_index int, type string, text string")
    assert [r.block_index for r in R.in_scope(blocks, "违约", 10).where("in_scope").orderBy("block_index").collect()] == [0, 1, 2]
    assert R.statuses(blocks, "违约金", None, "违约", 10).first().status == "matched"
    assert R.statuses(blocks, None, None).first().status == "indeterminate"
    assert R.statuses(blocks, "没有").first().status == "no_match"


def test_grids(spark):
    md = "| a | b\\|c |\n| --- | :-: |\n| --- | --- |\n| 1 | 2 |\n|  |  |\n| 3 |"
    assert one(spark, G.markdown_grid("t"), md) == [["a", "b\\", "c"], ["---", ":-:", ""], ["1", "2", ""], ["3", "", ""]]
    assert one(spark, G.markdown_grid("t"), "| a |") is None
    html = "<table><tr><td><p>a</p>x<br>y</td><td>&lt;b&gt;</td></tr><tr><td>1</td></tr></table>"
    assert one(spark, G.html_grid("t"), html) == [["ax y", "<b>"], ["1", ""]]
    assert one(spark, G.html_grid("t"), "no table") is None
    assert one(spark, G.is_grid(G.markdown_grid("t")), "| a |\n| b |") is False


def test_merged_tables(spark):
    t = "| a | b |\n| --- | --- |\n| {} | 2 |"
    rows = [(1, 0, "table", t.format(1)), (1, 1, "table", t.format(3)), (1, 2, "paragraph", "x"), (1, 3, "table", t.format(4))]
    got = Bl.merged_tables(spark.createDataFrame(rows, "doc_id long, block_index int, type string, text string")).orderBy("block_index").collect()
    assert [(r.block_index, r.merged) for r in got] == [(0, 2), (2, 1), (3, 1)]
    assert got[0].text == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 2 |"
    # A row that says what the head says stays; a later head goes, whatever it says, and only above a separator.
    rows = [(1, 0, "table", "| k | v |\n| --- | --- |\n| k | v |"), (1, 1, "table", "| x | y |\n|---|---|\n| 1 | 2 |"), (1, 2, "table", "| 3 | 4 |\n| 5 | 6 |")]
    got = Bl.merged_tables(spark.createDataFrame(rows, "doc_id long, block_index int, type string, text string")).collect()
    assert [(r.merged, r.text) for r in got] == [(3, "| k | v |\n| --- | --- |\n| k | v |\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |")]


def test_raw_blocks(spark):
    raw = spark.createDataFrame([(1, 0, "header", "h", None), (1, 1, "title", "T", ""), (1, 2, "text", " ", None), (1, 3, "table", "x", "own"), (1, 4, "text", "y", None)], "doc_id long, position int, type string, text string, block_id string")
    assert [(r.block_id, r.type) for r in Bl.normalized_blocks(raw).orderBy("position").collect()] == [("b1", "heading"), ("own", "table"), ("b4", "paragraph")]


def test_chunks(spark):
    assert all(len(c) <= 384 for c in C.sentence_windows("句子。" * 500, 384, 46))
    windows = C.sentence_windows("一" * 300 + "。" + "二" * 300 + "。", 384, 46)
    assert windows[1].startswith(windows[0][-46:])
    table = "| a |\n| - |\n" + "\n".join(f"| {i} |" for i in range(300))
    parts = C.structure_chunks("t", [{"type": "table", "text": table, "section": ""}])
    assert len(parts) > 1 and all(p.startswith("[文档] t\n\n| a |\n| - |\n") and len(p) <= 384 for p in parts)
    assert "\n".join(r for p in parts for r in p.split("\n")[4:]) == table.split("\n", 2)[2]
    a, b, c = "a" * 100, "b" * 100, "c" * 90
    assert C.merged_short([a, b, c], 200) == [a, f"{b}\n{c}"]  # 100 and 191 characters
    assert C.merged_short(["", "", a, "x", b], 201) == [f"{a}\nx", b] and C.merged_short(["", ""], 9) == [] and C.merged_short(["x", a], 50) == ["x", a]
    merged = C.structure_chunks("t", [{"type": "paragraph", "section": "s", "text": "第一条" + "甲" * 300 + "第二条" + "乙" * 150 + "第三条 丙"}])
    assert [m.split("\n\n")[1][:3] for m in merged] == ["第一条", "第二条"] and merged[1].endswith("乙\n第三条 丙") and all(m.startswith("[文档] t\n[章节] s\n\n") for m in merged)
    html = spark.createDataFrame([(1, "t", 0, "table", "", "<table><tr><td>k</td><td>v</td></tr><tr><td>1</td><td>2</td></tr></table>")], "doc_id long, title string, block_index int, type string, section string, text string")
    assert [r.chunk for r in C.structured(html).collect()] == ["[文档] t\n\n| k | v |\n| --- | --- |\n| 1 | 2 |"]
    assert all(len(c) <= 384 for c in C.recursive_chunks("word " * 1000)) and "".join(C.recursive_chunks("x" * 500, 384, 0)) == "x" * 500
    assert one(spark, T.truncated_for_embedding("t"), "[文档] a\n" + "句。" * 400).endswith("。")


def test_association(spark):
    key = "doc_id string, rule_id string, severity string, doc_type string, id long, text string, issue_id string"
    gold = spark.createDataFrame([("d", "r", "high", "c", 1, "the tenant must pay", None), ("d", "r", "high", "c", 2, "other clause text", None)], key)
    pred = spark.createDataFrame([("d", "r", "high", "c", 7, "tenant must pay", None), ("d", "r", "high", "c", 8, "zzz qqq", None), ("d", "r", "low", "c", 9, "other clause text", None)], key)
    assert [(r.gold_id, r.prediction_id) for r in E.associated(gold, pred).collect()] == [(1, 7)]
    assert E.text_score("a b", "AB") == 1 and E.text_score("", "x") == 0 and E.text_score("abcd", "ab") == 0.8


def test_answers(spark):
    block = [("b1", "pay five days", "p1")]
    cases = spark.createDataFrame(
        [("q", True, "d", "v", ["five"], block), ("r", False, "d", "v", [], block), ("s", True, "d", "v", ["six"], block), ("t", True, "d", "v", [], block)],
        "question_id string, answerable boolean, document_id string, version_id string, required_facts array<string>, blocks array<struct<block_id: string, text: string, locator: string>>",
    )
    cite = lambda *x: [("b1", "d", "v", *x)]
    answers = spark.createDataFrame(
        [("q", False, "within five days", cite(4, 8, "five", "p1"), ["token", "done"]), ("r", True, "", [], ["done"]), ("s", False, "none", cite(0, 3, "Pay", "p1") + cite(0, 3, "pay", "p2"), ["done", "error"])],
        f"question_id string, refused boolean, answer string, citations array<{E.CITATION}>, events array<string>",
    )
    checked = E.answer_quality(cases, answers)
    assert {r.question_id: r.failures for r in checked.collect()} == {
        "q": [], "r": [], "s": ["answer_fact_mismatch", "invalid_terminal_count", "locator_mismatch", "quote_mismatch"], "t": ["invalid_terminal_count", "missing_citation"],
    }
    m = E.qa_metrics(checked).first()
    assert (m.cases, m.answer_accuracy, m.citation_exact_match_rate, m.refusal_correct_rate, m.sse_unique_terminal_rate, m.passed) == (4, 2 / 3, 2 / 3, 1.0, 0.5, False)
    none = E.qa_metrics(E.answer_quality(cases.limit(0), answers)).first()
    assert (none.answer_accuracy, none.citation_exact_match_rate, none.refusal_correct_rate, none.passed) == (0.0, 1.0, 1.0, False)


def test_governor(spark):
    ev = [(1, 0.0, "admit", "a"), (2, 1.0, "admit", "b"), (3, 2.0, "admit", "c"), (4, 3.0, "admit", "d"), (5, 4.0, "admit", "a"), (6, 5.0, "complete", "a"), (7, 6.0, "admit", "d"), (8, 7.0, "admit", "e"), (9, 30.0, "admit", "e"), (10, 31.0, "complete", "x"), (11, 32.0, "complete", "b")]
    rows = spark.createDataFrame([(g, *r) for g in ("g", "h") for r in ev], "g string, id long, at double, kind string, job string")
    got = {(r.g, r.id): (r.outcome, r.promoted) for r in S.governed(rows, "g", 2, 1, 4, 10.0).collect()}
    want = ["running", "running", "queued", "queue_full", "running", "complete", "queued", "rate_limited", "queue_full", "complete", "complete"]
    promoted = {6: "c", 10: "d"}
    for g in ("g", "h"):
        assert [got[g, k][0] for k in range(1, 12)] == want
        assert {k: got[g, k][1] for k in range(1, 12) if got[g, k][1]} == promoted


def test_walk_equals_plain_loop(spark):
    """The governor over many keys and small batches is the same loop, key by key."""
    import random

    rng = random.Random(1)
    ev = [(rng.randint(1, 5), k, float(k // 3), rng.choice(["admit", "admit", "complete"]), f"j{rng.randint(0, 6)}") for k in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.id: (r.outcome, r.promoted) for r in S.governed(spark.createDataFrame(ev, "g long, id long, at double, kind string, job string"), "g", 1, 2, 3, 20.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(1, 6):
        runs, waits, times = [], [], []
        for _, k, at, kind, job in (e for e in ev if e[0] == g):
            if kind == "complete":
                runs = [x for x in runs if x != job]
                up = waits.pop(0) if waits else None
                runs += [up] if up and up not in runs else []
                assert got[k] == ("complete", up)
                continue
            times = [t for t in times if t > at - 20]
            if len(times) >= 3:
                want = "rate_limited"
            elif job in runs or job in waits:
                want = "running" if job in runs else "queued"
            elif not runs or len(waits) < 2:
                want = "running" if not runs else "queued"
                (waits if runs else runs).append(job)
                times.append(at)
            else:
                want = "queue_full"
            assert got[k] == (want, None)


def test_audit_chain_breaks(spark):
    chain = S.audit_chain(spark.createDataFrame([("j", k, f"a{k}") for k in range(1, 6)], "job string, seq long, action string"), "job")
    assert S.broken_links(chain, "job").count() == 0
    assert {r.seq for r in S.broken_links(chain.withColumn("action", F.when(F.col("seq") == 3, "x").otherwise(F.col("action"))), "job").collect()} == {3}


def test_admissions(spark):
    rows = spark.createDataFrame([("g", i, float(t)) for i, t in enumerate((0, 1, 2, 11, 11.5))], "g string, id long, at double")
    assert [r.admitted for r in S.admissions(rows, "g", "at", 2, 10.0).orderBy("id").collect()] == [True, True, False, True, True]


def test_sources(spark, tmp_path):
    (tmp_path / "12-a name.txt").write_text("body")
    (tmp_path / "b.txt").write_text("  ")
    got = Src.text_folder(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.title, r.text) for r in got] == [("12-a name.txt", "a name", "body")]
    v = spark.createDataFrame([("a.pdf", 1), ("a.doc", 1), ("a.txt", 1), ("b.DOCX", 0), ("c.pdf", 1 << 40)], "n string, s long").select(Src.upload_verdict("n", "s").alias("v")).collect()
    assert [r.v for r in v] == [None, "legacy_format", "unsupported_format", "empty", "too_large"]


def test_model_hook(spark):
    blocks = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "i int, text string")
    got = R.reviewed(blocks, lambda prompt, texts: [f"{prompt}:{t}" for t in texts], "p").orderBy("i").collect()
    assert [r.answer for r in got] == [f"p:t{i}" for i in range(40)]


def test_streams_equal_batches(spark, tmp_path):
    events = pd.DataFrame({"event_id": range(200), "ts": pd.date_range("2026-01-01", periods=200, freq="7min"), "user_id": [k % 5 for k in range(200)], "event_type": ["a", "b"] * 100, "value": [float(k) for k in range(200)], "props": "{}"})
    batch = spark.createDataFrame(events)
    for k in range(4):
        spark.createDataFrame(events[k * 50 : k * 50 + 50]).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = Ev.event_stream(spark, str(tmp_path / "e"), batch.schema)
    whole = {(r.start, r.event_type): r.n for r in Ev.tumbling(batch.withColumn("at", F.col("ts").cast("timestamp"))).collect()}
    # Complete mode gives every window, closed by the watermark or not.
    got = {(r.start, r.event_type): r.n for r in Ev.drained(Ev.tumbling(stream, late="30 days"), "tumbled", "complete").collect()}
    assert got == whole
    first = Ev.drained(Ev.tailed(stream, 3), "tailed").groupBy("user_id").agg(F.collect_list("event_id").alias("e")).collect()
    assert all(len(r.e) == 3 for r in first) and len(first) == 5


def test_search_reads_postings_of_its_terms_alone(spark, tmp_path):
    from lexiloom.operators import retrieval as Re
    from lexiloom.operators.search_index import write_index

    docs = spark.createDataFrame([(1, "red fox", "a red fox and a red hen"), (2, "hen", "one hen"), (3, None, "nothing here"), (4, "x", "")], "doc_id long, title string, content string")
    index = write_index(docs, ["title", "content"], str(tmp_path / "index"))
    assert index.fields["content"] == (4, 7 + 2 + 2)
    found = Re.bm25(index, ["red", "hen"], Re.BOOSTS)
    scores = {r.doc_id: r.score for r in found.collect()}
    assert set(scores) == {1, 2} and scores[1] > 0
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan) and "PushedFilters: [In(term" in plan
    assert Re.bm25(index, ["absent"], Re.BOOSTS).count() == 0
