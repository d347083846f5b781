"""Lives on odd input: nulls, repeats, steps out of turn, nothing at all."""

import json

from pyspark.sql import functions as F

from lexiloom.operators import anchors, lifecycles as L
from lexiloom.operators import state as S


def test_decisions(spark):
    rows = [(1, 1, "confirm"), (1, 2, "start"), (1, 3, None), (1, 4, "start"), (1, 5, "confirm"), (1, 6, "later"), (2, 1, "start")]
    states, audit = L.decisions(spark.createDataFrame(rows, "job long, n int, what string"), "job", ["n"], F.col("what"))
    assert sorted(tuple(r) for r in states.collect()) == [(1, 1, "waiting_confirmation"), (1, 2, "cancelled"), (2, 1, "waiting_confirmation")]
    assert [(r.n, r.audit, r.status) for r in audit.where("job = 1").orderBy("n").collect()] == [(1, "error", "unknown"), (2, "decision.started", "waiting_confirmation"), (4, "decision.started", "waiting_confirmation"), (5, "decision.resumed", "completed"), (6, "decision.resumed", "cancelled")]


def test_deletions(spark):
    steps = ["row_removed", "requested", "requested", "row_removed", "directory_removed", "directory_removed", "row_removed", "other", "index_removed", "requested", None]
    rows = spark.createDataFrame([(7, k, s) for k, s in enumerate(steps)] + [(8, 0, "requested")], "doc long, n int, step string")
    out = {(r.doc, r.seq): (r.verdict, r.phase) for r in L.deletions(rows, "doc", "n", "step").collect()}
    want = [("missing", None), ("moved", "pending_filesystem"), ("again", "pending_filesystem"), ("refused", "pending_filesystem"), ("moved", "pending_index"), ("again", "pending_index"), ("moved", "pending_es"), ("unknown", "pending_es"), ("moved", "complete"), ("again", "complete"), ("unknown", "complete")]
    assert [out[7, k] for k in range(len(steps))] == want and out[8, 0] == ("moved", "pending_filesystem")


def test_recovered(spark):
    rows = spark.createDataFrame([(1, "running", None), (2, "parsing", ["{}"]), (3, "complete", None), (4, None, ["{}"])], "id long, status string, errors array<string>")
    got = {r.id: r for r in L.recovered(rows, "status", "errors").collect()}
    assert [got[k].status for k in (1, 2, 3, 4)] == ["queued", "queued", "complete", None]
    assert json.loads(got[1].errors[0]) == L.RECOVERED and len(got[2].errors) == 2 and got[3].errors is None and got[4].errors == ["{}"]


def test_answers(spark):
    kind = "c long, r string, n int, tokens array<string>, answer string, outcome string"
    rows = [(1, "a", 1, ["x", "y"], None, None), (1, "a", 2, None, "whole", "done"), (1, "a", 3, ["z"], "other", "error"), (1, "b", 4, [""], "", "done"), (2, "a", 1, [], None, "error")]
    got = {}
    for r in L.answer_events(spark.createDataFrame(rows, kind), "c", "r", ["n"]).orderBy("c", "n", "part").collect():
        got.setdefault((r.c, r.r), []).append((r.event, r.data, r.replayed))
    said = [(e, d) for e, d, _ in got[1, "a"]]
    assert [e for e in said if e[0] in ("done", "error")] == [("done", "whole"), ("done", "whole")]  # one end, told twice
    assert [e for e, _, replayed in got[1, "a"] if replayed] == ["meta", "done"] and ("token", "z") not in said and ("token", "x") in said
    assert [e for e, _, _ in got[1, "b"]] == ["meta", "status", "status", "done"] and [e for e, _, _ in got[2, "a"]] == ["meta", "status", "error"]


def test_records(spark):
    rows = spark.createDataFrame([(1, "q", 10, 1), (1, "q", 11, 2), (1, None, 12, 3), (1, None, 13, 4), (2, "q", 14, 5)], "c long, request string, id long, n int")
    got = {r.id: (r.stored_id, r.inserted) for r in L.inserted_once(rows, ["c", "request"], ["n"], "id").collect()}
    assert got == {10: (10, True), 11: (10, False), 12: (12, True), 13: (13, True), 14: (14, True)}
    a, b = spark.createDataFrame([(1,), (2,)], "a long"), spark.createDataFrame([(1, 5), (2, 6), (2, 7)], "a long, b long")
    c = spark.createDataFrame([(5,), (6,), (None,)], "b long")
    left = L.cascaded(spark.createDataFrame([(2,), (2,)], "x long"), {"b": (b, "a", "b"), "c": (c, "b", None)})
    assert [tuple(r) for r in left["b"].collect()] == [(1, 5)] and {r.b for r in left["c"].collect()} == {5, None} and a.count() == 2
    spans = spark.createDataFrame([(1, 0.0, 25.0), (2, 5.0, 5000.0), (3, 5.0, None), (4, 9.0, 1.0)], "id long, a double, b double")
    told = {}
    for r in L.ticks(spans, F.col("a"), F.col("b")).collect():
        told.setdefault(r.id, []).append(r.progress)
    assert told == {1: [71, 72], 2: list(range(71, 80))}


def test_sent_events(spark):
    text = "event: a\r\ndata: {\"x\": 1}\r\n\r\nevent:\ndata: not json\n\ndata: [1]\n\n: comment\n\nevent: done\ndata:\n\nevent: a\ndata: 1\n\n"
    got = [(r.event, r.data) for r in S.decoded_events(spark.createDataFrame([(1, text), (2, ""), (3, "event: cut"), (4, None)], "k long, t string"), "k", "t").orderBy("n").collect()]
    assert got == [("a", '{"x": 1}'), ("message", '{"message":"not json"}'), ("message", "[1]"), ("done", '{"message":""}')]


def test_pages_of_repeated_lines(spark):
    line, n = "the same line again and again", 300
    spans = spark.createDataFrame([(1, k, line, k // 10 + 1) for k in range(n)] + [(1, n, "abcdXYZ", 99), (1, n + 1, "abcd", 98)], "doc_id long, n int, text string, page int")
    blocks = spark.createDataFrame([(1, k, line) for k in range(n)] + [(1, n, "abcdX"), (1, n + 1, "nothing"), (1, n + 2, " "), (2, 0, line)], "doc_id long, block_index int, text string")
    got = {(r.doc_id, r.block_index): (r.page, r.shared) for r in anchors.block_pages(blocks, spans).collect()}
    assert got == {(1, k): (1, len(line)) for k in range(n)} | {(1, n): (99, 5)}
