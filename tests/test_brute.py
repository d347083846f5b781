"""Queries that SQL cannot express against plain loops over the smallest tables."""

import os
import re

import duckdb
import pytest

from lexiloom.operators import chunking as C
from lexiloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES = registry.queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(sql):
    return duckdb.sql(sql.format(folder=FOLDER)).fetchall()


def documents():
    return dict(rows("SELECT doc_id, text FROM '{folder}/documents.parquet'"))


def test_patterns_are_those_of_python(spark):
    rule = re.compile(r"(?<!\w)(?:\w+ouion|ed\b)(?!\w)", re.IGNORECASE)
    want = sorted((i, n, m.start(), m.end(), m[0]) for i, t in documents().items() for n, line in enumerate(t.split("\n")) for m in rule.finditer(line))
    got = sorted((r.doc_id, r.block_index, r.start, r.end, r.quote) for r in QUERIES["scr_regex"](spark, FOLDER).collect())
    assert got == want


def test_admissions_are_those_of_a_loop(spark):
    want, held = {}, {}
    for user, i, at in rows("SELECT user_id, event_id, epoch_us(ts) / 1e6 AS at FROM '{folder}/events.parquet' ORDER BY 1, 3, 2"):
        held[user] = [t for t in held.get(user, []) if t > at - 36_000]
        want[i] = len(held[user]) < 2
        held[user] += [at] if want[i] else []
    assert {r.id: r.admitted for r in QUERIES["win_admissions"](spark, FOLDER).collect()} == want


def test_governor_is_that_of_a_loop(spark):
    want, state = {}, {}
    for user, i, at, kind in rows("SELECT user_id, event_id, epoch_us(ts) / 1e6 AS at, event_type FROM '{folder}/events.parquet' ORDER BY 1, 3, 2"):
        runs, waits, times = state.setdefault(user, (set(), [], []))
        job = str(i % 7)
        if kind == "click":
            runs.discard(job)
            up = waits.pop(0) if waits else None
            runs |= {up} if up else set()
            want[i] = ("complete", up)
            continue
        times[:] = [t for t in times if t > at - 86_400]
        if len(times) >= 4:
            want[i] = ("rate_limited", None)
        elif job in runs or job in waits:
            want[i] = ("running" if job in runs else "queued", None)
        elif len(runs) < 2 or len(waits) < 2:
            want[i] = ("running" if len(runs) < 2 else "queued", None)
            times.append(at)
            if len(runs) < 2:
                runs.add(job)
            else:
                waits.append(job)
        else:
            want[i] = ("queue_full", None)
    assert {r.id: (r.outcome, r.promoted) for r in QUERIES["stm_capacity"](spark, FOLDER).collect()} == want


@pytest.mark.parametrize("name", ["scr_recursive_split", "scr_sentence_window"])
def test_chunks_are_short_pieces_that_leave_nothing_out(spark, name):
    texts, got = documents(), {}
    for r in QUERIES[name](spark, FOLDER).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    for i, t in texts.items():
        solid, covered = "".join(t.split()), 0  # what lies between chunks is white space alone
        for chunk in got.get(i, []):
            own = "".join(chunk.split())
            assert 0 < len(chunk) <= C.CHUNK
            at = solid.rfind(own, 0, covered + len(own))
            assert at >= 0
            covered = max(covered, at + len(own))
        assert covered == len(solid)


def test_structure_chunks_carry_their_title(spark):
    sources = dict(rows("SELECT doc_id, source FROM '{folder}/documents.parquet'"))
    found = QUERIES["scr_structure_chunk"](spark, FOLDER).collect()
    bodies = {}
    for r in found:
        assert r.chunk.startswith(f"[文档] {sources[r.doc_id]}\n") or len(r.chunk) <= C.CHUNK
        bodies[r.doc_id] = bodies.get(r.doc_id, "") + r.chunk
    for i, t in documents().items():
        for line in t.split("\n"):
            if 40 < len(line.strip()) <= 200:
                assert line.strip() in bodies[i]


def test_live_governor_is_the_batch_one(spark):
    told = lambda name: sorted((r.id, r.outcome, r.promoted or "") for r in QUERIES[name](spark, FOLDER).select("id", "outcome", "promoted").collect())
    assert told("stm_live_capacity") == told("stm_capacity")
