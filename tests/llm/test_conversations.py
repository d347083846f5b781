"""Repairs against every edit tried, and against the SQL fold, on odd conversations cut into small segments."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from lexiloom.llm import conversations as c

WANTED = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, edits, turns) by trying all edits of few rows: (role, text, fault)."""
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for acts in itertools.product("KuaD", repeat=len(rows)):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                cost, audit, out = cost + 2 * len(gaps[k]), audit + "I" * len(gaps[k]), out + [(r, "") for r in gaps[k]]
                if k == len(rows):
                    break
                role, text, fault = rows[k]
                if acts[k] == "D":
                    cost, audit = cost + 3, audit + "D"
                elif fault in (c.BLANK, c.DUPLICATE):
                    break
                else:
                    new = {"K": role, "u": "user", "a": "assistant"}[acts[k]]
                    cost, audit, out = cost + 2 * (acts[k] != "K") + (fault == c.TRUNCATED), audit + ("K" if acts[k] == "K" else "R"), out + [(new, text)]
            else:
                raise AssertionError
            if k == len(rows) and all(r for r, _ in out) and WANTED.fullmatch("".join(r[0] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def plain(rows):
    """Faults of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(c.BLANKS)
        out.append(c.BLANK if not bare else c.DUPLICATE if (role, text) in seen else c.FINE if bare[-1] in ".!?" else c.TRUNCATED)
        seen.add((role, text))
    return out


def odd_rows():
    rng = random.Random(11)
    texts, roles = ["Yes.", "No!", "So", "", " \t", "Well?\n", "Fine. ", None], ["user", "assistant", "system", "tool", "", None, "unit"]
    rows = [(k, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)) for k in [None, *range(30)] for _ in range(rng.choice([1, 2, 3, 3, 4]))]
    return rows + [(100, 5, "user", "Again.")] * 30 + [(101, t % 9, rng.choice(roles), f"{t % 23}" + rng.choice([".", ""])) for t in range(60)]


def test_every_edit_tried():
    rng = random.Random(3)
    for _ in range(40):
        rows = [(t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c", ""])) for t in range(rng.choice([1, 2, 3]))]
        faults = plain(rows)
        want = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
        ends = c.best_edits([r[:1] for _, r, _ in rows], faults, c.NOTHING)
        assert min((cost + 2 * len(c.TAIL[m]), audit + c.TAIL[m]) for m, (cost, audit) in ends.items()) == want[:2]


@pytest.mark.parametrize("segment", [2, 5, 1024])
def test_segments_of_any_length(spark, segment):
    """Conversations over many segments and partitions equal the SQL fold; the turns make the digest."""
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    repair = c.Repair(c.damaged(df), segment)
    got = {r.conv_id: r for r in repair.summary().collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = [d[0] for d in con.execute(c.SQL).description]
    want = [dict(zip(names, r)) for r in con.fetchall()]
    for w in want:
        assert got[w["conv_id"]].asDict() == w
    assert set(got) == {r[0] for r in rows}
    by_conv = {}
    for r in sorted(repair.turns().collect(), key=lambda r: (r.at, r.part)):
        by_conv.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for k, r in got.items():
        assert hashlib.sha256("\n".join(by_conv.get(k, [])).encode()).hexdigest() == r.repaired_sha256
        assert len(re.sub("I", "", r.audit)) == sum((2 if h == 3 else h > 0) for a in rows if a[0] == k for h in [zlib.crc32(f"{' ' if a[0] is None else a[0]}:{' ' if a[1] is None else a[1]}".encode()) % 20])


def test_empty_and_gone(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.Repair(c.damaged(df)).summary().count() == 0
    rows = spark.createDataFrame([(1, 1, "user", "Hi.", True), (2, -(2**63), "user", "Hi.", False), (2, 2**63 - 1, "assistant", "Yes.", False)], "conv_id long, turn long, role string, text string, gone boolean")
    got = {r.conv_id: r for r in c.Repair(rows).summary().collect()}
    assert got[1][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[2].gaps, got[2].audit, got[2].cost) == (2**63 - 1, "KK", 0)
