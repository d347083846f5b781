"""Streams with state and timers: any cut into batches, and a restart in the middle, give what the batch forms give."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from lexiloom.operators import state as S
from lexiloom.streaming import jobs as J

START = datetime(2024, 1, 1)
ROWS = "job_id string, seq long, event string, data string, status string, at timestamp"


def log():
    """Logs that end by themselves, by a state alone, by both, twice, or not at all; states that were taken back."""
    at = lambda s: START + timedelta(seconds=s)
    rows = []
    for j, (events, states) in enumerate([
        (["a", "b", "complete", "late"], ["running", "complete"]), (["a", "b"], ["complete_degraded"]), ([], ["failed"]), (["a"], ["running"]), (["error"], ["failed"]),
        (["a", "b", "c"], ["failed", "running", "cancelled"]), (["a"], ["cancelled", "running"]), (["complete", "error", "x"], []),
    ]):
        rows += [(f"j{j}", k + 1, e, f'{{"n": {k}}}', None, at(10 * k)) for k, e in enumerate(events)]
        rows += [(f"j{j}", None, None, None, s, at(100 + 30 * k)) for k, s in enumerate(states)]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_tail(spark, tmp_path, seed):
    J.with_state(spark)
    rows = log()
    want = {tuple(r) for r in J.tail(spark.createDataFrame(rows, ROWS)).collect()}
    assert {(r[0], r[2]) for r in want if r[4]} == {("j1", "complete"), ("j2", "error"), ("j5", "error")}
    assert ("j0", 3, "complete", '{"n": 2}', False) in want and not any(r[2] in ("late", "x") for r in want)
    # Events of the first 100 seconds in any order over files, then states; a clock goes on at the end.
    events, states = [r for r in rows if r[4] is None], sorted((r for r in rows if r[4]), key=lambda r: r[5])
    random.Random(seed).shuffle(events)
    files = [events[k::3] for k in range(3)] + [states[:5], states[5:]]
    files += [[("clock", 1, "tick", "{}", None, START + timedelta(seconds=1000))], [("clock", 2, "tick", "{}", None, START + timedelta(seconds=2000))]]
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    got = []

    def run():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
        q = J.live_tail(stream, "200 seconds").writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()

    for k, f in enumerate(files):
        spark.createDataFrame(f, ROWS).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3, len(files) - 1):
            run()  # each run is a restart
    told = [r for r in got if r[0] != "clock"]
    assert len(told) == len(set(told)) and set(told) == want
    for j in {r[0] for r in told}:
        assert [r[1] for r in told if r[0] == j] == sorted(r[1] for r in told if r[0] == j)


def test_governor(spark, tmp_path):
    J.with_state(spark)
    rng = random.Random(4)
    rows = [(g, i, float(i * 10 + rng.randint(0, 9)), rng.choice(["admit", "admit", "complete"]), f"job{rng.randint(0, 6)}") for g in ("x", "y") for i in range(60)]
    schema = "governor string, id long, at double, kind string, job string"
    want = {(r.governor, r.id, r.outcome, r.promoted) for r in S.governed(spark.createDataFrame(rows, schema), "governor", 2, 2, 4, 120.0).collect()}
    assert len({w[2] for w in want}) == 5
    source, check, got = str(tmp_path / "in"), str(tmp_path / "check"), []
    for k in range(0, 60, 20):
        part = [r for r in rows if k <= r[1] < k + 20]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = J.live_governed(stream, 2, 2, 4, 120.0).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
    assert len(got) == 120 and set(got) == want


def test_ledger(spark, tmp_path):
    ledger = J.Ledger(spark, str(tmp_path / "out"))
    told, fail = [], [True]

    def make(df):
        if fail[0]:
            raise RuntimeError("cut off")
        return df.selectExpr("id", "id * 2 AS twice")

    once = ledger.callback(make, lambda df, b: told.append(b))
    a, b = spark.range(5), spark.range(5, 9)
    with pytest.raises(RuntimeError):
        once(a, 0)
    fail[0] = False
    once(a, 0)
    once(a, 0)  # comes again
    once(b, 1)
    b.selectExpr("id", "id AS twice").write.parquet(str(tmp_path / "out" / "rows" / "batch=2"))  # written, never entered
    assert sorted((r.id, r.twice) for r in ledger.results("id long, twice long").collect()) == [(i, 2 * i) for i in range(9)]
    assert told == [0, 0, 1]
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    a.coalesce(1).write.parquet(source)
    live = J.Ledger(spark, str(tmp_path / "live"))
    for _ in range(2):
        q = spark.readStream.schema("id long").parquet(source).writeStream.foreachBatch(live.callback(make)).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        b.coalesce(1).write.mode("append").parquet(source)
    assert sorted(r.id for r in live.results("id long, twice long").collect()) == list(range(9)) and live.entered().count() == 2


class Told:
    """A state that counts its calls."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            if name == "update":
                self.value = given[0]
            return {"get": self.value, "exists": self.value is not None, "containsKey": False, "keys": [], "iterator": [], "listTimers": []}.get(name)

        return call


class Handle:
    def __init__(self):
        self.calls = []

    def state(self, *given):
        return Told(self.calls)

    getValueState = getMapState = getListState = state

    def __getattr__(self, name):
        return getattr(Told(self.calls), name)


def test_events_that_leave_at_once_never_enter_the_state():
    rows = [("j", k + 1, "e", "{}", None, START + timedelta(seconds=k)) for k in range(500)] + [("j", None, None, None, "failed", START + timedelta(seconds=900))]
    one, handle = J._Tail(500), Handle()
    one.init(handle)
    out = pd.concat(list(one.handleInputRows(("j",), iter([pd.DataFrame(rows, columns=["job_id", "seq", "event", "data", "status", "at"])]), None)))
    assert out.seq.tolist() == list(range(1, 501)) and len(handle.calls) <= 6


def test_a_governor_asks_and_tells_its_state_once_a_batch():
    rows = pd.DataFrame([(float(k), k, "complete" if k % 3 == 2 else "admit", f"job{k % 5}") for k in range(300)], columns=["at", "id", "kind", "job"])
    one, handle = J._Governor(2, 2, 4, 20.0), Handle()
    one.init(handle)
    whole = pd.concat(list(one.handleInputRows(("x",), iter([rows]), None)))
    assert len(handle.calls) <= 2
    again, handle = J._Governor(2, 2, 4, 20.0), Handle()
    again.init(handle)
    parts = pd.concat([x for k in range(0, 300, 50) for x in again.handleInputRows(("x",), iter([rows[k : k + 50]]), None)])
    assert parts.values.tolist() == whole.values.tolist() and len(handle.calls) <= 12
