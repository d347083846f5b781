"""Live jobs: event logs that always end in one terminal event, governors and callbacks that survive a restart.

State lives in Spark's state store, so a stopped stream goes on where its checkpoint is. Rows of one key in a
batch are put in their own order first; what comes in later batches for an earlier place is dealt with as each function says.
Streams need the RocksDB state store (``with_state``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexiloom.sources.scratch import new_path

# Events and states that end a job, and the event that a state without one stands for.
TERMINAL_EVENTS = ("complete", "error")
ENDED = {"complete": ("complete", None), "complete_degraded": ("complete", None), "failed": ("error", "analysis failed"), "cancelled": ("error", "cancelled")}

EVENT = "job_id string, seq long, event string, data string, synthetic boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def synthetic_data(status: str) -> str:
    event, message = ENDED[status]
    return json.dumps({"message": message} if message else {"status": status}, ensure_ascii=False)


def tail(rows: DataFrame) -> DataFrame:
    """Events of each job up to its first terminal one; a job that has ended without one gets the event its state stands for.

    ``rows``: job_id, seq (null for states), event, data, status (null for events), at. The last state counts.
    """
    events = rows.where("status IS NULL")
    before = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("event").isin(*TERMINAL_EVENTS).cast("int")).over(before), F.lit(0))
    told = events.withColumn("_ended", ended).where("_ended = 0").select("job_id", "seq", "event", "data", F.lit(False).alias("synthetic"))
    states = rows.where("status IS NOT NULL").groupBy("job_id").agg(F.max_by("status", "at").alias("status")).where(F.col("status").isin(*ENDED))
    last = events.groupBy("job_id").agg(F.max("seq").alias("last"), F.max(F.col("event").isin(*TERMINAL_EVENTS).cast("int")).alias("ended"))
    due = states.join(last, "job_id", "left").where("coalesce(ended, 0) = 0")
    pick = lambda k: F.create_map(*[F.lit(x) for s in ENDED for x in (s, ENDED[s][0] if k == 0 else synthetic_data(s))])[F.col("status")]
    return told.unionByName(due.select("job_id", (F.coalesce("last", F.lit(0)) + 1).alias("seq"), pick(0).alias("event"), pick(1).alias("data"), F.lit(True).alias("synthetic")))


class _Tail(StatefulProcessor):
    """Events leave in the order of their numbers, from 1; one that comes early waits for those before it.

    A job's ended state sets a timer: if no terminal event has left by then, what waits leaves, and the event
    that the state stands for. Nothing leaves after a terminal event.
    """

    def __init__(self, grace: int):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq long, ended boolean")
        self.early = handle.getMapState("early", "seq long", "event string, data string")
        self.status = handle.getValueState("status", "status string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """State is asked and told as little as may be, as every call is an exchange with the JVM: what can leave at once never enters it."""
        held = self.next.get()
        seq, ended = held or (1, False)
        come, status, before = {}, None, None
        for part in rows:
            if ended:
                continue
            columns = [part[c].tolist() for c in ("at", "seq", "event", "data", "status")]
            for at, n, event, data, said in sorted(zip(*columns), key=lambda r: (r[0] is pd.NaT, r[0] if r[0] is not pd.NaT else 0, r[1] is None or r[1] != r[1], r[1] or 0)):
                if said is None or said != said:
                    if int(n) >= seq:
                        come[int(n)] = event, data
                    continue
                at = int(pd.Timestamp(at).value // 1_000_000)
                if status is None:
                    before = status = self.status.get() or ()
                if not status or status[1] <= at:
                    status = (said, at)
        out, first = [], seq
        while not ended:
            early = held is not None and self.early.containsKey((seq,))
            if seq not in come and not early:
                break
            event, data = come.pop(seq) if seq in come else self.early.getValue((seq,))
            if early:
                self.early.removeKey((seq,))
            out.append((key[0], seq, event, data, False))
            ended, seq = event in TERMINAL_EVENTS, seq + 1
        if not ended:
            for n, told in come.items():
                self.early.updateValue((n,), told)
            if status != before:
                if before and before[0] in ENDED:
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer)
                self.status.update(status)
                if status[0] in ENDED:
                    self.handle.registerTimer(status[1] + self.grace)
        if held is None or seq > first:
            self.next.update((seq, ended))
        if out:
            yield _events(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, ended = self.next.get() or (1, False)
        if ended:
            return
        out = []
        for (n,), (event, data) in sorted(self.early.iterator()):
            if not ended:
                out.append((key[0], n, event, data, False))
                ended, seq = event in TERMINAL_EVENTS, n + 1
        if out:
            self.early.clear()
        if not ended:
            status = self.status.get()[0]
            out.append((key[0], seq, ENDED[status][0], synthetic_data(status), True))
            seq += 1
        self.next.update((seq, True))
        yield _events(out)

    def close(self) -> None:
        pass


def _events(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["job_id", "seq", "event", "data", "synthetic"]).astype({"seq": "int64", "synthetic": "bool"})


def into_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there into a table of the shared folder."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def live_tail(rows: DataFrame, late: str = "10 seconds", grace_ms: int = 500) -> DataFrame:
    """The same of a stream: once the watermark has passed a job's end by the grace, its terminal event is there."""
    return rows.withWatermark("at", late).groupBy("job_id").transformWithStateInPandas(_Tail(grace_ms), EVENT, "append", "eventTime")


class _Event(NamedTuple):
    at: float
    id: int
    kind: str
    job: str


class _Governor(StatefulProcessor):
    """A governor's runs, queue and admissions between batches, as one value: every call of a state is an exchange with the JVM."""

    def __init__(self, running: int, queued: int, limit: int, seconds: float):
        self.running, self.queued, self.limit, self.seconds = running, queued, limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        runs, waits, admitted = json.loads(held[0]) if held else ([], [], [])
        runs, out = dict(map(tuple, runs)), []
        events = [_Event(*r) for part in rows for r in zip(*(part[c].tolist() for c in _Event._fields))]
        for r in sorted(events, key=lambda r: (r.at != r.at, r.at, r.id)):
            outcome, promoted = self._step(r, runs, waits, admitted)
            out.append((key[0], r.id, outcome, promoted))
        self.held.update((json.dumps([list(runs.items()), waits, admitted]),))
        yield pd.DataFrame(out, columns=["governor", "id", "outcome", "promoted"])

    def _step(self, r, runs: dict, waits: list, admitted: list) -> tuple[str, str | None]:
        if r.kind == "complete":
            runs.pop(r.job, None)
            if not waits:
                return "complete", None
            runs[waits[0]] = r.at
            return "complete", waits.pop(0)
        while admitted and admitted[0] <= r.at - self.seconds:
            admitted.pop(0)
        if len(admitted) >= self.limit:
            return "rate_limited", None
        if r.job in runs or r.job in waits:
            return ("running" if r.job in runs else "queued"), None
        if len(runs) < self.running:
            runs[r.job] = r.at
        elif len(waits) < self.queued:
            waits.append(r.job)
        else:
            return "queue_full", None
        admitted.append(r.at)
        return ("running" if r.job in runs else "queued"), None

    def close(self) -> None:
        pass


def live_governed(events: DataFrame, running: int, queued: int, limit: int, seconds: float) -> DataFrame:
    """``governor``, ``id``, ``outcome``, ``promoted`` for a stream of governor, id, at (seconds), kind, job; batches come in the order of time."""
    return events.groupBy("governor").transformWithStateInPandas(_Governor(running, queued, limit, seconds), "governor string, id long, outcome string, promoted string", "append", "none")


class Ledger:
    """Batches that have been dealt with: each writes into a folder of its own, then its number is entered. A batch that comes again is skipped, one that was cut off is written again over its own folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entered(self) -> DataFrame:
        return self.spark.read.schema("batch long").parquet(f"{self.path}/ledger") if self._begun() else self.spark.createDataFrame([], "batch long")

    def _begun(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def results(self, schema: str) -> DataFrame:
        """Rows of entered batches alone."""
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/rows").join(F.broadcast(self.entered()), "batch", "left_semi")

    def callback(self, make: Callable[[DataFrame], DataFrame], started: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: ``started`` is told of each new batch (again if it was cut off), ``make`` gives the rows to write."""

        def once(rows: DataFrame, batch: int) -> None:
            if not self.entered().where(F.col("batch") == batch).isEmpty():
                return
            if started:
                started(rows, batch)
            make(rows).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
            self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

        return once
