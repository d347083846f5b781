"""Jobs, events, versions and conversations as tables: replays, retries, idempotency, visibility, paging."""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.sources.scratch import written

RETRIES = 2
TERMINAL = ("complete", "error")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    return df.orderBy(*order).offset(max(number - 1, 0) * size).limit(size)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """Adds each row's number within its key, from 1, for keys of any size: ranges are numbered on their own and start where the ones before end."""
    placed = written(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))  # a row for each key and range
    offsets = held.select(*keys, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return placed.join(offsets, [*keys, "_part"]).withColumn(name, F.col("_offset") + inside).drop("_part", "_offset")


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key in the given order."""
    descending = [F.desc(c) if isinstance(c, str) else c for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*descending))).where("_n = 1").drop("_n")


def until_terminal(events: DataFrame, job: str, order: list[str], terminal: Column) -> DataFrame:
    """Each job's events up to and including its first terminal one."""
    before = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_t", F.coalesce(F.max(terminal.cast("int")).over(before), F.lit(0))).where("_t = 0").drop("_t")


def retries(attempts: DataFrame, keys: list[str], order: list[str], failed: Column, permanent: Column, limit: int = RETRIES, base: float = 1.0) -> DataFrame:
    """Outcome of each key: done, dead (permanent at once, others after ``limit`` retries) or waiting, with the next delay."""
    rows = attempts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    first = lambda c: F.min(F.when(c, F.col("_n")))
    sums = rows.groupBy(*keys).agg(F.max("_n").alias("seen"), first(~failed).alias("ok"), first(permanent).alias("stop"))
    end = F.least(F.coalesce("ok", F.lit(1 << 30)), F.coalesce("stop", F.lit(1 << 30)), F.lit(limit + 1))
    used = F.least("seen", end)
    state = F.when(F.col("ok") == used, "done").when((F.col("stop") == used) | (used == limit + 1), "dead").otherwise("waiting")
    return sums.select(*keys, used.cast("long").alias("attempts"), state.alias("state"), F.when(state == "waiting", F.lit(base) * F.pow(F.lit(2.0), used - 1)).alias("delay"))


def idempotent(requests: DataFrame, key: str, order: list[str], fingerprint: Column) -> DataFrame:
    """accepted for a key's first request, replay for equal later ones, conflict for others."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.first(fingerprint).over(w)
    return requests.withColumn("verdict", F.when(F.row_number().over(w) == 1, "accepted").when(fingerprint.eqNullSafe(first), "replay").otherwise("conflict"))


def sequence_gaps(events: DataFrame, job: str, order: list[str], sequence: str) -> DataFrame:
    """late if not beyond all before, gap if beyond the next, else ok."""
    before = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max(sequence).over(before), F.lit(0))
    return events.withColumn("verdict", F.when(F.col(sequence) <= top, "late").when(F.col(sequence) > top + 1, "gap").otherwise("ok"))


def carried(rows: DataFrame, key: str, order: list[str], start, step, added: str) -> DataFrame:
    """Each key's rows in order, past a state that goes from row to row: ``step(state, row)`` gives the added columns.

    Rows stream through in batches, so a key of any length takes the memory of its state alone.
    """
    names = [*rows.columns, *[x.split()[0] for x in added.split(", ")]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                own = getattr(r, key)
                if state is None or (own != last and not (own != own and last != last)):
                    last, state = own, start()
                out.append((*r, *step(state, r)))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{_ddl(rows)}, {added}")


def streamed_hash(rows: DataFrame, order: list[str], text: str, begin: str, between: str, end: str) -> DataFrame:
    """One SHA-256 over all rows' texts in order. The hash goes from row to row, so one task makes it; the rows are sorted on disk and stream past it, none is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, any_ = hashlib.sha256(begin.encode()), False
        for b in batches:
            for t in b.column("t").to_pylist():
                sha.update(((between if any_ else "") + (t or "")).encode())
                any_ = True
        sha.update(end.encode())
        yield pa.RecordBatch.from_arrays([pa.array([sha.hexdigest()])], names=["sha256"])

    return rows.select(*order, F.col(text).alias("t")).repartition(1).sortWithinPartitions(*order).select("t").mapInArrow(run, "sha256 string")


def audit_chain(rows: DataFrame, scope: str) -> DataFrame:
    """Adds previous_hash and hash: each row's hash covers the one before."""

    def link(state: dict, r) -> tuple:
        before = state.get("hash", "")
        state["hash"] = hashlib.sha256(json.dumps({"action": r.action, "previous_hash": before, "seq": r.seq}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        return before, state["hash"]

    return carried(rows.select(scope, "seq", "action"), scope, ["seq"], dict, link, "previous_hash string, hash string")


def broken_links(chain: DataFrame, scope: str) -> DataFrame:
    """Rows whose number, link or hash does not follow; in SQL functions, so a long chain is checked in parallel."""
    w = Window.partitionBy(scope).orderBy("seq")
    said = F.sha2(F.to_json(F.struct("action", "previous_hash", "seq")), 256)
    bad = (F.col("seq") != F.coalesce(F.lag("seq").over(w) + 1, F.lit(1))) | (F.col("previous_hash") != F.coalesce(F.lag("hash").over(w), F.lit(""))) | (F.col("hash") != said)
    return chain.withColumn("_bad", bad).where("_bad").drop("_bad")


def admissions(requests: DataFrame, governor: str, time: str, limit: int, seconds: float) -> DataFrame:
    """Adds ``admitted``: at most ``limit`` admitted requests in a window, expired ones not counted; refused ones never count."""

    def admit(held: deque, r) -> tuple:
        now = getattr(r, time)
        while held and held[0] <= now - seconds:
            held.popleft()
        if len(held) < limit:
            held.append(now)
            return (True,)
        return (False,)

    return carried(requests.select(governor, "id", time), governor, [time, "id"], deque, admit, "admitted boolean")


def governed(events: DataFrame, governor: str, running: int, queued: int, limit: int, seconds: float) -> DataFrame:
    """Jobs past a governor with bounded concurrency, queue and rate; ``events`` has id, at, kind (admit or complete) and job.

    Adds ``outcome``: running, queued, rate_limited or queue_full for an admission, the promoted job (or
    null) in ``promoted`` for a completion. A job that runs or waits is told so and counts no second time.
    """

    def step(state: dict, r) -> tuple:
        runs, waits, admitted = state.setdefault("runs", set()), state.setdefault("waits", deque()), state.setdefault("admitted", deque())
        if r.kind == "complete":
            runs.discard(r.job)
            if waits:
                runs.add(waits[0])
                return "complete", waits.popleft()
            return "complete", None
        while admitted and admitted[0] <= r.at - seconds:
            admitted.popleft()
        if len(admitted) >= limit:
            return "rate_limited", None
        if r.job in runs:
            return "running", None
        if r.job in waits:
            return "queued", None
        if len(runs) < running:
            runs.add(r.job)
        elif len(waits) < queued:
            waits.append(r.job)
        else:
            return "queue_full", None
        admitted.append(r.at)
        return "running" if r.job in runs else "queued", None

    return carried(events.select(governor, "id", "at", "kind", "job"), governor, ["at", "id"], dict, step, "outcome string, promoted string")


def upserted(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` win over ``base`` by key."""
    return base.join(rows.select(key), key, "left_anti").select(base.columns).unionByName(rows.select(base.columns))


def inserted_if_absent(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return upserted(rows, base, key)


def merged_maps(base, over) -> Column:
    """Two maps as one; the right one wins."""
    return F.map_zip_with(base, over, lambda _, a, b: F.coalesce(b, a))


def decoded_events(streams: DataFrame, key: str, text_col: str) -> DataFrame:
    """Events of a server-sent text: blocks between blank lines, the incomplete last one left out, nothing after a terminal event.

    ``data`` is JSON: a block's data lines, joined by line feeds, where they parse, else ``{"message": ...}`` of them. Blocks without data tell nothing.
    """
    blocks = F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n\n", -1)
    rows = streams.select(key, F.posexplode(F.slice(blocks, 1, F.size(blocks) - 1)).alias("n", "block"))
    lines = F.split("block", "\n", -1)
    field = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.trim(F.substring(x, len(name) + 2, F.length(x))))
    event = F.coalesce(F.nullif(F.try_element_at(field("event"), F.lit(-1)), F.lit("")), F.lit("message"))
    said = F.array_join(field("data"), "\n")
    parsed = F.try_parse_json(said).isNotNull() & (F.trim(said) != "")
    rows = rows.where(F.size(field("data")) > 0).select(key, "n", event.alias("event"), F.when(parsed, said).otherwise(F.to_json(F.struct(said.alias("message")))).alias("data"))
    return until_terminal(rows, key, ["n"], F.col("event").isin("done", "error"))


def visible(chunks: DataFrame, active: DataFrame, legacy: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Chunks of an active (doc, version), or without version of a legacy document; never of a tombstoned one."""
    alive = chunks.join(tombstones.select("doc_id").distinct(), "doc_id", "left_anti")
    keyed = alive.where("version IS NOT NULL").join(active.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_semi")
    old = alive.where("version IS NULL").join(legacy.select("doc_id").distinct(), "doc_id", "left_semi")
    return keyed.unionByName(old.select(keyed.columns))


def merged_journal(index: DataFrame, journal: DataFrame, key: str, generation: str) -> DataFrame:
    """An index with a write-ahead journal applied: the highest generation of each key wins."""
    return latest(index.unionByName(journal), [key], generation)


def sliding_count(events: DataFrame, key: str, seconds: Column, width: int) -> DataFrame:
    """Adds ``recent``: how many of the key's events lie in the ``width`` seconds up to each."""
    return events.withColumn("recent", F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(seconds).rangeBetween(-width, 0)))


# A document's states with their labels and default progress.
STATUS = {
    "uploaded": ("已上传", 65),
    "queued": ("排队中", 65),
    "parsing": ("解析版面", 70),
    "normalizing": ("整理结构", 74),
    "chunking": ("语义分块", 80),
    "indexing": ("写入检索", 90),
    "ready": ("已入库", 100),
    "failed": ("失败", 0),
    "needs_ocr": ("需 OCR", 70),
}
OTHER_PROGRESS = 65


def with_status(rows: DataFrame, status: str, progress: str, error: str, old_error: str) -> DataFrame:
    """Adds stage_label, progress (given or the state's) and the error that stays: a new one, else the old one of failed documents alone."""
    known = lambda k: F.create_map(*[F.lit(x) for s, v in STATUS.items() for x in (s, v[k])])[F.col(status)]
    label, least = F.coalesce(known(0), F.col(status)), F.coalesce(known(1), F.lit(OTHER_PROGRESS))
    kept = F.coalesce(F.col(error), F.when(F.col(status) == "failed", F.col(old_error)))
    return rows.withColumns({"stage_label": label, "shown_progress": F.coalesce(F.col(progress), least), "shown_error": kept})


def migrated_visibility(index: DataFrame, meta: DataFrame, tombstones: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows not migrated yet take the version ids of their document's record where it has them; deleted documents' rows stay; a missing record is an error."""
    gone = tombstones.select(key).distinct().withColumn("_gone", F.lit(True))
    own = meta.select(F.col(key), F.nullif("current_version_id", F.lit("")).alias("_current"), F.nullif("indexed_version_id", F.lit("")).alias("_indexed"), F.lit(True).alias("_there"))
    both = index.join(gone, key, "left").join(own, key, "left")
    due = F.col("_gone").isNull() & ~F.coalesce("visibility_migrated", F.lit(False))
    there = F.when(due & F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no visibility record for document "), F.col(key).cast("string")))).otherwise(due)
    out = both.withColumn("_due", there)
    moved = {c: F.when(F.col("_due"), F.coalesce(f"_{c.split('_')[0]}", c)).otherwise(F.col(c)) for c in ("current_version_id", "indexed_version_id")}
    return out.withColumns(moved | {"visibility_migrated": F.col("_due") | F.coalesce("visibility_migrated", F.lit(False))}).select(index.columns)


# A job's progress by its state; documents go from 40 to 95.
JOB_PROGRESS = {"queued": 5, "parsing": 10, "running": 40, "complete": 100, "complete_degraded": 100}
FIRST_DOCUMENT, DOCUMENTS = 40, 55


def progress_of(kind: Column, index: Column, total: Column) -> Column:
    """A job's progress after an event: its state's, or for the document that begins its share, halves to even; null for other events."""
    out = F.when(kind == "document", FIRST_DOCUMENT + F.bround(DOCUMENTS * index / F.greatest(total, F.lit(1)), 0))
    for state, percent in JOB_PROGRESS.items():
        out = out.when(kind == state, percent)
    return out.cast("int")


def reconciled(meta: DataFrame, index: DataFrame, journal: DataFrame, tombstones: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records and index rows after publications that were interrupted, and each journal entry's verdict.

    A journal entry (key, generation, ``meta`` and ``row`` as structs with key and generation) was written
    before either: whatever of the two is missing or old becomes what it says (applied). Entries whose
    parts disagree are invalid and change nothing; those of deleted documents are refused.
    """
    agrees = lambda part: F.coalesce((F.col(f"{part}.{key}") == F.col(key)) & (F.col(f"{part}.generation") == F.col("generation")), F.lit(False))
    valid = F.col(key).isNotNull() & (F.coalesce(F.col("generation"), F.lit("")) != "") & agrees("meta") & agrees("row")
    gone = tombstones.select(key).distinct().withColumn("_gone", F.lit(True))
    judged = journal.join(gone, key, "left").withColumn("verdict", F.when(~valid, "invalid").when(F.col("_gone"), "refused").otherwise("applied")).drop("_gone")
    applied = judged.where("verdict = 'applied'")
    return upserted(meta, applied.select("meta.*"), key), upserted(index, applied.select("row.*"), key), judged.select(key, "generation", "verdict")
