"""Lives of decisions, deletions, answers and records, as tables of what was asked for and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import carried

# The steps of a deletion with the phase that each leads to, states that a restart puts back, and its error.
DELETION = {"requested": "pending_filesystem", "directory_removed": "pending_index", "row_removed": "pending_es", "index_removed": "complete"}
DRIFTED = ("parsing", "running")
RECOVERED = {"code": "startup_recovered", "message": "running job recovered to queued", "retryable": True}
FIRST_TICK, LAST_TICK, TICK_SECONDS = 70, 79, 10


def decisions(actions: DataFrame, job: str, order: list[str], action: Column) -> tuple[DataFrame, DataFrame]:
    """States and audit rows of decisions that people are asked for.

    ``start`` opens the job's next decision, which waits; any other action resumes the latest one: ``confirm``
    completes it, everything else cancels it, and a later one wins. Resuming where nothing was started is an
    error that changes nothing. Null actions are none. States: job, decision (from 1), status. Audit: one row an action.
    """
    before = Window.partitionBy(job).orderBy(*order)
    rows = actions.withColumn("_a", action).where("_a IS NOT NULL").withColumn("decision", F.sum((F.col("_a") == "start").cast("long")).over(before))
    status = F.when(F.col("_a") == "start", "waiting_confirmation").when(F.col("decision") == 0, "unknown").when(F.col("_a") == "confirm", "completed").otherwise("cancelled")
    told = F.when(F.col("_a") == "start", "decision.started").when(F.col("decision") == 0, "error").otherwise("decision.resumed")
    audit = rows.select(job, *order, "decision", told.alias("audit"), status.alias("status"))
    states = audit.where("decision > 0").groupBy(job, "decision").agg(F.max_by("status", F.struct(*order)).alias("status"))
    return states, audit


def deletions(steps: DataFrame, key: str, order: str, step: str) -> DataFrame:
    """Each step of a deletion with its verdict and the phase after it.

    A step counts in its place alone: ``moved`` leads on, one already made is ``again``, one whose turn has not come is ``refused`` and
    before a request everything is ``missing``. After a restart the same steps may come again.
    """
    places = {name: k for k, name in enumerate(DELETION)}
    phases = list(DELETION.values())

    def go(state: dict, r) -> tuple:
        at, place = state.get("at", -1), places.get(r.step)
        if place is None:
            verdict = "unknown"
        elif at < 0 < place:
            verdict = "missing"
        elif place <= at:
            verdict = "again"
        elif place > at + 1:
            verdict = "refused"
        else:
            verdict, state["at"] = "moved", place
        at = state.get("at", -1)
        return verdict, phases[at] if at >= 0 else None

    rows = steps.select(key, F.col(order).alias("seq"), F.col(step).alias("step"))
    return carried(rows, key, ["seq"], dict, go, "verdict string, phase string")


def recovered(jobs: DataFrame, status: str, errors: str) -> DataFrame:
    """Jobs after a restart: those that ran are queued again and say so in an entry (JSON) behind their errors."""
    drifted = F.coalesce(F.col(status).isin(*DRIFTED), F.lit(False))
    entry = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in RECOVERED.items()]))
    kept = F.coalesce(errors, F.array().cast("array<string>"))
    return jobs.withColumns({status: F.when(drifted, "queued").otherwise(F.col(status)), errors: F.when(drifted, F.concat(kept, F.array(entry))).otherwise(F.col(errors)), "requeued": drifted})


def answer_events(requests: DataFrame, conversation: str, request: str, order: list[str]) -> DataFrame:
    """Events of every request for an answer, in order (``part`` from 0).

    Rows have ``tokens`` (array), ``answer`` and ``outcome`` (done, error, or null if it was cut off). A request
    whose id has ended before gets the stored end alone, whatever it would have brought; others get meta, states, tokens (the
    whole answer where nothing was streamed) and their end. So an id has one end, told as often as it is asked.
    """
    before = Window.partitionBy(conversation, request).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.first(F.when(F.col("outcome").isNotNull(), F.struct("outcome", "answer")), ignorenulls=True).over(before)
    rows = requests.withColumn("_ended", ended)
    event = lambda e, data: F.struct(F.lit(e).alias("event") if isinstance(e, str) else e.alias("event"), data.cast("string").alias("data"))
    none = F.lit(None)
    said = F.filter("tokens", lambda t: t != "")
    spoken = F.coalesce(F.size(said) > 0, F.lit(False))
    done = F.coalesce(F.col("outcome") == "done", F.lit(False))
    streamed = F.when(spoken, F.transform(said, lambda t: event("token", t))).when(done & (F.coalesce("answer", F.lit("")) != ""), F.array(event("token", F.col("answer")))).otherwise(F.array().cast("array<struct<event: string, data: string>>"))
    end = F.when(F.col("outcome").isNotNull(), F.array(event(F.col("outcome"), F.when(done, F.col("answer"))))).otherwise(F.array().cast("array<struct<event: string, data: string>>"))
    generating = F.when(spoken | done, F.array(event("status", F.lit("generating")))).otherwise(F.array().cast("array<struct<event: string, data: string>>"))
    fresh = F.concat(F.array(event("meta", none), event("status", F.lit("retrieving"))), generating, streamed, end)
    replay = F.array(event("meta", none), event(F.col("_ended.outcome"), F.when(F.col("_ended.outcome") == "done", F.col("_ended.answer"))))
    told = rows.withColumn("_e", F.when(F.col("_ended").isNotNull(), replay).otherwise(fresh))
    return told.select(conversation, request, *order, F.col("_ended").isNotNull().alias("replayed"), F.posexplode("_e").alias("part", "_x")).select(conversation, request, *order, "replayed", "part", "_x.event", "_x.data")


def inserted_once(messages: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """Messages with the id that an insert answers (``stored_id``) and whether it wrote (``inserted``): a request known by all its keys answers the first one's. Without a request id each is new."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = ~F.col(keys[-1]).isNull()
    return messages.withColumns({"stored_id": F.when(known, F.first(id_col).over(w)).otherwise(F.col(id_col)), "inserted": ~known | (F.row_number().over(w) == 1)})


def superseded(lists: DataFrame, key: str, generation: str) -> DataFrame:
    """All rows with ``status``: active in a key's last generation, superseded before."""
    last = F.max(generation).over(Window.partitionBy(key))
    return lists.withColumn("status", F.when(F.col(generation) == last, "active").otherwise("superseded"))


def cascaded(gone: DataFrame, tables: dict[str, tuple[DataFrame, str, str | None]]) -> dict[str, DataFrame]:
    """What stays of tables after parents have been deleted. ``tables``: name, in the order of parents first, to (rows, the key that names the parent, the column that children name it by, if any)."""
    out: dict[str, DataFrame] = {}
    dead = gone.select(F.col(gone.columns[0]).alias("_dead")).distinct()
    for name, (rows, parent, own) in tables.items():
        out[name] = rows.join(dead, F.col(parent) == F.col("_dead"), "left_anti")
        if own:
            dead = rows.join(dead, F.col(parent) == F.col("_dead"), "left_semi").select(F.col(own).alias("_dead")).distinct()
    return out


def ticks(spans: DataFrame, start: Column, end: Column) -> DataFrame:
    """Progress while something runs: from ``FIRST_TICK`` one more every ten seconds until it ends, ``LAST_TICK`` at most. ``tick`` (from 1) and ``progress``; times in seconds, without either there is none."""
    n = F.when((end - start).isNotNull(), F.least(F.lit(LAST_TICK - FIRST_TICK), F.floor((end - start) / TICK_SECONDS))).cast("int")
    rows = spans.withColumn("_n", F.coalesce(n, F.lit(0))).where("_n > 0").withColumn("tick", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    return rows.withColumn("progress", F.lit(FIRST_TICK) + F.col("tick"))
