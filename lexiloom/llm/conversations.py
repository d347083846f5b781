"""Conversation structure repair: A* over the edit lattice of every conversation.

A conversation's turns, in order, are edited into ``(s?(ua)+)?`` (initials of the roles) at the least cost:
keep 0, give the role user or assistant 2, delete 3 (required where the text is blank or role and text were
seen earlier), insert an empty turn of user or assistant 2; a truncated turn that is not deleted adds 1.
Among the cheapest edits the one whose initials (D, I, K, R) are ASCII-least holds.

A node of the lattice is a turn and what stands before it: nothing, a system turn, a user, an assistant. The
queue is keyed (cost plus heuristic, edits so far). The heuristic is the suffix sum of what no path avoids, 3
for a turn that must go and 1 for a truncated one; it is consistent, so the first visit of a node is the best.

A conversation may be of any size, so turns are sorted globally and cut into segments of bounded length, in
which A* answers for every entry and exit. Inserts belong to the turn they precede, hence no edit string of a
segment is the beginning of another and the ASCII-least of a chain is the chain of ASCII-least choices: one
pass over segments from the end finds the exit for each entry, one from the start takes the path. Both passes
stream light rows. Only the digest of a whole repaired text is one task's stream by its nature (SHA-256).

Nulls in role and text are one space each; a role that begins with none of s, u, a cannot be kept; an empty
role has no initial and cannot be kept either. Rows of equal turn come by role and text; repeated rows are
duplicates. Null turns come first, null conv_ids are one conversation. Other columns are not carried. An empty table
gives an empty one. Turn differences are whole numbers of any size; gaps beyond 64 bits end at the type's edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, sized

#: Turns of a segment at most.
SEGMENT = 1024

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What a turn of this initial makes of each state, if it may stand there.
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that an inserted or changed turn takes after each state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What ends a conversation in each state.
TAIL = ("", "II", "I", "")
#: Pairs of initials that may follow each other.
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
INT64 = 2**63 - 1

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


def best_edits(initials: str | list[str], faults: list[int], entry: int) -> dict[int, tuple[int, str]]:
    """For each state in which the turns can end: the least cost and the edits, from ``entry``."""
    n = len(faults)
    certain = [3 if f in (BLANK, DUPLICATE) else 1 if f == TRUNCATED else 0 for f in faults]
    ahead = [*accumulate(reversed(certain), initial=0)][::-1]
    found: dict[int, tuple[int, str]] = {}
    closed = set()
    queue = [(ahead[0], "", 0, entry)]
    while queue:
        f, audit, i, state = heappop(queue)
        node = 4 * i + state
        if node in closed:
            continue
        closed.add(node)
        if i == n:
            found[state] = (f, audit)
            continue
        cost, then = f - ahead[i], ahead[i + 1]
        heappush(queue, (cost + 3 + then, audit + "D", i + 1, state))
        if faults[i] not in (BLANK, DUPLICATE):
            charge = cost + then + (faults[i] == TRUNCATED)
            heappush(queue, (charge + 2, audit + "R", i + 1, NEXT[state]))
            kept = KEPT.get(initials[i], {}).get(state)
            if kept is not None:
                heappush(queue, (charge, audit + "K", i + 1, kept))
        heappush(queue, (f + 2, audit + "I", i, NEXT[state]))
    return found


def in_order(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with ``gone`` (no turn any more, the conversation stays) in global order: ``at`` grows with conversation, turn, role and text.

    Rows are spread by a running number too, so many equal rows, or rows of one turn, are many tasks'.
    """
    rows = turns.select("conv_id", "turn", F.when(~F.col("gone"), F.coalesce("role", F.lit(" "))).alias("role"), F.when(~F.col("gone"), F.coalesce("text", F.lit(" "))).alias("text"), "gone", F.monotonically_increasing_id().alias("_row"))
    first = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role")]
    # The driver's sample of range bounds holds the beginning of a text only.
    spread = rows.repartitionByRange(*first, F.asc_nulls_first(F.substring("text", 1, 64)), "_row")
    return spread.sortWithinPartitions(*first, F.asc_nulls_first("text"), "_row").withColumn("at", F.monotonically_increasing_id()).drop("_row")


def faults_of(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """``at``, ``conv_id``, ``turn``, ``initial`` and ``fault`` (0 none, 1 blank, 2 duplicate, 3 truncated) of the turns that are there."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    light = scratch.written(
        lines.where("NOT gone").select(
            "at", "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "role", F.sha2("text", 256).alias("said"),
            F.when(end == "", BLANK).when(end.isin(".", "!", "?"), FINE).otherwise(TRUNCATED).alias("fault"),
        )
    )
    # Occurrences are counted where they are, before the exchange.
    again = light.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "said").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = sized(scratch.written(again.select(*[F.col(c).alias(f"_{c}") for c in again.columns])))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("said") == F.col("_said"))
    joined = light.join(again, same, "left")
    return joined.select("at", "conv_id", "turn", "initial", F.when((F.col("fault") != BLANK) & (F.col("at") > F.col("_first")), DUPLICATE).otherwise(F.col("fault")).alias("fault"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 1 + sum(len(x) for x in row if isinstance(x, str)) // 2000
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def segments(faults: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation's turns in a block of ``segment`` places: costs and edits of all entries and exits, counts, first and last turn and initial."""
    kind = faults.schema["conv_id"].dataType.simpleString()

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def all_rows() -> Iterator[tuple]:
            nonlocal schema
            for b in batches:
                schema = schema or pa.schema([("conv_id", b.schema.field("conv_id").type), ("at", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64())), ("initials", pa.list_(pa.string()))])
                yield from _rows([b])

        def pieces() -> Iterator[tuple]:
            held: list[tuple] = []
            block = None
            for row in all_rows():
                if held and (row[0] // segment != held[0][0] // segment or row[1] != held[0][1]):
                    yield piece(held, block)
                    block, held = held[0][0] // segment, []
                held.append(row)
            if held:
                yield piece(held, block)

        def piece(held: list[tuple], before: int | None) -> tuple:
            """A conversation that follows another in its block begins there, with nothing before it."""
            at, conv, initials, faults = held[0][0], held[0][1], [r[3] for r in held], [r[4] for r in held]
            costs: list[int | None] = [None] * 16
            audits: list[str | None] = [None] * 16
            for entry in [NOTHING] if before == at // segment else range(4):
                for end, (cost, audit) in best_edits(initials, faults, entry).items():
                    costs[4 * entry + end], audits[4 * entry + end] = cost, audit
            turns = [r[2] for r in held if r[2] is not None]
            changed = sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns)
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            return conv, at, costs, audits, [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)] + [illegal, changed], [turns[0], turns[-1]] if turns else None, [initials[0], initials[-1]]

        yield from _typed(pieces(), lambda: schema)

    schema = f"conv_id {kind}, at bigint, costs array<bigint>, audits array<string>, counts array<bigint>, turns array<bigint>, initials array<string>"
    rows = faults.select("at", "conv_id", F.col("turn").cast("bigint"), "initial", "fault")
    return rows.repartition(F.expr(f"at div {segment}")).sortWithinPartitions("at").mapInArrow(solved, schema)


def _typed(rows: Iterator[tuple], schema) -> Iterator[pa.RecordBatch]:
    """Batches of a schema that is known once the first row has been made."""
    for first in rows:
        yield from _batches((r for part in ([first], rows) for r in part), schema())


def exits(parts: DataFrame) -> DataFrame:
    """Adds to each segment, for each entry, the exit that the rest of the conversation makes cheapest: ``exit`` and ``edits`` by entry, ``paid`` the cost of the segment itself; a last segment's edits end the conversation."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, worth, tail = object(), None, None
        for b in batches:
            out: list[tuple] = []
            for key, costs, audits in zip(*(b.column(c).to_pylist() for c in ("conv_id", "costs", "audits"))):
                if key != conv:
                    conv, worth, tail = key, [2 * len(t) for t in TAIL], TAIL
                to, edits, paid, value = [], [], [], []
                for entry in range(4):
                    ways = [(costs[4 * entry + m] + worth[m], audits[4 * entry + m], m) for m in range(4) if costs[4 * entry + m] is not None]
                    total, audit, m = min(ways) if ways else (None, None, None)
                    to.append(m)
                    value.append(total)
                    edits.append(None if m is None else audit + tail[m])
                    paid.append(None if m is None else costs[4 * entry + m] + 2 * len(tail[m]))
                worth, tail = value, ("", "", "", "")
                out.append((to, edits, paid))
            columns = [pa.array([x[k] for x in out], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("conv_id", "at", "counts", "turns", "initials")], *columns], names=["conv_id", "at", "counts", "turns", "initials", "exit", "edits", "paid"])

    schema = f"conv_id {kind}, at bigint, counts array<bigint>, turns array<bigint>, initials array<string>, exit array<int>, edits array<string>, paid array<bigint>"
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at")).mapInArrow(chosen, schema)


def path(choices: DataFrame) -> DataFrame:
    """The edits taken: ``conv_id``, ``at``, ``entry``, ``audit``, ``cost`` and the segment's share of the conversation's counts."""
    kind = choices.schema["conv_id"].dataType.simpleString()

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, turn, initial = object(), NOTHING, None, None
        for b in batches:
            out: list[tuple] = []
            for key, counts, turns, initials, to, edits, paid in zip(*(b.column(c).to_pylist() for c in ("conv_id", "counts", "turns", "initials", "exit", "edits", "paid"))):
                if key != conv:
                    conv, state, turn, initial = key, NOTHING, None, None
                elif initial is not None:  # what lies across the segments' border
                    counts[3] += initial + initials[0] not in LEGAL
                    counts[4] -= turns is not None and turns[0] == turn
                out.append((state, edits[state], paid[state], counts, *(turns or (None, None))))
                state, initial, turn = to[state], initials[1], turns[1] if turns else turn
            types = [pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("at"), *[pa.array([x[k] for x in out], t) for k, t in enumerate(types)]], names=["conv_id", "at", "entry", "audit", "cost", "counts", "low", "high"])

    return choices.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(taken, f"conv_id {kind}, at bigint, entry int, audit string, cost bigint, counts array<bigint>, low bigint, high bigint")


class Repair:
    """The edits of all conversations. ``turns`` has columns conv_id, turn, role, text and, where a conversation's turn has been taken away, a true ``gone``."""

    def __init__(self, turns: DataFrame, segment: int = SEGMENT):
        spark = turns.sparkSession
        bounded_batches(spark)
        self.scratch, self.segment = Scratch(spark), segment
        gone = F.coalesce("gone", F.lit(False)) if "gone" in turns.columns else F.lit(False)
        self.lines = self.scratch.written(in_order(turns.select("conv_id", "turn", "role", "text", gone.alias("gone"))))
        parts = segments(faults_of(self.lines, self.scratch), segment)
        self.edits = self.scratch.written(path(exits(parts)))

    def _with_edits(self) -> DataFrame:
        """Each segment's edits before its lines."""
        nothing = lambda c, t: F.lit(None).cast(t).alias(c)
        lines = self.lines.select("conv_id", "at", F.lit(1).alias("line"), "gone", "role", "text", nothing("entry", "int"), nothing("audit", "string"), nothing("cost", "bigint"), nothing("counts", "array<bigint>"), nothing("low", "bigint"), nothing("high", "bigint"))
        edits = self.edits.select("conv_id", "at", F.lit(0).alias("line"), F.lit(False).alias("gone"), nothing("role", "string"), nothing("text", "string"), "entry", "audit", "cost", "counts", "low", "high")
        return lines.unionByName(edits)

    def turns(self) -> DataFrame:
        """The repaired turns: ``conv_id``, ``at`` and ``part`` (their order), ``edit`` (keep, rerole, insert), ``role``, ``text``. Worked on by segment, however long a conversation is."""
        kind = self.lines.schema["conv_id"].dataType.simpleString()

        def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            walk = _Walk()
            for b in batches:
                out = []
                for conv, at, line, gone, role, text, entry, audit in zip(*(b.column(c).to_pylist() for c in ("conv_id", "at", "line", "gone", "role", "text", "entry", "audit"))):
                    if not line:
                        walk.begin(entry, audit)
                    elif not gone:
                        out += [(conv, at, part, *x) for part, x in enumerate(walk.line(role, text))]
                types = [b.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["conv_id", "at", "part", "edit", "role", "text"])

        rows = self._with_edits().repartition(F.expr(f"at div {self.segment}")).sortWithinPartitions("at", "line")
        return rows.mapInArrow(repaired, f"conv_id {kind}, at bigint, part int, edit string, role string, text string")

    def summary(self) -> DataFrame:
        """One row for each conversation, also where no turn is left: counts, cost, edits, SHA-256 of the repaired turns as ``role:text``, joined by line feeds."""
        kind = self.lines.schema["conv_id"].dataType.simpleString()
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            type_ = None

            def all_rows() -> Iterator[tuple]:
                nonlocal type_
                for b in batches:
                    type_ = b.schema.field("conv_id").type
                    yield from _rows([b])

            def conversations() -> Iterator[tuple]:
                key, one = object(), None
                for conv, _, line, gone, role, text, entry, audit, cost, counts, low, high in all_rows():
                    if one is None or conv != key:
                        if one is not None:
                            yield one.row(key)
                        key, one = conv, _Told()
                    if not line:
                        one.segment(entry, audit, cost, counts, low, high)
                    elif not gone:
                        one.line(role, text)
                if one is not None:
                    yield one.row(key)

            yield from _typed(conversations(), lambda: pa.schema([("conv_id", type_), *[(c, pa.int64()) for c in names], ("audit", pa.string()), ("repaired_sha256", pa.string())]))

        rows = self._with_edits().repartition("conv_id").sortWithinPartitions("conv_id", "at", "line")
        return rows.mapInArrow(told, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in names)}, audit string, repaired_sha256 string")


class _Walk:
    """Applies a segment's edits to its lines."""

    def begin(self, entry: int, audit: str) -> None:
        self.state, self.audit, self.done = entry, audit, 0

    def line(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The turns that come of one line; after the segment's last line also those that end the conversation."""
        while True:
            edit = self.audit[self.done]
            self.done += 1
            if edit == "K":
                self.state = KEPT[role[0]][self.state]
                yield "keep", role, text
            elif edit != "D":
                self.state = NEXT[self.state]
                yield ("rerole", ROLE[self.state], text) if edit == "R" else ("insert", ROLE[self.state], "")
            if edit != "I" and set(self.audit[self.done : self.done + 3]) - {"I"} or self.done == len(self.audit):
                return


class _Told:
    """A conversation's totals while its segments and lines pass."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False
        self.audits: list[str] = []
        self.cost, self.counts, self.low, self.high = 0, [0] * 5, None, None
        self.walk = _Walk()

    def segment(self, entry: int, audit: str, cost: int, counts: list[int], low: int | None, high: int | None) -> None:
        self.walk.begin(entry, audit)
        self.audits.append(audit)
        self.cost += cost
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        self.low, self.high = low if self.low is None else self.low, self.high if high is None else high

    def line(self, role: str, text: str) -> None:
        for _, role, text in self.walk.line(role, text):
            self.sha.update((b"\n" if self.any else b"") + f"{role}:{text}".encode())
            self.any = True

    def row(self, conv) -> tuple:
        gaps = 0 if self.low is None else min(INT64, self.high - self.low + 1 - self.counts[4])
        return conv, gaps, *self.counts[:4], self.cost, "".join(self.audits), self.sha.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """Turns damaged by CRC-32 of ``conv_id:turn`` modulo 20: 0 goes, 1 loses its text, 2 its sentence ends, 3 comes twice, 4 is a user's; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), kind.alias("_kind"))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


#: The same result by a table of cheapest costs and edits in place of a search: a fold over each conversation's rows, state by state.
SQL = r"""
WITH RECURSIVE bytes AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bytes WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bytes WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT k, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM (SELECT DISTINCT k FROM keyed), crcs),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed JOIN kinds USING (k), (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt
), judged AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c, CASE WHEN regexp_full_match(text, '[\x20\x09-\x0D]*') THEN 1
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 0 ELSE 3 END AS f,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev
  FROM placed
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
    count(*) FILTER (prev IS NOT NULL AND prev || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY conv_id
), ways AS (
  SELECT conv_id, 0::BIGINT AS i, s AS state, (CASE WHEN s = 0 THEN 0 ELSE 1000000000 END)::BIGINT AS cost, ''::VARCHAR AS audit, []::VARCHAR[] AS said FROM told, range(4) t(s)
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit, best.said FROM (
    SELECT conv_id, i, state, arg_min(step, (step.cost, step.audit)) AS best FROM (
      SELECT w.conv_id, j.i, e.t AS state, {'cost': w.cost + 2 * g.n + e.cost + CASE WHEN j.f = 3 AND e.edit <> 'D' THEN 1 ELSE 0 END, 'audit': w.audit || repeat('I', g.n) || e.edit,
        'said': w.said || g.said || CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [CASE e.t WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || j.text] END} AS step
      FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
      JOIN (VALUES (0, 0, 0, []::VARCHAR[]), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (2, 3, 1, ['assistant:']), (3, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])) g(s, m, n, said) ON g.s = w.state
      JOIN (VALUES (0, 0, 'D', '', 3), (1, 1, 'D', '', 3), (2, 2, 'D', '', 3), (3, 3, 'D', '', 3), (0, 2, 'R', '', 2), (1, 2, 'R', '', 2), (3, 2, 'R', '', 2), (2, 3, 'R', '', 2), (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0)) e(s, t, edit, c, cost)
        ON e.s = g.m AND (e.edit = 'D' OR j.f NOT IN (1, 2)) AND (e.edit <> 'K' OR e.c = j.c)
    ) GROUP BY conv_id, i, state
  )
), ends AS (
  SELECT w.conv_id, arg_min({'cost': cost + 2 * t.n, 'audit': audit || repeat('I', t.n), 'said': w.said || t.said}, (cost + 2 * t.n, audit || repeat('I', t.n))) AS best
  FROM ways w JOIN told ON told.conv_id IS NOT DISTINCT FROM w.conv_id JOIN (VALUES (0, 0, []::VARCHAR[]), (1, 2, ['user:', 'assistant:']), (2, 1, ['assistant:']), (3, 0, [])) t(s, n, said) ON t.s = w.state WHERE w.i = told.n GROUP BY w.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(array_to_string(coalesce(best.said, []), chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""
