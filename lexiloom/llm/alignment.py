"""Alignment of two tokenizers: which tokens of a byte-level vocabulary (A) cover which of a piece vocabulary (B).

Both token ends of a text are byte offsets in space + text. Their union (``union1d``) cuts the text into
elementary intervals; each interval lies in one A and one B token (``searchsorted`` gives the owners) and so is
one overlap. Where both tokens end together a group closes. All pairs of a group's A and B tokens are links: in
a group with one A or one B token these are its intervals, in others the product of both sides expands.

Whole texts are covered, by the run: a space between two visible ASCII characters begins a token in both
vocabularies (A's pre-tokens never cross it, no piece of B holds a space behind another character, which is
looked up in the file), so a text is cut there and each run is encoded and aligned once for a batch. A text in which a
run's bytes do not come back is encoded whole. A batch of texts is written with its runs numbered, the pairs
of each run and, for each pair, the number of documents of the batch that hold it linked. Counts are summed by
pair over all batches, best counts by A id; every batch asks for its own pairs, and the answers go back to it.
So no exchange holds a row for a document's token.

Null and empty texts, and texts whose bytes do not come back from both vocabularies, have no tokens: zeros and
an empty digest. A document is a row: repeated rows and equal ids count each. Other columns are carried in
``_row``. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, packed

#: Positions before a space that stands alone between visible ASCII characters.
CUT = re.compile(r"(?<=[!-~])(?= [!-~])")
#: Links of groups expanded at once; larger groups go by their distinct ids.
PRODUCT = 1 << 20
#: Characters of a text that are runs at once.
STRETCH = 1 << 20
#: Runs encoded at once.
TOGETHER = 4000
#: Known runs kept by a worker.
RUNS = 150_000
BITS = 20


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


class Pair:
    """Both vocabularies, with the bytes of every token."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks take the cores already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces_path)
        of = _byte_of_char()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        with open(bytes_path, encoding="utf-8") as f:
            form = json.load(f)
        splits = (form.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and form["pre_tokenizer"].get("use_regex") and not form.get("normalizer")
        self.cut = CUT if splits and not any(re.search("[^▁]▁", p) for p in pieces) else None
        # Each id as text, with what may follow it in the listing of groups.
        self.a_said = [f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"]
        self.b_said = [f"{i}{c}" for i in range(len(pieces)) for c in ",;"]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        #: A run's number; none where its bytes do not come back.
        self.known: dict[str, int | None] = {}
        self.said: list[str] = []
        self.counts: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        #: How often each known run has been met; halved whenever runs are forgotten.
        self.met = np.zeros(0, np.int64)

    def trim(self) -> None:
        """Forgets all but the runs met most often."""
        counts, links, weights = self.table()
        met = np.concatenate([self.met, np.zeros(len(self.said) - len(self.met), np.int64)])
        keep = np.sort(np.argsort(-met, kind="stable")[: RUNS // 2])
        at = _spread((np.cumsum(counts[:, 4]) - counts[:, 4])[keep], counts[keep, 4])
        new = np.full(len(self.said), -1)
        new[keep] = np.arange(len(keep))
        numbers = new.tolist()
        known = {r: numbers[k] for r, k in self.known.items() if k is not None and numbers[k] >= 0}
        said = [self.said[k] for k in keep.tolist()]
        self.known, self.said, self.met = known, said, met[keep] // 2
        self.counts, self.links, self.weights = [counts[keep]], [links[at]], [weights[at]]

    def meet(self, place: np.ndarray, times: np.ndarray) -> None:
        if len(self.met) < len(self.said):
            self.met = np.concatenate([self.met, np.zeros(len(self.said) - len(self.met), np.int64)])
        self.met[place[place >= 0]] += times[place >= 0]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all known runs: token, group and link counts and how many rows of links; the links; their weights."""
        for held in (self.counts, self.links, self.weights):
            held[:] = [np.concatenate(held)] if held else []
        return (self.counts[0], self.links[0], self.weights[0]) if self.said else (np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def runs(self, text: str) -> Iterator[list[str]]:
        """The runs of space + text, a stretch at a time."""
        text, begin = " " + text, 0
        while self.cut and (m := self.cut.search(text, begin + STRETCH)):
            yield self.cut.split(text[begin : m.start()])
            begin = m.start()
        yield self.cut.split(text[begin:]) if self.cut else [text]

    def learn(self, runs: list[str]) -> None:
        """Encodes and aligns runs. Those that end in a visible ASCII character can stand before any other, so they go to the libraries many at once."""
        raw = [r.encode() for r in runs]
        plain = [k for k, r in enumerate(raw) if 33 <= r[-1] <= 126] if self.cut else []
        for k in range(0, len(plain), TOGETHER):
            some = plain[k : k + TOGETHER]
            self._learn([runs[i] for i in some], [raw[i] for i in some])
        held = set(plain)
        for k in range(len(runs)):
            if k not in held:
                self._learn([runs[k]], [raw[k]])

    def _learn(self, runs: list[str], raw: list[bytes]) -> None:
        text, joined = "".join(runs), b"".join(raw)
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text[1:]), np.int64)
        ends = np.cumsum([len(r) for r in raw])
        if all(b"".join(map(of.__getitem__, ids.tolist())) == joined for ids, of in ((a, self.a_bytes), (b, self.b_bytes))):
            to = [np.cumsum(lengths[ids]) for ids, lengths in ((a, self.a_lengths), (b, self.b_lengths))]
            at = [np.searchsorted(t, ends) for t in to]
            if all((t[i] == ends).all() for t, i in zip(to, at)):
                self._align(runs, a, b, *(np.diff(i + 1, prepend=0) for i in at))
                return
        if len(runs) == 1:
            self.known[runs[0]] = None
        else:  # some run's bytes do not come back
            for r, x in zip(runs, raw):
                self._learn([r], [x])

    def _align(self, runs: list[str], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        """Many runs one after another: a run's end is a shared end. ``n_a`` and ``n_b``: tokens of each."""
        groups, links, weights, a_group, b_group = aligned(a, b, np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b]))
        n_groups = int(a_group[-1]) + 1
        # Each run's groups are consecutive.
        ends = a_group[np.cumsum(n_a) - 1] + 1
        begins = np.concatenate([[0], ends[:-1]])
        order = np.argsort(groups, kind="stable")
        groups, links, weights = groups[order], links[order], weights[order]
        edges = np.searchsorted(groups, np.append(begins, n_groups))
        n_links = np.diff(np.concatenate([[0], np.cumsum(weights)])[edges])
        # A group's A ids, then its B ids; the last of each side is followed by a bar or a semicolon.
        a_at, b_at = (np.searchsorted(g, np.arange(n_groups + 1)) for g in (a_group, b_group))
        said: np.ndarray = np.empty(len(a) + len(b), object)
        for ids, group, at, place, of in ((a, a_group, a_at, b_at[a_group], self.a_said), (b, b_group, b_at, a_at[b_group + 1], self.b_said)):
            last = np.zeros(len(ids), np.int64)
            last[at[1:] - 1] = 1
            said[np.arange(len(ids)) + place] = list(map(of.__getitem__, (2 * ids + last).tolist()))
        pieces = said.tolist()
        whole = "".join(pieces)
        to = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])[np.cumsum(n_a + n_b)].tolist()
        self.known.update(zip(runs, range(len(self.said), len(self.said) + len(runs))))
        self.said += [whole[i : j - 1] for i, j in zip([0, *to], to)]
        self.counts.append(np.stack([n_a, n_b, ends - begins, n_links, np.diff(edges)], axis=1))
        self.links.append(links)
        self.weights.append(weights)


def union1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """numpy's ``union1d`` of two arrays in order: runs that are sorted already merge faster than they hash."""
    both = np.sort(np.concatenate((a, b)), kind="stable")
    return both[np.append(True, both[1:] != both[:-1])] if len(both) else both


def aligned(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links as (group, A id and B id in one number, how often), and the group of each A and B token."""
    cuts = union1d(a_ends, b_ends)
    cuts = cuts[cuts > 0]
    a_own, b_own = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
    closes = (a_ends[a_own] == cuts) & (b_ends[b_own] == cuts)
    group = np.cumsum(closes) - closes
    shared = cuts[closes]
    a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
    n_a, n_b = np.bincount(a_group, minlength=len(shared)), np.bincount(b_group, minlength=len(shared))
    plain = (n_a == 1) | (n_b == 1)
    at = plain[group]
    out = [(group[at], a[a_own[at]] << BITS | b[b_own[at]], np.ones(int(at.sum()), np.int64))]
    a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    many = np.flatnonzero(~plain)
    size = n_a[many] * n_b[many]
    small, begin = many[size <= PRODUCT], 0
    while begin < len(small):  # products of bounded size at once
        end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(n_a[small[begin:]] * n_b[small[begin:]]), PRODUCT, "right")))
        g = small[begin:end]
        total = n_a[g] * n_b[g]
        of = np.repeat(g, total)
        nth = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
        out.append((of, a[a_first[of] + nth // n_b[of]] << BITS | b[b_first[of] + nth % n_b[of]], np.ones(len(of), np.int64)))
        begin = end
    for g in many[size > PRODUCT]:
        ids_a, times_a = np.unique(a[a_first[g] : a_first[g] + n_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[b_first[g] : b_first[g] + n_b[g]], return_counts=True)
        out.append((np.full(len(ids_a) * len(ids_b), g), (ids_a[:, None] << BITS | ids_b).ravel(), (times_a[:, None] * times_b).ravel()))
    return *(np.concatenate(x) for x in zip(*out)), a_group, b_group


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(bytes_path: str, pieces_path: str) -> Pair:
    if (bytes_path, pieces_path) not in _pairs:
        _pairs[bytes_path, pieces_path] = Pair(bytes_path, pieces_path)
    return _pairs[bytes_path, pieces_path]


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of ranges one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values without repeats, and how often each stands there."""
    values = np.sort(values)
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[begin], np.diff(np.append(begin, len(values)))


def _packed(values: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, int]:
    """Numbers from 0 as bytes, a value for each range, and the bytes that each number takes."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    data = values.astype(f"<u{width}").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32).tobytes()), pa.py_buffer(data)]), width


def _unpacked(data: bytes, width: str) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}").astype(np.int64)


def _lists(flat: np.ndarray, sizes: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind))


def encoded(docs: DataFrame, bytes_path: str, pieces_path: str, text_col: str = "text", keep: list[str] | None = None, groups: bool = False) -> DataFrame:
    """A row for each document (``n_a`` and so on, ``runs``: gaps between its run numbers in order, ``times``) and before a batch's documents one with its runs' pairs: ``pairs`` with ``docs`` that hold them, ``ends`` of each run's part in ``links`` and ``weights``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(packed(docs, keep=keep), text.alias("_text"))
    row_kind = rows.schema["_row"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(bytes_path, pieces_path)
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            number += 1
            yield from _batch(pair, b.column("_row"), b.column("_text").to_pylist(), number, groups)

    extra = ", groups binary" if groups else ""
    return rows.mapInArrow(encode, f"batch bigint, _row {row_kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string{extra}, runs binary, times binary, pairs array<bigint>, docs array<int>, ends binary, links binary, weights binary, widths string")


class _Numbers(dict):
    """Numbers from 0, in the order of asking."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _batch(pair: Pair, row: pa.Array, texts: list[str], number: int, groups: bool) -> Iterator[pa.RecordBatch]:
    if len(pair.known) > RUNS:
        pair.trim()
    numbers = _Numbers()

    def numbered(text: str) -> np.ndarray:
        parts = [np.fromiter(map(numbers.__getitem__, s), np.int64, len(s)) for s in pair.runs(text)] if text else []
        return np.concatenate(parts or [np.zeros(0, np.int64)])

    def learn(runs: list[str]) -> None:
        new = [r for r in runs if r not in pair.known]
        pair.learn(new)

    of = [numbered(t) for t in texts]
    learn(list(numbers))
    lost = np.array([pair.known[r] is None for r in numbers], bool)
    for k, s in enumerate(of):
        if lost[s].any():  # zeros, unless the whole text comes back
            whole = " " + texts[k]
            learn([whole])
            of[k] = np.array([numbers[whole]] if pair.known[whole] is not None else [], np.int64)
    # Runs that are used, by their numbers among all that are known.
    place = np.array([-1 if pair.known[r] is None else pair.known[r] for r in numbers], np.int64)
    counts, all_links, all_weights = pair.table()
    pair.meet(place, np.bincount(np.concatenate(of or [place]), minlength=len(place)))
    begin = np.cumsum(counts[:, 4]) - counts[:, 4]
    used = place >= 0
    n_a, n_b, n_groups, n_links, sizes = (np.where(used, counts[place, k], 0) if len(counts) else np.zeros(len(place), np.int64) for k in range(5))
    at = _spread(begin[place] if len(counts) else sizes, sizes)
    flat, weights = all_links[at], all_weights[at]
    strings_of = [pair.said[k] if k >= 0 else "" for k in place.tolist()]
    pairs, links = np.unique(flat, return_inverse=True)
    # Every document's distinct runs, one after another: document and run in one number, sorted once for the batch.
    lengths = np.array([len(x) for x in of], np.int64)
    n_runs = max(1, len(place))
    own, n = _distinct(np.repeat(np.arange(len(of)), lengths) * n_runs + np.concatenate(of or [place]))
    doc, mine = own // n_runs, own % n_runs
    edges = np.searchsorted(doc, np.arange(len(of) + 1))
    sums = [np.diff(np.concatenate([[0], np.cumsum(x[mine] * n)])[edges]) for x in (n_a, n_b, n_groups, n_links)]
    n_pairs = max(1, len(pairs))
    met, _ = _distinct(np.repeat(doc, sizes[mine]) * n_pairs + links[_spread((np.cumsum(sizes) - sizes)[mine], sizes[mine])])
    held = np.bincount(met % n_pairs, minlength=len(pairs))
    gaps = np.diff(mine, prepend=0)
    first = edges[:-1][np.diff(edges) > 0]
    gaps[first] = mine[first]
    hashes, strings = [], []
    for runs in of:
        said = ";".join(map(strings_of.__getitem__, runs.tolist())).encode()
        hashes.append(hashlib.sha256(said).hexdigest() if len(runs) else "")
        if groups:
            strings.append(said)
    kinds = {"batch": pa.int64(), "_row": row.type, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()} | ({"groups": pa.binary()} if groups else {})
    kinds |= {"runs": pa.binary(), "times": pa.binary(), "pairs": pa.list_(pa.int64()), "docs": pa.list_(pa.int32()), "ends": pa.binary(), "links": pa.binary(), "weights": pa.binary(), "widths": pa.string()}
    one = {"batch": pa.array([number], pa.int64()), "pairs": _lists(pairs, [len(pairs)], pa.int64()), "docs": _lists(held, [len(pairs)], pa.int32())}
    widths = []
    for name, values in (("ends", np.cumsum(sizes)), ("links", links), ("weights", weights)):
        one[name], width = _packed(values, np.array([0, len(values)]))
        widths.append(width)
    one["widths"] = pa.array([",".join(map(str, widths))])
    yield pa.RecordBatch.from_arrays([one.get(k, pa.nulls(1, t)) for k, t in kinds.items()], names=list(kinds))
    many = {"batch": pa.array([number] * len(texts), pa.int64()), "_row": row, "groups_sha256": pa.array(hashes, pa.string())} | ({"groups": pa.array(strings, pa.binary())} if groups else {})
    many |= {name: pa.array(sums[k], pa.int64()) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    (many["runs"], run_width), (many["times"], time_width) = _packed(gaps, edges), _packed(n, edges)
    many["widths"] = pa.array([f"{run_width},{time_width}"] * len(texts), pa.string())
    yield pa.RecordBatch.from_arrays([many.get(k, pa.nulls(len(texts), t)) for k, t in kinds.items()], names=list(kinds))


def align(docs: DataFrame, bytes_path: str, pieces_path: str, text_col: str = "text", keep: list[str] | None = None, groups: bool = False) -> DataFrame:
    """``_row`` (the columns to keep) with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` and, if asked for, the ``groups`` themselves: A ids, B ids, ``a1,a2|b1;a3|b2,b3``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    batches = Scratch(spark).written(encoded(docs, bytes_path, pieces_path, text_col, keep, groups))
    asked = batches.where("pairs IS NOT NULL").select("batch", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("batch", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("n"))
    # At most one row for each id of vocabulary A.
    a = F.expr(f"pair >> {BITS}")
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    counted = counts.join(F.broadcast(best), F.expr(f"pair >> {BITS} = a")).select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    back = asked.select("batch", "pair").join(counted, "pair").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "is_best"))).alias("answers"))
    answers = back.select("batch", F.col("answers.n").alias("n"), F.col("answers.is_best").alias("is_best"))
    row = batches.schema["_row"].dataType
    out = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"] + ["groups"] * groups
    nothing = lambda c: F.lit(None).cast(batches.schema[c].dataType).alias(c)
    told = answers.select("batch", F.lit(0).alias("kind"), "n", "is_best", *[nothing(c) for c in ["_row", *out, "runs", "times", "ends", "links", "weights", "widths"]])
    tables = batches.select("batch", F.when(F.col("pairs").isNotNull(), 1).otherwise(2).alias("kind"), F.lit(None).cast("array<bigint>").alias("n"), F.lit(None).cast("array<boolean>").alias("is_best"), "_row", *out, "runs", "times", "ends", "links", "weights", "widths")

    def totals(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's answers, then its runs, then its documents."""
        n = is_best = run_count = run_best = np.zeros(0, np.int64)
        for b in parts:
            kinds = b.column("kind").to_numpy()
            held = np.flatnonzero(kinds == 2)
            sums, bests = [], []
            widths, runs_of, times_of = (b.column(c).to_pylist() for c in ("widths", "runs", "times"))
            for k, kind in enumerate(kinds.tolist()):
                if kind == 0:
                    n, is_best = (b.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "is_best"))
                elif kind == 1:
                    ends, links, weights = (_unpacked(b.column(c)[k].as_py(), w) for c, w in zip(("ends", "links", "weights"), widths[k].split(",")))
                    edges = np.concatenate([[0], ends])
                    run_count, run_best = (np.diff(np.concatenate([[0], np.cumsum(x[links] * weights)])[edges]) if len(links) else np.zeros(len(ends), np.int64) for x in (n, is_best))
                else:
                    run_width, time_width = widths[k].split(",")
                    runs, times = np.cumsum(_unpacked(runs_of[k], run_width)), _unpacked(times_of[k], time_width)
                    sums.append(int((run_count[runs] * times).sum()) if len(runs) else 0)
                    bests.append(int((run_best[runs] * times).sum()) if len(runs) else 0)
            if len(held):
                own = b.take(pa.array(held))
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ["_row", *out]], pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], names=["_row", *out, "n_best", "count_sum"])

    schema = f"_row {row.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string{', groups binary' * groups}, n_best bigint, count_sum bigint"
    return told.unionByName(tables).repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(totals, schema)
