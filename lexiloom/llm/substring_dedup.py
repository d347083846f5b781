"""Exact-substring dedup: suffixes in sorted, front-coded runs, merged by loser trees that know prefixes.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller id. Sorting
every suffix of a corpus would move it many times over, so the sort takes only what plainer facts leave
open, and every step before it is exact (up to 112-bit hashes of equal position):

1. Copies of a whole text, but the first, go by the text's digest and take no further part.
2. Every LENGTH-byte string holds anchors: positions whose GRAM-byte hash is the least among those inside
   it. Equal strings hold equal anchors, so only anchors found in two documents can matter (one exchange
   of packed arrays; about one position in sixteen). Of a gram with more than HOT surroundings in one task
   only the smallest and largest owner of a group of slices are exchanged and all places stay open, so a
   passage that a third of the documents share is no hot group.
3. An anchor whose whole surrounding - all LENGTH-byte strings that hold it - also stands in a smaller
   document covers that surrounding. Of the others, those stay open that share the HALF bytes before or
   after the gram as well, as every common string asks for: mostly the ends of repeated passages.
4. The suffixes that start at open anchors, cut to LENGTH bytes, are sorted within each task into runs,
   front-coded against their predecessors, and exchanged by ranges, as many as the open places ask for;
   each brings the REACH bytes before it along. Each range merges its runs with a loser tree: a candidate's
   common prefix with the last suffix given out decides most comparisons, and no byte known to be equal
   is compared again. The common prefixes of neighbours tell which suffixes share how many bytes; with the
   same for the bytes before them, every string around an anchor is a pair of classes, whose smallest
   owner tells which others lose it. Strings around hot grams are exchanged one by one instead, with
   their smallest owner in the task only.

Defined results: null and empty texts, and texts shorter than LENGTH bytes, lose nothing; rows with a
null id lose nothing and take nothing from others; rows that repeat an id never take from each other,
and a row that repeats id and text gets the same result; an empty table gives no rows; columns in
``keep`` pass through in ``_row``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, bounded_batches, packed, written
from .shingles import mixed

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM  # a string that holds an anchor starts up to so many bytes before it
HALF = (REACH + 1) // 2  # and holds so many bytes before it or as many behind it
SLICE_BYTES, PIECE_BYTES, DEAL_BYTES, BUCKET_BYTES = 1_000_000, 200_000, 12_000_000, 16_000_000
HOT, HOT_CELLS = 128, 1 << 20
# A run is cut into a piece for every part, so pieces number the square of all entries over the product of both.
RUN_ENTRIES, PART_ENTRIES, LEAST_ENTRIES = 300_000, 200_000, 2000
SPLIT_DOCS, SPLIT_STRINGS, SPLIT_SEED, SPLITS = 2000, 32, 7, 4096

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _tables:
        _tables.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _tables[size] = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)])) for x in (_BASE, inverse))
    return _tables[size]


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over x[i : i + width] for every i, in doubling steps; what lies beyond the end plays no part."""
    have, out = 1, x
    while have < width:
        k = min(have, width - have)
        wider = out.copy()
        f(out[:-k], out[k:], out=wider[:-k])
        out, have = wider, have + k
    return out


def anchors(bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text number, position, hashes of gram and surrounding, and of the HALF bytes with it on either side (0: not there) of every anchor."""
    sizes = np.array([len(x) for x in bodies], np.int64)
    a = np.frombuffer(b"".join(bodies), np.uint8)
    n = len(a)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint16, np.uint16))
    ends = np.repeat(np.cumsum(sizes), sizes)
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    power, inverse = _powers(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[:n])])
    at = np.arange(n)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    gram = np.full(n, none)
    fits = at + GRAM <= ends
    m = n - GRAM + 1
    gram[:m] = mixed(mixed((sums[GRAM:] - sums[:m]) * inverse[:m])) >> np.uint64(1)
    gram[~fits] = none
    least = _slide(gram, REACH + 1, np.minimum)
    least[at + LENGTH > ends] = 0
    # The largest of the minima of all strings that hold a position: equal to its own hash only at anchors.
    held = _slide(least[::-1], REACH + 1, np.maximum)[::-1]
    found = np.flatnonzero((gram == held) & fits)
    lo, hi = np.maximum(begins[found], found - REACH), np.minimum(ends[found], found + LENGTH)
    around = mixed((sums[hi] - sums[lo]) * inverse[lo] + (found - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (hi - found).astype(np.uint64) * np.uint64(0x165667B19E3779F9))

    def side(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        there = (lo >= begins[found]) & (hi <= ends[found])
        lo, hi = np.maximum(lo, 0), np.minimum(hi, n)
        return np.where(there, np.maximum(1, mixed(mixed((sums[hi] - sums[lo]) * inverse[lo])) >> np.uint64(48)), 0).astype(np.uint16)

    left, right = side(found - HALF, found + GRAM), side(found, found + GRAM + HALF)
    return np.searchsorted(np.cumsum(sizes), found, "right"), found - begins[found], gram[found], around, left, right


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join([np.array([len(x) for x in arrays], "<i8").tobytes(), *(x.tobytes() for x in arrays)]), 1)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    lengths, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(lengths, kinds):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _slices(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[bytes]]]:
    own, bodies, size = [], [], 0
    for i, text in zip(ids.to_pylist(), texts.cast(pa.binary())):
        body = text.as_py() or b""
        own.append(i), bodies.append(body)
        size += len(body)
        if size >= SLICE_BYTES:
            yield own, bodies
            own, bodies, size = [], [], 0
    if own:
        yield own, bodies


def _pieces(bodies: list[bytes]) -> list[int]:
    """Ends of runs of texts of about PIECE_BYTES, whose arrays stay in a core's cache."""
    ends, size = [], 0
    for k, body in enumerate(bodies):
        size += len(body)
        if size >= PIECE_BYTES or k + 1 == len(bodies):
            ends.append(k + 1)
            size = 0
    return ends


def _marks(ids, crcs, codes, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(crcs, pa.int64()), pa.array(codes, pa.int64()), pa.array(kinds, pa.int32())], names=["id", "crc", "code", "kind"])


#: A covered stretch (kind 0; its start times 128, and its length of up to REACH + LENGTH) or an open place.
MARKS = "id long, crc long, code long, kind int"
COVERED, BEFORE, BEHIND, STRINGS = 0, 1, 2, 4  # open with as much before the gram as HALF bytes, behind it, or (their sum) both; open string by string


def _around(place: np.ndarray) -> np.ndarray:
    """Anchors' surroundings as stretches; what lies beyond a text's end is cut off there."""
    begin = np.maximum(place.astype(np.int64) - REACH, 0)
    return begin * 128 + (place + LENGTH - begin)


def packed_anchors(buckets: int):
    """Tasks' anchors, dealt to buckets by gram hash, as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(HOT_CELLS, np.int64)  # surroundings of each gram so far; grams that share a cell are only taken for hot sooner
        held, ids, crcs, size = [], [], [], 0

        def apart(own: list, bodies: list[bytes]) -> tuple[list, list[bytes]]:
            """Without later copies: their digests tell that all of them goes."""
            first: dict[bytes, int] = {}
            for i, body in zip(own, bodies):
                first[body] = min(i, first.get(body, i))
            stay = [k for k, (i, body) in enumerate(zip(own, bodies)) if i == first[body]]
            return [own[k] for k in stay], [bodies[k] for k in stay]

        def deal() -> Iterator[pa.RecordBatch]:
            text, place, gram, around, left, right = (np.concatenate(x) for x in zip(*held))
            own_ids, own_crcs = np.array(ids, np.int64), np.array(crcs, np.int64)
            order = np.lexsort((own_ids[text], around, gram))
            text, place, gram, around, left, right = (x[order] for x in (text, place, gram, around, left, right))
            owner = own_ids[text]
            # Of equal surroundings here the smallest id goes on; larger ids are covered already.
            new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
            new = new_gram | np.concatenate([[True], around[1:] != around[:-1]])
            done = owner > owner[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            starts, group = np.flatnonzero(new_gram), np.cumsum(new_gram) - 1
            cell = ((gram[starts] >> np.uint64(7)) % np.uint64(HOT_CELLS)).astype(np.int64)
            np.add.at(sent, cell, np.add.reduceat(new.astype(np.int64), starts))
            hot = (sent[cell] > HOT)[group]
            low = np.minimum.reduceat(np.where(done, np.iinfo(np.int64).max, owner), starts)[group]
            high = np.maximum.reduceat(np.where(done, np.iinfo(np.int64).min, owner), starts)[group]
            stays = hot & ~done & (owner != low) & (owner != high)
            bucket = (gram % np.uint64(buckets)).astype(np.int64)
            bucket[done | stays] = place[done | stays] % buckets
            by_bucket = np.lexsort((place, text, bucket))  # in the order of the text, so that places pack well
            for own in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1):
                used, number = np.unique(text[own], return_inverse=True)
                main, rest, opened = ~(done | stays)[own], done[own], stays[own]
                known = [x[at].astype("<u4") for at in (rest, opened) for x in (number, place[own])]
                at = own[main]
                hashes = gram[at], (around[at] >> np.uint64(32)).astype("<u4"), (around[at] >> np.uint64(16)).astype("<u2"), left[at], right[at], hot[at].astype("u1")
                blob = _pack(own_ids[used], own_crcs[used].astype("<u4"), *hashes, number[main].astype("<u4"), place[at].astype("<u4"), *known)
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[own[0]])], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

        for b in batches:
            for own, bodies in _slices(b.column("id"), b.column("text")):
                own, bodies = apart(own, bodies)
                begin = 0
                for end in _pieces(bodies):
                    text, *rest = anchors(bodies[begin:end])
                    if len(text):
                        held.append((text + len(ids) + begin, *rest))
                    begin = end
                ids += own
                crcs += [zlib.crc32(x) for x in bodies]
                size += sum(map(len, bodies))
                if size >= DEAL_BYTES and held:
                    yield from deal()
                    held, ids, crcs, size = [], [], [], 0
        if held:
            yield from deal()

    return run


def _spread(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Flags the rows whose group holds two ids."""
    if not len(group):
        return np.zeros(0, bool)
    order = np.argsort(group, kind="stable")
    new = np.concatenate([[True], np.diff(group[order]) != 0])
    starts, at = np.flatnonzero(new), np.cumsum(new) - 1
    out = np.empty(len(group), bool)
    out[order] = (np.minimum.reduceat(ids[order], starts) < np.maximum.reduceat(ids[order], starts))[at]
    return out


def judge_anchors(table: pa.Table) -> pa.Table:
    """Marks of one bucket: covered surroundings, and open places of anchors that share more than their gram."""
    out, parts = [], []
    for blob in table.column("blob"):
        ids, crcs, gram, high, low, left, right, hot, text, place, text2, place2, text3, place3 = _unpack(blob.as_py(), "<i8", "<u4", "<u8", "<u4", "<u2", "<u2", "<u2", "u1", *["<u4"] * 6)
        crcs = crcs.astype(np.int64)
        parts.append((gram, high.astype(np.uint64) << np.uint64(16) | low, left, right, hot, ids[text], crcs[text], place.astype(np.int64)))
        if len(text2):
            out.append(_marks(ids[text2], crcs[text2], _around(place2), np.zeros(len(text2))))
        if len(text3):
            out.append(_marks(ids[text3], crcs[text3], place3.astype(np.int64), np.full(len(text3), STRINGS)))
    gram, around, left, right, hot, ids, crcs, place = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, around, gram))
    gram, around, left, right, hot, ids, crcs, place = (x[order] for x in (gram, around, left, right, hot, ids, crcs, place))
    n = len(gram)
    if n:
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new_around = new_gram | np.concatenate([[True], around[1:] != around[:-1]])
        group, starts = np.cumsum(new_gram) - 1, np.flatnonzero(new_gram)
        smallest, largest = np.minimum.reduceat(ids, starts)[group], np.maximum.reduceat(ids, starts)[group]
        leader = ids == ids[np.maximum.accumulate(np.where(new_around, np.arange(n), 0))]
        hot = np.maximum.reduceat(hot, starts)[group].astype(bool)
        # No equal surrounding in a smaller document, but an equal gram and as much beside it.
        opened = np.where(leader & hot & (ids > smallest), STRINGS, 0)
        for kind, beside in ((BEFORE, left), (BEHIND, right)):
            rows = np.flatnonzero(leader & ~hot & (smallest < largest) & (beside != 0))
            opened[rows] |= kind * _spread(group[rows] << 16 | beside[rows], ids[rows])
        # Of a hot gram some owners are not here: whatever is smaller than an open one stays open with it.
        sought = np.maximum.reduceat(np.where(opened > 0, ids, np.iinfo(np.int64).min), starts)[group]
        opened[leader & hot & (ids < sought)] = STRINGS
        out.append(_marks(ids[~leader], crcs[~leader], _around(place[~leader]), np.zeros(n - leader.sum())))
        out.append(_marks(ids[opened > 0], crcs[opened > 0], place[opened > 0], opened[opened > 0]))
    return pa.Table.from_batches(out, _marks([], [], [], []).schema)


class Run:
    """A sorted run of suffixes: each knows the prefix it shares with the one before."""

    def __init__(self, blob: bytes):
        shared, tails, self.ids, self.crcs, self.places, self.sizes, self.befores, before = _unpack(blob, "<u1", "<u1", "<i8", "<u4", "<i8", "<u1", "<u1", "<u1")
        self.shared, self.tails, self.before = shared.tolist(), tails.tobytes(), before.reshape(-1, REACH)
        self.k, self.offset, self.string = -1, 0, b""

    def next(self) -> int:
        """Moves on; gives the prefix shared with the last suffix, or -1 at the end."""
        self.k += 1
        if self.k >= len(self.shared):
            return -1
        n = self.shared[self.k]
        end = self.offset + LENGTH - n
        self.string = self.string[:n] + self.tails[self.offset : end]
        self.offset = end
        return n


def _common(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row of a matrix shares with the one before; 0 for the first."""
    differ = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), rows.shape[1])]) if len(rows) else np.zeros(0, np.int64)


def in_order(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Entries sorted by suffix, then id."""
    order = np.lexsort((e["ids"], np.ascontiguousarray(e["suffix"]).view(f"S{LENGTH}").ravel()))
    return {c: x[order] for c, x in e.items()}


def front_coded(e: dict[str, np.ndarray]) -> bytes:
    """A run from entries in order."""
    shared = _common(e["suffix"])
    tails = e["suffix"][np.arange(LENGTH)[None, :] >= shared[:, None]]
    return _pack(shared.astype("<u1"), tails, e["ids"].astype("<i8"), e["crcs"].astype("<u4"), e["places"].astype("<i8"), e["sizes"].astype("<u1"), e["befores"].astype("<u1"), np.ascontiguousarray(e["before"]).ravel())


def _compare(a: bytes, b: bytes, known: int) -> tuple[bool, int]:
    """Whether a is at most b, and their common prefix, of which ``known`` bytes need no look."""
    n = known
    while n < LENGTH and a[n] == b[n]:
        n += 1
    return n == LENGTH or a[n] < b[n], n


def merged(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """The runs' suffixes in order: number of the run, place in it, and the prefix shared with the suffix before.

    A loser tree whose nodes keep the loser and the prefix that it shares with the winner that passed:
    between two candidates the one sharing more with the last winner is smaller; only if both share
    equally much are bytes compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    shared = [run.next() for run in runs] + [-1] * (size - len(runs))  # with the last winner; -1: ended
    shared = [min(s, 0) if s >= 0 else -1 for s in shared]
    loser = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        if shared[x] < 0:
            return x, y
        first, n = _compare(runs[x].string, runs[y].string, shared[x])
        winner, lost = (x, y) if first else (y, x)
        shared[lost] = n
        return winner, lost

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1) if size > 1 else 0
    while shared[top] >= 0:
        yield top, runs[top].k, shared[top]
        shared[top] = runs[top].next()
        node = (top + size) // 2
        while node:
            # All losers on this path lost to the string just given out, so all prefixes are against it.
            top, loser[node] = play(top, loser[node])
            node //= 2


def covered(ids: np.ndarray, shared: np.ndarray, sizes: np.ndarray, before: np.ndarray, befores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of suffixes in order, those with a string that a smaller owner has, and the most and fewest bytes before them that such strings take in.

    The string with k bytes before the suffix is a pair of classes: suffixes that share LENGTH - k bytes
    are neighbours, and so are those that share k bytes before, once ordered by these bytes backwards.
    """
    n = len(ids)
    back = np.ascontiguousarray(before[:, ::-1])
    order = np.argsort(back.view(f"S{REACH}").ravel(), kind="stable") if n else np.zeros(0, np.int64)
    common, left = _common(back[order]), np.empty(n, np.int64)
    most, least = np.full(n, -1), np.full(n, LENGTH)
    for k in range(REACH + 1):
        right = np.cumsum(shared < LENGTH - k)
        left[order] = np.cumsum(common < k) if k else 0
        valid = (sizes >= LENGTH - k) & (befores >= k) & (np.bincount(right, minlength=1)[right] > 1)
        rows = np.flatnonzero(valid)
        if not len(rows):
            continue
        key = right[rows] * np.int64(n + 1) + left[rows]
        by = np.lexsort((ids[rows], key))
        new = np.concatenate([[True], np.diff(key[by]) != 0])
        first = ids[rows[by]][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        lost = rows[by[ids[rows[by]] > first]]
        most[lost] = k
        least[lost] = np.minimum(least[lost], k)
    found = np.flatnonzero(most >= 0)
    return found, most[found], least[found]


def judge_runs(table: pa.Table) -> pa.Table:
    """What one range's suffixes and the bytes before them have in common with smaller owners."""
    out, runs = [], []
    for blob, known in zip(table.column("blob"), table.column("known").to_pylist()):
        if known:
            ids, crcs, places = _unpack(blob.as_py(), "<i8", "<u4", "<i8")
            out.append(_marks(ids, crcs.astype(np.int64), places * 128 + LENGTH, np.zeros(len(ids))))
        else:
            runs.append(Run(blob.as_py()))
    given = np.fromiter(chain.from_iterable(merged(runs)), np.int64).reshape(-1, 3)
    if len(given):
        at = np.cumsum([0, *(len(run.ids) for run in runs)])[given[:, 0]] + given[:, 1]
        ids, crcs, places, sizes, befores, before = (np.concatenate([getattr(run, c) for run in runs])[at] for c in ("ids", "crcs", "places", "sizes", "befores", "before"))
        found, most, least = covered(ids, given[:, 2], sizes, before, befores)
        out.append(_marks(ids[found], crcs[found].astype(np.int64), (places[found] - most) * 128 + LENGTH + most - least, np.zeros(len(found))))
    return pa.Table.from_batches(out, _marks([], [], [], []).schema)


def open_entries(body: bytes, codes: np.ndarray) -> dict[str, np.ndarray]:
    """The suffixes of one text that its open places (times 8, and kind) leave to be compared; a string by itself takes no bytes before it in."""
    places, kinds = codes >> 3, codes & 7
    starts = (places[kinds == STRINGS][:, None] - np.arange(REACH + 1)[None, :]).ravel()
    starts = np.unique(starts[(starts >= 0) & (starts + LENGTH <= len(body))])
    anchors_ = np.unique(places[kinds != STRINGS])
    at = np.concatenate([anchors_, starts])
    padded = np.frombuffer(bytes(REACH) + body + bytes(LENGTH), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, REACH + LENGTH)[at]
    single = np.arange(len(at)) >= len(anchors_)
    befores = np.where(single, 0, np.minimum(at, REACH))
    before = np.where((np.arange(REACH)[None, :] >= REACH - befores[:, None]), rows[:, :REACH], 0).astype(np.uint8)
    return {"suffix": rows[:, REACH:], "places": at, "sizes": np.minimum(len(body) - at, LENGTH), "befores": befores, "before": before, "single": single}


def sorted_runs(splitters: list[bytes], parts: int):
    """Tasks' entries as one front-coded run for each part; ``known`` rows hold strings that lose to smaller owners in the same task.

    A part is a range of GRAM-byte prefixes, or of whole strings for entries that are one; where there are
    more parts than ranges, a range is dealt further by the same bytes.
    """
    edges = np.array(splitters, f"S{LENGTH}")
    deep = -(-parts // (len(edges) + 1))

    def parts_of(e: dict[str, np.ndarray]) -> np.ndarray:
        key = e["suffix"].copy()
        key[~e["single"], GRAM:] = 0
        sums = np.zeros(len(key), np.uint64)
        for k, power in enumerate(_powers(LENGTH)[0][:LENGTH]):
            sums += key[:, k] * power
        return np.searchsorted(edges, np.ascontiguousarray(key).view(f"S{LENGTH}").ravel(), "right") * deep + (mixed(mixed(sums)) % np.uint64(deep)).astype(np.int64)

    def row(part: int, blob: bytes, known: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary()), pa.array([known])], names=["part", "blob", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            e = in_order({c: np.concatenate([x[c] for x in held]) for c in held[0]})
            alone = np.flatnonzero(e["single"])
            if len(alone):
                # Of a string that is an entry only the smallest owner goes on.
                strings, ids = e["suffix"][alone], e["ids"][alone]
                new = np.concatenate([[True], (strings[1:] != strings[:-1]).any(1)])
                lost = alone[ids > ids[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]]
                if len(lost):
                    yield row(int(e["places"][lost[0]]) % parts, _pack(e["ids"][lost].astype("<i8"), e["crcs"][lost].astype("<u4"), e["places"][lost].astype("<i8")), True)
                    e = {c: np.delete(x, lost, 0) for c, x in e.items()}
            part = parts_of(e)
            order = np.argsort(part, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(own):
                    yield row(int(part[own[0]]), front_coded({c: x[own] for c, x in e.items()}), False)

        for b in batches:
            for i, crc, text, codes in zip(b.column("id").to_pylist(), b.column("crc").to_pylist(), b.column("text").cast(pa.binary()), b.column("codes")):
                e = open_entries(text.as_py(), codes.values.to_numpy())
                n = len(e["places"])
                if n:
                    held.append(e | {"ids": np.full(n, i, np.int64), "crcs": np.full(n, crc, np.int64)})
                    size += n
                if size >= RUN_ENTRIES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def split_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most twice SPLIT_STRINGS of each text's keys, evenly spaced."""
    for b in batches:
        out = []
        for text, codes in zip(b.column("text").cast(pa.binary()), b.column("codes")):
            e = open_entries(text.as_py(), codes.values.to_numpy())
            for k in range(0, len(e["places"]), max(1, len(e["places"]) // SPLIT_STRINGS)):
                out.append(e["suffix"][k, : LENGTH if e["single"][k] else GRAM].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["key"])


def removed(body: bytes, codes: list | None, copy: bool) -> np.ndarray:
    """A flag for each byte: in a covered stretch, or in a later copy."""
    n = len(body)
    if copy and n >= LENGTH:
        return np.ones(n, bool)
    edge = np.zeros(n + 1, np.int32)
    if codes is not None and len(codes):
        c = np.asarray(codes, np.int64)
        np.add.at(edge, np.minimum(c >> 7, n), 1)
        np.add.at(edge, np.minimum((c >> 7) + (c & 127), n), -1)
    return np.cumsum(edge[:n]) > 0


def substring_dedup(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``_row``, n_bytes, n_removed, n_spans and kept (the remaining bytes) for each row."""
    bounded_batches(docs.sparkSession)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text")).where(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH))
    digested = plain.select("id", F.md5(F.col("text").cast("binary")).alias("digest"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    # Written, so that the join has plain exchanges on both sides and Spark can split a hot text.
    firsts = scratch.written(digested.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"))
    many = firsts.count() > BROADCAST_IDS
    copies = digested.join(firsts if many else F.broadcast(firsts), "digest").where("id > first").select("id", "crc").distinct()
    # All of a later copy goes, and what it says stands in the first, so it takes no further part; with too many digests to broadcast it does, as telling it apart would move every text.
    own = plain if many else plain.join(F.broadcast(firsts), F.md5(F.col("text").cast("binary")) == F.col("digest"), "left").where("first IS NULL OR id = first").select("id", "text")
    keyed = plain.withColumn("crc", F.crc32(F.col("text").cast("binary")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, -(-(plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    dealt = own.mapInArrow(packed_anchors(buckets), "bucket int, blob binary")
    marks = scratch.written(dealt.groupBy("bucket").applyInArrow(judge_anchors, MARKS))
    by_doc = lambda df, c: df.groupBy("id", "crc").agg(F.collect_set(c).alias("codes"))
    opened = scratch.written(by_doc(marks.where(F.col("kind") > COVERED), F.col("code") * 8 + F.col("kind")))
    entries = marks.where(F.col("kind") > COVERED).agg(F.coalesce(F.sum(F.when(F.col("kind") == STRINGS, REACH + 1).otherwise(1)), F.lit(0))).first()[0]
    parts = max(1 + entries // PART_ENTRIES, min(tasks, 1 + entries // LEAST_ENTRIES))
    probe = scratch.written(opened.orderBy(F.xxhash64("id", "crc"), "id").limit(SPLIT_DOCS).select("id", "crc", F.slice(F.shuffle("codes", SPLIT_SEED), 1, SPLIT_STRINGS).alias("codes")))
    seen = sorted(bytes(r.key) for r in keyed.join(F.broadcast(probe), ["id", "crc"]).select("text", "codes").mapInArrow(split_strings, "key binary").collect())  # twice SPLIT_DOCS times SPLIT_STRINGS at most
    ranges = min(parts, SPLITS, 1 + len(seen) // 8)
    splitters = sorted({seen[len(seen) * k // ranges] for k in range(1, ranges)})
    runs = keyed.join(opened, ["id", "crc"]).select("id", "crc", "text", "codes").mapInArrow(sorted_runs(splitters, parts), "part int, blob binary, known boolean")
    judged = runs.groupBy("part").applyInArrow(judge_runs, MARKS)
    found = written(
        by_doc(marks.where(F.col("kind") == COVERED).unionByName(judged), "code")
        .join(copies.withColumn("copy", F.lit(True)), ["id", "crc"], "full")
        .withColumnsRenamed({"id": "_id", "crc": "_crc"})
    )
    scratch.clear()
    framed = docs.select(packed(docs, keep=keep), F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text")).withColumn("crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    both = framed.join(found, (F.col("id") == F.col("_id")) & (F.col("crc") == F.col("_crc")), "left").select("_row", "text", "codes", F.coalesce("copy", F.lit(False)).alias("copy"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, gone, spans, kept = [], [], [], []
            for t, codes, copy in zip(b.column("text").cast(pa.binary()), b.column("codes"), b.column("copy").to_pylist()):
                body = t.as_py() or b""
                flags = removed(body, codes.values.to_numpy() if codes.is_valid else None, copy)
                lengths.append(len(body)), gone.append(int(flags.sum()))
                spans.append(int(flags[:1].sum() + (flags[1:] & ~flags[:-1]).sum()))
                kept.append(np.frombuffer(body, np.uint8)[~flags].tobytes() if gone[-1] else body)
            yield pa.RecordBatch.from_arrays([b.column("_row"), *(pa.array(x, pa.int64()) for x in (lengths, gone, spans)), pa.array(kept, pa.binary())], names=["_row", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(cut, f"_row {framed.schema['_row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


#: In hexadecimal digits, as byte strings cannot be cut in SQL; windows are cut from pieces of 1,024 bytes.
SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, c, substring(h, 2 * c + 1, 2146) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 1024)) AS c FROM b)),
s AS (SELECT doc_id, c + i AS p, substring(part, 2 * i + 1, 100) AS g FROM (SELECT doc_id, c, part, unnest(range(0, least(1024, length(part) // 2 - 49))) AS i FROM k)),
f AS (SELECT g, min(doc_id) AS f FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, p FROM s JOIN f USING (g) WHERE doc_id > f),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM c)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS e FROM i GROUP BY doc_id, k),
g AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
t AS (SELECT g.doc_id, sum(e - a)::BIGINT AS gone, count(*) AS spans, string_agg(substring(h, (2 * z + 1)::INT, (2 * (a - z))::INT), '' ORDER BY a) AS kept, max(e) AS last FROM g JOIN b ON b.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT b.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h ELSE kept || substring(h, (2 * last + 1)::INT) END)) AS kept_sha256
FROM b LEFT JOIN t ON t.doc_id = b.doc_id
"""
