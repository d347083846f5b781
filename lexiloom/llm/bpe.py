"""Byte-pair encoding and decoding of whole texts by tree concatenation.

Where white space always ends a token (``splits_at_spaces`` reads that from the vocabulary's file; texts
of others go to the library whole), a text is a row of unsplit runs and the encoding is the runs'
encodings in order. Short texts are encoded in one narrow pass: runs that
came before are looked up, new ones go to the tokenizers library together. A text of more than
``LEAF_CHARS`` characters is cut into leaves that are encoded in parallel, wherever the cuts fall, and
put together pairwise as a tree: around each join that splits a run, windows of the text that double
in size are encoded until their tokens agree exactly with the left side before the join and with the
right side after it; the window's tokens then replace what the cut had spoilt. Copies of a long text
are encoded once.

Defined results: a null text is an empty one (no tokens, empty decoding); repeated rows and ties give
equal rows; an empty table gives no rows; other columns pass through in ``_row`` under any name.
"""

from __future__ import annotations

import json
import os
import pickle
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, packed

LEAF_CHARS = 32_768
CACHED_RUN, CACHED_RUNS = 64, 150_000
WINDOW, AGREE = 32, 2
SLICE_CHARS = 500_000
#: The split of the vocabularies that the run-wise way is right for.
LETTERS_OR_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: ASCII separators that str.split() also cuts at although the vocabulary's white space leaves them in.
_ODD = re.compile(r"[\x1c-\x1f]")
_RUN = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def splits_at_spaces(tokenizer: Tokenizer) -> bool:
    """Whether runs between white space are encoded by themselves, lower-cased, letters apart from marks, and tokens are decoded one by one."""
    said = json.loads(tokenizer.to_str())
    steps = lambda part, inner: [x["type"] for x in (said[part] or {}).get(inner, [])]
    if said["decoder"] is not None or steps("normalizer", "normalizers") != ["NFC", "Replace", "Lowercase"] or steps("pre_tokenizer", "pretokenizers") != ["Split", "ByteLevel"]:
        return False
    split = said["pre_tokenizer"]["pretokenizers"][0]
    return split["pattern"] == {"Regex": LETTERS_OR_MARKS} and split["invert"] and split["behavior"] == "Removed" and said["post_processor"] is None


class Codec:
    """One worker's tokenizer with the runs that it has seen; two generations of bounded size."""

    def __init__(self, path: str, cached: int = CACHED_RUNS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks take the cores already
        self.cached = cached
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_runs = splits_at_spaces(self.tokenizer)
        self.tokens = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def runs(self, runs: list[str]) -> dict[str, bytes]:
        """Every run's ids (little-endian unsigned 32-bit)."""
        if len(self.seen) > self.cached:
            self.older, self.seen = self.seen, {}
        seen, older, long, cores, fresh = self.seen, self.older, {}, {}, set()
        for r in set(runs).difference(seen):
            if r in older:
                seen[r] = older[r]
                continue
            # Letters before a mark are a token row of their own; in ASCII their case is dropped first.
            end = r[-1] if r[-1] in ".," and r[:-1].isalpha() else ""
            core = r[:-1] if end else r
            if core.isascii() and core.isalpha():
                core = core.lower()
            cores[r] = core, end
            for x in (core, end) if end else (core,):
                if x not in seen:
                    if x in older:
                        seen[x] = older[x]
                    else:
                        fresh.add(x)
        fresh = list(fresh)
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            flat, at = np.fromiter(chain.from_iterable(found), "<u4").tobytes(), 0
            for r, ids in zip(part, found):
                (seen if len(r) <= CACHED_RUN else long)[r] = flat[at : at + 4 * len(ids)]
                at += 4 * len(ids)
        for r, (core, end) in cores.items():
            if r != core:
                (seen if len(r) <= CACHED_RUN else long)[r] = (long[core] if core in long else seen[core]) + (seen[end] if end else b"")
        return {r: long[r] if r in long else seen[r] for r in set(runs)} if long else seen

    def texts(self, texts: list[str]) -> list[tuple[bytes, str]]:
        if not self.by_runs:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [(np.array(e.ids, "<u4").tobytes(), self.tokenizer.decode(e.ids, skip_special_tokens=False)) for e in found]
        split = [t.split() if not _ODD.search(t) else _RUN.findall(t) for t in texts]
        known = self.runs(list(chain.from_iterable(split)))
        out = []
        for s in split:
            ids = b"".join([known[r] for r in s])
            out.append((ids, self.decode(np.frombuffer(ids, "<u4").tolist())))
        return out

    # Pieces of one unsplit run: its text, ids and the tokens' starts.
    def piece(self, text: str):
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return text, list(e.ids), [o[0] for o in e.offsets]

    def join(self, left, right):
        """One piece from two whose texts meet inside a run."""
        if not left[0] or not right[0]:
            return left if left[0] else right
        text, cut = left[0] + right[0], len(left[0])
        size = WINDOW
        while True:
            i = max(0, bisect_right(left[2], cut - size) - 1) if cut > size else 0
            a = left[2][i] if cut > size else 0
            while i and left[2][i - 1] == a:  # several tokens of one character start together
                i -= 1
            b = cut + size
            j = bisect_left(right[2], size)
            b = cut + right[2][j] if j < len(right[2]) else len(text)
            _, ids, starts = self.piece(text[a:b])
            starts = [s + a for s in starts]
            p = 0 if a == 0 else self._agree(left[1], left[2], ids, starts, cut - size // 4)
            q = None
            if b == len(text):
                q = (len(ids), len(right[1]))
            else:
                q = self._agree_right(ids, starts, right[1], [s + cut for s in right[2]], cut + size // 4)
            if p is not None and q is not None:
                keep, skip = (0, 0) if a == 0 else p
                end, resume = q
                if skip <= end:
                    return (
                        text,
                        left[1][:keep] + ids[skip:end] + right[1][resume:],
                        left[2][:keep] + starts[skip:end] + [s + cut for s in right[2][resume:]],
                    )
            if a == 0 and b == len(text):
                return text, ids, starts
            size *= 2

    @staticmethod
    def _agree(old, old_starts, new, new_starts, before: int):
        """The last place before ``before`` where AGREE tokens of both are the same: counts of old tokens to keep and of new ones to skip."""
        at = {s: k for k, s in enumerate(new_starts)}
        for k in range(bisect_left(old_starts, before) - 1, AGREE - 1, -1):
            if old_starts[k] < new_starts[0]:
                return None
            n = at.get(old_starts[k])
            if n is not None and n >= AGREE and all(old[k - d] == new[n - d] and old_starts[k - d] == new_starts[n - d] for d in range(AGREE + 1)):
                return k, n
        return None

    @staticmethod
    def _agree_right(new, new_starts, old, old_starts, after: int):
        """The first place after ``after`` where AGREE tokens are the same: where the new ones end and the old ones go on."""
        at = {s: k for k, s in reversed(list(enumerate(old_starts)))}
        for n in range(bisect_left(new_starts, after), len(new) - AGREE - 1):
            k = at.get(new_starts[n])
            if k is not None and k + AGREE < len(old) and all(new[n + d] == old[k + d] and new_starts[n + d] == old_starts[k + d] for d in range(AGREE + 1)):
                return n, k
        return None

    def leaf(self, text: str):
        """(head, middle, tail): first and last run as pieces, for joins, and the ids between; only a head if nothing splits the leaf."""
        spans = [m.span() for m in _RUN.finditer(text)]
        if spans == [(0, len(text))]:
            return self.piece(text), None, None
        head = self.piece(text[: spans[0][1]]) if spans and spans[0][0] == 0 else ("", [], [])
        tail = self.piece(text[spans[-1][0] :]) if spans and spans[-1][1] == len(text) else ("", [], [])
        inner = [text[s:e] for s, e in spans if s > 0 and e < len(text)]
        known = self.runs(inner)
        return head, b"".join([known[r] for r in inner]), tail

    def together(self, nodes: list):
        """The ids of a text from its leaves, put together pairwise."""
        pack = lambda piece: np.array(piece[1], "<u4").tobytes()
        while len(nodes) > 1:
            up = []
            for k in range(0, len(nodes) - 1, 2):
                (h1, m1, t1), (h2, m2, t2) = nodes[k], nodes[k + 1]
                if m1 is None and m2 is None:
                    up.append((self.join(h1, h2), None, None))
                elif m1 is None:
                    up.append((self.join(h1, h2), m2, t2))
                elif m2 is None:
                    up.append((h1, m1, self.join(t1, h2)))
                else:
                    up.append((h1, m1 + pack(self.join(t1, h2)) + m2, t2))
            nodes = up + ([nodes[-1]] if len(nodes) % 2 else [])
        head, middle, tail = nodes[0]
        return pack(head) + (b"" if middle is None else middle + pack(tail))


_codecs: dict[str, Codec] = {}


def codec_of(path: str, cached: int) -> Codec:
    """A Python worker's tokenizer and runs last from task to task, within the bound that the last caller set."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    _codecs[path].cached = cached
    return _codecs[path]


def bpe(docs: DataFrame, path: str, keep: list[str] | None = None, text_col: str = "text", leaf_chars: int = LEAF_CHARS, cached_runs: int = CACHED_RUNS) -> DataFrame:
    """Returns ``_row`` (the columns to keep), ``ids`` (little-endian unsigned 32-bit) and ``decoded`` for each row.

    A worker keeps at most twice ``cached_runs`` short runs, about 0.4 KB each: fewer take less memory and more time.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(packed(docs, keep=keep), text.alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, cached_runs)
        for b in batches:
            text, begin = b.column("_text"), 0
            lengths = pc.utf8_length(text).to_pylist()
            while begin < len(lengths):
                end, size = begin, 0
                while end < len(lengths) and (size < SLICE_CHARS or end == begin):
                    size += lengths[end]
                    end += 1
                found = codec.texts(text.slice(begin, end - begin).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("_row").slice(begin, end - begin), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], names=["_row", "ids", "decoded"])
                begin = end

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t in zip(b.column("_key").to_pylist(), (x.as_py() for x in b.column("_text"))):
                leaves = [t[i : i + leaf_chars] for i in range(0, len(t), leaf_chars)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(leaves)), pa.array(range(len(leaves)), pa.int32()), pa.array(leaves)], names=["_key", "_at", "_leaf"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, cached_runs)
        for b in batches:
            nodes = [zstandard.compress(pickle.dumps(codec.leaf(t.as_py())), 1) for t in b.column("_leaf")]
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_at"), pa.array(nodes, pa.binary())], names=["_key", "_at", "_node"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, cached_runs)
        for b in batches:
            for key, nodes in zip(b.column("_key").to_pylist(), b.column("_nodes")):
                ids = codec.together([pickle.loads(zstandard.decompress(n["_node"])) for n in nodes.as_py()])
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids], pa.binary()), pa.array([codec.decode(np.frombuffer(ids, "<u4").tolist())])], names=["_key", "ids", "decoded"])

    # Other vocabularies are left to the library, text by text.
    is_long = F.length("_text") > leaf_chars if splits_at_spaces(Tokenizer.from_file(path)) else F.lit(False)
    narrow = rows.where(~is_long).mapInArrow(short, f"_row {kind}, ids binary, decoded string")
    long = rows.where(is_long).withColumn("_key", F.sha2("_text", 256))
    # Copies of a long text are cut once; a text's leaves are dealt over tasks one by one.
    leaves = long.groupBy("_key").agg(F.first("_text").alias("_text")).mapInArrow(cut, "_key string, _at int, _leaf string")
    nodes = leaves.repartition("_key", "_at").mapInArrow(encode, "_key string, _at int, _node binary")
    whole = nodes.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_at", "_node"))).alias("_nodes")).mapInArrow(join, "_key string, ids binary, decoded string")
    return narrow.unionByName(long.select("_row", "_key").join(whole, "_key").select("_row", "ids", "decoded"))
