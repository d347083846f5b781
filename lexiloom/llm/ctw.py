"""Language-model scoring by context-tree weighting over bytes, beside a unigram base score.

A text is coded as its lower-cased (A-Z) words, one space between two, and one end byte, so what the
model codes is exactly the token sequence that the base score counts. Every byte is split into eight
binary decisions; each has a context tree over the bytes before it, up to DEPTH. A tree node predicts
with a Krichevsky-Trofimov estimate and is mixed with what lies below it, half and half a priori, so
the prediction weighs all depths by how well they coded the training texts.

Training counts every byte of every training text: tasks pre-aggregate (context, byte) strings and Spark
adds them up. Every context that occurs is a node, so the model grows with the corpus. Contexts that
share their CUT nearest bytes make up one subtree; subtrees are dealt to buckets, which run the
recursion of their depths and hand their sums to the depths above. Those, at most 256^(CUT-1) contexts
whatever the corpus, are mixed on the driver. Scoring tasks pre-aggregate what their texts ask, slice by
slice; each bucket answers all slices' questions from its part of the table, and no task or driver
holds the table. Words with at least WORD_SHARE of all tokens (at most 1/WORD_SHARE) are looked up in
the scoring pass; all others, which cannot be hot, go through a shuffled join.

Defined results: null and empty texts are the end token alone; repeated rows score alike; with no
training text every bit has probability 1/2 and every token 1; an empty table gives no rows; other
columns pass through in ``_row``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, packed, written
from .shingles import words

DEPTH, CUT = 5, 3
SPREAD = 0x9E3779B1
WORD_SHARE = 2.0**-20
SLICE_BYTES = 8_000_000
PIECE = 1 << 15
HELD_GRAMS, HELD_WORDS = 3_000_000, 1_000_000
END = b"\n"


def coded(found: list[bytes]) -> bytes:
    return b" ".join(found) + END


def _buffer(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts, each after DEPTH end bytes; where each body starts, and its length."""
    sizes = np.array([len(x) for x in bodies], np.int64)
    a = np.frombuffer(b"".join([x for body in bodies for x in (END * DEPTH, body)]), np.uint8)
    return a, np.cumsum(sizes + DEPTH) - sizes, sizes


def _bits() -> tuple[int, int]:
    """Bits of a gram's head (its CUT nearest bytes) and of the rest."""
    cut = min(CUT, DEPTH)
    return 8 * cut, 8 * (DEPTH + 1 - cut)


def _spread(head: np.ndarray) -> np.ndarray:
    """Heads dealt evenly over their whole range, one to one, so that buckets are ranges of grams."""
    return head * SPREAD & ((1 << _bits()[0]) - 1)


def _gathered(head: np.ndarray) -> np.ndarray:
    return head * pow(SPREAD, -1, 1 << _bits()[0]) & ((1 << _bits()[0]) - 1)


def positions(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every byte's gram - the DEPTH bytes before it, the nearest highest, its head spread, and the byte itself lowest -; where each body's bytes start, and how many it has."""
    a, starts, sizes = _buffer(bodies)
    # At every place eight bytes as one integer: the DEPTH bytes before a byte, the nearest highest, and the byte above them.
    rows = np.ndarray(len(a) - DEPTH, "<i8", np.concatenate([a, np.zeros(8, np.uint8)]), 0, (1,))
    inside = np.ones(len(a), bool)
    for k in range(1, DEPTH + 1):
        inside[starts - k] = False
    inside, low = inside[DEPTH:], _bits()[1]
    out, have = np.empty(int(sizes.sum()), np.int64), 0
    for k in range(0, len(rows), PIECE):  # a piece's arrays stay in a core's cache, and beside the grams nothing of their size is held
        at = rows[k : k + PIECE][inside[k : k + PIECE]]
        code = (at & ((1 << 8 * DEPTH) - 1)) << 8 | at >> (8 * DEPTH) & 255
        out[have : have + len(code)] = _spread(code >> low) << low | code & ((1 << low) - 1)
        have += len(code)
    return out, np.cumsum(sizes) - sizes, sizes


def gram_counts(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their counts."""
    gram = positions(bodies)[0]
    gram.sort()
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    return gram[starts], np.diff(starts, append=len(gram))


def _distinct(gram: np.ndarray) -> np.ndarray:
    gram = np.sort(gram)
    return gram[np.concatenate([[True], gram[1:] != gram[:-1]])] if len(gram) else gram


def _values(code: np.ndarray, distinct: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each gram from those of the distinct ones in order; in pieces whose places fit beside a gram in one integer, so that a plain sort does."""
    out, bits = np.empty(len(code)), np.uint64(64 - 8 * (DEPTH + 1))
    step = 1 << int(min(bits, 16))
    for i in range(0, len(code), step):
        piece = code[i : i + step].astype(np.uint64)
        held = np.sort(piece << bits | np.arange(len(piece), dtype=np.uint64))
        gram = (held >> bits).astype(np.int64)
        new = np.concatenate([[True], gram[1:] != gram[:-1]])
        out[i + (held & np.uint64(step - 1)).astype(np.int64)] = values[np.searchsorted(distinct, gram[new])][np.cumsum(new) - 1]
    return out


def counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(gram, null, n) and (null, word, n) over all texts; the end token is the row where both are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, ends, seen = [], 0, 0, Counter()

        def batch(g, n, w, m):
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(g, pa.int64()), pa.nulls(len(w), pa.int64())]), pa.concat_arrays([pa.nulls(len(g), pa.binary()), pa.array(w, pa.binary())]), pa.concat_arrays([pa.array(n, pa.int64()), pa.array(m, pa.int64())])],
                names=["gram", "word", "n"],
            )

        def merged():
            return _summed(*(np.concatenate(x) for x in zip(*grams)))

        def flush_grams():
            code, n = merged()
            return batch(code, n, [], [])

        for b in batches:
            texts, begin = b.column("text").to_pylist(), 0
            while begin < len(texts):
                bodies, size = [], 0
                while begin < len(texts) and size < SLICE_BYTES:
                    found = words(texts[begin])
                    seen.update(found)
                    bodies.append(coded(found))
                    size += len(bodies[-1])
                    begin += 1
                ends += len(bodies)
                grams.append(gram_counts(bodies))
                held += len(grams[-1][0])
                if held > HELD_GRAMS:
                    grams[:] = [merged()]
                    held = len(grams[0][0])
                    if held > HELD_GRAMS // 2:
                        yield flush_grams()
                        grams, held = [], 0
                if len(seen) > HELD_WORDS:
                    yield batch([], [], list(seen), list(seen.values()))
                    seen.clear()
        if grams:
            yield flush_grams()
        yield batch([], [], [*seen, None], [*seen.values(), ends])

    raw = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "gram long, word binary, n long")
    return raw.groupBy("gram", "word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    grams: DataFrame  # (gram, n): every context and byte of the training texts
    top: list  # depths below CUT, each a list of eight levels' (entries, gathered, left)
    words: dict  # log10(c + 0.1) of frequent words
    end: float
    known_end: bool
    total: int
    distinct: int
    light: DataFrame | None  # (word, n) of all other words


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


_HALVES, _WHOLES = (np.concatenate([[np.log(np.pi) / 2 if at == 0.5 else 0.0], _lgamma(np.arange(1, 4096) + at)]) for at in (0.5, 1.0))


def _log_kt_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """``_log_kt`` of whole counts: small ones from tables."""
    both = zeros + ones
    low = np.minimum(both, 4095)
    out = _HALVES[np.minimum(zeros, 4095)] + _HALVES[np.minimum(ones, 4095)] - _WHOLES[low] - np.log(np.pi)
    large = np.flatnonzero(both > 4095)
    out[large] = _log_kt(zeros[large].astype(np.float64), ones[large].astype(np.float64))
    return out


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Rising with the gram; the same as ``bucket_column``."""
    head, low = _bits()
    return (gram >> low) * buckets >> head


def bucket_column(gram: Column, buckets: int) -> Column:
    head, low = _bits()
    return F.shiftright(F.shiftright(gram, low) * F.lit(buckets), head).cast("int")


def _buckets(spark: SparkSession) -> int:
    return max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _entry(code: np.ndarray, depth: int, level: int) -> np.ndarray:
    """A node's decision: its context of so many bytes, and the ``level`` highest bits of the coded byte."""
    return (code >> (8 * (DEPTH + 1 - depth))) << level | (code & 255) >> (8 - level)


def _parent(entry: np.ndarray, depth: int, level: int) -> np.ndarray:
    """The decision of the next shorter context; from CUT up, heads are as they were before they were spread."""
    context, prefix = entry >> level, entry & ((1 << level) - 1)
    if depth == min(CUT, DEPTH):
        context = _gathered(context)
    return context >> 8 << level | prefix


def _summed(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    if len(keys) and (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys)
        keys, columns = keys[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[starts], *(np.add.reduceat(c, starts) if len(starts) else c for c in columns)]


def _mixed(depth: int, entry: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A depth's log probabilities, and the weights of the nodes' own estimates against what lies below."""
    estimate = _log_kt_counts(zeros, ones)
    if depth == DEPTH:
        return estimate, np.ones(len(entry))
    mixed = np.logaddexp(estimate, below) - np.log(2)
    return mixed, np.exp(estimate - np.log(2) - mixed)


def subtrees(code: np.ndarray, n: np.ndarray) -> Iterator[tuple[dict, tuple]]:
    """From whole subtrees' grams, level by level: depth -> (entries, zeros, ones, weights) from CUT down, and what the level hands to the depth above (entries, zeros, ones, log probabilities below)."""
    cut = min(CUT, DEPTH)
    for level in range(8):
        held = {}
        bit = (code >> (7 - level)) & 1
        entry, zeros, ones = _summed(_entry(code, DEPTH, level), n * (1 - bit), n * bit)
        below = np.zeros(len(entry))
        for depth in range(DEPTH, cut - 1, -1):
            mixed, weight = _mixed(depth, entry, zeros, ones, below)
            held[depth] = entry, zeros, ones, weight
            entry, zeros, ones, below = _summed(_parent(entry, depth, level), zeros, ones, mixed)
        yield held, (entry, zeros, ones, below)


def _downward(depth: int, level: int, entry, zeros, ones, weight, before) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries, the probability of a one gathered down to each, and the share left to what lies below it."""
    gathered, left = 0.0, 1.0
    if before is not None:
        at = np.searchsorted(before[0], _parent(entry, depth, level))
        gathered, left = before[1][at], before[2][at]
    return entry, gathered + left * weight * (ones + 0.5) / (zeros + ones + 1), left * (1 - weight)


def _ordered(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    gram, n = part.column("gram").to_numpy(), part.column("n").to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order]


def top_depths(grams: DataFrame) -> list:
    """The depths above CUT of the whole tree."""

    def run(part: pa.Table) -> pa.Table:
        above = (a for _, a in subtrees(*_ordered(part)))
        columns = [np.concatenate(x) for x in zip(*((np.full(len(a[0]), level), *a) for level, a in enumerate(above)))]
        return pa.table(dict(zip(("level", "entry", "zeros", "ones", "below"), columns)))

    dealt = grams.select("gram", "n", bucket_column(F.col("gram"), _buckets(grams.sparkSession)).alias("bucket"))
    parts = dealt.groupBy("bucket").applyInArrow(run, "level long, entry long, zeros long, ones long, below double")
    sums = parts.groupBy("level", "entry").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()  # at most 256^(CUT - 1) contexts, whatever the corpus
    columns = {c: sums.column(c).to_numpy() for c in sums.column_names}
    depths = [[None] * 8 for _ in range(min(CUT, DEPTH))]
    for level in range(8):
        own = np.flatnonzero(columns["level"] == level)
        own = own[np.argsort(columns["entry"][own])]
        entry, zeros, ones, below = (columns[c][own] for c in ("entry", "zeros", "ones", "below"))
        up = []
        for depth in range(len(depths) - 1, -1, -1):
            mixed, weight = _mixed(depth, entry, zeros, ones, below)
            up.append((depth, entry, zeros, ones, weight))
            entry, zeros, ones, below = _summed(_parent(entry, depth, level), zeros, ones, mixed)
        before = None
        for depth, *node in reversed(up):
            before = depths[depth][level] = _downward(depth, level, *node, before)
    return depths


def answers(code: np.ndarray, n: np.ndarray, asked: np.ndarray, top: list) -> np.ndarray:
    """log10 probabilities of the asked grams, whose subtrees' grams are all given; both in order."""
    low = _bits()[1]
    plain = _gathered(asked >> low) << low | asked & ((1 << low) - 1)
    out = np.zeros(len(asked))
    for level, (held, _) in enumerate(subtrees(code, n)):
        gathered, left, alive = np.zeros(len(asked)), np.ones(len(asked)), np.ones(len(asked), bool)
        before = None
        for depth in range(DEPTH + 1):
            before = top[depth][level] if depth < len(top) else _downward(depth, level, *held[depth], before)
            if not len(before[0]):
                break
            entry = _entry(plain if depth < len(top) else asked, depth, level)
            at = np.minimum(np.searchsorted(before[0], entry), len(before[0]) - 1)
            alive &= before[0][at] == entry
            gathered, left = np.where(alive, before[1][at], gathered), np.where(alive, before[2][at], left)
        p = np.clip(gathered + left / 2, 1e-12, 1 - 1e-12)  # a decision that no text has come to is even
        out += np.log10(np.where((asked >> (7 - level)) & 1, p, 1 - p))
    return out


def _packed_codes(code: np.ndarray) -> bytes:
    steps = np.diff(code, prepend=0)
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked_codes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel())


def train(docs: DataFrame, text_col: str = "text") -> Model:
    bounded_batches(docs.sparkSession, SLICE_BYTES)
    found = written(counts(docs, text_col))
    grams = found.where("gram IS NOT NULL")
    tokens = found.where("gram IS NULL")
    totals = tokens.agg(F.sum("n").alias("total"), F.count(F.when(F.col("n") > 0, 1)).alias("distinct"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("ends")).first()
    total, ends = totals.total or 0, totals.ends or 0
    top = top_depths(grams)
    words_only = tokens.where("word IS NOT NULL")
    frequent = words_only.where(F.col("n") >= total * WORD_SHARE).select("word", "n").toArrow()  # at most 1 / WORD_SHARE words
    known = dict(zip(frequent.column("word").to_pylist(), np.log10(frequent.column("n").to_numpy() + 0.1).tolist()))
    return Model(grams.select("gram", "n"), top, known, float(np.log10(ends + 0.1)), ends > 0, int(total), int(totals.distinct or 0), words_only.where(F.col("n") < total * WORD_SHARE).select("word", "n"))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``_row``, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for each row."""
    framed = docs.select(packed(docs, keep=keep), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    spark = docs.sparkSession
    bounded_batches(spark, SLICE_BYTES)
    shared, top, buckets = spark.sparkContext.broadcast((model.words, model.end, model.known_end)), spark.sparkContext.broadcast(model.top), _buckets(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, known_end = shared.value
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            texts, begin = b.column("_text").to_pylist(), 0
            while begin < len(texts):
                bodies, size, first = [], 0, begin
                crc, tokens, hits, base, light, edge = [], [], [], [], [], [0]
                while begin < len(texts) and size < SLICE_BYTES:
                    found = words(texts[begin])
                    bodies.append(coded(found))
                    size += len(bodies[-1])
                    total, n_known, rare = end, int(known_end), []
                    for w, n in Counter(found).items():
                        c = known.get(w)
                        if c is None:
                            rare.append((w, n))
                        else:
                            total += n * c
                            n_known += n
                    crc.append(zlib.crc32((texts[begin] or "").encode("utf-8", "replace")))
                    tokens.append(len(found) + 1), hits.append(n_known), base.append(total)
                    light += [*rare, (None, 1)] if rare else []
                    edge.append(len(light))
                    begin += 1
                arrays = [b.column("_row").slice(first, begin - first), b.column("_id").slice(first, begin - first), pa.array(crc, pa.int64()), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64())]
                sizes = np.array([len(x) for x in bodies], np.int64)
                grams = _distinct(positions(bodies)[0])
                own = bucket_of(grams, buckets)
                edges = np.flatnonzero(np.diff(own, prepend=-1))
                asks = [{"bucket": int(own[i]), "codes": _packed_codes(grams[i:j])} for i, j in zip(edges, [*edges[1:], len(own)])]
                body = zstandard.ZstdCompressor(1).compress(np.int64(len(sizes)).tobytes() + sizes.tobytes() + b"".join(bodies))
                count = len(bodies)
                arrays += [pa.array(sizes), pa.array(np.full(count, number)), pa.array(np.arange(count)), pa.array([body] + [None] * (count - 1), pa.binary())]
                arrays.append(pa.array([asks] + [None] * (count - 1), pa.list_(pa.struct([("bucket", pa.int32()), ("codes", pa.binary())]))))
                word, n = zip(*light) if light else ((), ())
                arrays.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([pa.array(word, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])))
                number += 1
                yield pa.RecordBatch.from_arrays(arrays, names=["_row", "_id", "_crc", "n_tokens", "_hits", "_base", "_bytes", "_slice", "_at", "_body", "_asks", "_light"])

    def answer(key, own: pa.Table, asking: pa.Table) -> pa.Table:
        asked = [_unpacked_codes(x) for x in asking.column("codes").to_pylist()]
        distinct = _distinct(np.concatenate([np.zeros(0, np.int64), *asked]))
        logp = answers(*_ordered(own), distinct, top.value).astype(np.float32)
        found = [logp[np.searchsorted(distinct, x)].tobytes() for x in asked]
        return pa.table({"_slice": asking.column("_slice"), "bucket": asking.column("bucket"), "logp": pa.array(found, pa.binary())})

    def add_up(key, bodies: pa.Table, found: pa.Table) -> pa.Table:
        raw = zstandard.ZstdDecompressor().decompress(bodies.column("_body")[0].as_py())
        count = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes = np.frombuffer(raw, np.int64, count, 8)
        ends = 8 * (count + 1) + np.cumsum(sizes)
        texts = [raw[e - x : e] for x, e in zip(sizes, ends)]
        by = np.argsort(found.column("bucket").to_numpy())
        logp = np.frombuffer(b"".join(found.column("logp").take(pa.array(by)).to_pylist()), np.float32)  # of the distinct grams, in order
        del raw
        code, starts, own = positions(texts)
        p = _values(code, _distinct(code), logp)
        del code, texts
        # Every text has its end byte, so no sum is of nothing.
        return pa.table({"_slice": pa.array(np.full(count, key[0].as_py())), "_at": pa.array(np.arange(count)), "score": pa.array(np.add.reduceat(p, starts))})

    schema = f"_row {framed.schema['_row'].dataType.simpleString()}, _id long, _crc long, n_tokens long, _hits long, _base double, _bytes long, _slice long, _at long, _body binary, _asks array<struct<bucket: int, codes: binary>>, _light array<struct<word: binary, n: long>>"
    framed = written(framed.mapInArrow(run, schema))
    asks = framed.where("_asks IS NOT NULL").select("_slice", F.explode("_asks").alias("ask")).select("_slice", "ask.bucket", "ask.codes")
    dealt = model.grams.select("gram", "n", bucket_column(F.col("gram"), buckets).alias("bucket"))
    found = dealt.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(answer, "_slice long, bucket int, logp binary")
    bodies = framed.where("_body IS NOT NULL").select("_slice", "_body")
    scores = bodies.groupBy("_slice").cogroup(found.groupBy("_slice")).applyInArrow(add_up, "_slice long, _at long, score double")
    scored = framed.drop("_body", "_asks").join(scores, ["_slice", "_at"])
    rare = framed.where(F.size("_light") > 0).select("_id", "_crc", F.explode("_light").alias("w")).select("_id", "_crc", "w.word", F.col("w.n").alias("times"))
    looked = rare.where("word IS NOT NULL").join(model.light, "word", "left")
    # Rows repeated in (id, checksum) add their rare words together; each has brought one mark to divide by.
    parts = looked.select("_id", "_crc", (F.log10(F.coalesce("n", F.lit(0)) + 0.1) * F.col("times")).alias("add"), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("hit"), F.lit(0).alias("mark"))
    marks = rare.where("word IS NULL").select("_id", "_crc", F.lit(0.0).alias("add"), F.lit(0).cast("long").alias("hit"), F.lit(1).alias("mark"))
    added = parts.unionByName(marks).groupBy("_id", "_crc").agg(F.sum("add").alias("add"), F.sum("hit").alias("hit"), F.sum("mark").alias("mark")).withColumnsRenamed({"_id": "_rid", "_crc": "_rcrc"})
    both = scored.join(added, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_crc") == F.col("_rcrc")), "left")
    floor = float(np.log10(model.total + 0.1 * (model.distinct + 1)))
    return both.select(
        "_row",
        "n_tokens",
        (F.col("_hits") + F.coalesce((F.col("hit") / F.col("mark")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce(F.col("add") / F.col("mark"), F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        "score",
        (F.col("score") / -np.log10(2.0) / F.col("_bytes")).alias("bits_per_byte"),
    )
