"""Toxicity by compression distance: two zstandard dictionaries, word windows, calibrated thresholds.

Training takes a bounded sample of labelled rows (``MAX_TOXIC_ROWS``, ``MAX_ORDINARY_ROWS`` whole
texts, ``MAX_SAMPLE_BYTES`` bytes; smallest row hashes first, so the sample does not depend on the
layout) and everything else covers all rows. Half of the sample trains the dictionaries:

* the ordinary dictionary is trained on all windows of the ordinary texts;
* the toxic dictionary is trained on all that the toxic texts say and the ordinary ones do not: the stretches
  whose every GRAM bytes occur in no ordinary text of the half and in ``MIN_TEXTS`` toxic ones. Trained on whole
  windows it would hold what both classes share, as most windows of a toxic text are ordinary. For the same
  reason it stands before the ordinary dictionary's content, so that this cancels out and the two lengths
  differ by toxic segments alone.

A text is cut into windows of ``WINDOW_WORDS`` lower-cased words, or of ``WINDOW_BYTES`` where words are long or
not parted at all. For each, the bytes that the toxic
dictionary saves against the ordinary one are compared with thresholds that the other half of the
sample calibrates: the counts of windows beyond each threshold go into a logistic score.

Defined results: null and empty texts score as texts without windows; ties and repeated rows score
alike; without labelled rows of both classes the score is the prior of toxic rows (0.5 if none).
Labels, language, source and ids are never inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, packed

MAX_TOXIC_ROWS, MAX_ORDINARY_ROWS, MAX_SAMPLE_BYTES = 2000, 3000, 32_000_000
WINDOW_WORDS, WINDOW_BYTES, WINDOW_OVERLAP = 8, 256, 32
GRAM, MIN_TEXTS, TRIM = 6, 4, 3
ORDINARY_DICT, TOXIC_DICT = 8192, 2048
ORDINARY_SEGMENT, TOXIC_SEGMENT = 64, 12
LEVEL, MIN_MATCH = 5, 5
THRESHOLDS = (1, 2, 3, 4, 5)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray


def windows(text: str | None, n: int = WINDOW_WORDS, most: int = WINDOW_BYTES, overlap: int = WINDOW_OVERLAP) -> list[bytes]:
    """The whole text as consecutive windows of n words, lower-cased; one of more than ``most`` bytes, as texts without blanks are, is cut into windows of that size that overlap."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    out = [b" " + b" ".join(words[i : i + n]) + b" " for i in range(0, len(words), n)]
    if any(len(w) > most for w in out):
        out = [w[i : i + most] for w in out for i in range(0, max(1, len(w) - overlap), most - overlap)]
    return out


def _compressor(content: bytes):
    how = zstandard.ZstdCompressionParameters(window_log=15, hash_log=14, chain_log=14, search_log=5, min_match=MIN_MATCH, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress


def savings(texts: list[str | None], ordinary, toxic) -> list[np.ndarray]:
    """For each text and window, the bytes that the toxic dictionary saves."""
    return [np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in windows(t)), np.int32) for t in texts]


def features(saved: list[np.ndarray]) -> np.ndarray:
    """Bias, log count of windows beyond each threshold, largest saving, log of their share."""
    out = np.zeros((len(saved), len(THRESHOLDS) + 3))
    out[:, 0] = 1
    for i, s in enumerate(saved):
        if len(s):
            beyond = [(s >= t).sum() for t in THRESHOLDS]
            out[i, 1 : 1 + len(THRESHOLDS)] = np.log1p(beyond)
            out[i, -2] = max(0, s.max()) / 4
            out[i, -1] = np.log1p(1000 * beyond[2] / len(s))
    return out


def _grams(text: bytes) -> np.ndarray:
    """Every GRAM bytes in a row as an integer."""
    a = np.frombuffer(text, np.uint8).astype(np.int64)
    n = max(0, len(a) - GRAM + 1)
    return sum((a[k : k + n] << (8 * (GRAM - 1 - k)) for k in range(GRAM)), np.zeros(n, np.int64))


def stretches(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """What toxic texts say and ordinary ones do not: runs of telling grams, without TRIM bytes at either end, which belong to the words beside them."""
    plain = lambda t: b" " + b" ".join(t.lower().encode("utf-8", "replace").split()) + b" "
    gram, texts = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(_grams(plain(t))) for t in toxic)]), return_counts=True)
    telling = gram[texts >= MIN_TEXTS]
    del gram, texts
    stays = np.ones(len(telling), bool)
    for t in ordinary if len(telling) else []:  # one by one: all their grams would take many times what they say
        grams = _grams(plain(t))
        at = np.minimum(np.searchsorted(telling, grams), len(telling) - 1)
        stays[at[telling[at] == grams]] = False
    telling = telling[stays]
    out = []
    for text in map(plain, toxic):
        runs = np.flatnonzero(np.diff(np.isin(_grams(text), telling).astype(np.int8), prepend=0, append=0))
        out += [x for i, j in zip(runs[::2], runs[1::2]) if len(x := text[i + TRIM : j + GRAM - 1 - TRIM]) >= GRAM]
    return out


def _apart(texts: list[str]) -> list[str]:
    """Without texts that share over a tenth of their five-word shingles with earlier ones: copies are no new evidence."""
    held = []
    for t in texts:
        words = t.lower().split()
        held.append(np.unique(np.fromiter((hash(tuple(words[i : i + 5])) for i in range(max(1, len(words) - 4))), np.int64)))
    if not held:
        return []
    # As arrays: a set of all shingles takes some 100 bytes for each in the driver.
    sizes = np.array([len(x) for x in held])
    owner, shingle = np.repeat(np.arange(len(held), dtype=np.int32), sizes), np.concatenate(held)
    del held
    order = np.argsort(shingle, kind="stable").astype(np.int32)
    shingle = shingle[order]
    first = np.bincount(owner[order[np.concatenate([[True], shingle[1:] != shingle[:-1]])]], minlength=len(sizes))
    return [t for t, n, new in zip(texts, sizes, first) if (n - new) * 10 <= n]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """COVER training; where zstandard declines (too few samples) the samples themselves, most frequent last."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(w for w, _ in reversed(Counter(samples).most_common()))[-size:]


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    toxic, ordinary = _apart(toxic), _apart(ordinary)
    prior = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1)
    flat = np.zeros(len(THRESHOLDS) + 3)
    flat[0] = np.log(prior / (1 - prior))
    if min(len(toxic), len(ordinary)) < 4:
        return Model(b"", b"", flat)
    learn_t, learn_o, rest_t, rest_o = toxic[::2], ordinary[::2], toxic[1::2], ordinary[1::2]
    base = _trained([w for t in learn_o for w in windows(t)], ORDINARY_DICT, ORDINARY_SEGMENT)  # all windows: the sample itself is bounded
    model = Model(base, _trained(stretches(learn_t, learn_o), TOXIC_DICT, TOXIC_SEGMENT) + base, flat)
    tools = _compressor(model.ordinary), _compressor(model.toxic)
    x = features(savings(rest_t + rest_o, *tools))
    y = np.r_[np.ones(len(rest_t)), np.zeros(len(rest_o))]
    w = flat.copy()
    ridge = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(40):  # Newton steps of a logistic fit
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
    model.weights = w
    return model


def scores(texts: list[str | None], model: Model, tools) -> np.ndarray:
    saved = savings(texts, *tools) if tools else [np.zeros(0)] * len(texts)
    return 1 / (1 + np.exp(-np.clip(features(saved) @ model.weights, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int | None = None, ordinary_rows: int | None = None, sample_bytes: int | None = None) -> dict[int, list[str]]:
    """Distinct whole texts of each class: at most so many rows, smallest id hashes first, up to half of ``sample_bytes`` each; a text that would pass that is left out. Without numbers MAX_TOXIC_ROWS, MAX_ORDINARY_ROWS and MAX_SAMPLE_BYTES hold.

    Labels are cut to the row bound before any text is read, then the rows that they meet, then their
    bytes: what is broadcast and what comes to the driver stay bounded however often an id repeats.
    """
    ids = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"), F.xxhash64(f"`{id_col}`").alias("_order")).where(F.col("_id").isNotNull())
    bounds = {1: toxic_rows or MAX_TOXIC_ROWS, 0: ordinary_rows or MAX_ORDINARY_ROWS}
    first = lambda c: ids.where(F.col("_label") == c).orderBy("_order", "_id").limit(bounds[c])
    picked = [tuple(r) for c in bounds for r in first(c).collect()]
    out: dict[int, list] = {0: [], 1: []}
    if not picked:
        return out
    spark, kind = docs.sparkSession, ids.schema.simpleString()[7:-1].replace(":", " ")
    digest = F.md5(F.col("_text").cast("binary")).alias("_digest")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).where(F.col("_text").isNotNull())
    met = texts.join(F.broadcast(spark.createDataFrame(picked, kind)), "_id").select("_id", "_label", "_order", digest, F.octet_length("_text").alias("_size")).distinct()
    keep = []
    for c in bounds:
        total = 0
        for r in met.where(F.col("_label") == c).orderBy("_order", "_id", "_digest").limit(bounds[c]).collect():
            if total + r._size <= (sample_bytes or MAX_SAMPLE_BYTES) // 2:
                total += r._size
                keep.append((r._id, r._label, r._order, r._digest))
    if keep:
        found = texts.select("_id", "_text", digest).join(F.broadcast(spark.createDataFrame(keep, f"{kind}, _digest string")), ["_id", "_digest"])
        for r in found.groupBy("_id", "_label", "_order", "_digest").agg(F.first("_text").alias("_text")).collect():
            out[r._label].append((r._order, r._digest, r._text))
    return {c: [t for _, _, t in sorted(out[c])] for c in out}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **bounds: int) -> Model:
    """``bounds``: toxic_rows, ordinary_rows and sample_bytes of the sample."""
    found = sample(docs, labels, id_col, text_col, label_col, **bounds)
    return fit(found[1], found[0])


def toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5) to each row, given as ``_row``; one narrow pass."""
    bounded_batches(docs.sparkSession)
    framed = docs.select(packed(docs, keep=keep), F.col(f"`{text_col}`").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of some KB and eight weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tools = (_compressor(m.ordinary), _compressor(m.toxic)) if m.toxic else None
        for b in batches:
            s = scores(b.column("_text").to_pylist(), m, tools)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["_row", "score", "predicted"])

    return framed.mapInArrow(run, f"_row {framed.schema['_row'].dataType.simpleString()}, score double, predicted int")
