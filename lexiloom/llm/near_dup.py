"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components.

A document's set holds the hashes of its distinct five-word shingles. Documents with equal sets fall
together first; of each, the smallest doc_id stands for all; a doc_id with several texts is one node
that all of them stand for, linked with the representatives of each. A representative has BANDS x ROWS
MinHash samples. Bands give candidates; the samples folded into a parity bitmap (the odd sketch) give
the similarity of a candidate pair from the bits that differ, most precisely where similarity is high.
Pairs that the sketch leaves above ``SKETCH_FLOOR`` (almost four standard errors below the threshold)
go on. A second bitmap holds the parities of the whole set: bits that differ never exceed the elements
that differ, so more of them than the threshold allows rule a pair out without any loss. The rest are
confirmed on the full sets.

Nothing pairs all members of a band's bucket. Each member meets the bucket's smallest first, and what
that links is joined into components. Only members outside the component of the bucket's first then
meet the bucket's members of other components: two members of one component need no comparison, so
no component is lost and a bucket of n copies costs n comparisons.

Defined results: null and empty texts have no set, link with nothing and are kept; so do rows with a
null doc_id (component null); rows that repeat a doc_id are one node and share its component; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import bounded_batches, counted, sized, written
from .graph import components, components_with
from .shingles import mixed, shingle_set

BANDS, ROWS = 40, 5
SKETCH_BITS = 1024
SHARE, OF = 75, 100
SKETCH_FLOOR = 0.62
STEPS = (0.8, SKETCH_FLOOR)

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_SALT = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def samples(hashes: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set, in blocks that stay in cache."""
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    best = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 256):
        block = np.multiply.outer(low[i : i + 256], _A)
        block += _B
        block ^= block >> np.uint32(15)
        np.minimum(best, block.min(0), out=best)
    return best


def folded(found: np.ndarray) -> np.ndarray:
    """The odd sketch: sample i flips one of SKETCH_BITS bits; as signed 64-bit words."""
    at = mixed(found.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _SALT) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """The set's own odd sketch: every element flips one of SKETCH_BITS bits."""
    odd = np.bincount(((hashes >> np.uint64(13)) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_keys(found: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mixed(key + found[k::ROWS].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return key.view(np.int64)


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, digest of the set, band keys, sketch and parities of every row; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, bands, sketch, parity = [], [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t)
                n.append(len(s))
                if len(s):
                    m = samples(s)
                    digest.append(xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(m))
                    sketch.append(folded(m))
                    parity.append(parities(s))
                else:
                    digest.append(None), bands.append(None), sketch.append(None), parity.append(None)
            longs = [pa.array(x, pa.list_(pa.int64())) for x in (bands, sketch, parity)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *longs], names=["id", "n", "digest", "bands", "sketch", "parity"])

    framed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return framed.mapInArrow(run, "id long, n long, digest binary, bands array<long>, sketch array<long>, parity array<long>")


def sets(docs: DataFrame, ids: DataFrame, n_ids: int, id_col: str, text_col: str) -> DataFrame:
    """The full shingle sets of the documents in ``ids``, which has ``n_ids`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t).view(np.int64) for t in b.column("text").to_pylist()]
            digest = pa.array([xxh3_128_digest(x.tobytes()) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), digest, pa.array(found, pa.list_(pa.int64()))], names=["id", "digest", "set"])

    framed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return framed.join(sized(ids, n_ids), "id", "left_semi").mapInArrow(run, "id long, digest binary, set array<long>")


def differing(x: Column, y: Column) -> Column:
    return sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(x[0].bitwiseXOR(y[0])))


def possible(a: str, b: str) -> Column:
    """Whether sizes and parities leave the threshold within reach; never false for a pair that reaches it."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    return (F.least(n, m) * OF >= F.greatest(n, m) * SHARE) & (differing(F.col(f"parity{a}"), F.col(f"parity{b}")) * (OF + SHARE) <= (n + m) * (OF - SHARE))


def sketch_similarity(x: Column, y: Column) -> Column:
    """Jaccard similarity from two odd sketches; 0 where too many bits differ to tell."""
    differ = differing(x, y)
    return F.when(differ * 2 >= SKETCH_BITS, 0.0).otherwise(1 + SKETCH_BITS / (4.0 * BANDS * ROWS) * F.log(1 - 2.0 * differ / SKETCH_BITS))


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The pairs (a, b) whose sketches are near and whose full sets are similar enough, and their number."""
    side = lambda x: reps.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch", "parity")])
    near, n = counted(
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(possible("_a", "_b") & (sketch_similarity(F.col("sketch_a"), F.col("sketch_b")) >= SKETCH_FLOOR))
        .select("a", "b")
        .distinct()
    )
    if not n:
        return near, 0
    ids, n = counted(near.select(F.col("a").alias("id")).union(near.select("b")).distinct())
    full = written(sets(docs, ids, n, id_col, text_col).dropDuplicates(["id", "digest"]).drop("digest"))  # an id has a set for each of its texts
    both = near.join(full.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(full.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return counted(both.where(shared * OF >= (F.size("set_a") + F.size("set_b") - shared) * SHARE).select("a", "b").distinct())


def _across(placed: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs of a bucket's members in different components, one at least outside its first's component.

    Sizes and sketches are compared within the join, which gives a pair once, in the first band that it
    shares, and only if its sketches come to ``least``.
    """
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.count(F.when(F.col("component") != F.col("head"), 1)).alias("strangers")).where("held > 2 AND strangers > 0")
    rows = placed.join(mixed.select("key"), "key").join(reps, "id").withColumns({"stranger": F.col("component") != F.col("head"), "first": F.col("id") == F.col("pivot")})
    side = lambda df, x: df.select(F.col("key").alias(f"key_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "sketch", "parity", "bands", "stranger")])
    shared = F.coalesce(*[F.when(F.col("bands_x")[i] == F.col("bands_y")[i], F.col("bands_x")[i]) for i in range(BANDS)])
    near = (
        (F.col("key_x") == F.col("key_y"))
        & (F.col("component_x") != F.col("component_y"))
        & (~F.col("stranger_y") | (F.col("id_x") < F.col("id_y")))
        & possible("_x", "_y")
        & (sketch_similarity(F.col("sketch_x"), F.col("sketch_y")) >= least)
        & (shared == F.col("key_x"))
    )
    pairs = side(rows.where("stranger"), "x").join(side(rows.where("NOT first"), "y"), near)
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Bucket members with their components and their first's."""
    own = members.join(found.withColumnsRenamed({"node": "id"}), "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = found.select(F.col("node").alias("pivot"), F.col("component").alias("head"))
    return written(own.join(heads, "pivot", "left").withColumn("head", F.coalesce("head", "pivot")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_shingles, component_id and kept for each row."""
    bounded_batches(docs.sparkSession)
    found = written(features(docs, id_col, text_col))
    usable = found.where("digest IS NOT NULL AND id IS NOT NULL")
    classes = written(usable.groupBy("digest").agg(F.min("id").alias("rep")))
    reps = written(usable.join(classes, "digest").where("id = rep").dropDuplicates(["id", "digest"]).select("id", "n", "bands", "sketch", "parity"))
    banded = reps.select(F.explode("bands").alias("key"), "id")
    shared = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("key", "pivot")
    members = written(banded.join(shared, "key"))
    # doc_ids with several texts, of which one may be empty.
    texts = found.where("id IS NOT NULL").groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"), F.max(F.col("digest").isNull()).alias("blank"))
    several, n = counted(texts.where("least < most OR (least IS NOT NULL AND blank)"))
    same = usable.join(sized(several.where("least < most").select("id"), n), "id").join(classes, "digest").where("rep < id").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    near, _ = confirmed(members.where("id > pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), reps, docs, id_col, text_col)
    joined = components(near.unionByName(same))
    for least in STEPS:
        # The most similar first: what they join needs no further comparison.
        more, n = confirmed(_across(_placed(members, joined), reps, least), reps, docs, id_col, text_col)
        if n:
            joined = components_with(joined, more)
    # Written, so that the join on the digest has plain exchanges on both sides and Spark can split a hot text; rows without a set stay out of it.
    # No broadcast either: digests of all texts would take many times their bytes in the driver's heap, while ids and digests are little to exchange.
    by_class = written(classes.join(joined.withColumnsRenamed({"node": "rep"}), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")))
    by_text = found.where("digest IS NOT NULL").select("id", "n", "digest").join(by_class, "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
    beside, n = counted(several.where("blank").select("id", F.col("least").alias("digest")).join(by_class, "digest").select("id", "component"))
    blank = found.where("digest IS NULL").select("id", "n").join(sized(beside, n), "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    placed = by_text.unionByName(blank)
    return placed.select(F.col("id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4]) END) AS sh
  FROM w
),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i, any_value(x.n) AS nx, any_value(y.n) AS ny FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (nx + ny - i)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (WITH RECURSIVE t(node, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, t.c FROM t JOIN u ON u.a = t.node AND t.c < u.b) SELECT node, min(c) AS c FROM t GROUP BY node)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept FROM s JOIN r ON r.node = s.doc_id
"""
