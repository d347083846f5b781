"""Approximate nearest neighbours by low-dimensional stable projections under kd-trees.

Gaussian projections to DIMS dimensions keep distances on average: the squared projected distance of
two vectors at distance d is d squared times a chi-square variable with DIMS degrees of freedom.
Neighbours are taken in order of projected distance and verified on the original vectors, until the
next projected distance r fails the stopping test: P(chi-square <= (r / d_k)^2) > CONFIDENCE, where
d_k is the k-th best verified distance. A neighbour nearer than d_k is missed with probability
1 - CONFIDENCE at most.

The kd-tree has two levels. Its top is split at medians of a bounded sample (``SAMPLE`` vectors,
smallest id hashes) and deals every row to a leaf; a leaf of more than ``BLOCK`` rows, as equal vectors
make it, is dealt further by id hash, so no task holds more than a block. Below, each block has its own
tree. Each query is searched in its home leaf first; its d_k then rules out the leaves whose region the
stopping test excludes, and the rest are searched. Queries go in blocks too.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor
do vectors whose length is not the most frequent one (no distance to them is defined); a null id takes no part. Every
row is a candidate of its own, so rows that repeat an id are all found and each asks for itself; repeated rows of
one id and vector are neighbours of each other. Ties go to the smaller id; fewer candidates than k give them all. Other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

DIMS, CONFIDENCE = 16, 0.95
SAMPLE, MAX_LEAVES = 65_536, 16_384
BLOCK, QUERIES, BUCKET = 4096, 1024, 64


def chi_square_limit(p: float = CONFIDENCE, dims: int = DIMS) -> float:
    """The value that a chi-square variable with an even number of degrees of freedom stays below with probability p."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


LIMIT = chi_square_limit()


def projection(size: int) -> np.ndarray:
    return np.random.default_rng(271828).standard_normal((size, DIMS))


def top_tree(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimensions and values of a perfect tree in heap order (node i has children 2i+1, 2i+2)."""
    dims, values = np.zeros(leaves - 1, np.int64), np.zeros(leaves - 1)
    parts = {0: points}
    for i in range(leaves - 1):
        own = parts.pop(i)
        if len(own):
            dims[i] = int(np.argmax(own.max(0) - own.min(0)))
            values[i] = float(np.median(own[:, dims[i]]))
        right = own[:, dims[i]] > values[i]
        parts[2 * i + 1], parts[2 * i + 2] = own[~right], own[right]
    return dims, values


def leaf_of(points: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    rows = np.arange(len(points))
    for _ in range(int(math.log2(len(dims) + 1))):
        at = 2 * at + 1 + (points[rows, dims[at]] > values[at])
    return at - len(dims)


def leaves_within(point: np.ndarray, radius2: float, dims: np.ndarray, values: np.ndarray) -> list[int]:
    """Leaves whose region is at most the radius away."""
    out, todo = [], [(0, 0.0, ())]
    while todo:
        i, dist2, offs = todo.pop()
        if i >= len(dims):
            out.append(i - len(dims))
            continue
        d, gap = int(dims[i]), float(point[dims[i]] - values[i])
        near, far = (2 * i + 2, 2 * i + 1) if gap > 0 else (2 * i + 1, 2 * i + 2)
        todo.append((near, dist2, offs))
        known = dict(offs)
        beyond = dist2 - known.get(d, 0.0) ** 2 + gap**2
        if beyond <= radius2:
            todo.append((far, beyond, tuple((known | {d: gap}).items())))
    return out


class Block:
    """A kd-tree over one block: rows in the order of its buckets, and the buckets' boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, names: np.ndarray | None = None):
        """``ids`` tell rows apart, ``names`` (the ids themselves, if not given) settle ties and are found."""
        names = ids if names is None else names
        parts, todo = [], [np.arange(len(ids))]
        while todo:
            own = todo.pop()
            width = np.ptp(points[own], 0)
            if len(own) > BUCKET and width.any():
                by = own[np.argsort(points[own, np.argmax(width)], kind="stable")]
                todo += [by[len(by) // 2 :], by[: len(by) // 2]]
            else:
                parts.append(own)
        order = np.concatenate(parts)
        self.ids, self.names, self.vectors, self.points = ids[order], names[order], vectors[order], points[order]
        self.bucket = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        self.low, self.high = (np.array([f(points[x], 0) for x in parts]) for f in (np.min, np.max))

    def search(self, query_id: int, vector: np.ndarray, point: np.ndarray, k: int, bound: float) -> list[tuple[float, int]]:
        """The k nearest found, where ``bound`` is a k-th distance known already: buckets in the order of their distance, a few, then twice as many each time."""
        away = (np.maximum(0, np.maximum(self.low - point, point - self.high)) ** 2).sum(1)
        order = np.argsort(away)
        best, found, kth, at, step = np.zeros(0), np.zeros(0, np.int64), bound, 0, 2
        while at < len(order):
            near = order[at : at + step][away[order[at : at + step]] <= LIMIT * kth * kth]
            if not len(near):
                break  # the chi-square test stops here: everything left is projected farther away
            at, step = at + step, 2 * step
            chosen = np.zeros(len(order), bool)
            chosen[near] = True
            rows = np.flatnonzero(chosen[self.bucket])
            rows = rows[(((self.points[rows] - point) ** 2).sum(1) <= LIMIT * kth * kth) & (self.ids[rows] != query_id)]
            exact = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(1))
            best, found = np.concatenate([best, exact]), np.concatenate([found, self.names[rows]])
            if len(best) > k:
                kth = min(kth, np.partition(best, k - 1)[k - 1])
            stay = best <= kth
            first = np.lexsort((found[stay], best[stay]))[:k]
            best, found = best[stay][first], found[stay][first]
            if len(best) == k:
                kth = min(kth, best[-1])
        return list(zip(best.tolist(), found.tolist()))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (Euclidean distance) for every query row."""
    spark = vectors.sparkSession
    v = F.col("v")
    plain = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), is_query.alias("asks"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = plain.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    usual = finite.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema)
    base = written(finite.where(F.size("v") == usual.size).select("id", F.monotonically_increasing_id().alias("row"), "asks", "v"))
    n, to_low = base.count(), projection(usual.size)
    leaves = 1 << max(0, min(int(math.log2(MAX_LEAVES)), math.ceil(math.log2(max(1, n / BLOCK)))))

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(list(_matrix(b.column("v")) @ to_low), pa.list_(pa.float64()))], names=["p"])

    picked = _matrix(base.orderBy(F.xxhash64("id", "row"), "id", "row").limit(SAMPLE).select("v").mapInArrow(low, "p array<double>").toArrow().column("p")).reshape(-1, DIMS)
    dims, values = top_tree(picked, leaves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf_of(_matrix(b.column("v")) @ to_low, dims, values))], names=["id", "row", "asks", "v", "leaf"])

    placed = written(base.mapInArrow(place, "id long, row long, asks boolean, v array<double>, leaf long"))
    # A row a leaf, MAX_LEAVES at most.
    sizes = written(placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts")))
    hashed = lambda parts: F.pmod(F.xxhash64("row", F.lit(7)), F.col(parts)).cast("int")
    blocks = placed.join(F.broadcast(sizes), "leaf").select("id", "row", "v", "leaf", hashed("salts").alias("salt"))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            own = _matrix(left.column("v"))
            block = Block(left.column("row").to_numpy(), own, own @ to_low, left.column("id").to_numpy())
            asked = _matrix(right.column("v"))
            for q, row, x, p, bound in zip(right.column("id").to_pylist(), right.column("row").to_pylist(), asked, asked @ to_low, right.column("bound").to_pylist()):
                for score, i in block.search(row, x, p, k, math.inf if bound is None else bound):
                    out["query_id"].append(q), out["query_row"].append(row), out["vec_id"].append(i), out["score"].append(score)
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    def asked_in_blocks(asking: DataFrame) -> DataFrame:
        """``asking`` has id, row, v, bound and leaf: every query in every block of its leaves, both sides in blocks."""
        asking = written(asking)
        groups = written(asking.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts")))
        each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        mine = blocks.join(F.broadcast(groups), "leaf").select("id", "row", "v", "leaf", "salt", each("parts").alias("part"))
        theirs = asking.join(F.broadcast(groups.join(sizes, "leaf")), "leaf").select("id", "row", "v", "bound", "leaf", hashed("parts").alias("part"), each("salts").alias("salt"))
        cell = ["leaf", "salt", "part"]
        return mine.groupBy(cell).cogroup(theirs.groupBy(cell)).applyInArrow(search, "query_id long, query_row long, vec_id long, score double")

    rank = Window.partitionBy("query_row").orderBy("score", "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    queries = placed.where("asks").select("id", "row", "v", "leaf")
    near = written(best(asked_in_blocks(queries.withColumn("bound", F.lit(None).cast("double")))).drop("rank"))
    bounds = near.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, to = [], []
            for r, (vector, bound, home) in enumerate(zip(b.column("v").to_pylist(), b.column("bound").to_pylist(), b.column("leaf").to_pylist())):
                found = range(leaves) if bound is None else leaves_within(np.array(vector) @ to_low, LIMIT * bound * bound, dims, values)
                to += (own := [x for x in found if x != home])
                at += [r] * len(own)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("id", "row", "v", "bound")), pa.array(to, pa.int64())], names=["id", "row", "v", "bound", "leaf"])

    further = asked_in_blocks(queries.join(bounds, "row", "left").mapInArrow(route, "id long, row long, v array<double>, bound double, leaf long"))
    return best(near.unionByName(further)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
