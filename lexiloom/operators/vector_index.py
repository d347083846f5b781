"""A persisted index of vectors: random-hyperplane signatures, candidates under a filter, exact verification.

A vector's signature has one bit for each hyperplane, so two signatures differ in about ``angle / pi`` of their
bits. Signatures stand apart from the vectors (32 bytes against eight a dimension); both are dealt to directories
by the first bits and sorted by id. A question ranks the signatures that its filter leaves, of all buckets or of the ``probes``
nearest, keeps ``candidates`` of them and reads those vectors alone. Where the filter leaves no more vectors than that,
all of them are verified and the answer is exact.

Vectors that are null, zero, of another length or not finite are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import cosine, ranked

BITS, BUCKET_BITS = 256, 6
#: Candidates that are verified; recall grows with them.
CANDIDATES = 200


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    dimensions: int
    bits: int
    bucket_bits: int
    seed: int

    @classmethod
    def write(cls, vectors: DataFrame, path: str, dimensions: int, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS, bucket_bits: int = BUCKET_BITS, seed: int = 7) -> VectorIndex:
        index = cls(vectors.sparkSession, path, dimensions, bits, bucket_bits, seed)
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(f"id IS NOT NULL AND size(vector) = {dimensions}")
        planes = index.planes()

        def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                good = np.isfinite(v).all(1) & (v != 0).any(1)
                ones = v[good] @ planes > 0
                kept = b.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(ones, bucket_bits), pa.int32()), kept.column("id"), pa.array([x.tobytes() for x in np.packbits(ones, axis=1)], pa.binary()), kept.column("vector")], names=["bucket", "id", "signature", "vector"])

        table = rows.mapInArrow(signed, "bucket int, id long, signature binary, vector array<double>")
        for name, columns in (("signatures", ["bucket", "id", "signature"]), ("vectors", ["bucket", "id", "vector"])):
            table.select(*columns).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{path}/{name}")
        return index

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.dimensions, self.bits))

    def _rows(self, name: str, columns: str) -> DataFrame:
        return self.spark.read.schema(f"id long, {columns}, bucket int").parquet(f"{self.path}/{name}")

    def candidates(self, query: list[float], n: int = CANDIDATES, inside: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """``bucket`` and ``id`` of the ``n`` vectors whose signatures are nearest to the query's; of those in ``inside`` (column ``id``), if given."""
        along = np.array(query) @ self.planes()
        signature = np.packbits(along > 0).tobytes()
        rows = self._rows("signatures", "signature binary")
        if probes is not None:
            rows = rows.where(F.col("bucket").isin(self.probed(along, probes)))
        if inside is not None:
            rows = rows.join(inside.select("id"), "id", "left_semi")
        # Eight bytes at a time; a signature is a multiple of them.
        word = lambda c, k: F.conv(F.hex(F.substring(c, 8 * k + 1, 8)), 16, -10).cast("long")
        mine = [int.from_bytes(signature[8 * k : 8 * k + 8], "big", signed=True) for k in range(self.bits // 64)]
        differ = sum((F.bit_count(word("signature", k).bitwiseXOR(F.lit(w))) for k, w in enumerate(mine)), F.lit(0))
        return rows.select("bucket", "id", differ.alias("differ")).orderBy("differ", "id").limit(n)

    def probed(self, along: np.ndarray, probes: int) -> list[int]:
        """Buckets in the order of what the query would have to give up to lie in them."""
        own, margin = along[: self.bucket_bits] > 0, np.abs(along[: self.bucket_bits])
        flips = [[(b >> k) & 1 for k in range(self.bucket_bits)] for b in range(1 << self.bucket_bits)]
        cost = sorted((float(np.dot(margin, [bool(f[k]) != own[k] for k in range(self.bucket_bits)])), b) for b, f in enumerate(flips))
        return [b for _, b in cost[:probes]]

    def nearest(self, query: list[float], k: int, candidates: int = CANDIDATES, inside: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """``vec_id``, ``score`` (cosine) and ``rank`` (from 0) of the k nearest found, nearest first, ties to the smaller id."""
        chosen = self.candidates(query, max(candidates, k), inside, probes).collect()  # as many rows as candidates were asked for
        ids, buckets = [r.id for r in chosen], sorted({r.bucket for r in chosen})
        held = self._rows("vectors", "vector array<double>").where(F.col("bucket").isin(buckets) & F.col("id").isin(ids))
        one = self.spark.createDataFrame([(None, [float(x) for x in query])], "id long, vector array<double>")
        scored = cosine(held, None, "id", "vector", query=one).withColumnRenamed("id", "vec_id")
        return ranked(scored, "vec_id", k).orderBy("rank")


def _bucket(ones: np.ndarray, bits: int) -> np.ndarray:
    return (ones[:, :bits].astype(np.int32) << np.arange(bits)).sum(1)
