"""As-of joins: each row with the last mark of its key at or before its time.

Rows and marks are sorted together by ranges of key and time, so a key of any share is split over tasks; the last
mark is carried along within a range as batches stream by. What a range begins with, before its first mark, is
answered by the ranges before it: each tells one row, its last key with that key's last mark. That table has a row a
task and is the only thing broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.sources.scratch import written


def asof(rows: DataFrame, marks: DataFrame, key: str, time: str, mark_time: str | None = None, name: str = "mark") -> DataFrame:
    """``rows`` with a struct ``name`` of the mark's columns (null where there is none yet).

    Of marks of one key and time the one that sorts last wins. Rows or marks of a null key or time meet nothing.
    Keys and times have the same types on both sides.
    """
    mark_time = mark_time or time
    row_struct, mark_struct = (F.struct(*[F.col(f"`{c}`") for c in df.columns]) for df in (rows, marks))
    row_type, mark_type = rows.select(row_struct.alias("r")).schema["r"].dataType, marks.select(mark_struct.alias("m")).schema["m"].dataType
    wide = rows.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(mark_type).alias("_mark"), row_struct.alias("_row"), F.monotonically_increasing_id().alias("_n"))
    known = marks.where(F.col(key).isNotNull() & F.col(mark_time).isNotNull())
    both = wide.where("_k IS NOT NULL AND _t IS NOT NULL").unionByName(known.select(F.col(key).alias("_k"), F.col(mark_time).alias("_t"), F.lit(0).alias("_side"), mark_struct.alias("_mark"), F.lit(None).cast(row_type).alias("_row"), F.monotonically_increasing_id().alias("_n")))
    placed = both.repartitionByRange("_k", "_t", "_side", "_n").sortWithinPartitions("_k", "_t", "_side", "_mark", "_n")
    kind = both.schema["_k"].dataType.simpleString()

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = held = None
        for b in batches:
            if not b.num_rows:
                continue
            keys, side, mark = b.column("_k"), b.column("_side").to_numpy(), b.column("_mark")
            same_as_before = last is not None and keys[0].as_py() == last
            if first is None:
                first, held = keys[0].as_py(), pa.nulls(1, mark.type)
            elif not same_as_before:
                held = pa.nulls(1, mark.type)
            change = np.concatenate([[False], pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)])
            at = np.arange(len(keys))
            begin = np.maximum.accumulate(np.where(change, at, 0))
            # Places among what was held and this batch's marks: 0 what was held, for the first key alone.
            place = np.maximum.accumulate(np.where(side == 0, at + 1, 0))
            place = np.where(place > begin, place, np.where(begin == 0, 0, -1))
            source = pa.concat_arrays([held, mark])
            found = source.take(pa.array(place, mask=place < 0))
            own = pa.array(np.flatnonzero(side == 1))
            is_first = pc.equal(keys, pa.scalar(first, keys.type)).take(own)
            mine = found.take(own)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int32()), keys.take(own), b.column("_row").take(own), mine, pc.and_(is_first, pc.is_null(mine)), pa.array([False] * len(own), pa.bool_())], names=["_part", "_k", "_row", "_mark", "_open", "_end"])
            last, held = keys[-1].as_py(), found.slice(len(found) - 1)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([last], keys.type), pa.nulls(1, b.column("_row").type), held, pa.array([False]), pa.array([True])], names=["_part", "_k", "_row", "_mark", "_open", "_end"])

    carried = written(placed.mapInArrow(carry, f"_part int, _k {kind}, _row {row_type.simpleString()}, _mark {mark_type.simpleString()}, _open boolean, _end boolean"), "asof")
    ends = carried.where("_end").select(F.col("_part").alias("_p"), F.col("_k").alias("_ek"), F.col("_mark").alias("_em"))
    # The nearest range before whose last key is this one and had a mark.
    before = carried.where("_open").select("_part", "_k").distinct()  # at most a row a range
    near = before.join(F.broadcast(ends), (F.col("_ek") == F.col("_k")) & (F.col("_p") < F.col("_part")) & F.col("_em").isNotNull())
    newest = near.withColumn("_o", F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("_p")))).where("_o = 1").select(F.col("_part").alias("_fp"), F.col("_em").alias("_found"))
    done = carried.where("NOT _end").join(F.broadcast(newest), F.col("_open") & (F.col("_part") == F.col("_fp")), "left")
    out = done.select("_row.*", F.coalesce("_mark", "_found").alias(name))
    return out.unionByName(wide.where("_k IS NULL OR _t IS NULL").select("_row.*", F.lit(None).cast(mark_type).alias(name)))
