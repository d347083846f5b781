"""Contiguous shards of nearly equal bytes, in DataFrame functions only.

Documents are put in doc_id order over range partitions. Each partition's total gives its offset in
the global prefix sum, a running sum inside the partition gives every row's place, and the byte line
is cut at equal targets: a row belongs to the shard that its midpoint falls into, so a shard misses
its target by half a row at each end at most.

Rows that are equal in (doc_id, size, checksum) are counted first and expanded after their start is
known, so a repeated row that holds a third of the table is one row for the sort and the windows; its copies are
expanded in runs of ``COPIES`` that are dealt over tasks.

Defined results for odd rows: a null text has no bytes (size 8, checksum 0); a null doc_id sorts
first; equal rows take neighbouring slots; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 24
ROW_BYTES = 8
#: Copies of one row that a task expands at once.
COPIES = 100_000


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """Returns doc_id, size, text_crc32, shard and slot; law ``bytes``: shard sizes are nearly equal."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    runs = (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    order = ["doc_id", "size", "text_crc32"]
    # Written once: the partition a row is in must not change between the totals and the running sums.
    placed = written(runs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))
    # One row for each range partition, so this single ordered window is as small as the partition count.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.withColumns(
        {
            "byte_start": F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)),
            "row_start": F.coalesce(F.sum("copies").over(inside), F.lit(0)),
        }
    ).join(F.broadcast(offsets), "part")
    kept = [*order, "copies", "byte_start", "byte_offset", "row_start", "row_offset", "total"]
    # Copies of one row in runs of COPIES, dealt out before they are expanded: no task holds them all.
    runs_of = starts.select(*kept, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))).alias("run"))
    many = runs_of.where(f"copies > {COPIES}").repartition(*order, "run")
    spread = runs_of.where(f"copies <= {COPIES}").unionByName(many)
    rows = spread.select(*kept, F.explode(F.sequence(F.col("run") * COPIES, F.least(F.col("copies") - 1, F.col("run") * COPIES + COPIES - 1))).alias("copy")).drop("copies")
    start = F.col("byte_offset") + F.col("byte_start") + F.col("copy") * F.col("size")
    # Midpoint over total, doubled to stay in whole numbers; decimals hold it beyond 2^63.
    middle = (F.lit(2) * start + F.col("size")).cast("decimal(28,0)") * F.lit(shards).cast("decimal(5,0)")
    dealt = rows.select(
        *order,
        F.least(F.lit(shards - 1), F.floor(middle / (F.lit(2) * F.col("total")).cast("decimal(28,0)"))).cast("int").alias("shard"),
        (F.col("row_offset") + F.col("row_start") + F.col("copy")).alias("place"),
    )
    firsts = dealt.groupBy("shard").agg(F.min("place").alias("first_place"))  # a row for each shard
    return dealt.join(F.broadcast(firsts), "shard").select(*order, "shard", (F.col("place") - F.col("first_place")).alias("slot"))
