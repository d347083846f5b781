"""Helpers shared by the training-data operators."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources.scratch import new_path

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the shared folder: later reads survive lost executors and recompute nothing. ``clear`` empties them once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, "table")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, what: str = "true") -> tuple[DataFrame, int]:
        """Such a table and for how many of its rows ``what`` is true: counted as it is written, at least so many if a task ran twice."""
        rows = Observation()
        out = self.written(df.observe(rows, F.count(F.when(F.expr(what), 1)).alias("n")))
        return out, rows.get["n"]

    def kept(self) -> None:
        """The table written last stays until ``emptied``."""
        TABLES.append(self.paths.pop())

    def clear(self) -> None:
        for path in self.paths:
            _empty(self.spark, path)
        self.paths.clear()


def _empty(spark: SparkSession, path: str) -> None:
    spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)


#: Tables that ``written`` has made, in order; whoever knows that nothing reads them any more empties them.
TABLES: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """One such table that stays until ``emptied``."""
    one = Scratch(df.sparkSession)
    out = one.written(df)
    TABLES.extend(one.paths)
    return out


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """One such table and its number of rows, which takes no job of its own."""
    one = Scratch(df.sparkSession)
    out = one.counted(df)
    TABLES.extend(one.paths)
    return out


def emptied(spark: SparkSession, paths: list[str]) -> None:
    """Empties tables of ``written``."""
    for path in paths:
        _empty(spark, path)
        TABLES.remove(path)


#: Bytes of an Arrow batch.
BATCH_BYTES = 4_000_000


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Sets the session's batch size: whole texts in Spark's usual batches of 64 MB take hundreds of MB in each Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def crc_of_id(column: str | Column) -> Column:
    """CRC-32 of an id written as text, the value that folds are dealt by; a null id is an empty text, so it is 0 and held out."""
    return F.crc32(F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")).cast("binary"))


def packed(df: DataFrame, name: str = "_row", keep: list[str] | None = None) -> Column:
    """The columns to carry (all by default) as one struct, so that no name can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias(name)


#: A join side of at most so many rows is broadcast after they have been counted; beyond that the join shuffles.
BROADCAST_IDS = 500_000


def sized(rows: DataFrame, n: int | None = None) -> DataFrame:
    """A table already written, of fixed-size columns, hinted for broadcast if its rows allow: n, if they are counted already."""
    return F.broadcast(rows) if (rows.count() if n is None else n) <= BROADCAST_IDS else rows
