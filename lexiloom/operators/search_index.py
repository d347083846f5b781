"""An inverted index of immutable segments: written, written again, deleted from, backfilled and compacted.

A segment holds ``docs`` (key, the token count of each field, attributes) and ``postings`` (term, field, key, tf,
len), dealt to directories by term; directories grow with the segment's tokens, and a frequent term's directory
is written by many tasks. Words are counted within their text, before the one exchange. A commit is a row of the manifest:
the live segments, the tombstones (a key that is dead in segments before one) and the statistics of what lives.
Segments of no commit are never read; of two writers of one commit the second fails.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.sources.scratch import new_path, written

#: Tokens of a directory, about.
PART_TOKENS = 20_000_000
#: Dead keys broadcast at most.
BROADCAST_KEYS = 500_000

_MANIFEST = "version long, segments array<struct<id: long, docs: string, postings: string, parts: int>>, dead string, n_dead long, fields map<string, struct<n: long, tokens: long>>, attributes array<string>"


class IndexConflict(RuntimeError):
    """A commit that is there already, or counters that do not agree."""


@dataclass(frozen=True)
class Segment:
    id: int
    docs: str
    postings: str
    parts: int


@dataclass
class SearchIndex:
    spark: SparkSession
    path: str
    version: int = 0
    segments: list[Segment] = field(default_factory=list)
    dead: str | None = None
    n_dead: int = 0
    #: Texts with the field and their tokens, over live documents.
    fields: dict[str, tuple[int, int]] = field(default_factory=dict)
    attributes: list[str] = field(default_factory=list)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SearchIndex:
        """The last commit."""
        row = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/*").orderBy(F.desc("version")).first()
        return cls(spark, path, row.version, [Segment(*s) for s in row.segments], row.dead, row.n_dead, {f: (x.n, x.tokens) for f, x in row.fields.items()}, row.attributes)

    # Reading

    def _tombstones(self) -> DataFrame | None:
        if not self.dead:
            return None
        rows = self.spark.read.parquet(self.dead)
        return F.broadcast(rows) if self.n_dead <= BROADCAST_KEYS else rows

    def _live(self, rows: DataFrame) -> DataFrame:
        """Without what tombstones cover; rows have ``segment`` and ``key``."""
        gone = self._tombstones()
        return rows if gone is None else rows.join(gone, (F.col("key") == F.col("_key")) & (F.col("segment") < F.col("_before")), "left_anti")

    def docs(self) -> DataFrame:
        """Live documents: ``segment``, ``key``, ``len`` (by field), attributes."""
        parts = [self.spark.read.parquet(s.docs).withColumn("segment", F.lit(s.id)) for s in self.segments]
        return self._live(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))

    def postings(self, terms: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
        """Live postings, of given terms those alone: their directories, and within them their row groups."""
        found = []
        for s in self.segments:
            rows = self.spark.read.parquet(s.postings)
            if terms is not None:
                rows = rows.where(F.col("part").isin(sorted({part_of(t, s.parts) for t in terms})) & F.col("term").isin(terms))
            if fields is not None:
                rows = rows.where(F.col("field").isin(fields))
            found.append(rows.select(F.lit(s.id).alias("segment"), "term", "field", "key", "tf", "len"))
        return self._live(reduce(DataFrame.unionByName, found))

    def stat(self, name: str) -> tuple[int, float]:
        """Texts of a field and their mean length."""
        n, tokens = self.fields.get(name, (0, 0))
        return n, tokens / n if n and tokens else 1.0

    # Writing

    def _new(self, name: str, number: int) -> str:
        """A folder of this writer's own: what another one left without a commit is never in the way."""
        return f"{self.path}/{name}-{number}-{uuid.uuid4().hex[:12]}"

    def _commit(self, segments: list[Segment], dead: DataFrame | None, attributes: list[str]) -> SearchIndex:
        version, path, n_dead = self.version + 1, None, 0
        if dead is not None:
            path = self._new("dead", version)
            dead.write.parquet(path)
            n_dead = self.spark.read.parquet(path).count()
        new = SearchIndex(self.spark, self.path, version, segments, path if n_dead else None, n_dead, {}, attributes)
        if segments:
            counted = new.docs().select(F.explode("len").alias("field", "n")).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("n").cast("long").alias("tokens"))
            new.fields = {r.field: (r.n, r.tokens) for r in counted.collect()}  # a row a field
        row = (version, [(s.id, s.docs, s.postings, s.parts) for s in segments], new.dead, n_dead, new.fields, attributes)
        try:
            self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/{version:012d}")
        except Exception as e:
            raise IndexConflict(f"commit {version} of {self.path} cannot be written; open the index again") from e
        return new

    def _killed(self, keys: DataFrame, before: int) -> DataFrame:
        """Tombstones with those of ``keys`` added."""
        new = keys.select(F.col("key").alias("_key"), F.lit(before).cast("long").alias("_before"))
        old = self.spark.read.parquet(self.dead) if self.dead else new.limit(0)
        return old.unionByName(new).groupBy("_key").agg(F.max("_before").alias("_before"))

    def add(self, docs: DataFrame, fields: list[str], key: str = "doc_id", attributes: list[str] = ()) -> tuple[SearchIndex, dict[str, int]]:
        """Writes documents; earlier ones of the same keys are replaced. Counters: documents ``written``, of them ``replaced`` keys.

        A commit holds if every document that was read has been written. Documents with a null key are counted as ``rejected``.
        """
        id_ = self.version + 1
        at = self._new("segment", id_)
        given = docs.where(F.col(key).isNotNull())
        words = [F.coalesce(T.tokens(f), F.array().cast("array<string>")).alias(f"_{i}") for i, f in enumerate(fields)]
        sized = given.select(F.col(key).alias("key"), *attributes, *words)
        # Each text is taken to words once: what both tables need is written.
        counted = [F.struct(F.lit(f).alias("field"), F.size(f"_{i}").alias("len"), counts(F.col(f"_{i}")).alias("words")) for i, f in enumerate(fields)]
        table = written(sized.select("key", *attributes, F.array(*counted).alias("fields")), "counted")
        lengths = F.map_from_arrays(F.col("fields.field"), F.col("fields.len"))
        table.select("key", *attributes, lengths.alias("len")).write.parquet(f"{at}/docs")
        tokens = table.agg(F.sum(F.aggregate("fields.len", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
        parts = 1
        while parts * PART_TOKENS < tokens:
            parts *= 2
        rows = table.select("key", F.explode("fields").alias("f")).select("key", "f.field", "f.len", F.explode("f.words").alias("w"))
        part = F.pmod(F.crc32(F.col("w.term").cast("binary")), F.lit(parts)).cast("int").alias("part")
        # A directory that is too large for a task is dealt to several, small ones share one.
        dealt = rows.select(part, "w.term", "field", "key", "w.tf", "len").hint("rebalance", F.col("part"))
        dealt.sortWithinPartitions("part", "term", "field", "key").write.partitionBy("part").parquet(f"{at}/postings")
        n, there = given.count(), self.spark.read.parquet(f"{at}/docs").count()
        if n != there:
            raise IndexConflict(f"{there} of {n} documents written")
        schema_known = [*self.attributes, *[a for a in attributes if a not in self.attributes]]
        mine = self.spark.read.parquet(f"{at}/docs").select("key")
        dead, replaced = None, 0
        if self.segments:
            again = self.docs().select("key").join(mine, "key", "left_semi").distinct()
            replaced = again.count()
            dead = self._killed(again, id_)
        segment = Segment(id_, f"{at}/docs", f"{at}/postings", parts)
        # A segment of no words at all has no directories.
        if not tokens:
            segment = Segment(id_, f"{at}/docs", self._no_postings(at, table.schema["key"].dataType), 1)
        new = self._commit([*self.segments, segment], dead, schema_known)
        return new, {"written": n, "replaced": replaced, "rejected": docs.count() - n}

    def _no_postings(self, at: str, kind) -> str:
        path = f"{at}/no-postings"
        self.spark.createDataFrame([], f"part int, term string, field string, key {kind.simpleString()}, tf int, len int").write.parquet(path)
        return path

    def delete(self, keys: DataFrame, key: str = "doc_id") -> tuple[SearchIndex, dict[str, int]]:
        """Deletes documents by key: ``total`` found, ``deleted`` that are gone now; both agree or nothing is committed."""
        if not self.segments:
            return self, {"total": 0, "deleted": 0}
        asked = keys.select(F.col(key).alias("key")).distinct()
        found = self.docs().join(asked, "key", "left_semi")
        total = found.count()
        if not total:
            return self, {"total": 0, "deleted": 0}
        dead = written(self._killed(found.select("key").distinct(), self.version + 1), "dead")
        trial = SearchIndex(self.spark, self.path, self.version, self.segments)
        left = trial.docs().join(dead, (F.col("key") == F.col("_key")) & (F.col("segment") < F.col("_before")), "left_anti").join(asked, "key", "left_semi").count()
        if left:
            raise IndexConflict(f"{left} of {total} documents would stay")
        return self._commit(self.segments, dead, self.attributes), {"total": total, "deleted": total - left}

    def backfill(self, name: str, value: Column, where: Column | None = None) -> tuple[SearchIndex, dict[str, int]]:
        """Gives an attribute where it is missing, among the documents that ``where`` names; what is there stays.

        Only segments with gaps are written again; a value still missing there is an error and nothing is committed.
        Counters: ``total`` documents asked for, ``updated`` of them.
        """
        out, total = [], 0
        for s in self.segments:
            docs = self.spark.read.parquet(s.docs)
            given = docs if name in docs.columns else docs.withColumn(name, F.lit(None).cast("string"))
            gap = F.col(name).isNull() & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
            missing = given.where(gap).count()
            if not missing:
                out.append(s)
                continue
            path = self._new("docs", s.id)
            given.withColumn(name, F.when(gap, value).otherwise(F.col(name))).write.parquet(path)
            left = self.spark.read.parquet(path).where(gap).count()
            if left:
                raise IndexConflict(f"{left} documents have no {name}")
            total += missing
            out.append(Segment(s.id, path, s.postings, s.parts))
        if not total:
            return self, {"total": 0, "updated": 0}
        dead = self.spark.read.parquet(self.dead) if self.dead else None
        return self._commit(out, dead, [*self.attributes, *[name] * (name not in self.attributes)]), {"total": total, "updated": total}

    def compact(self) -> SearchIndex:
        """One segment of what lives, and no tombstones; earlier commits stay readable."""
        id_ = self.version + 1
        at = self._new("segment", id_)
        self.docs().drop("segment").write.parquet(f"{at}/docs")
        tokens = sum(t for _, t in self.fields.values())
        parts = 1
        while parts * PART_TOKENS < tokens:
            parts *= 2
        rows = self.postings().drop("segment").withColumn("part", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(parts)).cast("int"))
        rows.hint("rebalance", F.col("part")).sortWithinPartitions("part", "term", "field", "key").write.partitionBy("part").parquet(f"{at}/postings")
        segment = Segment(id_, f"{at}/docs", f"{at}/postings" if tokens else self._no_postings(at, self.docs().schema["key"].dataType), parts)
        return self._commit([segment], None, self.attributes)


def part_of(term: str, parts: int) -> int:
    return zlib.crc32(term.encode()) % parts


def counts(words: Column) -> Column:
    """Distinct words of an array with how often they stand in it: sorted, then cut where the word changes."""
    return T.let(
        F.array_sort(words),
        lambda s: T.let(
            F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (F.get(s, i - 1) != w), i)), lambda i: i.isNotNull()),
            lambda starts: F.transform(starts, lambda at, k: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(starts, k + 1), F.size(s)) - at).alias("tf"))),
        ),
    )


def write_index(docs: DataFrame, fields: list[str], path: str | None = None, key: str = "doc_id", attributes: list[str] = ()) -> SearchIndex:
    """A new index of documents."""
    spark = docs.sparkSession
    return SearchIndex(spark, path or new_path(spark, "search")).add(docs, fields, key, list(attributes))[0]
