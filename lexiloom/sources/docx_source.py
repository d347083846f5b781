"""A data source for word-processor files, alone or in archives: ``spark.read.format("docx").load(folder)``.

Files (.docx) and the entries of archives (.zip) are listed once by size and dealt to partitions of about
``partitionBytes``; a large archive is many partitions, each of which reads its own entries. The columns are those of ``SCHEMA``;
a schema given by the reader names the ones that are wanted, and what is not asked for is not parsed. Equality filters on
doc_id leave other files unread, on type they drop blocks at once. A file that cannot be read is an error, or with ``mode`` ``permissive`` a
row whose ``error`` says why.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .files import _read_docx

SCHEMA = "path string, doc_id string, block_index int, locator string, type string, level int, text string, error string"
PARTITION_BYTES = 32_000_000


@dataclass
class Part(InputPartition):
    #: (file, entry of the archive or none)
    files: list[tuple[str, str | None]]


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DocxReader:
        return DocxReader(schema, dict(self.options))


class DocxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        known = {c.split()[0]: c.split()[1] for c in SCHEMA.split(", ")}
        for f in schema.fields:
            if known.get(f.name) != f.dataType.simpleString():
                raise ValueError(f"docx gives no column {f.name} {f.dataType.simpleString()}")
        if "path" not in options:
            raise ValueError("docx needs a path")
        self.path, self.mode = options["path"], options.get("mode", "failfast").lower()
        self.most = int(options.get("partitionbytes") or options.get("partitionBytes") or PARTITION_BYTES)
        self.ids: set[str] | None = None
        self.types: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("doc_id",), ("type",)):
                yield f
            elif f.attribute == ("doc_id",):
                self.ids = values if self.ids is None else self.ids & values
            else:
                self.types = values if self.types is None else self.types & values

    def _listed(self) -> Iterator[tuple[str, str | None, int]]:
        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith(("/", "file:")) else (fs.LocalFileSystem(), self.path)
        found = files.get_file_info(root)
        infos = [found] if found.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        for info in sorted((i for i in infos if i.type == fs.FileType.File), key=lambda i: i.path):
            if info.path.lower().endswith(".docx"):
                yield info.path, None, info.size
            elif info.path.lower().endswith(".zip"):
                with files.open_input_file(info.path) as raw, zipfile.ZipFile(raw) as z:  # the directory alone
                    yield from ((info.path, e.filename, e.compress_size) for e in z.infolist() if e.filename.lower().endswith(".docx"))

    def partitions(self) -> Sequence[Part]:
        out: list[Part] = []
        size = self.most
        for path, entry, n in self._listed():
            if self.ids is not None and _id(path, entry) not in self.ids:
                continue
            if size + n > self.most and (size or not out):
                out.append(Part([]))
                size = 0
            out[-1].files.append((path, entry))
            size += n
        return out or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith(("/", "file:")) else fs.LocalFileSystem()
        kinds = {"block_index": pa.int32(), "level": pa.int32()}
        parse = set(self.columns) - {"path", "doc_id", "error"} or self.types
        opened: tuple[str, zipfile.ZipFile] | None = None
        for path, entry in partition.files:
            error, blocks = None, [(None, None, None)]
            try:
                if entry is not None and (opened is None or opened[0] != path):
                    opened = path, zipfile.ZipFile(files.open_input_file(path))
                if parse:
                    raw = opened[1].read(entry) if entry is not None else files.open_input_file(path).read()
                    blocks = _read_docx(raw)
                elif entry is None:
                    with zipfile.ZipFile(io.BytesIO(files.open_input_file(path).read())) as z:
                        z.getinfo("word/document.xml")
            except Exception as e:  # whatever is wrong with a file
                if self.mode != "permissive":
                    raise ValueError(f"{path}{'!' + entry if entry else ''} cannot be read") from e
                error, blocks = f"{type(e).__name__}: {e}", [(None, None, None)]
            place = path if entry is None else f"{path}!{entry}"
            rows = [(place, _id(path, entry), None if error or not parse else i, None if error or not parse else f"docx-p-{i:06d}", *b, error) for i, b in enumerate(blocks) if self.types is None or b[0] in self.types]
            held = dict(zip((c.split()[0] for c in SCHEMA.split(", ")), zip(*rows))) if rows else {}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(held[c], kinds.get(c, pa.string())) for c in self.columns], names=self.columns)


def _id(path: str, entry: str | None) -> str:
    return (entry or path).rsplit("/", 1)[-1]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
