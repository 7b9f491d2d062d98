"""Strict JSON lines as a data source: ``spark.read.format("strict_jsonl").schema(...).option("required", "id").load(folder)``.

Files are cut into ranges of lines, a partition each. A line that is no JSON
object of the schema, or that lacks a required field, is an error that tells
file and offset; blank lines and a byte-order mark are skipped. Writing is all
or nothing: tasks write aside, the commit moves their files into place and
puts a manifest of files and row counts last, an abort removes them.

Folders are reached by pyarrow's file systems, so a path may be one of a
shared mount or an address that pyarrow knows.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MANIFEST, STAGED = "_manifest.json", "_staged"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class StrictJsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strict_jsonl"

    def schema(self) -> str:
        raise ValueError("strict_jsonl needs a schema")

    def reader(self, schema: StructType) -> StrictReader:
        return StrictReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> StrictWriter:
        return StrictWriter(self.options["path"], schema, overwrite)


class StrictReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"], schema
        self.required = [c.strip() for c in options.get("required", "").split(",") if c.strip()]
        self.size = int(options.get("rangebytes", options.get("rangeBytes", 64 << 20)))

    def partitions(self) -> list[Range]:
        system, root = _opened(self.path)
        if system.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"JSONL_NOT_FOUND: {self.path}")
        found = [system.get_file_info(root)] if system.get_file_info(root).is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        # names that begin with _ or . are no data, at any depth
        data = [f for f in found if f.is_file and not any(p.startswith(("_", ".")) for p in f.path[len(root) :].split("/") if p)]
        return [Range(f.path, at, min(at + self.size, f.size)) for f in sorted(data, key=lambda f: f.path) for at in range(0, f.size, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None or not isinstance(partition, Range):  # an empty folder
            return
        system, _ = _opened(self.path)
        arrow, rows = to_arrow_schema(self.schema), []
        names = {f.name for f in self.schema}
        with io.BufferedReader(system.open_input_file(partition.path), 1 << 20) as file:
            at = partition.start
            if at:  # the line that the range begins in is the one before's
                file.seek(at - 1)
                at += len(file.readline()) - 1
            while at < partition.stop:
                line = file.readline()
                if not line:
                    break
                text = line.removeprefix(b"\xef\xbb\xbf") if at == 0 else line
                if text.strip():
                    rows.append(self._record(text, names, partition.path, at))
                at += len(line)
                if len(rows) >= 4096:
                    yield self._batch(rows, arrow, partition.path)
                    rows = []
        if rows:
            yield self._batch(rows, arrow, partition.path)

    def _record(self, text: bytes, names: set[str], path: str, at: int) -> dict:
        try:
            record = json.loads(text)
        except ValueError as error:
            raise ValueError(f"JSONL_INVALID_JSON: {path} at {at}: {error}") from None
        if not isinstance(record, dict):
            raise ValueError(f"JSONL_INVALID_RECORD: {path} at {at}: no object")
        if lacking := [c for c in self.required if record.get(c) is None]:
            raise ValueError(f"JSONL_INVALID_RECORD: {path} at {at}: lacks {', '.join(lacking)}")
        return {k: v for k, v in record.items() if k in names}

    def _batch(self, rows: list[dict], arrow: pa.Schema, path: str) -> pa.RecordBatch:
        try:
            return pa.RecordBatch.from_pylist(rows, arrow)
        except (pa.ArrowInvalid, pa.ArrowTypeError, TypeError) as error:
            raise ValueError(f"JSONL_INVALID_RECORD: {path}: {error}") from None


class StrictWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.path)
        folder = posixpath.join(root, STAGED, self.run)
        system.create_dir(folder, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(posixpath.join(folder, name)) as out:
            for batch in iterator:
                for record in batch.to_pylist():
                    out.write(json.dumps({k: v for k, v in record.items() if v is not None}, ensure_ascii=False, default=str).encode() + b"\n")
                    n += 1
        return Written([(name, n)])

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", "."))]
        manifest = posixpath.join(root, MANIFEST)
        listed = {} if self.overwrite or system.get_file_info(manifest).type == fs.FileType.NotFound else json.loads(system.open_input_file(manifest).readall())
        fresh = {name: n for m in messages if m for name, n in m.files if n}
        for name in fresh:
            system.move(posixpath.join(root, STAGED, self.run, name), posixpath.join(root, name))
        with system.open_output_stream(manifest) as out:
            out.write(json.dumps(listed | fresh, indent=1, sort_keys=True).encode())
        for path in old if self.overwrite else []:
            system.delete_file(path)
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        folder = posixpath.join(root, STAGED, self.run)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StrictJsonLines)
