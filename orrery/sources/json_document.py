"""One pretty JSON document as a data source of its own.

Every task writes its rows to a file named for its attempt and reports it; only when
all have, the job's commit puts the parts together to the document, in their order,
and moves it into place, then the manifest, which names the parts and what run or case
they belong to. A task or job that fails leaves nothing that a reader sees, and what it
wrote is removed. With ``case``, the parts of the cases before stay and a case that is
written again replaces its own, so that results are whole after each case. Readers go
by the manifest, a task for each part.

The document is for results that people read; it is streamed by one process from the
parts, never held."""

from __future__ import annotations

import datetime
import decimal
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "json_document"


def _files(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    rows: int


@dataclass
class Part(InputPartition):
    name: str


def _manifest(files, root: str) -> list[dict]:
    from pyarrow import fs

    at = f"{root}/manifest.json"
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return []
    with files.open_input_stream(at) as f:
        return json.loads(f.read().decode())


class Writer(DataSourceWriter):
    def __init__(self, schema: StructType, path: str, case: str | None):
        self.names, self.path, self.case, self.run = schema.names, path.rstrip("/"), case, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        files, root = _files(self.path)
        part, rows = TaskContext.get().partitionId(), 0
        name = f"part-{self.run}-{part:06}-{uuid.uuid4().hex}"
        files.create_dir(f"{root}/parts", recursive=True)
        with files.open_output_stream(f"{root}/parts/{name}") as out:
            for row in iterator:
                text = json.dumps({k: _plain(v) for k, v in zip(self.names, row, strict=True)}, ensure_ascii=False, indent=2)
                out.write((",\n" * (rows > 0) + "\n".join("  " + line for line in text.split("\n"))).encode())
                rows += 1
        return Written(part, name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _files(self.path)
        own = [{"case": self.case, "name": m.name, "rows": m.rows} for m in sorted((m for m in messages if m), key=lambda m: m.part)]
        before = _manifest(files, root)
        kept = [p for p in before if self.case is not None and p["case"] != self.case]
        parts = kept + own
        temp = f"{root}/.new-{self.run}"
        with files.open_output_stream(temp) as out:
            out.write(b"[")
            filled = False
            for p in parts:
                if p["rows"]:
                    out.write(b",\n" if filled else b"\n")
                    filled = True
                    with files.open_input_stream(f"{root}/parts/{p['name']}") as f:
                        while block := f.read(1 << 20):
                            out.write(block)
            out.write(b"\n]\n" if filled else b"]\n")
        with files.open_output_stream(f"{temp}-manifest") as out:
            out.write(json.dumps(parts, ensure_ascii=False).encode())
        files.move(f"{temp}-manifest", f"{root}/manifest.json")
        files.move(temp, f"{root}/document.json")
        for p in before:
            if p not in parts:
                files.delete_file(f"{root}/parts/{p['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = _files(self.path)
        for f in files.get_file_info(fs.FileSelector(f"{root}/parts", allow_not_found=True)):
            if f.base_name.startswith(f"part-{self.run}-"):
                files.delete_file(f.path)


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.schema, self.path = schema, path.rstrip("/")

    def partitions(self) -> list[Part]:
        files, root = _files(self.path)
        return [Part(p["name"]) for p in _manifest(files, root) if p["rows"]] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.name:
            return
        files, root = _files(self.path)
        with files.open_input_stream(f"{root}/parts/{partition.name}") as f:
            text = f.read().decode()
        for row in json.loads(f"[{text}]"):
            yield tuple(row.get(n) for n in self.schema.names)


class JsonDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("name the columns: .schema(...)")

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options["path"], self.options.get("case"))


def sink_document(df: DataFrame, path: str, case: str | None = None) -> None:
    """df as ``document.json`` under path; beside the rows of other cases with ``case``."""
    df.sparkSession.dataSource.register(JsonDocument)
    out = df.write.format(NAME).mode("append").option("path", path)
    (out.option("case", case) if case is not None else out).save()


def read_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows under path, those that the last manifest names; none if nothing was written."""
    spark.dataSource.register(JsonDocument)
    return spark.read.format(NAME).schema(schema).option("path", path).load()
