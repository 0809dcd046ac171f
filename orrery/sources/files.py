"""Files as DataFrames: a folder's documents, triples, golden queries."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pdf import pages as pdf_pages

SUFFIXES = (".pdf", ".md", ".markdown", ".txt", ".py")
#: Tried in this order; the last always succeeds.
ENCODINGS = ("utf-8", "gbk", "gb2312", "gb18030", "latin-1")
TRIPLES = "chunk_id string, source_doc string, triples array<struct<subject:string,relation:string,object:string>>"
GOLDEN = "description string, test_cases array<struct<id:string,query:string,category:string,golden_chunk_sources:array<string>,golden_answer:string,notes:string>>"


def detect_encoding(data: bytes) -> str:
    for name in ENCODINGS[:-1]:
        try:
            data.decode(name)
        except UnicodeDecodeError:
            continue
        return name
    return ENCODINGS[-1]


def scan_directory(spark: SparkSession, folder: str) -> DataFrame:
    """(source, path, content): the folder's own files of known suffixes, by
    name. A missing folder raises, as the reader does."""
    rows = spark.read.format("binaryFile").load(folder)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return rows.select(name.alias("source"), "path", "content").filter(F.lower(F.regexp_extract("source", r"(\.[^.]*)$", 1)).isin(*SUFFIXES)).orderBy("source")


def load_documents(files: DataFrame, pdf: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """(source, encoding, text) of (source, content): decoded with the first
    encoding that fits, line ends unified. PDF pages come from the extractor
    given, by default one for simple files, joined by blank lines; where it fails
    the text is empty."""

    def text_of(name: str, data: bytes | None) -> tuple[str | None, str]:
        if name.lower().endswith(".pdf"):
            try:
                return None, "\n\n".join(pdf(data))
            except Exception:
                return None, ""
        encoding = detect_encoding(data or b"")
        return encoding, (data or b"").decode(encoding).replace("\r\n", "\n").replace("\r", "\n")

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            got = [text_of(n, d) for n, d in zip(names, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["source", "encoding", "text"])

    return files.select("source", "content").mapInArrow(run, "source string, encoding string, text string")


def load_document(spark: SparkSession, path: str, **how) -> DataFrame:
    """One file; an unknown suffix raises."""
    if not path.lower().endswith(SUFFIXES):
        raise ValueError(f"unsupported file type: {path}")
    rows = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("source"), "content")
    return load_documents(rows, **how)


def scan_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triple records of a JSON Lines file; lines that aren't JSON are dropped."""
    return spark.read.schema(TRIPLES).option("mode", "DROPMALFORMED").json(path)


def scan_golden(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(GOLDEN).option("multiLine", True).json(path).select(F.explode("test_cases").alias("c"))
    return rows.select(F.col("c.id").alias("query_id"), "c.query", "c.category", F.col("c.golden_chunk_sources").alias("golden"), "c.golden_answer")


def resolve_split(split: str) -> str:
    files = {"train": "train_queries.json", "test": "test_queries.json", "all": "test_queries_all.json"}
    if split not in files:
        raise ValueError(f"unknown split: {split}")
    return files[split]


def load_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.json(path) if fs.exists(p) else None
