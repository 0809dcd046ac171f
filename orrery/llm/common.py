"""Shared plumbing of the training-data operators: table access, the shared
scratch folder and the word pattern that all contracts use."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

#: A word of the contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(jpath)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends
    here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def same(df: DataFrame, of: DataFrame) -> DataFrame:
    """df, a selection of a written table's columns, as that table's."""
    df._written = of._written
    return df


def forget(df: DataFrame) -> None:
    """Deletes a written table that no plan reads any more."""
    drop_path(df.sparkSession, df._written)


def spread(rows: DataFrame, keys: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """rows joined to the one row of keys with the same ``on``; ``weight`` is how many
    rows have it, total how many there are. Keys with over a thousandth of all rows
    are fewer than a thousand, so these are broadcast; the others are shuffled, and
    no task gets more than that thousandth for one of them."""
    most = max(64, total // 1000)
    hot = F.broadcast(keys.filter(F.col(weight) >= most))
    rest = rows.join(F.broadcast(keys.filter(F.col(weight) >= most).select(on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(keys.filter(F.col(weight) < most), on))


def let(value, body) -> F.Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def trimmed(run):
    """run, for mapInArrow, handing free memory back to the system at its end:
    Python workers wait for later tasks, and what they hold adds up."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
