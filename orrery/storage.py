"""Index tables and cut lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names by ``spark.checkpoint.dir`` or
    ``setCheckpointDir``. Only a local session, whose driver and executors are one
    process, may go without: a folder is made for it."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not re.match(r"local($|\[)", context.master):
                raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            held = context._jsc.sc().getCheckpointDir()
        base = held.get()
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df's rows as a table of the shared folder."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
