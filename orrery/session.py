"""A local session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import params


def local(cores: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def _bytes(df: DataFrame):
    """About how many bytes a row holds, by its columns' types."""
    total = F.lit(0)
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif kind.startswith("array<") and kind[6:-1] in ("int", "bigint", "float", "double", "long"):
            total = total + 8 * F.greatest(F.size(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + 8
    return total


def small(df: DataFrame, rows: int = params.BROADCAST_ROWS, most: int = params.BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes; as it is beyond."""
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(_bytes(df)), F.lit(0)).alias("held")).first()
    return F.broadcast(df) if got.n <= rows and got.held <= most else df
