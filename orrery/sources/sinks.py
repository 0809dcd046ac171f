"""Results as files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sink_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sink_append_jsonl(df: DataFrame, path: str) -> None:
    """Adds records; what is there stays, so a rerun reads it as its cache."""
    df.write.mode("append").json(path)


def sink_filtered(records: DataFrame, clean: DataFrame, path: str) -> None:
    """The records of clean sources (source)."""
    records.join(clean.select(F.col("source").alias("source_doc")), "source_doc", "left_semi").write.mode("overwrite").json(path)


def sink_run(df: DataFrame, path: str, run: str, part: str) -> None:
    """Results of one run and part beside those of others: rerunning replaces its own."""
    (df.withColumn("run", F.lit(run)).withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "part").parquet(path))


def bar(value: float, width: int = 20) -> str:
    n = int(round(max(0.0, min(1.0, value)) * width))
    return "█" * n + "░" * (width - n)


def report_md(title: str, tables: dict[str, DataFrame], rows: int | None = None) -> str:
    """A Markdown report of small summary tables, all rows of each; with ``rows``
    so many at most, the number of the rest said below."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        got = df.collect() if rows is None else df.limit(rows + 1).collect()
        shown = got if rows is None else got[:rows]
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in shown]
        if len(got) > len(shown):
            out += ["", f"{df.count() - len(shown)} more rows are not shown."]
        out.append("")
    return "\n".join(out)


def report_experiments(ablation: DataFrame, categories: DataFrame, latency: DataFrame) -> str:
    """The three result sets of the experiments, MRR with a bar."""
    barred = lambda df, c: df.withColumn("bar", F.concat(F.repeat(F.lit("█"), F.round(20 * F.col(c)).cast("int")), F.repeat(F.lit("░"), 20 - F.round(20 * F.col(c)).cast("int"))))
    return report_md("Experiments", {"Modules": barred(ablation.orderBy("ordinal"), "mrr"), "Categories": categories.orderBy("category", "configuration"), "Latency (ms)": latency.orderBy("stage")})


def sink_case(df: DataFrame, path: str, case: str) -> None:
    """A case's results beside those of the cases before; ``done_cases`` tells a
    rerun which are there. A case that is run again replaces its own."""
    sink_run(df, path, "cases", case)


def done_cases(spark, path: str) -> set[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return set()
    return {r.part for r in spark.read.parquet(path).select("part").distinct().collect()}  # a name for each case
