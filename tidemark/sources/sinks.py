"""Sinks: idempotent window results, object-store history, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeline import window_id


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def emit_once(results: DataFrame, path: str, batch_id: int) -> None:
    """Append results whose window_id is not there yet; a batch that runs again replaces what it wrote.

    Each batch has a folder of its own, so a transaction is a folder: complete
    once Spark has committed it, overwritten if the batch is repeated.
    """
    spark = results.sparkSession
    new = results.dropDuplicates(["window_id"])
    if _exists(spark, path):
        before = spark.read.parquet(path).where(F.col("batch") != batch_id).select("window_id")
        new = new.join(before, "window_id", "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def history(results: DataFrame, path: str, size_ms: int = 5_000) -> None:
    """Gzip JSON under a folder for each partition."""
    named = results.withColumn("window_id", window_id(F.col("partition_id"), F.col("ws"), size_ms))
    named.write.mode("append").partitionBy("partition_id").option("compression", "gzip").json(path)


def read_history(spark: SparkSession, path: str, partitions: list[int] | None = None) -> DataFrame:
    """What ``history`` wrote, of some partitions only if they are named (the others' folders are not read)."""
    found = spark.read.json(path)
    return found.where(F.col("partition_id").isin(partitions)) if partitions is not None else found


def history_stats(spark: SparkSession, path: str) -> DataFrame:
    """partition_id, results, first_ws, last_ws of what is stored."""
    return spark.read.json(path).groupBy("partition_id").agg(F.count(F.lit(1)).alias("results"), F.min("ws").alias("first_ws"), F.max("ws").alias("last_ws"))


def purge_history(spark: SparkSession, path: str, before_ms: int, size_ms: int = 5_000) -> str:
    """Leaves out windows that ended before ``before_ms``: what stays is written to a new folder, which is returned."""
    kept = f"{path.rstrip('/')}-from-{before_ms}"
    spark.read.json(path).where(F.col("ws") + size_ms >= before_ms).write.mode("overwrite").partitionBy("partition_id").option("compression", "gzip").json(kept)
    return kept


def audited(results: DataFrame, path: str, audit: str, batch_id: int) -> None:
    """``emit_once`` with a copy of everything that was offered, repeats too, in the audit folder."""
    emit_once(results, path, batch_id)
    results.withColumn("offered", F.lit(batch_id)).write.mode("append").parquet(audit)


def report_csv(table: DataFrame, path: str, *order: str) -> None:
    """A report's table as one CSV with a header; reports have as many rows as parameters."""
    table.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def report_markdown(title: str, tables: dict[str, DataFrame], most: int = 1_000) -> str:
    """Small tables as Markdown; ``most`` bounds the rows of each that reach the driver."""
    out = [f"# {title}"]
    for name, df in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(most).collect()]
    return "\n".join(out) + "\n"
