"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then $BENCH_RUNS times (5 unless set); the
median counts. Results are consumed by a no-op sink, whole. ``timeline`` has the
six sweeps over a timeline of about $BENCH_ROWS events (3 million unless set, 0:
none), made by repeating the events one after the other, with rows a second;
``stream`` has rows a second of the strict stateful stream over the events.
"""

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

SWEEPS = ("strict_sweep", "window_loss", "partition_completeness", "window_size_sensitivity", "curve_fit", "heuristic_sweep")
HEADLINE = (
    *SWEEPS,
    "windowed_counts",
    "dedup_windowed_counts",
    "lateness_summary",
    "lateness_percentiles",
    "lateness_histogram",
    "interarrival_gaps",
    "running_max",
    "ddsketch_quantiles",
    "late_events_dlq",
    "dlq_corrections",
    "global_watermark",
)


def seconds(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def repeated(spark, sf_dir: str, wanted: int) -> tuple[str, int]:
    """A folder whose events table is that of ``sf_dir`` over and over, each time after the last, and its rows."""
    from pyspark.sql import functions as F

    from tidemark.sources.folders import new_folder

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, first, last, top = events.agg(F.count(F.lit(1)), F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp"))), F.max("event_id")).first()
    times = max(1, round(wanted / max(1, n)))
    copies = events.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("k") * (last - first + 1)).cast("timestamp_ntz")
    folder = new_folder(spark, "bench")
    copies.withColumn("ts", at).withColumn("event_id", F.col("event_id") + F.col("k") * (top + 1)).drop("k").write.parquet(f"{folder}/events.parquet")
    return folder, n * times


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "5"))
    wanted = int(os.environ.get("BENCH_ROWS", "3000000"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "7g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.plans import registry

    queries = registry.queries()
    took = {name: round(median([seconds(queries[name], spark, sf_dir) for _ in range(runs + 1)][1 if runs else 0 :]), 3) for name in HEADLINE}
    out = {"metric": "total_median_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": cpus, "runs": runs}
    if wanted:
        folder, n = repeated(spark, sf_dir, wanted)
        large = {name: round(seconds(queries[name], spark, folder), 3) for name in SWEEPS}
        out["timeline"] = {"rows": n, "queries": large, "seconds": round(sum(large.values()), 3), "rows_per_second": round(n / sum(large.values()))}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    streamed = seconds(queries["strict_stream_accounts"], spark, sf_dir)
    out["stream"] = {"rows": events, "seconds": round(streamed, 3), "rows_per_second": round(events / streamed)}
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
