"""Statistics of a timeline: summary, percentiles, histograms, skew, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.running import bucket_width

PERCENTS = (1, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 85, 90, 92, 95, 97, 98, 99, 99.9, 99.99, 100)
#: Lower edges (s) of the lateness histogram; the last bin is open.
EDGES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 20, 22, 25, 28, 30, 35, 40, 45, 50, 60, 75, 90, 120, 150, 180, 240, 360)
BINS = 24


def lateness_summary(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("host").alias("n_hosts"),
        F.count_if(F.col("status") >= 500).alias("n_500"),
        F.min("et_ms").alias("min_et_ms"),
        F.max("et_ms").alias("max_et_ms"),
        (F.max("et_ms") - F.min("et_ms")).alias("span_ms"),
        F.round(F.avg("lateness_ms"), 3).alias("mean_ms"),
        F.round(F.stddev_pop("lateness_ms"), 3).alias("std_ms"),
        F.round(F.skewness("lateness_ms"), 3).alias("skew"),
        F.count_if(F.col("lateness_ms") < 0).alias("negative"),
        F.count_if(F.col("lateness_ms") == 0).alias("zero"),
    )


def lateness_percentiles(events: DataFrame, percents=PERCENTS) -> DataFrame:
    """Exact, linearly interpolated."""
    one = events.agg(F.percentile("lateness_ms", F.array(*[F.lit(p / 100) for p in percents])).alias("q"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(p)).alias("percent"), F.round(F.element_at("q", i + 1), 3).alias("lateness_ms")) for i, p in enumerate(percents)])))


def nearest_rank_percentiles(events: DataFrame, percents=(50, 90, 95, 99)) -> DataFrame:
    """Entry floor(n p / 100) in order, the last at most: found by running counts of distinct values."""
    counts = events.groupBy("lateness_ms").agg(F.count(F.lit(1)).alias("c"))
    w = W.orderBy("lateness_ms").rowsBetween(W.unboundedPreceding, 0)
    run = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(W.partitionBy()))
    at = [F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)) for p in percents]
    one = run.agg(*[F.min(F.when(F.col("upto") > a, F.col("lateness_ms"))).alias(f"_p{i}") for i, a in enumerate(at)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"_p{i}").alias("lateness_ms")) for i, p in enumerate(percents)])))


def _bin(edges) -> F.Column:
    """Number of the half-open bin, by comparisons in one expression."""
    return sum((F.col("lateness_ms") >= e * 1000).cast("int") for e in edges) - 1


def lateness_histogram(events: DataFrame, edges=EDGES) -> DataFrame:
    """bin, low_s, n, pct, cum_pct; lateness below the first edge is in no bin."""
    n = F.sum("n").over(W.partitionBy())
    counts = events.where(F.col("lateness_ms") >= edges[0] * 1000).groupBy(_bin(edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    low = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1)
    cum = F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return counts.select("bin", low.alias("low_s"), "n", F.round(F.lit(100.0) * F.col("n") / n, 3).alias("pct"), F.round(F.lit(100.0) * cum / n, 3).alias("cum_pct"))


def event_time_histogram(events: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width bins over the span of event time; the last one is closed."""
    ends = events.agg(F.min("et_ms").alias("lo"), F.max("et_ms").alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("et_ms") - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))).cast("int")
    return events.join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def partition_skew(events: DataFrame) -> DataFrame:
    counts = events.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy()
    return counts.select("partition_id", "n", F.round(F.max("n").over(everything) / F.avg("n").over(everything), 4).alias("max_over_mean"))


def top_hosts(events: DataFrame, k: int = 20) -> DataFrame:
    return events.groupBy("host").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(k)


def host_entropy(events: DataFrame) -> DataFrame:
    counts = events.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    # -sum p ln p = ln N - sum(n ln n) / N, which needs no second pass for N.
    return counts.agg(F.count(F.lit(1)).alias("hosts"), F.round(F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n"), 6).alias("entropy_nats"))


def lateness_correlation(events: DataFrame) -> DataFrame:
    return events.agg(F.round(F.corr("et_ms", "lateness_ms"), 4).alias("corr"))


def _neighbours(events: DataFrame) -> DataFrame:
    """Adds the event and arrival time of the row before in arrival order, without one global sort."""
    b = events.withColumn("_b", F.floor(F.col("arrival_ms") / bucket_width(events, "arrival_ms")).cast("long"))
    order = F.struct("arrival_ms", "event_id", "et_ms")
    last = b.groupBy("_b").agg(F.max(order).alias("_last"))
    last = last.select("_b", F.lag("_last").over(W.orderBy("_b")).alias("_prev"))
    w = W.partitionBy("_b").orderBy("arrival_ms", "event_id")
    inside = b.withColumns({"_et": F.lag("et_ms").over(w), "_at": F.lag("arrival_ms").over(w)})
    return inside.join(last, "_b").withColumns({"prev_et": F.coalesce("_et", "_prev.et_ms"), "prev_arrival": F.coalesce("_at", "_prev.arrival_ms")}).drop("_b", "_et", "_at", "_prev")


def out_of_order_steps(events: DataFrame) -> DataFrame:
    back = F.count_if(F.col("et_ms") < F.col("prev_et"))
    return _neighbours(events).agg(F.count(F.lit(1)).alias("n"), back.alias("steps_back"), F.round(F.lit(100.0) * back / (F.count(F.lit(1)) - 1), 4).alias("pct"))


def interarrival_gaps(events: DataFrame) -> DataFrame:
    gaps = _neighbours(events).select((F.col("arrival_ms") - F.col("prev_arrival")).alias("gap")).where("gap IS NOT NULL")
    return gaps.agg(
        F.round(F.avg("gap"), 4).alias("mean_ms"),
        F.percentile("gap", F.lit(0.5)).alias("median_ms"),
        F.round(F.percentile("gap", F.lit(0.95)), 4).alias("p95_ms"),
        F.round(F.percentile("gap", F.lit(0.99)), 4).alias("p99_ms"),
        F.max("gap").alias("max_ms"),
        F.count_if(F.col("gap") < 1).alias("bursts"),
    )


def windowed_counts(events: DataFrame) -> DataFrame:
    """The continuous query's answer over all events: count and errors of each partition and window."""
    return events.groupBy("partition_id", "ws").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == 500).alias("status_500"))


def worker_rollup(events: DataFrame, workers: int = 4) -> DataFrame:
    """Partitions summed by worker, with completeness at no wait over the worker's totals."""
    from tidemark.operators.completeness import pct, with_need

    need = with_need(events, ["partition_id"])
    good = F.count_if(F.col("need_ms").isNull() | (F.col("need_ms") < 0))
    per = need.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"), good.alias("ok"), F.percentile("lateness_ms", F.lit(0.5)).alias("p50"), F.percentile("lateness_ms", F.lit(0.99)).alias("p99"))
    return per.groupBy((F.col("partition_id") % workers).alias("worker")).agg(
        F.sum("n").alias("received"), F.sum("ok").alias("on_time"), pct(F.sum("ok"), F.sum("n")).alias("completeness_pct"), F.round(F.avg("p50"), 3).alias("p50_ms"), F.round(F.max("p99"), 3).alias("p99_ms")
    )


def latency_percentiles(rows: DataFrame, value: str, by: list[str], percents=(50, 95, 99)) -> DataFrame:
    """by..., p<percent>: entry min(floor(n p), n - 1) of the values in order, in thousandths, negatives left out."""
    good = rows.where(F.col(value) >= 0).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*by)
    run = good.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = {p: F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)) for p in percents}
    return run.groupBy(*by).agg(*[F.round(F.min(F.when(F.col("upto") > a, F.col(value))) / 1000, 2).alias(f"p{p}") for p, a in at.items()])


def worst_windows(marked: DataFrame, k: int = 20) -> DataFrame:
    """ws, total, late, loss_pct, overall_pct: the ``k`` windows that lose the largest share (marked: ws, late)."""
    per = marked.groupBy("ws").agg(F.count(F.lit(1)).alias("total"), F.count_if("late").alias("late"))
    overall = per.agg(F.round(F.lit(100.0) * F.sum("late") / F.sum("total"), 4).alias("overall_pct"))
    top = per.withColumn("loss_pct", F.round(F.lit(100.0) * F.col("late") / F.col("total"), 4)).orderBy(F.desc("loss_pct"), F.desc("late"), "ws").limit(k)
    return top.join(F.broadcast(overall))


def worst_partitions(metrics: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` partitions of the largest p99 (partition_id, p99_us)."""
    return metrics.groupBy("partition_id").agg(F.max("p99_us").alias("p99_us")).orderBy(F.desc("p99_us"), "partition_id").limit(k)


def described(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, mean, std, least, p25, p50, p75, most of numeric columns."""
    each = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]
    q = F.percentile("v", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    found = rows.select(F.inline(F.array(*each))).where("v IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev("v"), 4).alias("std"), F.min("v").alias("least"), q.alias("q"), F.max("v").alias("most"))
    return found.select("name", "n", "mean", "std", "least", *[F.round(F.get("q", F.lit(i)), 4).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "most")


def stage_shares(metrics: DataFrame) -> DataFrame:
    """Share of each stage in the summed worst p99 (stage, p99_us), with a verdict."""
    share = F.lit(100.0) * F.col("p99") / F.sum("p99").over(W.partitionBy())
    rows = metrics.groupBy("stage").agg(F.max("p99_us").alias("p99")).withColumn("share_pct", F.round(share, 2))
    return rows.withColumn("verdict", F.when(F.col("share_pct") >= 45, "Dominant").when(F.col("share_pct") >= 25, "High").otherwise("Watch"))


def completeness_pivot(runs: DataFrame) -> DataFrame:
    """Mean completeness by wait, one column a mode (runs: mode, wait_ms, completeness_pct)."""
    return runs.groupBy("wait_ms").pivot("mode", ["strict", "heuristic"]).agg(F.round(F.avg("completeness_pct"), 3))


def trip_statistics(trips: DataFrame, divisors=(30, 60, 120)) -> DataFrame:
    """Raw data counts: durations not positive or over six hours, duration percentiles, p95 lateness at each divisor."""
    d = F.col("duration_s")
    good = F.when((d > 0) & (d <= 6 * 3600), d)
    return trips.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(d <= 0).alias("not_positive"),
        F.count_if(d > 6 * 3600).alias("over_6h"),
        F.percentile(good, F.lit(0.5)).alias("p50_s"),
        F.percentile(good, F.lit(0.95)).alias("p95_s"),
        *[F.round(F.percentile(good, F.lit(0.95)) / k, 3).alias(f"p95_late_div{k}") for k in divisors],
    )
