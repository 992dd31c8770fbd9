"""Control-plane semantics as queries: heartbeats, global watermarks, alerts, hysteresis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Age (s) up to which a partition is ACTIVE, STALE or IDLE; older: FAILED.
AGES = ((0.5, "ACTIVE"), (2.0, "STALE"), (30.0, "IDLE"))
SKEWS_MS = ((1_000, "OK"), (5_000, "Warning"))
LAGS_S = ((12, "OK"), (30, "Warning"), (60, "High"))


def heartbeats(events: DataFrame, delta_ms: int = 10_000, every_ms: int = 60_000) -> DataFrame:
    """partition_id, tick, at_ms (last arrival), w_ms (greatest event time less the wait) for each interval."""
    tick = F.floor(F.col("arrival_ms") / every_ms).cast("long")
    return events.groupBy("partition_id", tick.alias("tick")).agg(F.max("arrival_ms").alias("at_ms"), (F.max("et_ms") - delta_ms).alias("top_ms")).select(
        "partition_id", "tick", "at_ms", F.max("top_ms").over(W.partitionBy("partition_id").orderBy("tick")).alias("w_ms")
    )


def _tiered(value, tiers, last: str):
    out = F.lit(last)
    for limit, name in reversed(tiers):
        out = F.when(value <= limit, name).otherwise(out)
    return out


def partition_status(beats: DataFrame, now_ms: int) -> DataFrame:
    """Latest heartbeat of each partition with its age at ``now_ms`` and status."""
    last = beats.groupBy("partition_id").agg(F.max(F.struct("tick", "at_ms", "w_ms")).alias("x")).select("partition_id", "x.at_ms", "x.w_ms")
    age = (F.lit(now_ms) - F.col("at_ms")) / 1000.0
    return last.withColumn("age_s", age).withColumn("status", _tiered(age, AGES, "FAILED"))


def global_watermark(beats: DataFrame, dead_after: int = 3) -> DataFrame:
    """tick, w_ms, partitions: least watermark of the partitions heard of in the last ``dead_after`` ticks, never falling."""
    ticks = beats.select(F.col("tick").alias("at")).distinct()
    seen = ticks.join(beats, (F.col("tick") <= F.col("at")) & (F.col("tick") > F.col("at") - dead_after))
    each = seen.groupBy("at", "partition_id").agg(F.max(F.struct("tick", "w_ms")).alias("x"))
    least = each.groupBy("at").agg(F.min("x.w_ms").alias("least_ms"), F.count(F.lit(1)).alias("partitions"))
    return least.select(F.col("at").alias("tick"), F.max("least_ms").over(W.orderBy("at")).alias("w_ms"), "partitions")


def skew_status(beats: DataFrame, delta_ms: int = 10_000) -> DataFrame:
    """Per tick: skew of watermarks over partitions, lag of the least one, both tiers and the diagnosis."""
    per = beats.groupBy("tick").agg((F.max("w_ms") - F.min("w_ms")).alias("skew_ms"), ((F.max("at_ms") - F.min("w_ms") - delta_ms) / 1000.0).alias("lag_s"))
    rows = per.withColumn("skew_status", _tiered(F.col("skew_ms"), SKEWS_MS, "Critical")).withColumn("lag_status", _tiered(F.col("lag_s"), LAGS_S, "Critical"))
    wide, late = F.col("skew_ms") > SKEWS_MS[0][0], F.col("lag_s") > LAGS_S[0][0]
    diagnosis = F.when(wide & late, "one partition holds all back").when(wide, "partitions drift").when(late, "all are behind").otherwise("healthy")
    combined = F.when((F.col("skew_status") == "Critical") | (F.col("lag_status") == "Critical"), "Critical").when(wide | late, "Degraded").otherwise("Healthy")
    return rows.withColumn("combined", combined).withColumn("diagnosis", diagnosis)


def backpressure(queue: DataFrame, by: str = "partition_id", pause_at: int = 500, resume_below: int = 100) -> DataFrame:
    """Adds ``paused`` and ``signal`` (PAUSE, RESUME or null) with hysteresis over (at, queued).

    Between the limits the last decisive length holds.
    """
    w = W.partitionBy(by).orderBy("at")
    decisive = F.when(F.col("queued") >= pause_at, F.lit(1)).when(F.col("queued") < resume_below, F.lit(0))
    rows = queue.withColumn("_p", F.coalesce(F.last(decisive, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    rows = rows.withColumn("_q", F.coalesce(F.lag("_p").over(w), F.lit(0)))
    signal = F.when(F.col("_p") > F.col("_q"), "PAUSE").when(F.col("_p") < F.col("_q"), "RESUME")
    return rows.withColumn("signal", signal).withColumn("paused", F.col("_p") == 1).drop("_p", "_q")


def ingestor_health(beats: DataFrame, now_ms: int) -> DataFrame:
    """ingestor_id, status, skew tier and deviation from (ingestor_id, t_commit_ms, heard_ms, clock_ms)."""
    last = beats.groupBy("ingestor_id").agg(F.max(F.struct("heard_ms", "t_commit_ms", "clock_ms")).alias("x")).select("ingestor_id", "x.*")
    silent, stuck = F.lit(now_ms) - F.col("heard_ms") > 15_000, F.lit(now_ms) - F.col("t_commit_ms") > 5_000
    status = F.when(silent, "SILENT").when(stuck, "STUCK").otherwise("ACTIVE")
    skew = F.abs(F.col("clock_ms") - F.col("heard_ms"))
    tier = F.when(skew < 100, "OK").when(skew < 500, "WARNING").when(skew < 2_000, "ALERT").otherwise("CRITICAL")
    w_meta = F.min(F.when(status != "SILENT", F.col("t_commit_ms"))).over(W.partitionBy())
    return last.select("ingestor_id", status.alias("status"), tier.alias("clock_tier"), w_meta.alias("w_meta_ms"), (F.col("t_commit_ms") - w_meta > 10_000).alias("deviates"))


#: Fixed alert rules: name, predicate over one row of metrics, severity.
ALERTS = (
    ("watermark_lag_critical", "watermark_lag_s > 60", "critical"),
    ("watermark_lag_warning", "watermark_lag_s > 30 AND watermark_lag_s <= 60", "warning"),
    ("node_skew_warning", "node_skew_ms > 1000 AND node_skew_ms <= 5000", "warning"),
    ("node_skew_critical", "node_skew_ms > 5000", "critical"),
    ("combined_status_critical", "combined_status >= 3", "critical"),
    ("fencing_violation", "fencing_violations > 0", "high"),
    ("ingestor_silent", "ingestor_silent > 0", "high"),
    ("negative_lag_warning", "negative_lag_rate > 0.01 AND negative_lag_rate <= 0.05", "warning"),
    ("negative_lag_critical", "negative_lag_rate > 0.05", "critical"),
    ("all_workers_idle", "all_workers_idle > 0", "high"),
    ("replay_mode_extended", "replay_mode_extended > 0", "warning"),
    ("correction_latency_high", "correction_latency_s > 3600", "warning"),
    ("dlq_backlog_critical", "dlq_backlog > 50000", "critical"),
    ("sketch_drift_high", "estimator_drift > 0.5", "warning"),
    ("extreme_lag_detected", "extreme_lag_count > 0", "warning"),
)


def alerts(metrics: DataFrame, clock_ms: str = "at_ms", cooldown_ms: int = 60_000) -> DataFrame:
    """at, rule, severity of the rules that fire; absent metrics are 0, and a rule is silent for the cooldown.

    Cooldown is per rule and counted from interval to interval: of the firings
    in one interval the first stands.
    """
    names = dict.fromkeys(word for _, predicate, _ in ALERTS for word in predicate.split() if word.islower())
    full = metrics.withColumns({c: F.lit(0.0) for c in names if c not in metrics.columns})
    fired = F.array_compact(F.array(*[F.when(F.expr(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, p, s in ALERTS]))
    rows = full.select(F.col(clock_ms).alias("at_ms"), F.inline(fired))
    return rows.groupBy("rule", "severity", F.floor(F.col("at_ms") / cooldown_ms).alias("_i")).agg(F.min("at_ms").alias("at_ms")).drop("_i")
