"""Progress of partitions in time: silence, replays, backlog, pacing and what adapts to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.running import prior_max

IDLE_MS = 30_000
RETENTION_MS = 7 * 86_400_000
#: p99 (s) below which and above which the sketch's relative error changes, and the errors.
ALPHA_LIMITS_S, ALPHAS = (1.0, 30.0), (0.001, 0.01)


def token_progress(events: DataFrame, every_ms: int = 10_000, delta_ms: int = 10_000, idle_ms: int = IDLE_MS) -> DataFrame:
    """partition_id, tick, is_empty, idle, w_ms: each partition's token at the end of each interval.

    A token is empty if no event came since the one before; a partition is idle
    once it has been silent for ``idle_ms``. Tokens run from a partition's first
    event to the last event of all.
    """
    tick = F.floor(F.col("arrival_ms") / every_ms).cast("long")
    per = events.groupBy("partition_id", tick.alias("tick")).agg(F.max("arrival_ms").alias("heard"), F.max("et_ms").alias("top"))
    last = per.agg(F.max("tick").alias("last"))
    spans = per.groupBy("partition_id").agg(F.min("tick").alias("first")).join(F.broadcast(last))
    ticks = spans.select("partition_id", F.explode(F.sequence("first", "last")).alias("tick"))
    w = W.partitionBy("partition_id").orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    rows = ticks.join(per, ["partition_id", "tick"], "left")
    rows = rows.select("partition_id", "tick", F.col("heard").isNull().alias("is_empty"), F.max("heard").over(w).alias("_heard"), (F.max("top").over(w) - delta_ms).alias("w_ms"))
    return rows.select("partition_id", "tick", "is_empty", ((F.col("tick") + 1) * every_ms - F.col("_heard") >= idle_ms).alias("idle"), "w_ms")


def watermark_without_idle(tokens: DataFrame) -> DataFrame:
    """tick, w_ms, active: least watermark of the partitions that are not idle, never falling; while all are idle it stays."""
    per = tokens.groupBy("tick").agg(F.min(F.when(~F.col("idle"), F.col("w_ms"))).alias("least"), F.count_if(~F.col("idle")).alias("active"))
    # A row for each interval.
    return per.select("tick", F.max("least").over(W.orderBy("tick").rowsBetween(W.unboundedPreceding, 0)).alias("w_ms"), "active")


def watermark_of_live(beats: DataFrame, every_ms: int = 60_000, stale_ms: int = 2_000) -> DataFrame:
    """tick, w_ms, live: least watermark of partitions heard of within ``stale_ms`` of the interval's last beat, never falling."""
    newest = beats.groupBy("tick").agg(F.max("at_ms").alias("now"))
    live = beats.join(newest, "tick").where(F.col("now") - F.col("at_ms") <= stale_ms)
    per = live.groupBy("tick").agg(F.min("w_ms").alias("least"), F.count(F.lit(1)).alias("live"))
    return per.select("tick", F.max("least").over(W.orderBy("tick").rowsBetween(W.unboundedPreceding, 0)).alias("w_ms"), "live")


def strict_replays(events: DataFrame, delta_ms: int = 10_000) -> DataFrame:
    """Adds ``replay``: the event is more than two waits behind its partition's watermark when it comes."""
    w = F.col("prior_max") - delta_ms
    return prior_max(events, ["partition_id"]).withColumn("replay", F.coalesce(w - F.col("et_ms") > 2 * delta_ms, F.lit(False))).drop("prior_max")


def lag_replays(events: DataFrame, baseline: DataFrame, times: float = 10.0) -> DataFrame:
    """Adds ``replay``: the lag is over ``times`` the block's baseline (block, base_ms), which then does not learn from it.

    ``events`` has block; a block without a baseline above zero has no replays.
    """
    known = events.join(baseline, "block", "left")
    return known.withColumn("replay", F.coalesce((F.col("base_ms") > 0) & (F.col("lateness_ms") > times * F.col("base_ms")), F.lit(False))).drop("base_ms")


def sub_checkpoints(numbered: DataFrame, every: int = 1_000) -> DataFrame:
    """partition_id, checkpoint, rows, upto_ms: a checkpoint for each ``every`` events of a partition (seq: its arrival order from 0)."""
    return numbered.groupBy("partition_id", F.floor(F.col("seq") / every).cast("long").alias("checkpoint")).agg(F.count(F.lit(1)).alias("rows"), F.max("arrival_ms").alias("upto_ms"))


def adaptive_alpha(events: DataFrame, every_ms: int = 30_000) -> DataFrame:
    """partition_id, period, p99_s, alpha: the sketch's error for the next period; each period's sketch starts empty."""
    period = F.floor(F.col("arrival_ms") / every_ms).cast("long")
    per = events.where("lateness_ms >= 0").groupBy("partition_id", period.alias("period")).agg(F.round(F.percentile("lateness_ms", F.lit(0.99)) / 1000, 6).alias("p99_s"))
    low, high = ALPHA_LIMITS_S
    decided = F.when(F.col("p99_s") < low, ALPHAS[0]).when(F.col("p99_s") > high, ALPHAS[1])
    held = F.last(decided, ignorenulls=True).over(W.partitionBy("partition_id").orderBy("period").rowsBetween(W.unboundedPreceding, 0))
    return per.withColumn("alpha", F.coalesce(held, F.lit(ALPHAS[1])))


def dlq_state(late: DataFrame, now_ms: int, drained: int, retention_ms: int = RETENTION_MS) -> DataFrame:
    """backlog, oldest_age_ms, expired of the dead-letter table at ``now_ms``, its ``drained`` oldest rows being done.

    Rows older than the retention have expired; they are not in the backlog.
    """
    here = late.where(F.col("arrival_ms") <= now_ms)
    old = now_ms - F.col("arrival_ms") > retention_ms
    per = here.where(~old).groupBy("arrival_ms").agg(F.count(F.lit(1)).alias("n"))
    upto = per.withColumn("upto", F.sum("n").over(W.orderBy("arrival_ms").rowsBetween(W.unboundedPreceding, 0)))
    left = upto.where(F.col("upto") > drained).agg(F.sum(F.least(F.col("n"), F.col("upto") - drained)).alias("backlog"), F.min("arrival_ms").alias("oldest"))
    gone = here.agg(F.count_if(old).alias("expired"))
    return left.join(F.broadcast(gone)).select(F.coalesce("backlog", F.lit(0)).alias("backlog"), (F.lit(now_ms) - F.col("oldest")).alias("oldest_age_ms"), "expired")


def due_ms(arrival: Column, base_ms: int, start_ms: int, speed: float) -> Column:
    """When a paced replay releases a row: ``speed`` times as fast as it came."""
    return (F.lit(start_ms) + F.floor((arrival - base_ms) / speed)).cast("long")


def in_arrival_order(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds ``seq`` (from 0) in arrival order, of all rows or of each group of ``by``."""
    return prior_max(events, by, seq=True).drop("prior_max")
