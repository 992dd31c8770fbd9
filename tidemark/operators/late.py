"""Late events: guards, the dead-letter table, corrections and their reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.timeline import window_id
from tidemark.operators.completeness import with_need

FUTURE_SKEW_MS = 300_000
TIERS = ((0.001, "NORMAL"), (0.01, "WARNING"), (0.05, "ALERT"))


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The first arrival of each id. An aggregate, so it combines before the shuffle and a hot id stays small."""
    rest = [c for c in events.columns if c not in (key, "arrival_ms")]
    first = F.min(F.struct("arrival_ms", *rest)).alias("x")
    return events.groupBy(key).agg(first).select(key, "x.*").select(*events.columns)


def future_skew_split(events: DataFrame, most_ms: int = FUTURE_SKEW_MS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): events further ahead of their arrival than ``most_ms`` touch no state."""
    ahead = F.col("et_ms") - F.col("arrival_ms") > most_ms
    return events.where(~ahead), events.where(ahead)


def extreme_lag_split(events: DataFrame, most_ms: int) -> tuple[DataFrame, DataFrame]:
    extreme = F.col("arrival_ms") - F.col("et_ms") > most_ms
    return events.where(~extreme), events.where(extreme)


def negative_lag_tier(events: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """second, total, negative, rate, tier over the last minute of arrivals, per second."""
    second = F.floor(F.col("arrival_ms") / 1000).cast("long")
    per = events.groupBy(second.alias("second")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lateness_ms") < 0).alias("neg"))
    w = W.orderBy("second").rangeBetween(-(window_ms // 1000) + 1, 0)
    rows = per.select("second", F.sum("n").over(w).alias("total"), F.sum("neg").over(w).alias("negative"))
    rate = F.col("negative") / F.col("total")
    tier = F.lit("CRITICAL")
    for limit, name in reversed(TIERS):
        tier = F.when(rate < limit, name).otherwise(tier)
    return rows.withColumn("rate", F.round(rate, 6)).withColumn("tier", tier)


def negative_lag_adjusted(events: DataFrame, window: int = 1_000) -> DataFrame:
    """Adds adjusted_ms: negative lag raised by the size of the upper median of the last negative lags of its partition."""
    negative = F.col("lateness_ms") < 0
    w = W.partitionBy("partition_id").orderBy("arrival_ms", "event_id")
    lags = events.where(negative).withColumn("_last", F.array_sort(F.collect_list("lateness_ms").over(w.rowsBetween(-(window - 1), 0))))
    shift = F.abs(F.get("_last", F.floor(F.size("_last") / 2).cast("int")))
    return lags.withColumn("adjusted_ms", F.col("lateness_ms") + shift).drop("_last").unionByName(events.where(~negative).withColumn("adjusted_ms", F.col("lateness_ms")))


def late_events(events: DataFrame, wait_ms: int, size_ms: int = 5_000) -> DataFrame:
    """The dead-letter table of a fixed wait: late rows with the watermark they met and how late they were."""
    w = F.col("prior_max") - wait_ms
    rows = with_need(events, ["partition_id"], size_ms).withColumn("w_ms", w)
    return rows.where(F.col("need_ms") >= wait_ms).select(
        "event_id", "partition_id", "et_ms", "arrival_ms", "status", "ws", "w_ms", (F.col("arrival_ms") - F.col("et_ms")).alias("lag_ms"), F.greatest(F.col("w_ms") - F.col("et_ms"), F.lit(0)).alias("past_w_ms")
    )


def corrections(late: DataFrame, results: DataFrame) -> DataFrame:
    """One correction a window: what was emitted, what the late rows add, what it becomes.

    Ids of late rows are counted and their least and greatest kept, so that a
    window with any number of them stays one small row.
    """
    delta = late.groupBy("partition_id", "ws").agg(
        F.count(F.lit(1)).alias("delta_count"), F.count_if(F.col("status") == 500).alias("delta_500"), F.min("event_id").alias("first_late_id"), F.max("event_id").alias("last_late_id")
    )
    before = results.select("partition_id", "ws", F.col("n").alias("previous_count"), F.col("status_500").alias("previous_500"))
    joined = delta.join(before, ["partition_id", "ws"], "left").fillna(0, ["previous_count", "previous_500"])
    return joined.withColumns({"corrected_count": F.col("previous_count") + F.col("delta_count"), "corrected_500": F.col("previous_500") + F.col("delta_500")})


def correction_messages(late: DataFrame, results: DataFrame, value: str = "status") -> DataFrame:
    """``corrections`` with delta_sum (of ``value``) and ids, the late ids in order.

    A message carries all its ids, so it grows with its window's late rows;
    ``corrections`` is the bounded form.
    """
    more = late.groupBy("partition_id", "ws").agg(F.sum(value).alias("delta_sum"), F.array_sort(F.collect_list("event_id")).alias("ids"))
    return corrections(late, results).join(more, ["partition_id", "ws"])


def late_ids(late: DataFrame, size_ms: int = 5_000) -> DataFrame:
    """Late ids with the window they belong to, one row each: the list a correction message carries, unbounded."""
    return late.select(window_id(F.col("partition_id"), F.col("ws"), size_ms).alias("window_id"), "event_id")


def applied(results: DataFrame, changes: DataFrame, mode: str = "incremental") -> DataFrame:
    """Results with corrections: ``incremental`` adds deltas, ``replace`` sets counts, ``append`` keeps both versions.

    Corrections seen twice (same window and values) are applied once.
    """
    once = changes.select("partition_id", "ws", "delta_count", "delta_500", "corrected_count", "corrected_500").distinct()
    joined = results.join(once, ["partition_id", "ws"], "full_outer")
    known = F.col("delta_count").isNotNull()
    if mode == "incremental":
        n, bad = F.coalesce("n", F.lit(0)) + F.coalesce("delta_count", F.lit(0)), F.coalesce("status_500", F.lit(0)) + F.coalesce("delta_500", F.lit(0))
    elif mode in ("replace", "append"):
        n, bad = F.coalesce("corrected_count", "n"), F.coalesce("corrected_500", "status_500")
    else:
        raise ValueError("mode must be incremental, replace or append")
    version = F.when(known, F.lit(2)).otherwise(F.lit(1))
    out = joined.select("partition_id", "ws", n.alias("n"), bad.alias("status_500"), version.alias("version"))
    if mode == "append":
        first = results.join(once.select("partition_id", "ws"), ["partition_id", "ws"], "left_semi").select("partition_id", "ws", "n", "status_500", F.lit(1).alias("version"))
        out = out.unionByName(first)
    return out


def final_reconciliation(results: DataFrame, finals: DataFrame, now_ms: int, horizon_ms: int, size_ms: int = 5_000) -> DataFrame:
    """Windows that ended before the horizon and have no final message yet."""
    ended = results.where(F.col("ws") + size_ms < now_ms - horizon_ms)
    return ended.join(finals.select("partition_id", "ws"), ["partition_id", "ws"], "left_anti").select("partition_id", "ws", "n", F.lit("FINAL").alias("message"))


def sla_compliance(late: DataFrame, limit_ms: int) -> DataFrame:
    """Share of late rows that came within the limit (0 when there is none)."""
    good = F.count_if(F.col("lag_ms") <= limit_ms)
    return late.agg(F.count(F.lit(1)).alias("corrections"), good.alias("compliant"), F.coalesce(F.round(F.lit(100.0) * good / F.nullif(F.count(F.lit(1)), F.lit(0)), 3), F.lit(0.0)).alias("compliant_pct"))


def topk_corrections(changes: DataFrame, k: int = 10) -> DataFrame:
    return changes.select("partition_id", "ws", "delta_count").orderBy(F.desc("delta_count"), "partition_id", "ws").limit(k)


def oldest_first(late: DataFrame, k: int = 500) -> DataFrame:
    """The rows a drain of ``k`` takes."""
    return late.orderBy("arrival_ms", "event_id").limit(k)


def idempotent(new: DataFrame, emitted: DataFrame, key: str = "window_id") -> DataFrame:
    """Results whose key was not emitted before, one a key."""
    return new.dropDuplicates([key]).join(emitted.select(key), key, "left_anti")
