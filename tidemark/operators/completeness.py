"""Completeness against waiting time: the batch study of both lateness policies.

An event is on time for a wait d if its window's end is past the watermark
``prior_max - d``. ``need_ms = prior_max - window_end`` is computed once; every
wait is then one conditional count over the same pass.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.timeline import window_start
from tidemark.operators.running import prior_max

DELTAS = (0, 1, 2, 3, 5, 7, 10, 15, 20, 30, 40, 50, 60, 90, 120)
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
SIZES_S = (1, 5, 10, 30, 60)
#: Rows whose running percentiles one task finds.
CHUNK_ROWS = 1_000_000
THRESHOLDS_S = (0, 1, 2, 3, 5, 7, 10, 12, 15, 20, 25, 30, 40, 45, 50, 60, 75, 90, 120, 150, 180)


def on_time(need: Column, delta_ms: Column | int) -> Column:
    """Null need: no event came before, so nothing is late."""
    return need.isNull() | (need < delta_ms)


def with_need(events: DataFrame, by: list[str] | None = None, size_ms: int = 5_000, seq: bool = False) -> DataFrame:
    return prior_max(events, by, seq=seq).withColumn("ws", window_start(F.col("et_ms"), size_ms)).withColumn("need_ms", F.col("prior_max") - (F.col("ws") + size_ms))


def pct(part: Column, total: Column, digits: int = 3) -> Column:
    return F.round(F.lit(100.0) * part / total, digits)


def _counts(df: DataFrame, by: list[str], deltas, keep: str = "need_ms") -> DataFrame:
    """by..., delta_s, total, on_time: one pass with a conditional count for each wait."""
    counts = [F.count_if(on_time(F.col(keep), d * 1000)).alias(f"_d{i}") for i, d in enumerate(deltas)]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts)
    rows = F.array(*[F.struct(F.lit(d).cast("int").alias("delta_s"), F.col(f"_d{i}").alias("on_time")) for i, d in enumerate(deltas)])
    return wide.select(*by, "total", F.explode(rows).alias("x")).select(*by, "x.delta_s", "total", "x.on_time")


def strict_sweep(events: DataFrame, deltas=DELTAS, size_ms: int = 5_000) -> DataFrame:
    """delta_s, wait_time_ms, total, on_time, late, completeness_pct, late_rate_pct under one global watermark."""
    rows = _counts(with_need(events, None, size_ms), [], deltas)
    late = F.col("total") - F.col("on_time")
    return rows.select(
        "delta_s",
        (F.col("delta_s") * 1000).alias("wait_time_ms"),
        "total",
        "on_time",
        late.alias("late"),
        pct(F.col("on_time"), F.col("total")).alias("completeness_pct"),
        pct(late, F.col("total")).alias("late_rate_pct"),
    )


def window_loss(events: DataFrame, deltas=DELTAS, size_ms: int = 5_000) -> DataFrame:
    """Per wait, the distribution over windows of the share of events lost."""
    rows = _counts(with_need(events, None, size_ms), ["ws"], deltas)
    loss = F.lit(100.0) * (F.col("total") - F.col("on_time")) / F.col("total")
    return rows.withColumn("loss", loss).groupBy("delta_s").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("loss") > 0).alias("windows_with_loss"),
        F.round(F.percentile("loss", F.lit(0.5)), 4).alias("p50_loss"),
        F.round(F.percentile("loss", F.lit(0.95)), 4).alias("p95_loss"),
        F.round(F.percentile("loss", F.lit(0.99)), 4).alias("p99_loss"),
        F.round(F.max("loss"), 4).alias("max_loss"),
        F.round(F.avg("loss"), 4).alias("mean_loss"),
        F.count_if(F.col("loss") >= 99.9).alias("windows_lost"),
        F.count_if(F.col("loss") <= 0.1).alias("windows_kept"),
    )


def partition_completeness(events: DataFrame, deltas=DELTAS, key: str = "partition_id") -> DataFrame:
    """Per partition and wait, with the partition's own watermark."""
    return _counts(with_need(events, [key]), [key], deltas).withColumn("completeness_pct", pct(F.col("on_time"), F.col("total")))


def window_size_sensitivity(events: DataFrame, sizes_s=SIZES_S, deltas=DELTAS) -> DataFrame:
    """Per window size: windows, completeness at 0 and 60 s and at most, first waits that reach 95 and 99 %.

    The running maximum does not depend on the size, so it is found once; each
    event then counts in every size. ``deltas`` must hold 0 and 60.
    """
    run = prior_max(events)

    def need(s: int) -> Column:
        return F.col("prior_max") - (window_start(F.col("et_ms"), s * 1000) + s * 1000)

    each = run.select("et_ms", F.inline(F.array(*[F.struct(F.lit(s).alias("window_size_s"), need(s).alias("need_ms")) for s in sizes_s])))
    counts = [F.count_if(on_time(F.col("need_ms"), d * 1000)).alias(f"_d{d}") for d in deltas]
    per = each.groupBy("window_size_s").agg(F.count(F.lit(1)).alias("n"), F.max("et_ms").alias("last"), *counts)
    per = per.withColumns({f"_d{d}": pct(F.col(f"_d{d}"), F.col("n")) for d in deltas})

    def first(least: float) -> Column:
        return F.least(*[F.when(F.col(f"_d{d}") >= least, F.lit(d)) for d in deltas])

    return per.select(
        "window_size_s",
        (F.floor(F.col("last") / (F.col("window_size_s") * 1000)) + 1).cast("long").alias("n_windows"),
        F.col("_d0").alias("completeness_at_0s"),
        F.col("_d60").alias("completeness_at_60s"),
        F.greatest(*[F.col(f"_d{d}") for d in deltas]).alias("max_completeness"),
        first(95.0).alias("delta_for_95pct"),
        first(99.0).alias("delta_for_99pct"),
    )


def marginal_cost(sweep: DataFrame) -> DataFrame:
    """Milliseconds of waiting for one more percent, from each wait to the next (null: nothing gained)."""
    w = W.orderBy("delta_s")
    rows = sweep.select("delta_s", "wait_time_ms", "completeness_pct").withColumns(
        {"from_delta_s": F.lag("delta_s").over(w), "from_pct": F.lag("completeness_pct").over(w), "from_ms": F.lag("wait_time_ms").over(w)}
    )
    gain, wait = F.round(F.col("completeness_pct") - F.col("from_pct"), 3), F.col("wait_time_ms") - F.col("from_ms")
    return rows.where("from_delta_s IS NOT NULL").select(
        "from_delta_s", F.col("delta_s").alias("to_delta_s"), "from_pct", F.col("completeness_pct").alias("to_pct"), wait.alias("delta_wait_ms"), gain.alias("delta_comp_pct"), F.when(gain > 0, F.round(wait / gain, 1)).alias("ms_per_pct")
    )


def curve_fit(events: DataFrame, deltas=DELTAS) -> DataFrame:
    """Per wait, measured completeness and the share of events at most that late; R squared of the two."""
    wide = [F.count(F.lit(1)).alias("n")]
    wide += [F.count_if(on_time(F.col("need_ms"), d * 1000)).alias(f"_e{d}") for d in deltas]
    wide += [F.count_if(F.col("lateness_ms") <= d * 1000).alias(f"_t{d}") for d in deltas]
    one = with_need(events).agg(*wide)
    rows = F.array(*[F.struct(F.lit(d).alias("delta_s"), pct(F.col(f"_e{d}"), F.col("n")).alias("empirical_pct"), (F.lit(100.0) * F.col(f"_t{d}") / F.col("n")).alias("theory")) for d in deltas])
    points = one.select(F.inline(rows))
    everything = W.partitionBy()
    mean = F.avg("empirical_pct").over(everything)
    res = F.sum(F.pow(F.col("empirical_pct") - F.col("theory"), F.lit(2))).over(everything)
    spread = points.withColumn("mean", mean).withColumn("res", res)
    total = F.sum(F.pow(F.col("empirical_pct") - F.col("mean"), F.lit(2))).over(everything)
    return spread.withColumn("tot", total).select(
        "delta_s", "empirical_pct", F.round("theory", 3).alias("theoretical_pct"), F.round(F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(0.0), 5).alias("r_squared")
    )


def wait_thresholds(events: DataFrame, thresholds=THRESHOLDS_S) -> DataFrame:
    """Share of events at most each threshold late, and how many are later."""
    one = events.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("lateness_ms") <= t * 1000).alias(f"_t{t}") for t in thresholds])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold_s"), pct(F.col(f"_t{t}"), F.col("n")).alias("within_pct"), (F.col("n") - F.col(f"_t{t}")).alias("later")) for t in thresholds])
    return one.select(F.inline(rows))


def _quantiles_by_block(key, before: pd.DataFrame, rows: pd.DataFrame, ps, warm: int) -> pd.DataFrame:
    """block, i, leff_ms, on_time for the blocks of one chunk, from a running histogram of distinct lateness."""
    values = np.unique(np.concatenate([before["lateness_ms"].to_numpy(np.int64), rows["lateness_ms"].to_numpy(np.int64)]))
    counts = np.zeros(len(values), np.int64)
    np.add.at(counts, np.searchsorted(values, before["lateness_ms"].to_numpy(np.int64)), before["n"].to_numpy(np.int64))
    rows = rows.sort_values("block", kind="stable")
    block, place = rows["block"].to_numpy(np.int64), np.searchsorted(values, rows["lateness_ms"].to_numpy(np.int64))
    need = rows["need_ms"].to_numpy(np.float64, na_value=-np.inf)
    cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1)) if len(block) else np.zeros(0, np.int64)
    out = []
    for lo, hi in zip(cuts, [*cuts[1:], len(block)], strict=True):
        upto = np.cumsum(counts)
        n = int(upto[-1])
        at = np.array(ps, float) * max(n - 1, 0)
        low, high = np.floor(at), np.ceil(at)
        if n >= warm:
            below, above = (values[np.searchsorted(upto, x.astype(np.int64), side="right")] for x in (low, high))
            leff = np.where(low == high, below, (high - at) * below + (at - low) * above)
        else:
            leff = np.zeros(len(ps))
        good = (need[lo:hi, None] < leff[None, :]).sum(axis=0)
        out += [(int(block[lo]), i, float(x), int(g), n) for i, (x, g) in enumerate(zip(leff, good, strict=True))]
        counts += np.bincount(place[lo:hi], minlength=len(values))
    return pd.DataFrame(out, columns=["block", "i", "leff_ms", "on_time", "rows_before"]).astype({"block": "int64", "i": "int32", "leff_ms": "float64", "on_time": "int64", "rows_before": "int64"})


def _by_block(events: DataFrame, ps, every: int, warm: int, chunk_rows: int) -> DataFrame:
    """block, i, leff_ms, on_time, rows_before: exact percentiles of the lateness of all rows before each block.

    Blocks go in chunks of about ``chunk_rows`` rows. What a chunk must know of
    the rows before it is a histogram of distinct lateness, so the work is that of
    the rows, plus distinct lateness times chunks.
    """
    rows = with_need(events, seq=True).withColumn("block", F.floor(F.col("seq") / every).cast("long"))
    rows = rows.select("block", F.floor(F.col("block") / max(1, chunk_rows // every)).cast("long").alias("chunk"), "lateness_ms", "need_ms")
    counts = rows.groupBy("chunk", "lateness_ms").agg(F.count(F.lit(1)).alias("n"))
    last = counts.agg(F.max("chunk").alias("last"))
    # Each lateness counts in all chunks after its own: a row for each of them, then running sums.
    later = counts.groupBy("lateness_ms").agg(F.min("chunk").alias("first")).join(F.broadcast(last)).where("first < last")
    later = later.select("lateness_ms", F.explode(F.sequence("first", "last")).alias("chunk")).join(counts, ["chunk", "lateness_ms"], "left")
    before = later.select("chunk", "lateness_ms", F.sum("n").over(W.partitionBy("lateness_ms").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)).alias("n")).where("n IS NOT NULL")
    # Columns of their own: both sides come from the same rows.
    before = before.select(*[F.col(c).alias(c) for c in before.columns])
    search = partial(_quantiles_by_block, ps=tuple(ps), warm=warm)
    return before.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInPandas(search, "block long, i int, leff_ms double, on_time long, rows_before long")


def leff_convergence(events: DataFrame, ps=PERCENTILES, every: int = 1_000, warm: int = 100, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """block, p, leff_ms: exact percentile of the lateness of all rows before the block (0 until ``warm``)."""
    p = F.element_at(F.array(*[F.lit(float(p)) for p in ps]), F.col("i") + 1)
    return _by_block(events, ps, every, warm, chunk_rows).where("rows_before > 0").select("block", p.alias("p"), "leff_ms")


def heuristic_sweep(events: DataFrame, ps=PERCENTILES, every: int = 1_000, warm: int = 100, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per percentile: final L_eff, rows on time at once, rows left to the dead-letter queue."""
    good = _by_block(events, ps, every, warm, chunk_rows).groupBy("i").agg(F.sum("on_time").alias("on_time"))
    one = events.agg(F.count(F.lit(1)).alias("total"), F.percentile("lateness_ms", F.array(*[F.lit(p) for p in ps])).alias("q"))
    p = F.element_at(F.array(*[F.lit(float(p)) for p in ps]), F.col("i") + 1)
    return good.join(F.broadcast(one)).select(
        p.alias("p"),
        F.round(F.element_at("q", F.col("i") + 1) / 1000, 3).alias("leff_s"),
        "total",
        "on_time",
        (F.col("total") - F.col("on_time")).alias("late_dlq"),
        pct(F.col("on_time"), F.col("total")).alias("immediate_pct"),
    )


def strict_vs_heuristic(events: DataFrame, deltas=DELTAS, ps=PERCENTILES, every: int = 1_000) -> DataFrame:
    """For each wait, the percentile whose L_eff is nearest (ties: the smaller)."""
    strict = strict_sweep(events, deltas).select("delta_s", "completeness_pct")
    heuristic = heuristic_sweep(events, ps, every).select("p", "leff_s", "immediate_pct")
    # Both tables have as many rows as parameters.
    near = strict.join(F.broadcast(heuristic)).groupBy("delta_s", "completeness_pct").agg(F.min(F.struct(F.round(F.abs(F.col("leff_s") - F.col("delta_s")), 3).alias("gap_s"), "p", "leff_s", "immediate_pct")).alias("x"))
    return near.select("delta_s", F.col("completeness_pct").alias("strict_pct"), "x.p", "x.leff_s", "x.gap_s", F.col("x.immediate_pct").alias("heuristic_pct"))


def edge_cases(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count_if(F.col("lateness_ms") > 120_000).alias("over_120s"),
        F.count_if(F.col("lateness_ms") > 180_000).alias("over_180s"),
        F.max("lateness_ms").alias("max_ms"),
        F.round(F.percentile("lateness_ms", F.lit(0.9999)), 3).alias("p9999_ms"),
    )


def first_reaching(sweep: DataFrame, targets=(50.0, 80.0, 90.0, 95.0, 99.0)) -> DataFrame:
    """The least wait that reaches each target (null: none does)."""
    one = sweep.agg(*[F.min(F.when(F.col("completeness_pct") >= t, F.col("delta_s"))).alias(f"_t{i}") for i, t in enumerate(targets)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("target_pct"), F.col(f"_t{i}").alias("delta_s")) for i, t in enumerate(targets)])))
