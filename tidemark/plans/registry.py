"""Queries over the driver's tables and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.partitioning import stable_partition_of, with_stable_partition
from tidemark.functions.schemas import EVENT_V1, valid_json
from tidemark.functions.timeline import window_id, windows_overlapping
from tidemark.operators import completeness as C
from tidemark.operators import control, late, sketch, stats
from tidemark.operators.running import prior_max
from tidemark.sources.events import table, timeline, trips_to_events
from tidemark.sources.folders import new_folder
from tidemark.streaming import jobs
from tidemark.streaming.engines import HeuristicOptions

#: Waits and limits of the registered late-data queries.
WAIT_MS = 20_000
SLA_MS = 60_000
EXTREME_MS = 300_000
FINAL_HORIZON_MS = 3_600_000
HEURISTIC_EVERY = 1_000
QUANTILES = (0.5, 0.9, 0.95, 0.99, 0.999)


def events(spark, sf_dir):
    return timeline(table(spark, sf_dir, "events"))


def _skewed(ev):
    """Every 997th event claims to come an hour later than it can."""
    return ev.withColumn("et_ms", F.when(F.col("event_id") % 997 == 0, F.col("et_ms") + 3_600_000).otherwise(F.col("et_ms")))


def _negative(ev):
    """Clocks that run 40 seconds ahead: negative lateness."""
    return ev.withColumn("lateness_ms", F.col("lateness_ms") - 40_000).withColumn("arrival_ms", F.col("et_ms") + F.col("lateness_ms"))


def _doubled(ev):
    """Every tenth event delivered again three seconds later."""
    return ev.unionByName(ev.where("event_id % 10 = 0").withColumn("arrival_ms", F.col("arrival_ms") + 3_000))


def _emitted(ev):
    """Results of the events on time for WAIT_MS, and the late rest."""
    need = C.with_need(ev, ["partition_id"])
    return stats.windowed_counts(need.where(C.on_time(F.col("need_ms"), WAIT_MS))), late.late_events(ev, WAIT_MS)


def _corrected(ev, mode):
    results, rest = _emitted(ev)
    return late.applied(results, late.corrections(rest, results), mode)


def strict_sweep(spark, d):
    return C.strict_sweep(events(spark, d))


def window_loss(spark, d):
    return C.window_loss(events(spark, d))


def partition_completeness(spark, d):
    return C.partition_completeness(events(spark, d))


def completeness_by_host(spark, d):
    return C.partition_completeness(events(spark, d), deltas=(0, 10, 60), key="host")


def window_size_sensitivity(spark, d):
    return C.window_size_sensitivity(events(spark, d))


def marginal_cost(spark, d):
    return C.marginal_cost(C.strict_sweep(events(spark, d)))


def first_reaching(spark, d):
    return C.first_reaching(C.strict_sweep(events(spark, d)))


def curve_fit(spark, d):
    return C.curve_fit(events(spark, d))


def wait_thresholds(spark, d):
    return C.wait_thresholds(events(spark, d))


def heuristic_sweep(spark, d):
    return C.heuristic_sweep(events(spark, d), every=HEURISTIC_EVERY)


def leff_convergence(spark, d):
    return C.leff_convergence(events(spark, d), every=HEURISTIC_EVERY).withColumn("leff_ms", F.round("leff_ms", 3))


def strict_vs_heuristic(spark, d):
    return C.strict_vs_heuristic(events(spark, d), every=HEURISTIC_EVERY)


def edge_cases(spark, d):
    return C.edge_cases(events(spark, d))


def windowed_counts(spark, d):
    return stats.windowed_counts(events(spark, d)).withColumn("window_id", window_id(F.col("partition_id"), F.col("ws"), 5_000))


def dedup_windowed_counts(spark, d):
    return stats.windowed_counts(late.deduplicated(_doubled(events(spark, d))))


def lateness_summary(spark, d):
    return stats.lateness_summary(events(spark, d))


def lateness_percentiles(spark, d):
    return stats.lateness_percentiles(events(spark, d))


def nearest_rank_percentiles(spark, d):
    return stats.nearest_rank_percentiles(events(spark, d))


def lateness_histogram(spark, d):
    return stats.lateness_histogram(events(spark, d))


def event_time_histogram(spark, d):
    return stats.event_time_histogram(events(spark, d))


def partition_skew(spark, d):
    return stats.partition_skew(events(spark, d))


def top_hosts(spark, d):
    return stats.top_hosts(events(spark, d))


def host_entropy(spark, d):
    return stats.host_entropy(events(spark, d))


def lateness_correlation(spark, d):
    return stats.lateness_correlation(events(spark, d))


def out_of_order_steps(spark, d):
    return stats.out_of_order_steps(events(spark, d))


def interarrival_gaps(spark, d):
    return stats.interarrival_gaps(events(spark, d))


def worker_rollup(spark, d):
    return stats.worker_rollup(events(spark, d))


def running_max(spark, d):
    return prior_max(events(spark, d), inclusive=True).select("event_id", F.col("prior_max").alias("max_et_ms"))


def running_max_by_partition(spark, d):
    return prior_max(events(spark, d), ["partition_id"]).select("event_id", F.col("prior_max").alias("prior_et_ms"))


def window_enumeration(spark, d):
    ev = events(spark, d)
    each = ev.select("event_id", F.explode(windows_overlapping(F.col("et_ms"), F.col("arrival_ms"), 5_000)).alias("ws"))
    return each.groupBy("ws").agg(F.count(F.lit(1)).alias("open_events"))


def _seconds(ev):
    return ev.withColumn("v", F.col("lateness_ms") / 1000.0)


def ddsketch_buckets(spark, d):
    return sketch.build(_seconds(events(spark, d)), "v")


def ddsketch_quantiles(spark, d):
    return sketch.quantiles(sketch.build(_seconds(events(spark, d)), "v"), QUANTILES)


def ddsketch_midpoint_quantiles(spark, d):
    return sketch.quantiles(sketch.build(_seconds(events(spark, d)), "v"), QUANTILES, mode="middle")


def ddsketch_merge_by_partition(spark, d):
    each = sketch.build(_seconds(events(spark, d)), "v", ["partition_id"])
    return sketch.quantiles(sketch.merge(each.where("partition_id < 6").drop("partition_id"), each.where("partition_id >= 6").drop("partition_id")), QUANTILES)


def ddsketch_collapsed(spark, d):
    return sketch.collapse(sketch.build(_seconds(events(spark, d)), "v"), 64)


def sliding_sketch_counts(spark, d):
    return sketch.sliding(_seconds(events(spark, d)), "v", "arrival_ms")


def future_skew_split(spark, d):
    good, bad = late.future_skew_split(_skewed(events(spark, d)))
    side = lambda df, name: df.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"), F.max("et_ms").alias("max_et_ms")).withColumn("side", F.lit(name))
    return side(good, "accepted").unionByName(side(bad, "future_skew"))


def extreme_lag(spark, d):
    good, bad = late.extreme_lag_split(events(spark, d), EXTREME_MS)
    return good.groupBy("partition_id").agg(F.count(F.lit(1)).alias("accepted")).join(bad.groupBy("partition_id").agg(F.count(F.lit(1)).alias("extreme")), "partition_id", "left").fillna(0, ["extreme"])


def negative_lag_tier(spark, d):
    return late.negative_lag_tier(_negative(events(spark, d)))


def late_events_dlq(spark, d):
    return late.late_events(events(spark, d), WAIT_MS)


def dlq_corrections(spark, d):
    results, rest = _emitted(events(spark, d))
    return late.corrections(rest, results)


def corrected_windows_incremental(spark, d):
    return _corrected(events(spark, d), "incremental")


def corrected_windows_replace(spark, d):
    return _corrected(events(spark, d), "replace")


def corrected_windows_append(spark, d):
    return _corrected(events(spark, d), "append")


def final_reconciliation(spark, d):
    ev = events(spark, d)
    results = stats.windowed_counts(ev)
    return late.final_reconciliation(results, results.where("partition_id = 3"), 50_000_000, FINAL_HORIZON_MS)


def sla_compliance(spark, d):
    return late.sla_compliance(late.late_events(events(spark, d), WAIT_MS), SLA_MS)


def topk_corrections(spark, d):
    results, rest = _emitted(events(spark, d))
    return late.topk_corrections(late.corrections(rest, results))


def dlq_oldest_first(spark, d):
    return late.oldest_first(late.late_events(events(spark, d), WAIT_MS)).select("event_id", "arrival_ms")


def global_watermark(spark, d):
    return control.global_watermark(control.heartbeats(events(spark, d)))


def node_skew_status(spark, d):
    return control.skew_status(control.heartbeats(events(spark, d))).withColumn("lag_s", F.round("lag_s", 3))


def partition_status(spark, d):
    beats = control.heartbeats(events(spark, d))
    return control.partition_status(beats, 43_200_000).withColumn("age_s", F.round("age_s", 3))


def backpressure_signals(spark, d):
    ev = events(spark, d)
    queue = ev.groupBy((F.col("partition_id") % 4).alias("partition_id"), F.floor(F.col("arrival_ms") / 10_000).alias("at")).agg((F.count(F.lit(1)) * 100).alias("queued"))
    return control.backpressure(queue)


def metric_alerts(spark, d):
    per = control.skew_status(control.heartbeats(events(spark, d)))
    return control.alerts(per.select((F.col("tick") * 60_000).alias("at_ms"), F.col("lag_s").alias("watermark_lag_s"), F.col("skew_ms").cast("double").alias("node_skew_ms")))


def schema_normalise(spark, d):
    from tidemark.functions.schemas import normalised

    ev = events(spark, d).withColumn("odd", F.col("event_id") % 2 == 1)
    rows = ev.select(
        "event_id",
        F.when(~F.col("odd"), F.col("status")).alias("status"),
        F.when(F.col("odd"), F.col("status")).alias("http_status"),
        F.when(F.col("odd"), F.concat(F.lit("svc-"), F.col("host"))).alias("service_name"),
        F.when(F.col("odd"), 2).alias("schema_version"),
    )
    return normalised(rows).groupBy("status", "http_status", "schema_version", (F.col("service_name") == "legacy-service").alias("legacy")).agg(F.count(F.lit(1)).alias("n"))


def schema_valid_json(spark, d):
    """Whether the events' props and made-up messages are valid version 1 events."""
    ev = events(spark, d)
    status = F.when(F.col("event_id") % 3 == 0, F.lit('"200"')).when(F.col("event_id") % 3 == 1, F.lit("200")).otherwise(F.lit("null"))
    message = F.concat(F.lit('{"event_id":"'), F.col("event_id").cast("string"), F.lit('","event_time":1.5,"schema_version":1,"status":'), status, F.lit("}"))
    return ev.select("event_id", valid_json(message, EVENT_V1).alias("valid"))


def stable_partition(spark, d):
    return with_stable_partition(events(spark, d).select("event_id", "host")).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))


def completeness_pivot(spark, d):
    ev = events(spark, d)
    strict = C.strict_sweep(ev).select(F.lit("strict").alias("mode"), F.col("wait_time_ms").cast("long").alias("wait_ms"), "completeness_pct")
    heuristic = C.heuristic_sweep(ev, every=HEURISTIC_EVERY).select(F.lit("heuristic").alias("mode"), (F.round("leff_s") * 1000).cast("long").alias("wait_ms"), F.col("immediate_pct").alias("completeness_pct"))
    return stats.completeness_pivot(strict.unionByName(heuristic))


def stage_shares(spark, d):
    ev = table(spark, d, "events")
    per = ev.groupBy(F.col("event_type").alias("stage"), (F.col("user_id") % 12).alias("p")).agg(F.percentile("value", F.lit(0.99)).alias("p99_us"))
    return stats.stage_shares(per).withColumn("p99", F.round("p99", 6))


def _trips(spark, d):
    """Orders and their lines as trips: ordered is pickup, shipped drop-off."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("o_orderdate").cast("timestamp_ntz").alias("tpep_pickup_datetime"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("tpep_dropoff_datetime"),
        F.col("l_suppkey").alias("PULocationID"),
        F.col("l_partkey").alias("DOLocationID"),
        F.col("l_extendedprice").cast("double").alias("total_amount"),
    )


def trips_cleaned(spark, d):
    ev = trips_to_events(_trips(spark, d), ("1995-01-01", "1997-01-01"), longest_s=90 * 86_400)
    return ev.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min("et_ms").alias("min_et_ms"), F.max("arrival_ms").alias("max_arrival_ms"), F.count("url").alias("urls"))


def trip_statistics(spark, d):
    t = _trips(spark, d).select((F.unix_date(F.to_date("tpep_dropoff_datetime")) - F.unix_date(F.to_date("tpep_pickup_datetime"))).alias("duration_s"))
    return stats.trip_statistics(t)


#: Slices of a bounded stream at least, and rows of one at most on average.
SLICES, SLICE_ROWS = 4, 1_000_000


def _slices(rows, spark):
    """A bounded stream's rows as files in arrival order.

    A file stream reads files by age, so the slices, equal spans of arrival time,
    are written one after the other, each as one file. The rows are read once
    and dealt to the slices' folders before that.
    """
    folder = new_folder(spark, "stream")
    span = rows.agg(F.count(F.lit(1)).alias("n"), F.min("arrival_ms").alias("first"), F.max("arrival_ms").alias("last")).first()
    n = max(SLICES, -(-span["n"] // SLICE_ROWS))
    width = max(1, -(-((span["last"] or 0) - (span["first"] or 0) + 1) // n))
    part = F.floor((F.col("arrival_ms") - (span["first"] or 0)) / width).cast("int")
    rows.withColumn("slice", part).write.partitionBy("slice").parquet(f"{folder}/cut")
    cut = spark.read.parquet(f"{folder}/cut")
    for i in range(n):
        cut.where(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return folder


def _streamed(spark, d, job, policy, delta_ms=10_000):
    rows = jobs.with_punctuation(events(spark, d), policy, delta_ms, 5_000)
    folder = _slices(rows, spark)
    jobs.run_to_files(job(jobs.read_stream(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


def stream_accounts(spark, d, delta_ms):
    """partition_id, received, on_time, late, duplicates of the strict stream under per-second tokens of the greatest event time."""
    out = _streamed(spark, d, lambda s: jobs.strict(s, delta_ms), "max-event-time", delta_ms).where("kind = 'metrics'")
    last = out.groupBy("partition_id").agg(F.max(F.struct("received", "on_time", "late", "duplicates")).alias("x"))
    return last.select("partition_id", "x.*")


def accounts_sql(delta_ms):
    """A row is late if its window ended by the watermark of the tokens before it, those of the seconds before its own."""
    return (
        "WITH "
        + _EV
        + f""", tk AS (SELECT partition_id, arrival_ms // 1000 AS tick, max(et_ms) AS top FROM ev GROUP BY 1, 2),
wm AS (SELECT partition_id, tick, max(top) OVER (PARTITION BY partition_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {delta_ms} AS w FROM tk)
SELECT ev.partition_id, count(*) AS received, count(*) FILTER (w IS NULL OR ev.ws + 5000 > w) AS on_time, count(*) FILTER (ev.ws + 5000 <= w) AS late, 0::BIGINT AS duplicates
FROM ev JOIN wm ON ev.partition_id = wm.partition_id AND ev.arrival_ms // 1000 = wm.tick GROUP BY 1"""
    )


def strict_stream(spark, d):
    """All windows of the strict stateful stream with end-of-stream punctuation: nothing is late."""
    out = _streamed(spark, d, jobs.strict, "data-driven").where("kind = 'window'")
    return out.select("partition_id", F.col("window_start").alias("ws"), F.col("count").alias("n"), "status_500")


def strict_stream_accounts(spark, d):
    """Counters of the strict stream, after the last batch."""
    return stream_accounts(spark, d, 10_000)


def heuristic_stream(spark, d):
    """Rows kept late by the adaptive stream, by route, and the accounts of each partition."""
    options = HeuristicOptions(l_max_ms=60_000, warmup_samples=100, every=50)
    out = _streamed(spark, d, lambda s: jobs.heuristic(s, options), "data-driven")
    late_rows = out.where("kind = 'late'").groupBy("partition_id").agg(F.count(F.lit(1)).alias("kept_late"))
    last = out.where("kind = 'metrics'").groupBy("partition_id").agg(F.max(F.struct("received", "on_time", "late", "duplicates")).alias("x")).select("partition_id", "x.*")
    return last.join(late_rows, "partition_id", "left").fillna(0, ["kept_late"])


def native_stream(spark, d):
    """Windows that Spark's own watermark closed in a bounded stream."""
    rows = jobs.with_punctuation(events(spark, d), "data-driven", 10_000, 5_000)
    folder = _slices(rows, spark)
    stream = jobs.native_strict(jobs.read_stream(spark, f"{folder}/in"), 60_000)
    jobs.run_to_files(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").drop("batch")


_HELPERS = {"stream_accounts", "accounts_sql", "new_folder", "HeuristicOptions", "events", "table", "timeline", "prior_max", "window_id", "windows_overlapping", "valid_json", "with_stable_partition", "stable_partition_of", "trips_to_events", "queries", "oracle_sql"}


def queries():
    from tidemark.plans import extra

    return {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and k not in _HELPERS} | extra.queries()


# DuckDB SQL. ``ev`` is the timeline; ``run`` adds the running maxima.

_EV = """
ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS host, CAST(user_id % 12 AS INTEGER) AS partition_id,
         (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 60000 AS et_ms,
         CAST(round(value * 1000) AS BIGINT) AS lateness_ms,
         (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 60000 + CAST(round(value * 1000) AS BIGINT) AS arrival_ms,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         ((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 60000) // 5000 * 5000 AS ws
  FROM events
)"""
_RUN = """, run AS (
  SELECT *, max(et_ms) OVER (ORDER BY arrival_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m,
         max(et_ms) OVER (PARTITION BY partition_id ORDER BY arrival_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
  FROM ev
)"""
_DELTAS = ", d AS (SELECT CAST(unnest([" + ", ".join(map(str, C.DELTAS)) + "]) AS INTEGER) AS delta_s)"
_SWEEP = (
    _RUN
    + _DELTAS
    + """, sweep AS (
  SELECT delta_s, delta_s * 1000 AS wait_time_ms, count(*) AS total, count(*) FILTER (m IS NULL OR ws + 5000 > m - delta_s * 1000) AS on_time
  FROM run, d GROUP BY delta_s
), strict AS (
  SELECT delta_s, wait_time_ms, total, on_time, total - on_time AS late,
         round(100.0::DOUBLE * on_time / total, 3) AS completeness_pct, round(100.0::DOUBLE * (total - on_time) / total, 3) AS late_rate_pct FROM sweep
)"""
)
_PS = "[" + ", ".join(map(str, C.PERCENTILES)) + "]"
_LEFF = f""", numbered AS (
  SELECT *, (row_number() OVER (ORDER BY arrival_ms, event_id) - 1) // {HEURISTIC_EVERY} AS block FROM run
), blocks AS (SELECT DISTINCT block FROM numbered), ps AS (SELECT unnest({_PS}) AS p), cum AS (
  SELECT b.block, count(*) AS n, quantile_cont(r.lateness_ms, {_PS}) AS q
  FROM blocks b JOIN numbered r ON r.block < b.block GROUP BY b.block
), leff AS (
  SELECT block, unnest({_PS}) AS p, CASE WHEN n >= 100 THEN unnest(q) ELSE 0.0 END AS leff_ms FROM cum
), heur AS (
  SELECT ps.p, count(*) AS total, count(*) FILTER (m IS NULL OR ws + 5000 > m - coalesce(l.leff_ms, 0)) AS on_time
  FROM numbered n CROSS JOIN ps LEFT JOIN leff l ON l.block = n.block AND l.p = ps.p GROUP BY ps.p
), final AS (SELECT unnest({_PS}) AS p, unnest(quantile_cont(lateness_ms, {_PS})) AS q FROM ev), heuristic AS (
  SELECT heur.p, round(q / 1000, 3) AS leff_s, total, on_time, total - on_time AS late_dlq, round(100.0::DOUBLE * on_time / total, 3) AS immediate_pct
  FROM heur JOIN final USING (p)
)"""
_LATE = (
    _RUN
    + f""", ontime AS (
  SELECT partition_id, ws, count(*) AS n, count(*) FILTER (status = 500) AS status_500 FROM run WHERE pm IS NULL OR pm - (ws + 5000) < {WAIT_MS} GROUP BY 1, 2
), dlq AS (
  SELECT event_id, partition_id, et_ms, arrival_ms, status, ws, pm - {WAIT_MS} AS w_ms, arrival_ms - et_ms AS lag_ms, greatest(pm - {WAIT_MS} - et_ms, 0) AS past_w_ms
  FROM run WHERE pm - (ws + 5000) >= {WAIT_MS}
), delta AS (
  SELECT partition_id, ws, count(*) AS delta_count, count(*) FILTER (status = 500) AS delta_500, min(event_id) AS first_late_id, max(event_id) AS last_late_id FROM dlq GROUP BY 1, 2
), corr AS (
  SELECT partition_id, ws, delta_count, delta_500, first_late_id, last_late_id, coalesce(n, 0) AS previous_count, coalesce(status_500, 0) AS previous_500,
         coalesce(n, 0) + delta_count AS corrected_count, coalesce(status_500, 0) + delta_500 AS corrected_500
  FROM delta LEFT JOIN ontime USING (partition_id, ws)
)"""
)
_FIXED = """SELECT coalesce(o.partition_id, c.partition_id) AS partition_id, coalesce(o.ws, c.ws) AS ws, coalesce(corrected_count, n) AS n,
       coalesce(corrected_500, status_500) AS status_500, CASE WHEN delta_count IS NULL THEN 1 ELSE 2 END AS version
FROM ontime o FULL JOIN corr c ON o.partition_id = c.partition_id AND o.ws = c.ws"""
_G = "(1.01 / 0.99)"
_BUCKETS = f""", sk AS (
  SELECT CAST(ceil(ln(least(greatest(lateness_ms / 1000.0::DOUBLE, 0.001), 3600.0) / 0.001) / {sketch.math.log(sketch.gamma())!r}) AS BIGINT) AS bucket, count(*) AS n FROM ev WHERE lateness_ms >= 0 GROUP BY 1
), cumsk AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM sk),
qs AS (SELECT unnest([{", ".join(map(str, QUANTILES))}])::DOUBLE AS q), picked AS (SELECT q, min(bucket) FILTER (upto >= greatest(1, ceil(total * q))) AS bucket FROM cumsk, qs GROUP BY q)"""
_BEATS = """, hb0 AS (
  SELECT partition_id, arrival_ms // 60000 AS tick, max(arrival_ms) AS at_ms, max(et_ms) - 10000 AS top_ms FROM ev GROUP BY 1, 2
), hb AS (SELECT partition_id, tick, at_ms, max(top_ms) OVER (PARTITION BY partition_id ORDER BY tick) AS w_ms FROM hb0), sk0 AS (
  SELECT tick, max(w_ms) - min(w_ms) AS skew_ms, (max(at_ms) - min(w_ms) - 10000) / 1000.0::DOUBLE AS lag_s FROM hb GROUP BY tick
)"""
_TRIPS = """trips AS (
  SELECT CAST(o_orderdate AS DATE) AS up, CAST(l_shipdate AS DATE) AS down, l_suppkey, l_partkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
_SKEW_COLUMNS = """CASE WHEN skew_ms <= 1000 THEN 'OK' WHEN skew_ms <= 5000 THEN 'Warning' ELSE 'Critical' END AS skew_status,
       CASE WHEN lag_s <= 12 THEN 'OK' WHEN lag_s <= 30 THEN 'Warning' WHEN lag_s <= 60 THEN 'High' ELSE 'Critical' END AS lag_status,
       CASE WHEN skew_ms > 5000 OR lag_s > 60 THEN 'Critical' WHEN skew_ms > 1000 OR lag_s > 12 THEN 'Degraded' ELSE 'Healthy' END AS combined,
       CASE WHEN skew_ms > 1000 AND lag_s > 12 THEN 'one partition holds all back' WHEN skew_ms > 1000 THEN 'partitions drift' WHEN lag_s > 12 THEN 'all are behind' ELSE 'healthy' END AS diagnosis"""


def oracle_sql():
    from tidemark.plans import extra

    return _sql() | extra.oracle_sql()


def _sql():
    ev = "WITH " + _EV
    sizes = " UNION ALL ".join(
        f"""SELECT {s} AS window_size_s, (max(et_ms) // {s * 1000}) + 1 AS n_windows FROM ev""" for s in C.SIZES_S
    )
    sens = f""", sz AS (SELECT unnest([{", ".join(map(str, C.SIZES_S))}]) AS w), sw AS (
  SELECT w, delta_s, round(100.0::DOUBLE * count(*) FILTER (m IS NULL OR et_ms // (w * 1000) * (w * 1000) + w * 1000 > m - delta_s * 1000) / count(*), 3) AS c FROM run, d, sz GROUP BY 1, 2
), nw AS ({sizes})
SELECT w AS window_size_s, any_value(n_windows) AS n_windows, max(c) FILTER (delta_s = 0) AS completeness_at_0s, max(c) FILTER (delta_s = 60) AS completeness_at_60s, max(c) AS max_completeness,
       min(delta_s) FILTER (c >= 95) AS delta_for_95pct, min(delta_s) FILTER (c >= 99) AS delta_for_99pct FROM sw JOIN nw ON w = window_size_s GROUP BY w"""
    edges = ", ".join(map(str, stats.EDGES))
    percents = ", ".join(str(p / 100) for p in stats.PERCENTS)
    q_upper = f"round(0.001::DOUBLE * pow({sketch.gamma()!r}::DOUBLE, bucket), 6)"
    q_mid = f"round(0.001::DOUBLE * pow({sketch.gamma()!r}::DOUBLE, bucket) * 2 / ({sketch.gamma()!r} + 1), 6)"
    doubled = """, dup AS (SELECT * FROM ev UNION ALL SELECT event_id, host, partition_id, et_ms, lateness_ms, arrival_ms + 3000, status, ws FROM ev WHERE event_id % 10 = 0),
one AS (SELECT * FROM dup QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_ms) = 1)"""
    nb = """, nb AS (SELECT et_ms, arrival_ms, lag(et_ms) OVER w AS pe, lag(arrival_ms) OVER w AS pa FROM ev WINDOW w AS (ORDER BY arrival_ms, event_id))"""
    per_alert = " UNION ALL ".join(
        f"SELECT tick * 60000 AS at_ms, '{n}' AS rule, '{s}' AS severity FROM (SELECT tick, lag_s AS watermark_lag_s, skew_ms AS node_skew_ms FROM sk0) WHERE {p}" for n, p, s in control.ALERTS if p.startswith(("watermark_lag_s", "node_skew_ms"))
    )
    return {
        "strict_stream_accounts": accounts_sql(10_000),
        # Spark drops what is late by the watermark of the batch before the last one; it starts at zero.
        "native_stream": ev
        + f""", sp AS (SELECT min(arrival_ms) AS first, max(arrival_ms) AS last, greatest({SLICES}, ceil((count(*) + 2 * count(DISTINCT partition_id)) / {SLICE_ROWS}.0)) AS n FROM ev),
sl AS (SELECT ev.*, (arrival_ms - first) // CAST(greatest(1, ceil((last - first + 1) / n)) AS BIGINT) AS slice FROM ev, sp),
tp AS (SELECT slice, max(et_ms) AS top FROM sl GROUP BY 1), wm AS (SELECT slice, greatest(0, coalesce(max(top) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 60000, 0)) AS w FROM tp)
SELECT partition_id, ws AS window_start, count(*) AS count, count(*) FILTER (status = 500) AS status_500 FROM sl JOIN wm USING (slice)
WHERE et_ms > w AND ws + 5000 <= (SELECT max(et_ms) - 60000 FROM ev) GROUP BY 1, 2""",
        "strict_sweep": ev + _SWEEP + " SELECT * FROM strict",
        "window_loss": ev
        + _RUN
        + _DELTAS
        + """, wl AS (SELECT delta_s, ws, 100.0::DOUBLE * (count(*) - count(*) FILTER (m IS NULL OR ws + 5000 > m - delta_s * 1000)) / count(*) AS loss FROM run, d GROUP BY 1, 2)
SELECT delta_s, count(*) AS windows, count(*) FILTER (loss > 0) AS windows_with_loss, round(quantile_cont(loss, 0.5), 4) AS p50_loss, round(quantile_cont(loss, 0.95), 4) AS p95_loss,
       round(quantile_cont(loss, 0.99), 4) AS p99_loss, round(max(loss), 4) AS max_loss, round(avg(loss), 4) AS mean_loss, count(*) FILTER (loss >= 99.9) AS windows_lost, count(*) FILTER (loss <= 0.1) AS windows_kept FROM wl GROUP BY 1""",
        "partition_completeness": ev
        + _RUN
        + _DELTAS
        + """, c AS (SELECT partition_id, delta_s, count(*) AS total, count(*) FILTER (pm IS NULL OR ws + 5000 > pm - delta_s * 1000) AS on_time FROM run, d GROUP BY 1, 2)
SELECT *, round(100.0::DOUBLE * on_time / total, 3) AS completeness_pct FROM c""",
        "completeness_by_host": ev
        + """, r AS (SELECT *, max(et_ms) OVER (PARTITION BY host ORDER BY arrival_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev), d AS (SELECT CAST(unnest([0, 10, 60]) AS INTEGER) AS delta_s),
c AS (SELECT host, delta_s, count(*) AS total, count(*) FILTER (m IS NULL OR ws + 5000 > m - delta_s * 1000) AS on_time FROM r, d GROUP BY 1, 2)
SELECT *, round(100.0::DOUBLE * on_time / total, 3) AS completeness_pct FROM c""",
        "window_size_sensitivity": ev + _RUN + _DELTAS + sens,
        "marginal_cost": ev
        + _SWEEP
        + """, l AS (SELECT *, lag(delta_s) OVER w AS pd, lag(completeness_pct) OVER w AS pc, lag(wait_time_ms) OVER w AS pw FROM strict WINDOW w AS (ORDER BY delta_s))
SELECT pd AS from_delta_s, delta_s AS to_delta_s, pc AS from_pct, completeness_pct AS to_pct, wait_time_ms - pw AS delta_wait_ms, round(completeness_pct - pc, 3) AS delta_comp_pct,
       CASE WHEN round(completeness_pct - pc, 3) > 0 THEN round((wait_time_ms - pw) / round(completeness_pct - pc, 3), 1) END AS ms_per_pct FROM l WHERE pd IS NOT NULL""",
        "first_reaching": ev + _SWEEP + ", t AS (SELECT unnest([50.0, 80.0, 90.0, 95.0, 99.0])::DOUBLE AS target_pct) SELECT target_pct, min(delta_s) FILTER (completeness_pct >= target_pct) AS delta_s FROM strict, t GROUP BY 1",
        "curve_fit": ev
        + _RUN
        + _DELTAS
        + """, pt AS (SELECT delta_s, round(100.0::DOUBLE * count(*) FILTER (m IS NULL OR ws + 5000 > m - delta_s * 1000) / count(*), 3) AS e, 100.0::DOUBLE * count(*) FILTER (lateness_ms <= delta_s * 1000) / count(*) AS t FROM run, d GROUP BY 1)
SELECT delta_s, e AS empirical_pct, round(t, 3) AS theoretical_pct, (SELECT round(1 - sum((e - t) * (e - t)) / sum((e - a) * (e - a)), 5) FROM pt, (SELECT avg(e) AS a FROM pt)) AS r_squared FROM pt""",
        "wait_thresholds": ev
        + f", t AS (SELECT CAST(unnest([{', '.join(map(str, C.THRESHOLDS_S))}]) AS INTEGER) AS threshold_s) SELECT threshold_s, round(100.0::DOUBLE * count(*) FILTER (lateness_ms <= threshold_s * 1000) / count(*), 3) AS within_pct, count(*) FILTER (lateness_ms > threshold_s * 1000) AS later FROM ev, t GROUP BY 1",
        "heuristic_sweep": ev + _RUN + _LEFF + " SELECT * FROM heuristic",
        "leff_convergence": ev + _RUN + _LEFF + " SELECT block, p::DOUBLE AS p, round(leff_ms, 3) AS leff_ms FROM leff",
        "strict_vs_heuristic": ev
        + _SWEEP
        + _LEFF
        + """, g AS (SELECT delta_s, completeness_pct AS strict_pct, p::DOUBLE AS p, leff_s, round(abs(leff_s - delta_s), 3) AS gap_s, immediate_pct AS heuristic_pct FROM strict, heuristic)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY delta_s ORDER BY gap_s, p) = 1""",
        "edge_cases": ev + " SELECT count(*) FILTER (lateness_ms > 120000) AS over_120s, count(*) FILTER (lateness_ms > 180000) AS over_180s, max(lateness_ms) AS max_ms, round(quantile_cont(lateness_ms, 0.9999), 3) AS p9999_ms FROM ev",
        "windowed_counts": ev + " SELECT partition_id, ws, count(*) AS n, count(*) FILTER (status = 500) AS status_500, format('{}_{:.1f}-{:.1f}', partition_id, ws / 1000.0::DOUBLE, (ws + 5000) / 1000.0::DOUBLE) AS window_id FROM ev GROUP BY 1, 2",
        "strict_stream": ev + " SELECT partition_id, ws, count(*) AS n, count(*) FILTER (status = 500) AS status_500 FROM ev GROUP BY 1, 2",
        "dedup_windowed_counts": ev + doubled + " SELECT partition_id, ws, count(*) AS n, count(*) FILTER (status = 500) AS status_500 FROM one GROUP BY 1, 2",
        "lateness_summary": ev
        + """ SELECT count(*) AS n, count(DISTINCT host) AS n_hosts, count(*) FILTER (status >= 500) AS n_500, min(et_ms) AS min_et_ms, max(et_ms) AS max_et_ms, max(et_ms) - min(et_ms) AS span_ms,
       round(avg(lateness_ms), 3) AS mean_ms, round(stddev_pop(lateness_ms), 3) AS std_ms,
       (SELECT round(avg(pow((lateness_ms - a) / s, 3)), 3) FROM ev, (SELECT avg(lateness_ms) AS a, stddev_pop(lateness_ms) AS s FROM ev)) AS skew,
       count(*) FILTER (lateness_ms < 0) AS negative, count(*) FILTER (lateness_ms = 0) AS zero FROM ev""",
        "lateness_percentiles": ev + f" SELECT unnest([{', '.join(map(str, stats.PERCENTS))}])::DOUBLE AS percent, round(unnest(quantile_cont(lateness_ms, [{percents}])), 3) AS lateness_ms FROM ev",
        "nearest_rank_percentiles": ev + ", o AS (SELECT lateness_ms, row_number() OVER (ORDER BY lateness_ms) - 1 AS i, count(*) OVER () AS n FROM ev), p AS (SELECT CAST(unnest([50, 90, 95, 99]) AS INTEGER) AS percent) SELECT percent, lateness_ms FROM o, p WHERE i = least(n - 1, n * percent // 100)",
        "lateness_histogram": ev
        + f""", e AS (SELECT CAST(unnest([{edges}]) AS INTEGER) AS low_s), b AS (SELECT (SELECT count(*) FROM e WHERE low_s * 1000 <= lateness_ms) - 1 AS bin FROM ev), h AS (SELECT bin, count(*) AS n FROM b WHERE bin >= 0 GROUP BY 1)
SELECT CAST(bin AS INTEGER) AS bin, list_extract([{edges}], CAST(bin + 1 AS INTEGER)) AS low_s, n, round(100.0::DOUBLE * n / sum(n) OVER (), 3) AS pct, round(100.0::DOUBLE * sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 3) AS cum_pct FROM h""",
        "event_time_histogram": ev + ", e AS (SELECT min(et_ms) AS lo, max(et_ms) AS hi FROM ev) SELECT CAST(least(23, (et_ms - lo) * 24 // greatest(hi - lo, 1)) AS INTEGER) AS bin, count(*) AS n FROM ev, e GROUP BY 1",
        "partition_skew": ev + ", c AS (SELECT partition_id, count(*) AS n FROM ev GROUP BY 1) SELECT partition_id, n, round(max(n) OVER () / avg(n) OVER (), 4) AS max_over_mean FROM c",
        "top_hosts": ev + " SELECT host, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, host LIMIT 20",
        "host_entropy": ev + ", c AS (SELECT count(*) AS n FROM ev GROUP BY host) SELECT count(*) AS hosts, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy_nats FROM c",
        "lateness_correlation": ev + " SELECT round(corr(et_ms, lateness_ms), 4) AS corr FROM ev",
        "out_of_order_steps": ev + nb + " SELECT count(*) AS n, count(*) FILTER (et_ms < pe) AS steps_back, round(100.0::DOUBLE * count(*) FILTER (et_ms < pe) / (count(*) - 1), 4) AS pct FROM nb",
        "interarrival_gaps": ev
        + nb
        + """, g AS (SELECT arrival_ms - pa AS gap FROM nb WHERE pa IS NOT NULL)
SELECT round(avg(gap), 4) AS mean_ms, quantile_cont(gap, 0.5) AS median_ms, round(quantile_cont(gap, 0.95), 4) AS p95_ms, round(quantile_cont(gap, 0.99), 4) AS p99_ms, max(gap) AS max_ms, count(*) FILTER (gap < 1) AS bursts FROM g""",
        "worker_rollup": ev
        + _RUN
        + """, p AS (SELECT partition_id, count(*) AS n, count(*) FILTER (pm IS NULL OR pm - (ws + 5000) < 0) AS ok, quantile_cont(lateness_ms, 0.5) AS p50, quantile_cont(lateness_ms, 0.99) AS p99 FROM run GROUP BY 1)
SELECT partition_id % 4 AS worker, CAST(sum(n) AS BIGINT) AS received, CAST(sum(ok) AS BIGINT) AS on_time, round(100.0::DOUBLE * sum(ok) / sum(n), 3) AS completeness_pct, round(avg(p50), 3) AS p50_ms, round(max(p99), 3) AS p99_ms FROM p GROUP BY 1""",
        "running_max": ev + " SELECT event_id, max(et_ms) OVER (ORDER BY arrival_ms, event_id ROWS UNBOUNDED PRECEDING) AS max_et_ms FROM ev",
        "running_max_by_partition": ev + _RUN + " SELECT event_id, pm AS prior_et_ms FROM run",
        "window_enumeration": ev + " SELECT ws, count(*) AS open_events FROM (SELECT unnest(range(et_ms // 5000 * 5000, arrival_ms, 5000)) AS ws FROM ev) GROUP BY 1",
        "ddsketch_buckets": ev + _BUCKETS + " SELECT * FROM sk",
        "ddsketch_quantiles": ev + _BUCKETS + f" SELECT q, bucket, {q_upper} AS estimate_s FROM picked",
        "ddsketch_midpoint_quantiles": ev + _BUCKETS + f" SELECT q, bucket, {q_mid} AS estimate_s FROM picked",
        "ddsketch_merge_by_partition": ev + _BUCKETS + f" SELECT q, bucket, {q_upper} AS estimate_s FROM picked",
        "ddsketch_collapsed": ev + _BUCKETS + ", r AS (SELECT bucket, n, row_number() OVER (ORDER BY bucket DESC) AS r FROM sk), f AS (SELECT min(bucket) AS f FROM r WHERE r <= 64) SELECT greatest(bucket, f) AS bucket, CAST(sum(n) AS BIGINT) AS n FROM r, f GROUP BY 1",
        "sliding_sketch_counts": ev + ", c AS (SELECT arrival_ms // 1000 AS second, count(*) AS n FROM ev WHERE lateness_ms >= 0 GROUP BY 1) SELECT second, CAST(sum(n) OVER (ORDER BY second RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM c",
        "future_skew_split": ev
        + """, s AS (SELECT partition_id, arrival_ms, CASE WHEN event_id % 997 = 0 THEN et_ms + 3600000 ELSE et_ms END AS et FROM ev)
SELECT partition_id, count(*) AS n, max(et) AS max_et_ms, CASE WHEN et - arrival_ms > 300000 THEN 'future_skew' ELSE 'accepted' END AS side FROM s GROUP BY 1, 4""",
        "extreme_lag": ev + f" SELECT partition_id, count(*) FILTER (lateness_ms <= {EXTREME_MS}) AS accepted, count(*) FILTER (lateness_ms > {EXTREME_MS}) AS extreme FROM ev GROUP BY 1",
        "negative_lag_tier": ev
        + """, c AS (SELECT CAST(floor((arrival_ms - 40000) / 1000.0) AS BIGINT) AS second, count(*) AS n, count(*) FILTER (lateness_ms < 40000) AS neg FROM ev GROUP BY 1),
w AS (SELECT second, sum(n) OVER r AS total, sum(neg) OVER r AS negative FROM c WINDOW r AS (ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT second, CAST(total AS BIGINT) AS total, CAST(negative AS BIGINT) AS negative, round(negative / total, 6) AS rate, CASE WHEN negative / total < 0.001 THEN 'NORMAL' WHEN negative / total < 0.01 THEN 'WARNING' WHEN negative / total < 0.05 THEN 'ALERT' ELSE 'CRITICAL' END AS tier FROM w""",
        "late_events_dlq": ev + _LATE + " SELECT * FROM dlq",
        "dlq_corrections": ev + _LATE + " SELECT * FROM corr",
        "corrected_windows_incremental": ev + _LATE + " " + _FIXED,
        "corrected_windows_replace": ev + _LATE + " " + _FIXED,
        "corrected_windows_append": ev + _LATE + " " + _FIXED + " UNION ALL SELECT partition_id, ws, n, status_500, 1 AS version FROM ontime SEMI JOIN corr USING (partition_id, ws)",
        "final_reconciliation": ev + f" SELECT partition_id, ws, count(*) AS n, 'FINAL' AS message FROM ev WHERE ws + 5000 < 50000000 - {FINAL_HORIZON_MS} AND partition_id <> 3 GROUP BY 1, 2",
        "sla_compliance": ev + _LATE + f" SELECT count(*) AS corrections, count(*) FILTER (lag_ms <= {SLA_MS}) AS compliant, coalesce(round(100.0::DOUBLE * count(*) FILTER (lag_ms <= {SLA_MS}) / nullif(count(*), 0), 3), 0.0) AS compliant_pct FROM dlq",
        "topk_corrections": ev + _LATE + " SELECT partition_id, ws, delta_count FROM corr ORDER BY delta_count DESC, partition_id, ws LIMIT 10",
        "dlq_oldest_first": ev + _LATE + " SELECT event_id, arrival_ms FROM dlq ORDER BY arrival_ms, event_id LIMIT 500",
        "global_watermark": ev
        + _BEATS
        + """, t AS (SELECT DISTINCT tick AS u FROM hb), l AS (SELECT u, partition_id, arg_max(w_ms, tick) AS w FROM t JOIN hb ON tick <= u AND tick > u - 3 GROUP BY 1, 2), g AS (SELECT u, min(w) AS low, count(*) AS partitions FROM l GROUP BY 1)
SELECT u AS tick, max(low) OVER (ORDER BY u) AS w_ms, partitions FROM g""",
        "node_skew_status": ev + _BEATS + f" SELECT tick, skew_ms, round(lag_s, 3) AS lag_s, {_SKEW_COLUMNS} FROM sk0",
        "partition_status": ev
        + _BEATS
        + """, l AS (SELECT partition_id, arg_max(at_ms, tick) AS at_ms, arg_max(w_ms, tick) AS w_ms FROM hb GROUP BY 1), a AS (SELECT *, (43200000 - at_ms) / 1000.0::DOUBLE AS age FROM l)
SELECT partition_id, at_ms, w_ms, round(age, 3) AS age_s, CASE WHEN age <= 0.5 THEN 'ACTIVE' WHEN age <= 2 THEN 'STALE' WHEN age <= 30 THEN 'IDLE' ELSE 'FAILED' END AS status FROM a""",
        "backpressure_signals": ev
        + """, q AS (SELECT partition_id % 4 AS partition_id, arrival_ms // 10000 AS "at", count(*) * 100 AS queued FROM ev GROUP BY 1, 2),
p AS (SELECT *, coalesce(last_value(CASE WHEN queued >= 500 THEN 1 WHEN queued < 100 THEN 0 END IGNORE NULLS) OVER (PARTITION BY partition_id ORDER BY "at" ROWS UNBOUNDED PRECEDING), 0) AS p FROM q),
l AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY partition_id ORDER BY "at"), 0) AS b FROM p)
SELECT partition_id, "at", queued, CASE WHEN p > b THEN 'PAUSE' WHEN p < b THEN 'RESUME' END AS signal, p = 1 AS paused FROM l""",
        "metric_alerts": ev + _BEATS + f" SELECT * FROM ({per_alert})",
        "schema_normalise": ev + " SELECT status, status AS http_status, CASE WHEN event_id % 2 = 1 THEN 2 ELSE 1 END AS schema_version, event_id % 2 <> 1 AS legacy, count(*) AS n FROM ev GROUP BY 1, 2, 3, 4",
        "schema_valid_json": ev + " SELECT event_id, event_id % 3 = 1 AS valid FROM ev",
        # BLAKE2b has no SQL: the hosts' partitions are listed.
        "stable_partition": f"SELECT list_extract([{', '.join(str(stable_partition_of(str(i))) for i in range(5_000))}], CAST(user_id + 1 AS INTEGER)) AS partition_id, count(*) AS n FROM events GROUP BY 1",
        "completeness_pivot": ev
        + _SWEEP
        + _LEFF
        + """, u AS (SELECT 's' AS mode, CAST(wait_time_ms AS BIGINT) AS wait_ms, completeness_pct AS c FROM strict UNION ALL SELECT 'h', CAST(round(leff_s) * 1000 AS BIGINT), immediate_pct FROM heuristic)
SELECT wait_ms, round(avg(c) FILTER (mode = 's'), 3) AS strict, round(avg(c) FILTER (mode = 'h'), 3) AS heuristic FROM u GROUP BY 1""",
        "stage_shares": """WITH p AS (SELECT event_type AS stage, user_id % 12 AS p, quantile_cont(value, 0.99) AS q FROM events GROUP BY 1, 2), m AS (SELECT stage, max(q) AS p99 FROM p GROUP BY 1), s AS (SELECT stage, p99, round(100.0::DOUBLE * p99 / sum(p99) OVER (), 2) AS share_pct FROM m)
SELECT stage, round(p99, 6) AS p99, share_pct, CASE WHEN share_pct >= 45 THEN 'Dominant' WHEN share_pct >= 25 THEN 'High' ELSE 'Watch' END AS verdict FROM s""",
        "trips_cleaned": "WITH "
        + _TRIPS
        + """, g AS (SELECT * FROM trips WHERE down > up AND down - up <= 90 AND up >= DATE '1995-01-01' AND down < DATE '1997-01-01'), z AS (SELECT min(up) AS t0 FROM g)
SELECT CAST(l_suppkey AS VARCHAR) AS host, count(*) AS n, min((up - t0) * 1440000) AS min_et_ms, max((down - t0) * 1440000) AS max_arrival_ms, count(*) AS urls FROM g, z GROUP BY 1""",
        "trip_statistics": "WITH "
        + _TRIPS
        + """, t AS (SELECT down - up AS d, CASE WHEN down - up > 0 AND down - up <= 21600 THEN down - up END AS g FROM trips)
SELECT count(*) AS n, count(*) FILTER (d <= 0) AS not_positive, count(*) FILTER (d > 21600) AS over_6h, quantile_cont(g, 0.5) AS p50_s, quantile_cont(g, 0.95) AS p95_s,
       round(quantile_cont(g, 0.95) / 30, 3) AS p95_late_div30, round(quantile_cont(g, 0.95) / 60, 3) AS p95_late_div60, round(quantile_cont(g, 0.95) / 120, 3) AS p95_late_div120 FROM t""",
    }
