"""More queries over the driver's tables, with their DuckDB SQL: sources, sinks, progress and live runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import schemas
from tidemark.functions.timeline import window_id
from tidemark.operators import completeness as C
from tidemark.operators import control, late, progress, sketch, stats
from tidemark.plans import registry as base
from tidemark.sources import events as sources
from tidemark.sources import sinks
from tidemark.sources.folders import new_folder
from tidemark.streaming import jobs

#: Waits (s) of the live sweep; a cluster run for each.
LIVE_DELTAS = (0, 10, 30, 60)
NOW_MS, DRAINED, RETENTION_MS = 40_000_000, 500, 20_000_000
REPLAY_TIMES = 3.0


def _events(spark, d):
    """The timeline with a size for each event: the bytes of its properties."""
    ev = sources.table(spark, d, "events")
    return base.events(spark, d).join(ev.select("event_id", F.octet_length("props").cast("long").alias("bytes")), "event_id")


def _per_host(rows):
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min("et_ms").alias("min_et_ms"), F.max("arrival_ms").alias("max_arrival_ms"), F.sum("bytes").alias("bytes"), F.count_if(F.col("status") == 500).alias("errors"))


def engine_csv_source(spark, d):
    path = new_folder(spark, "engine-csv")
    sources.write_csv(_events(spark, d), path)
    return _per_host(sources.read_csv_any(spark, path))


def access_log_source(spark, d):
    path = new_folder(spark, "access-log")
    sources.write_access_log(_events(spark, d), path)
    return _per_host(sources.read_csv_any(spark, path))


def jsonl_source(spark, d):
    """Both versions as JSON lines, every seventh row without event time, which drops it."""
    path, ev = new_folder(spark, "jsonl"), base.events(spark, d)
    odd = F.col("event_id") % 2 == 1
    at = F.when(F.col("event_id") % 7 != 0, F.col("et_ms") / 1000.0)
    ev.select(F.col("event_id").cast("string").alias("event_id"), at.alias("event_time"), F.when(~odd, F.col("status")).alias("status"), F.when(odd, F.col("status")).alias("http_status"), F.when(odd, F.lit("svc")).alias("service_name"), F.when(odd, 2).otherwise(1).alias("schema_version")).write.json(path)
    return sources.read_jsonl(spark, path).groupBy("schema_version", "service_name", "status", "http_status").agg(F.count(F.lit(1)).alias("n"), F.max("event_time").alias("last_s"))


def taxi_source(spark, d):
    path = new_folder(spark, "trips")
    base._trips(spark, d).withColumn("tpep_dropoff_datetime", F.expr("tpep_pickup_datetime + INTERVAL '90' MINUTES")).write.parquet(path)
    rows = sources.read_taxi(spark, path, ("1995-01-01", "1996-01-01"))
    return rows.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.min("et_ms").alias("min_et_ms"), F.max("arrival_ms").alias("max_arrival_ms"), F.sum("bytes").alias("bytes"))


def synthetic_source(spark, d):
    return sources.synthetic(spark, 5_000)


def disturbed_arrivals(spark, d):
    return sources.shuffled_arrivals(base.events(spark, d), remap_ms=3_600_000).select("event_id", "sort_ms", "et_ms")


def _results(spark, d):
    ev = base.events(spark, d)
    return stats.windowed_counts(ev).withColumn("window_id", window_id(F.col("partition_id"), F.col("ws"), 5_000))


def idempotent_sink(spark, d):
    """Three partitions, then all of them twice under one batch id, then all once more: each window is there once."""
    path, results = new_folder(spark, "emitted"), _results(spark, d)
    for batch, rows in ((0, results.where("partition_id < 3")), (1, results), (1, results), (2, results)):
        sinks.emit_once(rows, path, batch)
    return spark.read.parquet(path).select("window_id", "n", "batch")


def audit_sink(spark, d):
    path, results = new_folder(spark, "audit"), _results(spark, d)
    for batch in (0, 1):
        sinks.audited(results.where(f"partition_id < {3 * (batch + 1)}"), f"{path}/results", f"{path}/copies", batch)
    return spark.read.parquet(f"{path}/copies").groupBy("offered", "partition_id").agg(F.sum("n").alias("n"))


def object_store_history(spark, d):
    path = new_folder(spark, "history")
    sinks.history(stats.windowed_counts(base.events(spark, d)), path)
    kept = sinks.purge_history(spark, path, 10_000_000)
    some = sinks.read_history(spark, kept, [1, 5]).groupBy("partition_id").agg(F.sum("n").alias("events"))
    return sinks.history_stats(spark, kept).join(some, "partition_id", "left").withColumn("partition_id", F.col("partition_id").cast("int"))


def report_tables(spark, d):
    path = new_folder(spark, "report")
    sinks.report_csv(C.strict_sweep(base.events(spark, d)), path, "delta_s")
    return spark.read.csv(path, header=True, schema="delta_s int, wait_time_ms int, total long, on_time long, late long, completeness_pct double, late_rate_pct double").select("delta_s", "total", "on_time", "completeness_pct")


def idempotent_emit(spark, d):
    results = _results(spark, d)
    return late.idempotent(results.unionByName(results), results.where("partition_id % 2 = 0")).select("window_id", "n")


def dual_schema_emit(spark, d):
    ev = base.events(spark, d)
    rows = schemas.normalised(ev.select("event_id", "status", F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("service_name"), F.lit(None).cast("int").alias("schema_version")))
    out = schemas.emitted(rows, "dual_emit")
    return out.groupBy("schema_version", "service_name").agg(F.count(F.lit(1)).alias("n"), F.count("status").alias("with_status"), F.count("http_status").alias("with_http_status"))


def schema_compatibility(spark, d):
    pairs = (("event 1 to 2", schemas.EVENT_V1, schemas.EVENT_V2), ("event 2 to 1", schemas.EVENT_V2, schemas.EVENT_V1), ("result 1 to 2", schemas.RESULT_V1, schemas.RESULT_V2))
    registry = schemas.Registry()
    rows = [(name, len(schemas.incompatibilities(a, b)), registry.register(name, a)[0], registry.register(name, b)[0], registry.register(name, a)[0]) for name, a, b in pairs]
    return spark.createDataFrame(rows, "step string, problems int, first_id int, second_id int, again_id int")


def negative_lag_adjusted(spark, d):
    return late.negative_lag_adjusted(base._negative(base.events(spark, d)), 50).select("event_id", "adjusted_ms")


def corrections_seen_twice(spark, d):
    results, rest = base._emitted(base.events(spark, d))
    changes = late.corrections(rest, results)
    return late.applied(results, changes.unionByName(changes), "incremental")


def dlq_correction_messages(spark, d):
    results, rest = base._emitted(base.events(spark, d))
    return late.correction_messages(rest, results).select("partition_id", "ws", "delta_count", "delta_sum", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))


def dlq_state(spark, d):
    return progress.dlq_state(late.late_events(base.events(spark, d), base.WAIT_MS), NOW_MS, DRAINED, RETENTION_MS)


def ingestor_health(spark, d):
    ev = base.events(spark, d)
    beats = ev.select((F.col("partition_id") % 4).alias("ingestor_id"), F.col("et_ms").alias("t_commit_ms"), F.col("arrival_ms").alias("heard_ms"), (F.col("arrival_ms") + F.col("partition_id") * 100).alias("clock_ms"))
    return control.ingestor_health(beats.where(f"heard_ms <= {NOW_MS}"), NOW_MS)


def byte_summary(spark, d):
    return _events(spark, d).agg(F.sum("bytes").alias("total_bytes"), F.max("bytes").alias("max_bytes"))


def latency_percentiles(spark, d):
    return stats.latency_percentiles(base._negative(base.events(spark, d)), "lateness_ms", ["partition_id"])


def worst_windows(spark, d):
    need = C.with_need(base.events(spark, d), ["partition_id"])
    return stats.worst_windows(need.select("ws", (~C.on_time(F.col("need_ms"), base.WAIT_MS)).alias("late")))


def worst_partitions(spark, d):
    ev = base.events(spark, d)
    return stats.worst_partitions(ev.groupBy("partition_id").agg(F.percentile("lateness_ms", F.lit(0.99)).alias("p99_us")))


def zone_counts(spark, d):
    return base._trips(spark, d).groupBy(F.col("PULocationID").alias("zone")).agg(F.count(F.lit(1)).alias("pickups"), F.countDistinct("DOLocationID").alias("drop_offs"))


def trip_description(spark, d):
    return stats.described(base._trips(spark, d), ["total_amount", "PULocationID", "DOLocationID"])


def sliding_quantiles(spark, d):
    return sketch.sliding_quantiles(base._seconds(base.events(spark, d)), "v", "arrival_ms", window_s=600)


def token_progress(spark, d):
    return progress.token_progress(base.events(spark, d), every_ms=600_000, idle_ms=1_200_000)


def watermark_without_idle(spark, d):
    return progress.watermark_without_idle(progress.token_progress(base.events(spark, d).where("partition_id <> 4 OR et_ms < 9000000"), every_ms=600_000, idle_ms=1_200_000))


def watermark_of_live(spark, d):
    return progress.watermark_of_live(control.heartbeats(base.events(spark, d)), stale_ms=30_000)


def strict_replays(spark, d):
    return progress.strict_replays(base.events(spark, d)).where("replay").select("event_id", "partition_id", "et_ms")


def lag_replays(spark, d):
    numbered = progress.in_arrival_order(base.events(spark, d)).withColumn("block", F.floor(F.col("seq") / base.HEURISTIC_EVERY).cast("long"))
    found = C.leff_convergence(base.events(spark, d), ps=(0.5,), every=base.HEURISTIC_EVERY).select("block", F.col("leff_ms").alias("base_ms"))
    return progress.lag_replays(numbered, found, REPLAY_TIMES).groupBy("block").agg(F.count_if("replay").alias("replays"), F.count(F.lit(1)).alias("rows"))


def sub_checkpoints(spark, d):
    return progress.sub_checkpoints(progress.in_arrival_order(base.events(spark, d), ["partition_id"]), 100)


def adaptive_alpha(spark, d):
    return progress.adaptive_alpha(base.events(spark, d), 600_000)


def arrival_order(spark, d):
    return progress.in_arrival_order(base.events(spark, d)).select("event_id", "seq")


def first_arrivals(spark, d):
    """The row cap: the first rows of the stream."""
    return base.events(spark, d).orderBy("arrival_ms", "event_id").limit(500).select("event_id", "arrival_ms")


def paced_replay(spark, d):
    ev = base.events(spark, d)
    return ev.select("event_id", progress.due_ms(F.col("arrival_ms"), 0, 1_000_000, 60.0).alias("due_ms"))


def live_sweep(spark, d):
    """delta_s, received, on_time, late, completeness_pct: a live strict run for each wait, its partitions' last accounts summed."""
    out = None
    for delta in LIVE_DELTAS:
        accounts = base.stream_accounts(spark, d, delta * 1000)
        one = accounts.agg(F.sum("received").alias("received"), F.sum("on_time").alias("on_time"), F.sum("late").alias("late")).select(F.lit(delta).alias("delta_s"), "*", C.pct(F.col("on_time"), F.col("received")).alias("completeness_pct"))
        out = one if out is None else out.unionByName(one)
    return out


_OWN = {n for n in globals() if not n.startswith("_")} & {
    "engine_csv_source", "access_log_source", "jsonl_source", "taxi_source", "synthetic_source", "disturbed_arrivals", "idempotent_sink", "audit_sink", "object_store_history", "report_tables",
    "idempotent_emit", "dual_schema_emit", "schema_compatibility", "negative_lag_adjusted", "corrections_seen_twice", "dlq_correction_messages", "dlq_state", "ingestor_health", "byte_summary",
    "latency_percentiles", "worst_windows", "worst_partitions", "zone_counts", "trip_description", "sliding_quantiles", "token_progress", "watermark_without_idle", "watermark_of_live",
    "strict_replays", "lag_replays", "sub_checkpoints", "adaptive_alpha", "arrival_order", "first_arrivals", "paced_replay", "live_sweep",
}


def queries():
    return {n: globals()[n] for n in sorted(_OWN)}


def oracle_sql():
    ev = "WITH " + base._EV
    by_host = "SELECT host, count(*) AS n, min({et}) AS min_et_ms, max({at}) AS max_arrival_ms, CAST(sum(strlen(props)) AS BIGINT) AS bytes, count(*) FILTER (status = 500) AS errors FROM ev JOIN events USING (event_id) GROUP BY 1"
    draw = lambda seed, x: f"(CAST('0x' || md5('{seed}:' || {x})[1:8] AS BIGINT) / 4294967296.0::DOUBLE)"
    wid = "format('{}_{:.1f}-{:.1f}', partition_id, ws / 1000.0::DOUBLE, (ws + 5000) / 1000.0::DOUBLE) AS window_id"
    res = f", res AS (SELECT partition_id, ws, count(*) AS n, {wid} FROM ev GROUP BY 1, 2)"
    neg = ", neg AS (SELECT event_id, partition_id, lateness_ms - 40000 AS late, et_ms + lateness_ms - 40000 AS seen FROM ev)"
    tokens = """, t0 AS (SELECT partition_id, arrival_ms // 600000 AS tick, max(arrival_ms) AS heard, max(et_ms) AS top FROM {src} GROUP BY 1, 2),
t1 AS (SELECT partition_id, unnest(range(min(tick), (SELECT max(tick) FROM t0) + 1)) AS tick FROM t0 GROUP BY 1),
tok AS (SELECT partition_id, tick, t0.heard IS NULL AS is_empty, (tick + 1) * 600000 - max(t0.heard) OVER w >= 1200000 AS idle, max(top) OVER w - 10000 AS w_ms
  FROM t1 LEFT JOIN t0 USING (partition_id, tick) WINDOW w AS (PARTITION BY partition_id ORDER BY tick ROWS UNBOUNDED PRECEDING))"""
    live = " UNION ALL ".join(
        f"SELECT CAST({x} AS INTEGER) AS delta_s, CAST(sum(received) AS BIGINT) AS received, CAST(sum(on_time) AS BIGINT) AS on_time, CAST(sum(late) AS BIGINT) AS late, round(100.0::DOUBLE * sum(on_time) / sum(received), 3) AS completeness_pct FROM ({base.accounts_sql(x * 1000)})"
        for x in LIVE_DELTAS
    )
    return {
        "engine_csv_source": ev + " " + by_host.format(et="et_ms", at="arrival_ms"),
        "access_log_source": ev + " " + by_host.format(et="et_ms // 1000 * 1000", at="et_ms // 1000 * 1000 + 2000"),
        "jsonl_source": ev + " SELECT CAST(CASE WHEN event_id % 2 = 1 THEN 2 ELSE 1 END AS INTEGER) AS schema_version, CASE WHEN event_id % 2 = 1 THEN 'svc' ELSE 'legacy-service' END AS service_name, status, status AS http_status, count(*) AS n, max(et_ms / 1000.0::DOUBLE) AS last_s FROM ev WHERE event_id % 7 <> 0 GROUP BY 1, 2, 3, 4",
        "taxi_source": "WITH "
        + base._TRIPS
        + """, g AS (SELECT *, up AS u, l_extendedprice AS a FROM trips WHERE up >= DATE '1995-01-01' AND up < DATE '1996-01-01' AND up + INTERVAL 90 MINUTES < TIMESTAMP '1996-01-01'), z AS (SELECT min(u) AS t0 FROM g)
SELECT '/zone/' || CAST(l_partkey AS VARCHAR) AS url, count(*) AS n, min((u - t0) * 1440000) AS min_et_ms, max((u - t0) * 1440000 + 90000) AS max_arrival_ms, CAST(sum(CAST(trunc(greatest(0, CAST(a AS DOUBLE) * 100)) AS BIGINT)) AS BIGINT) AS bytes FROM g, z GROUP BY 1""",
        "synthetic_source": f"SELECT 'syn-' || i AS event_id, CAST(i % 12 AS INTEGER) AS partition_id, i * 10 AS arrival_ms, i * 10 - CAST(floor({draw(42, 'i')} * 5000) AS BIGINT) AS et_ms, CASE WHEN {draw(43, 'i')} < 0.2 THEN 500 ELSE 200 END AS status FROM range(5000) t(i)",
        "disturbed_arrivals": ev + f", e AS (SELECT min(et_ms) AS lo, max(et_ms) AS hi FROM ev) SELECT event_id, arrival_ms + CASE WHEN {draw(42, 'event_id')} < 0.3 THEN CAST(floor({draw(43, 'event_id')} * 30000) AS BIGINT) ELSE 0 END AS sort_ms, (et_ms - lo) * 3600000 // greatest(hi - lo, 1) AS et_ms FROM ev, e",
        "idempotent_sink": ev + res + " SELECT window_id, n, CAST(CASE WHEN partition_id < 3 THEN 0 ELSE 1 END AS INTEGER) AS batch FROM res",
        "audit_sink": ev + res + " SELECT CAST(o AS INTEGER) AS offered, partition_id, CAST(sum(n) AS BIGINT) AS n FROM res, (SELECT unnest([0, 1]) AS o) WHERE partition_id < 3 * (o + 1) GROUP BY 1, 2",
        "object_store_history": ev + res + " SELECT partition_id, count(*) AS results, min(ws) AS first_ws, max(ws) AS last_ws, CASE WHEN partition_id IN (1, 5) THEN CAST(sum(n) AS BIGINT) END AS events FROM res WHERE ws + 5000 >= 10000000 GROUP BY 1",
        "report_tables": ev + base._SWEEP + " SELECT delta_s, total, on_time, completeness_pct FROM strict",
        "idempotent_emit": ev + res + " SELECT window_id, n FROM res WHERE partition_id % 2 <> 0",
        "dual_schema_emit": "SELECT CAST(v AS INTEGER) AS schema_version, CASE WHEN v = 2 THEN 'legacy-service' END AS service_name, count(*) AS n, count(*) FILTER (v = 1) AS with_status, count(*) FILTER (v = 2) AS with_http_status FROM events, (SELECT unnest([1, 2]) AS v) GROUP BY 1, 2",
        "schema_compatibility": "SELECT * FROM (VALUES ('event 1 to 2', 3::INTEGER, 1::INTEGER, 2::INTEGER, 1::INTEGER), ('event 2 to 1', 3, 3, 4, 3), ('result 1 to 2', 0, 5, 6, 5)) t(step, problems, first_id, second_id, again_id)",
        "negative_lag_adjusted": ev
        + neg
        + """, k AS (SELECT event_id, late, list(late) OVER (PARTITION BY partition_id ORDER BY seen, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS y FROM neg WHERE late < 0), l AS (SELECT event_id, late, list_sort(y) AS x FROM k)
SELECT event_id, late + abs(x[len(x) // 2 + 1]) AS adjusted_ms FROM l UNION ALL SELECT event_id, late FROM neg WHERE late >= 0""",
        "corrections_seen_twice": ev + base._LATE + " " + base._FIXED,
        "dlq_correction_messages": ev + base._LATE + " SELECT partition_id, ws, count(*) AS delta_count, CAST(sum(status) AS BIGINT) AS delta_sum, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM dlq GROUP BY 1, 2",
        "dlq_state": ev
        + base._LATE
        + f""", h AS (SELECT arrival_ms FROM dlq WHERE arrival_ms <= {NOW_MS}), k AS (SELECT arrival_ms, row_number() OVER (ORDER BY arrival_ms) AS r FROM h WHERE {NOW_MS} - arrival_ms <= {RETENTION_MS})
SELECT count(*) FILTER (r > {DRAINED}) AS backlog, {NOW_MS} - min(arrival_ms) FILTER (r > {DRAINED}) AS oldest_age_ms, (SELECT count(*) FROM h WHERE {NOW_MS} - arrival_ms > {RETENTION_MS}) AS expired FROM k""",
        "ingestor_health": ev
        + f""", b AS (SELECT partition_id % 4 AS ingestor_id, et_ms AS t, arrival_ms AS h, arrival_ms + partition_id * 100 AS c FROM ev WHERE arrival_ms <= {NOW_MS}), l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY ingestor_id ORDER BY h DESC, t DESC, c DESC) = 1),
s AS (SELECT *, CASE WHEN {NOW_MS} - h > 15000 THEN 'SILENT' WHEN {NOW_MS} - t > 5000 THEN 'STUCK' ELSE 'ACTIVE' END AS status FROM l), w AS (SELECT *, min(t) FILTER (status <> 'SILENT') OVER () AS w_meta_ms FROM s)
SELECT ingestor_id, status, CASE WHEN abs(c - h) < 100 THEN 'OK' WHEN abs(c - h) < 500 THEN 'WARNING' WHEN abs(c - h) < 2000 THEN 'ALERT' ELSE 'CRITICAL' END AS clock_tier, w_meta_ms, t - w_meta_ms > 10000 AS deviates FROM w""",
        "byte_summary": "SELECT CAST(sum(strlen(props)) AS BIGINT) AS total_bytes, max(strlen(props)) AS max_bytes FROM events",
        "latency_percentiles": ev
        + neg
        + """, o AS (SELECT partition_id, late, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY partition_id) AS n FROM neg WHERE late >= 0 WINDOW w AS (PARTITION BY partition_id ORDER BY late))
SELECT partition_id, """
        + ", ".join(f"round(max(late) FILTER (i = least(n - 1, n * {p} // 100)) / 1000.0::DOUBLE, 2) AS p{p}" for p in (50, 95, 99))
        + " FROM o GROUP BY 1",
        "worst_windows": ev
        + base._RUN
        + f""", p AS (SELECT ws, count(*) AS total, count(*) FILTER (pm - (ws + 5000) >= {base.WAIT_MS}) AS late FROM run GROUP BY 1)
SELECT ws, total, late, round(100.0::DOUBLE * late / total, 4) AS loss_pct, (SELECT round(100.0::DOUBLE * sum(late) / sum(total), 4) FROM p) AS overall_pct FROM p ORDER BY loss_pct DESC, late DESC, ws LIMIT 20""",
        "worst_partitions": ev + " SELECT partition_id, quantile_cont(lateness_ms, 0.99) AS p99_us FROM ev GROUP BY 1 ORDER BY p99_us DESC, partition_id LIMIT 8",
        "zone_counts": "SELECT l_suppkey AS zone, count(*) AS pickups, count(DISTINCT l_partkey) AS drop_offs FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
        "trip_description": """WITH t AS (SELECT CAST(l_extendedprice AS DOUBLE) AS a, CAST(l_suppkey AS DOUBLE) AS s, CAST(l_partkey AS DOUBLE) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT 'total_amount' AS name, a AS v FROM t UNION ALL SELECT 'PULocationID', s FROM t UNION ALL SELECT 'DOLocationID', p FROM t)
SELECT name, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS least, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, max(v) AS most FROM u WHERE v IS NOT NULL GROUP BY 1""",
        "sliding_quantiles": ev
        + f""", b AS (SELECT arrival_ms // 1000 AS second, CAST(ceil(ln(least(greatest(lateness_ms / 1000.0::DOUBLE, 0.001), 3600.0) / 0.001) / {sketch.math.log(sketch.gamma())!r}) AS BIGINT) AS bucket, count(*) AS n FROM ev WHERE lateness_ms >= 0 GROUP BY 1, 2),
h AS (SELECT s.second, b.bucket, sum(n) AS n FROM (SELECT DISTINCT second FROM b) s JOIN b ON b.second BETWEEN s.second - 600 AND s.second GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY second ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY second) AS total FROM h)
SELECT second, CAST(max(total) AS BIGINT) AS n, min(bucket) FILTER (upto >= greatest(1, ceil(total * 0.99::DOUBLE))) AS bucket, round(0.001::DOUBLE * pow({sketch.gamma()!r}::DOUBLE, min(bucket) FILTER (upto >= greatest(1, ceil(total * 0.99::DOUBLE)))), 6) AS estimate_s FROM r GROUP BY 1""",
        "token_progress": ev + tokens.format(src="ev") + " SELECT * FROM tok",
        "watermark_without_idle": ev + tokens.format(src="ev WHERE partition_id <> 4 OR et_ms < 9000000") + ", p AS (SELECT tick, min(w_ms) FILTER (NOT idle) AS low, count(*) FILTER (NOT idle) AS active FROM tok GROUP BY 1) SELECT tick, max(low) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) AS w_ms, active FROM p",
        "watermark_of_live": ev + base._BEATS + ", n AS (SELECT tick, max(at_ms) AS now FROM hb GROUP BY 1), p AS (SELECT tick, min(w_ms) AS low, count(*) AS live FROM hb JOIN n USING (tick) WHERE now - at_ms <= 30000 GROUP BY 1) SELECT tick, max(low) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) AS w_ms, live FROM p",
        "strict_replays": ev + base._RUN + " SELECT event_id, partition_id, et_ms FROM run WHERE pm - 10000 - et_ms > 20000",
        "lag_replays": ev
        + base._RUN
        + f""", numbered AS (SELECT *, (row_number() OVER (ORDER BY arrival_ms, event_id) - 1) // {base.HEURISTIC_EVERY} AS block FROM run), blocks AS (SELECT DISTINCT block FROM numbered),
b AS (SELECT b.block, CASE WHEN count(*) >= 100 THEN quantile_cont(r.lateness_ms, 0.5) ELSE 0 END AS mid FROM blocks b JOIN numbered r ON r.block < b.block GROUP BY 1)
SELECT block, count(*) FILTER (mid > 0 AND lateness_ms > {REPLAY_TIMES} * mid) AS replays, count(*) AS rows FROM numbered LEFT JOIN b USING (block) GROUP BY 1""",
        "sub_checkpoints": ev + ", n AS (SELECT partition_id, arrival_ms, (row_number() OVER (PARTITION BY partition_id ORDER BY arrival_ms, event_id) - 1) // 100 AS checkpoint FROM ev) SELECT partition_id, checkpoint, count(*) AS rows, max(arrival_ms) AS upto_ms FROM n GROUP BY 1, 2",
        "adaptive_alpha": ev
        + """, p AS (SELECT partition_id, arrival_ms // 600000 AS period, round(quantile_cont(lateness_ms, 0.99) / 1000, 6) AS p99_s FROM ev WHERE lateness_ms >= 0 GROUP BY 1, 2)
SELECT partition_id, period, p99_s, coalesce(last_value(CASE WHEN p99_s < 1 THEN 0.001::DOUBLE WHEN p99_s > 30 THEN 0.01::DOUBLE END IGNORE NULLS) OVER (PARTITION BY partition_id ORDER BY period ROWS UNBOUNDED PRECEDING), 0.01::DOUBLE) AS alpha FROM p""",
        "arrival_order": ev + " SELECT event_id, row_number() OVER (ORDER BY arrival_ms, event_id) - 1 AS seq FROM ev",
        "first_arrivals": ev + " SELECT event_id, arrival_ms FROM ev ORDER BY arrival_ms, event_id LIMIT 500",
        "paced_replay": ev + " SELECT event_id, 1000000 + arrival_ms // 60 AS due_ms FROM ev",
        "live_sweep": f"SELECT * FROM ({live})",
    }
