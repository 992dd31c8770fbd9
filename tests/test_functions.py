import pytest
from pyspark.sql import functions as F

from tidemark.functions import schemas
from tidemark.functions.partitioning import stable_partition_of, with_stable_partition
from tidemark.functions.timeline import nearest_rank, window_id, window_start, windows_between
from tidemark.operators import control, late, sketch
from tidemark.operators.running import prior_max
from tidemark.sources import events as sources
from tidemark.sources import sinks


def test_pinned_partitions(spark):
    assert (stable_partition_of("140"), stable_partition_of("48")) == (0, 10)
    df = spark.createDataFrame([("140",), ("48",), (None,)], "host string")
    assert {r["host"]: r["partition_id"] for r in with_stable_partition(df).collect()} == {"140": 0, "48": 10, None: None}


def test_windows(spark):
    df = spark.createDataFrame([(0,), (4_900,), (5_000,), (9_900,)], "t long")
    assert [r[0] for r in df.select(window_start(F.col("t"), 5_000)).collect()] == [0, 0, 5_000, 5_000]
    one = spark.range(1).select(windows_between(F.lit(10_000), F.lit(22_000), 5_000).alias("a"), windows_between(F.lit(5), F.lit(0), 5_000).alias("b"), window_id(F.lit(0), F.lit(100_000), 5_000).alias("c")).first()
    assert (one["a"], one["b"], one["c"]) == ([10_000, 15_000, 20_000], [], "0_100.0-105.0")
    with pytest.raises(ValueError):
        window_start(F.col("t"), 0)


def test_nearest_rank(spark):
    got = spark.createDataFrame([([3, 1, 2, 4],), ([],)], "v array<int>").select(nearest_rank(F.col("v"), 50), nearest_rank(F.col("v"), 100)).collect()
    assert [tuple(r) for r in got] == [(3, 4), (None, None)]


def test_schema_rules(spark):
    good = {"event_id": "a", "event_time": 1.0, "status": 200, "schema_version": 1}
    assert schemas.valid_event(good, schemas.EVENT_V1) == []
    assert schemas.valid_event({k: v for k, v in good.items() if k != "status"}, schemas.EVENT_V1)
    assert schemas.valid_event({**good, "status": "200"}, schemas.EVENT_V1)
    assert schemas.valid_event({**good, "status": True}, schemas.EVENT_V1)
    assert schemas.incompatibilities(schemas.EVENT_V1, schemas.EVENT_V2)
    assert not schemas.incompatibilities(schemas.RESULT_V1, schemas.RESULT_V2)
    rows = ['{"event_id":"a","event_time":1,"status":200,"schema_version":1}', '{"event_id":"a","event_time":1,"status":"200","schema_version":1}', "not json", None, "[]"]
    df = spark.createDataFrame([(r,) for r in rows], "m string")
    assert [r[0] for r in df.select(schemas.valid_json(F.col("m"), schemas.EVENT_V1)).collect()] == [True, False, False, False, False]


def test_registry_gives_known_schemas_their_id():
    r = schemas.Registry()
    first, _ = r.register("events", schemas.EVENT_V1)
    second, warned = r.register("events", schemas.EVENT_V2)
    assert first != second and warned
    assert r.register("events", schemas.EVENT_V1) == (first, [])
    assert r.latest("events") == schemas.EVENT_V2 and r.latest("none") is None


def test_migration_modes(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    with open(path, "w") as f:
        f.write('{"event_id":"a","event_time":1.0,"status":500,"schema_version":1}\n{"event_id":"b","event_time":2.0,"http_status":200,"service_name":"s","schema_version":2}\n{"event_id":"c"}\n')
    rows = sources.read_jsonl(spark, path)
    assert {(r["event_id"], r["status"], r["http_status"], r["service_name"]) for r in rows.collect()} == {("a", 500, 500, "legacy-service"), ("b", 200, 200, "s")}
    assert schemas.emitted(rows, "dual_emit").count() == 4
    assert "service_name" not in schemas.emitted(rows, "v1_only").columns
    with pytest.raises(ValueError):
        schemas.emitted(rows, "other")


def test_csv_dialects(spark, tmp_path):
    a, b = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    with open(a, "w") as f:
        f.write(",host,time,method,url,response,bytes,arrival\n0,h,10.5,GET,/,500,7,12.25\n1,h,11,GET,/,,,\n2,h,20,GET,/,200,1,19\n3,h,bad,GET,/,200,1,1\n")
    with open(b, "w") as f:
        f.write(",remote_addr,timestamp,method,path,status,body_bytes_sent\n0,1.2.3.4,01/Jan/2024:00:00:10 +0000,GET,/x,404,9\n")
    got = sorted(tuple(r) for r in sources.read_csv_any(spark, a).select("et_ms", "arrival_ms", "lateness_ms", "status", "bytes").collect())
    assert got == [(10_500, 12_250, 1_750, 500, 7), (11_000, 13_000, 2_000, 200, 0), (20_000, 20_000, 0, 200, 1)]
    r = sources.read_csv_any(spark, b).first()
    assert (r["host"], r["url"], r["status"], r["bytes"], r["et_ms"]) == ("1.2.3.4", "/x", 404, 9, 1_704_067_210_000)


def test_synthetic_and_shuffled(spark):
    s = sources.synthetic(spark)
    assert s.count() == 1_000 and s.where("arrival_ms - et_ms NOT BETWEEN 0 AND 5000").count() == 0
    moved = sources.shuffled_arrivals(s)
    assert 200 < moved.where("sort_ms > arrival_ms").count() < 400
    assert moved.where("sort_ms < arrival_ms OR sort_ms >= arrival_ms + 30000").count() == 0


def test_prior_max_against_a_loop(spark):
    import random

    r = random.Random(1)
    rows = [(i, r.randrange(3), r.randrange(100_000), r.randrange(100_000)) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, partition_id int, et_ms long, arrival_ms long")
    want, top = {}, {}
    for i, p, et, _ in sorted(rows, key=lambda x: (x[3], x[0])):
        want[i] = top.get(p)
        top[p] = max(et, top.get(p, et))
    assert {x["event_id"]: x["prior_max"] for x in prior_max(df, ["partition_id"], bucket_ms=700).collect()} == want


def test_sketch_error_and_merge(spark):
    values = [0.01 * 1.7**i for i in range(12)] * 20
    df = spark.createDataFrame([(v,) for v in [*values, -1.0]], "v double")
    s = sketch.build(df, "v")
    assert s.agg(F.sum("n")).first()[0] == len(values)
    exact = sorted(values)
    for r in sketch.quantiles(s, (0.1, 0.5, 0.9), mode="middle").collect():
        true = exact[max(1, -(-int(r["q"] * len(values)) // 1)) - 1]
        assert abs(r["estimate_s"] / true - 1) <= sketch.ALPHA + 1e-6
    twice = {r["bucket"]: r["n"] for r in sketch.merge(s, s).collect()}
    assert twice == {r["bucket"]: 2 * r["n"] for r in s.collect()}
    assert sketch.collapse(s, 3).count() == 3


def test_backpressure_hysteresis(spark):
    df = spark.createDataFrame([(0, i, q) for i, q in enumerate((10, 500, 600, 300, 50, 99, 501))], "partition_id int, at int, queued long")
    assert [r["signal"] for r in control.backpressure(df).orderBy("at").collect()] == [None, "PAUSE", None, None, "RESUME", None, "PAUSE"]


def test_ingestor_health(spark):
    now = 100_000
    df = spark.createDataFrame([("a", now - 1_000, now, now + 50), ("b", now - 9_000, now, now + 700), ("c", now, now - 20_000, now)], "ingestor_id string, t_commit_ms long, heard_ms long, clock_ms long")
    got = {r["ingestor_id"]: (r["status"], r["clock_tier"]) for r in control.ingestor_health(df, now).collect()}
    assert got == {"a": ("ACTIVE", "OK"), "b": ("STUCK", "ALERT"), "c": ("SILENT", "CRITICAL")}


def test_idempotent_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([("w1", 1), ("w2", 2)], "window_id string, n int")
    second = spark.createDataFrame([("w2", 9), ("w3", 3)], "window_id string, n int")
    sinks.emit_once(first, path, 0)
    for _ in range(2):
        sinks.emit_once(second, path, 1)
    assert sorted((r["window_id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("w1", 1), ("w2", 2), ("w3", 3)]
    assert late.idempotent(second, first).collect()[0]["window_id"] == "w3"


def test_history_and_report(spark, tmp_path):
    results = spark.createDataFrame([(0, 5_000, 3), (1, 0, 4)], "partition_id int, ws long, n long")
    sinks.history(results, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 2
    sinks.report_csv(results, str(tmp_path / "r"), "partition_id")
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2
    assert "| 0 | 5000 | 3 |" in sinks.report_markdown("x", {"t": results})


def test_dedup_keeps_the_first_arrival(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("b", 5, 3)], "event_id string, arrival_ms long, x int")
    assert sorted(tuple(r) for r in late.deduplicated(df).collect()) == [("a", 1, 2), ("b", 5, 3)]


def test_negative_lag_adjustment(spark):
    df = spark.createDataFrame([(1, 0, 10, -5), (2, 0, 20, -7), (3, 0, 30, 4), (4, 0, 40, -1)], "event_id long, partition_id int, arrival_ms long, lateness_ms long")
    assert {r["event_id"]: r["adjusted_ms"] for r in late.negative_lag_adjusted(df).collect()} == {1: 0, 2: -2, 3: 4, 4: 4}


def test_empty_events(spark, data):
    ev = sources.timeline(sources.table(spark, data, "events").where("false"))
    from tidemark.operators import completeness, stats

    assert completeness.window_loss(ev).count() == 0
    assert stats.windowed_counts(ev).count() == 0
    assert completeness.strict_sweep(ev).where("total > 0").count() == 0
