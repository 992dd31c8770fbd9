"""The row-at-a-time policies, by themselves and inside a stream."""

import random

import pytest

from tidemark.plans import registry
from tidemark.streaming import jobs
from tidemark.streaming.engines import Heuristic, HeuristicOptions, Strict


def test_strict_without_loss():
    e = Strict(10_000, 5_000)
    for t in range(20):
        e.punctuation((1_000 + t) * 1_000)
        for i in range(10):
            e.event(f"{t}-{i}", (1_000 + t) * 1_000 - 5_000 + 500 * i, 200)
    assert (e.s.late, e.s.on_time) == (0, 200)


def test_strict_rules():
    e = Strict(10_000, 5_000)
    e.punctuation(100_000)
    e.punctuation(99_000)
    assert (e.s.last_t, e.s.non_monotonic) == (100_000, 1)
    e.punctuation(110_000)
    assert [e.event("x", 200_000, 200), e.event("x", 200_000, 200)] == ["on_time", "duplicate"]
    e = Strict(10_000, 5_000)
    e.event("a", 200_000, 500)
    closed = e.punctuation(300_000)
    assert [(r.window_start, r.count, r.status_500) for r in closed] == [(200_000, 1, 1)]
    assert e.event("b", 100_000, 200) == "late" and "b" not in e.s.seen


def events(n=6_000, seed=4):
    r = random.Random(seed)
    out, now = [], 0
    for k in range(n):
        now += 20
        late = 200 + 100 * (k % 50) + r.randrange(50)
        out.append((f"e{k}", now - late, now, 500 if k % 7 == 0 else 200))
    return out


@pytest.mark.parametrize("strict_late", [True, False])
def test_heuristic_accounts_and_monotone_watermark(strict_late):
    e = Heuristic(HeuristicOptions(p_normal=0.9, warmup_samples=500, strict_late=strict_late, every=10))
    last, routes = None, {}
    for x in events():
        route, _, _ = e.event(*x)
        routes[route] = routes.get(route, 0) + 1
        assert last is None or e.s.watermark >= last
        last = e.s.watermark
    assert e.s.on_time + e.s.late + e.s.duplicates == e.s.received == 6_000
    assert e.s.on_time >= 0.8 * 6_000
    assert routes.get("late", 0) == e.s.late


def test_future_skew_moves_nothing():
    e = Heuristic(HeuristicOptions(warmup_samples=100, every=10))
    for x in events(2_000):
        e.event(*x)
    top = e.s.max_et
    assert e.event("poison", 2_000 * 20 + 3_600_000, 2_000 * 20, 200)[0] == "future_skew"
    assert e.s.max_et == top
    assert e.event("slow", 0, 20_000_000_000, 200)[0] == "extreme_lag"


def test_negative_lags_degrade():
    e = Heuristic(HeuristicOptions())
    for i in range(100):
        e.event(str(i), i * 10 + (500 if i % 2 else 0), i * 10, 200)
    assert e.s.degraded_since > 0 or e.s.degraded_since == 10
    assert e.s.negatives


@pytest.mark.parametrize("engine", ["strict", "heuristic"])
def test_state_survives_json(engine):
    options = HeuristicOptions(warmup_samples=200, every=5)
    whole = Strict(2_000) if engine == "strict" else Heuristic(options)
    parts = Strict(2_000) if engine == "strict" else Heuristic(options)
    for i, (k, et, at, status) in enumerate(events(1_500)):
        for e in (whole, parts):
            if engine == "strict":
                e.event(k, et, status)
                if i % 50 == 0:
                    e.punctuation(at - 1_000)
            else:
                e.event(k, et, at, status)
        if i % 300 == 0:
            parts = Strict.load(parts.dump(), delta_ms=2_000) if engine == "strict" else Heuristic.load(parts.dump(), options)
    assert whole.s == parts.s


def test_streams_equal_the_engines(spark, data, tmp_path):
    """The stateful operators give what the engines give on each partition's rows in order."""
    rows = jobs.with_punctuation(registry.events(spark, data), "max-event-time", 10_000, 5_000)
    folder = f"file://{tmp_path}"
    rows.coalesce(1).orderBy("arrival_ms").write.parquet(f"{folder}/in")
    options = HeuristicOptions(l_max_ms=60_000, warmup_samples=20)
    local = sorted(rows.collect(), key=lambda r: (r["arrival_ms"], r["seq"], r["event_id"] or ""))
    for name, job in (("strict", jobs.strict), ("heuristic", lambda s: jobs.heuristic(s, options))):
        jobs.run_to_files(job(jobs.read_stream(spark, f"{folder}/in")), f"{folder}/{name}", f"{folder}/{name}-cp")
        out = spark.read.parquet(f"{folder}/{name}")
        last = {r["partition_id"]: (r["received"], r["on_time"], r["late"], r["duplicates"]) for r in out.where("kind = 'metrics'").collect()}
        windows = {(r["partition_id"], r["window_start"]): r["count"] for r in out.where("kind = 'window'").collect()}
        engines, closed = {}, {}
        for r in local:
            p = r["partition_id"]
            e = engines.setdefault(p, Strict() if name == "strict" else Heuristic(options))
            if r["kind"] == "event":
                found = e.event(r["event_id"], r["et_ms"], r["status"]) if name == "strict" else e.event(r["event_id"], r["et_ms"], r["arrival_ms"], r["status"])
                results = [] if name == "strict" else found[2]
            elif r["kind"] == "punctuation":
                results = e.punctuation(r["et_ms"]) if name == "strict" else []
            else:
                results = e.flush()
            closed |= {(p, x.window_start): x.count for x in results}
        assert last == {p: (e.s.received, e.s.on_time, e.s.late, e.s.duplicates) for p, e in engines.items()}
        assert windows == closed


def test_punctuation_policies(spark, data):
    ev = registry.events(spark, data)
    counts = {p: jobs.with_punctuation(ev, p, 10_000, 5_000).where("kind = 'punctuation'").count() for p in jobs.POLICIES}
    assert counts["data-driven"] == 12 < counts["max-event-time"] == counts["wall-clock"]
    with pytest.raises(ValueError):
        jobs.with_punctuation(ev, "other", 0, 1)


def test_strict_with_end_punctuation_loses_nothing(spark, data):
    assert registry.strict_stream(spark, data).agg({"n": "sum"}).first()[0] == 1_000
