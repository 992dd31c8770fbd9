"""Limits and refusals of the core engine, and the adaptive stream against a naive replay."""

import math
import os
import subprocess
import sys
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from tidemark import shipping
from tidemark.operators import completeness as C
from tidemark.operators import progress, sketch
from tidemark.plans import registry
from tidemark.sources import folders, sinks


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_chunks_do_not_change_running_percentiles(spark, data):
    ev = registry.events(spark, data)
    whole = C.leff_convergence(ev, every=50).cache()
    assert rows(whole) == rows(C.leff_convergence(ev, every=50, chunk_rows=100)) and whole.count() == 19 * len(C.PERCENTILES)
    assert rows(C.heuristic_sweep(ev, every=50)) == rows(C.heuristic_sweep(ev, every=50, chunk_rows=150))
    assert C.leff_convergence(ev.where("false")).count() == 0


def test_running_percentiles_against_sorted_lists(spark, data):
    ev = registry.events(spark, data)
    late = [r["lateness_ms"] for r in ev.orderBy("arrival_ms", "event_id").collect()]
    got = {(r["block"], r["p"]): r["leff_ms"] for r in C.leff_convergence(ev, ps=(0.5, 0.99), every=100, chunk_rows=200).collect()}
    for block in range(1, 10):
        known = sorted(late[: block * 100])
        for p in (0.5, 0.99):
            at = p * (len(known) - 1)
            low = known[math.floor(at)]
            assert math.isclose(got[block, p], low + (known[math.ceil(at)] - low) * (at - math.floor(at)))


def test_unlike_sketches_are_refused(spark, data):
    one = sketch.build(registry._seconds(registry.events(spark, data)), "v")
    assert rows(sketch.merge(one, one, bounds=[(0.01, 1e-3)] * 2)) == sorted((r["bucket"], 2 * r["n"]) for r in one.collect())
    with pytest.raises(ValueError):
        sketch.merge(one, one, bounds=[(0.01, 1e-3), (0.001, 1e-3)])


def test_silent_partition_holds_nothing_back(spark):
    ev = spark.createDataFrame([(p, t * 1_000, t * 1_000 + 100) for t in range(200) for p in (0, 1) if p == 0 or t < 50], "partition_id int, et_ms long, arrival_ms long")
    out = {r["tick"]: (r["w_ms"], r["active"]) for r in progress.watermark_without_idle(progress.token_progress(ev)).collect()}
    assert out[4] == (39_000, 2) and out[6] == (39_000, 2) and out[8] == (79_000, 1) and out[19] == (189_000, 1)


def test_history_can_be_purged_and_read_by_partition(spark, data, tmp_path):
    from tidemark.operators import stats

    results = stats.windowed_counts(registry.events(spark, data))
    sinks.history(results, f"{tmp_path}/h")
    kept = sinks.purge_history(spark, f"{tmp_path}/h", 20_000_000)
    assert sinks.read_history(spark, kept).count() == results.where("ws + 5000 >= 20000000").count()
    assert sinks.read_history(spark, kept, [3]).count() == results.where("ws + 5000 >= 20000000 AND partition_id = 3").count()


def test_package_can_be_imported_from_what_is_shipped(tmp_path):
    path = tmp_path / "t.zip"
    path.write_bytes(shipping.package())
    assert "tidemark/plans/registry.py" in zipfile.ZipFile(BytesIO(path.read_bytes())).namelist()
    code = "import sys; sys.path = [p for p in sys.path if 'repo' not in p]; sys.path.insert(0, sys.argv[1]); import tidemark.operators.stats as s; assert '.zip' in s.__file__"
    subprocess.run([sys.executable, "-c", code, str(path)], check=True, cwd="/", env={**os.environ, "PYTHONPATH": ""})


def test_local_folders_are_refused_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        folders.new_folder(Session(), "x")


def test_entry_lists_core_queries_where_a_corpus_import_fails():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'strict_sweep' in q and 'op8_decontaminate' not in q and 'pipeline' not in q; assert 'strict_sweep' in e.oracle_sql()"
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=repo)


def replayed(events, l_max=60_000, samples=100, every=50, p=0.99, size=5_000):
    """Accounts of one partition, every quantile recomputed from the list of what was seen."""
    top, w, leff, count_then = None, None, float(l_max), None
    seen, late, first = [], 0, events[0][1]
    past, p_until = [], None
    gamma = 1.01 / 0.99
    for i, (et, at) in enumerate(events, 1):
        top = et if top is None else max(top, et)
        seen.append((at // 1000, at - et))
        oldest = (at - 60_000) // 1000
        age = at - first
        phase = 0 if age < 5_000 and i < 100 else 2 if age >= 5_000 and i >= samples else 1
        if i % every == 0:
            held = [lag for second, lag in seen if second >= oldest]
            edges = sorted(math.ceil(math.log(max(x / 1000, 1e-3) / 1e-3) / math.log(gamma)) for x in held)
            q = gamma ** edges[max(1, math.ceil(p * len(edges))) - 1] * 1e-3 * 1000
            if phase < 2:
                leff = float(l_max)
            elif len(held) >= 10 and len(held) != count_then:
                count_then = len(held)
                past = [*past, q][-60:]
                middle = sorted(past[:-1])[len(past[:-1]) // 2] if len(past) >= 30 else 0
                if p_until is None and middle > 0 and q / middle > 2:
                    p, p_until = 0.999, at + 300_000
                elif p_until is not None and len(past) and at >= p_until:
                    p, p_until = 0.99, None
                change = (q - leff) / max(leff, 1.0)
                leff = min(q if change >= 0.1 else max(q, leff * 0.95) if change < 0 else leff, float(l_max))
        if phase:
            w = max(w if w is not None else -(1 << 62), math.floor(top - leff))
        late += w is not None and et // size * size + size <= w
    return len(events), len(events) - late, late, 0, late


def test_adaptive_stream_against_a_naive_replay(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("needs the larger table")
    per = {}
    for r in registry.events(spark, folder).select("partition_id", "et_ms", "arrival_ms", F.col("event_id").cast("string").alias("id")).orderBy("arrival_ms", "id").collect():
        per.setdefault(r["partition_id"], []).append((r["et_ms"], r["arrival_ms"]))
    got = {r["partition_id"]: tuple(r[c] for c in ("received", "on_time", "late", "duplicates", "kept_late")) for r in registry.heuristic_stream(spark, folder).collect()}
    assert got == {k: replayed(v) for k, v in per.items()}
