"""Every registered query against its SQL on the same tables."""

import pandas as pd
import pytest

from tidemark.plans import registry


def rows(frame):
    def text(v):
        if pd.isna(v):
            return "~"
        return str(v) if isinstance(v, str) else f"{float(v):.9g}"

    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, data, name):
    got = registry.queries()[name](spark, data).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_known_counts_of_the_strict_sweep(spark, data):
    found = {r["delta_s"]: r["on_time"] for r in registry.strict_sweep(spark, data).collect()}
    assert found == {0: 700, 1: 709, 2: 711, 3: 715, 5: 724, 7: 732, 10: 746, 15: 768, 20: 784, 30: 838, 40: 863, 50: 890, 60: 913, 90: 958, 120: 979}


def test_completeness_grows_with_the_wait(spark, data):
    found = [r["on_time"] for r in registry.strict_sweep(spark, data).orderBy("delta_s").collect()]
    assert found == sorted(found)


def test_no_event_is_sorted_in_one_task(spark, data):
    """The running maximum never needs all events in one partition."""
    plan = registry.strict_sweep(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x and "et_ms" in x]
    assert windows and all("_bucket" in x for x in windows)
