"""Structured Streaming jobs: native watermarks, and the two engines as stateful operators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.streaming.engines import Heuristic, HeuristicOptions, Strict

#: Rows of a stream: events (kind 'event'), tokens ('punctuation', with et_ms as T_commit) and 'eof'.
STREAM_SCHEMA = "kind string, event_id string, partition_id int, et_ms long, arrival_ms long, status int, seq long"
#: One tagged output: closed windows, kept late rows, and a row of counters for each batch and partition.
OUTPUT_SCHEMA = "kind string, partition_id int, window_start long, count long, status_500 long, version int, event_id string, et_ms long, arrival_ms long, route string, past_w_ms long, w_ms long, received long, on_time long, late long, duplicates long"
POLICIES = ("data-driven", "max-event-time", "wall-clock")
_COLUMNS = [c.split()[0] for c in OUTPUT_SCHEMA.split(", ")]


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_punctuation(events: DataFrame, policy: str, delta_ms: int, size_ms: int, every_ms: int = 1_000) -> DataFrame:
    """A bounded stream's rows with its tokens, in STREAM_SCHEMA.

    ``data-driven`` commits at the end only; ``max-event-time`` commits each
    partition's greatest event time so far every ``every_ms`` of arrivals;
    ``wall-clock`` commits the clock less the wait. All end with a token past
    every window, and an 'eof' row.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    names = ["kind", "event_id", "partition_id", "et_ms", "arrival_ms", "status", "seq"]
    rows = events.select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("event_id"), "partition_id", "et_ms", "arrival_ms", "status", F.lit(0).cast("long").alias("seq"))
    ends = events.groupBy("partition_id").agg(F.max("et_ms").alias("top"), F.max("arrival_ms").alias("end"))
    none = F.lit(None)

    def tokens(df: DataFrame, t, at, kind: str = "punctuation", seq: int = 1) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), none.cast("string").alias("event_id"), "partition_id", t.cast("long").alias("et_ms"), at.cast("long").alias("arrival_ms"), none.cast("int").alias("status"), F.lit(seq).cast("long").alias("seq"))

    out = rows.unionByName(tokens(ends, F.col("top") + delta_ms + size_ms, F.col("end"), seq=2)).unionByName(tokens(ends, F.col("top"), F.col("end"), "eof", 3))
    tick = F.floor(F.col("arrival_ms") / every_ms)
    if policy != "data-driven":
        per = events.groupBy("partition_id", tick.alias("tick")).agg(F.max("et_ms").alias("top"), F.max("arrival_ms").alias("at"))
        if policy == "max-event-time":
            from pyspark.sql import Window as W

            per = per.withColumn("top", F.max("top").over(W.partitionBy("partition_id").orderBy("tick")))
            out = out.unionByName(tokens(per, F.col("top"), F.col("at")))
        else:
            out = out.unionByName(tokens(per, F.col("at") - delta_ms, F.col("at")))
    return out.select(*names)


def native_strict(events: DataFrame, delta_ms: int, size_ms: int = 5_000, ttl: str = "60 seconds") -> DataFrame:
    """Windowed counts by Spark's own watermark: greatest event time less the wait, late rows dropped."""
    seconds = lambda ms: f"{ms} milliseconds"
    stamped = events.where("kind = 'event'").withColumn("ts", F.timestamp_millis("et_ms")).withWatermark("ts", seconds(delta_ms))
    once = stamped.dropDuplicatesWithinWatermark(["event_id"])
    counted = once.groupBy("partition_id", F.window("ts", seconds(size_ms)).alias("w")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("status") == 500).alias("status_500"))
    return counted.select("partition_id", F.unix_millis("w.start").alias("window_start"), "count", "status_500")


def _frame(rows: list[dict]) -> pd.DataFrame:
    types = {"kind": "object", "event_id": "object", "route": "object", "partition_id": "int32", "version": "Int32"}
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.astype({c: types.get(c, "Int64") for c in _COLUMNS})


def _ordered(frames: Iterator[pd.DataFrame]) -> list:
    """A batch's rows in arrival order; tokens follow the events they cover."""
    rows = pd.concat(list(frames), ignore_index=True)
    return list(rows.sort_values(["arrival_ms", "seq", "event_id"], kind="stable").itertuples(index=False))


def _closed(partition: int, results) -> list[dict]:
    return [{"kind": "window", "partition_id": partition, "window_start": r.window_start, "count": r.count, "status_500": r.status_500, "version": r.version} for r in results]


def _counters(partition: int, s) -> dict:
    return {"kind": "metrics", "partition_id": partition, "w_ms": s.watermark, "received": s.received, "on_time": s.on_time, "late": s.late, "duplicates": s.duplicates}


def strict(stream: DataFrame, delta_ms: int = 10_000, size_ms: int = 5_000) -> DataFrame:
    """The strict policy with in-band tokens, state per partition; late rows appear in the counters."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine = Strict.load(state.get[0] if state.exists else None, delta_ms=delta_ms, size_ms=size_ms)
        out: list[dict] = []
        for r in _ordered(frames):
            if r.kind == "event":
                # Rows without event time are dropped.
                if not pd.isna(r.et_ms):
                    engine.event(r.event_id, int(r.et_ms), int(r.status))
            elif r.kind == "punctuation":
                out += _closed(key[0], engine.punctuation(int(r.et_ms)))
            else:
                out += _closed(key[0], engine.flush())
        state.update((engine.dump(),))
        yield _frame([*out, _counters(key[0], engine.s)])

    return stream.groupBy("partition_id").applyInPandasWithState(run, OUTPUT_SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)


def heuristic(stream: DataFrame, options: HeuristicOptions | None = None) -> DataFrame:
    """The adaptive policy; tokens are ignored, late rows come out with their route."""
    options = replace(options or HeuristicOptions())

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine = Heuristic.load(state.get[0] if state.exists else None, options)
        out: list[dict] = []
        for r in _ordered(frames):
            if r.kind == "event" and not pd.isna(r.et_ms):
                route, past, results = engine.event(r.event_id, int(r.et_ms), int(r.arrival_ms), int(r.status))
                out += _closed(key[0], results)
                if route not in ("on_time", "duplicate"):
                    out.append({"kind": "late", "partition_id": key[0], "event_id": r.event_id, "et_ms": r.et_ms, "arrival_ms": r.arrival_ms, "status_500": int(r.status == 500), "route": route, "past_w_ms": past})
            elif r.kind == "eof":
                out += _closed(key[0], engine.flush())
        state.update((engine.dump(),))
        yield _frame([*out, _counters(key[0], engine.s)])

    return stream.groupBy("partition_id").applyInPandasWithState(run, OUTPUT_SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is there into Parquet; batch ids make a rerun of a batch overwrite itself."""
    stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
