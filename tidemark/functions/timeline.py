"""Time and window functions on columns of whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without time zone since 1970, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def window_start(at: Column, size_ms: int) -> Column:
    if size_ms <= 0:
        raise ValueError("window size must be positive")
    return (F.floor(at / size_ms) * size_ms).cast("long")


def window_id(partition: Column, start: Column, size_ms: int) -> Column:
    """``<partition>_<start>-<end>`` with seconds to one decimal."""
    return F.concat(partition.cast("string"), F.lit("_"), F.format_string("%.1f", start / 1000), F.lit("-"), F.format_string("%.1f", (start + size_ms) / 1000))


def windows_between(a: Column, b: Column, size_ms: int) -> Column:
    """Starts from that of ``a`` while below ``b``."""
    first = window_start(a, size_ms)
    return F.when(first < b, F.sequence(first, b - 1, F.lit(size_ms).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def windows_overlapping(a: Column, b: Column, size_ms: int) -> Column:
    """Starts of all windows [s, s + size) with s + size > a and s < b."""
    return windows_between(a, b, size_ms)


def lateness(arrival: Column, event: Column) -> Column:
    return arrival - event


def nearest_rank(values: Column, p: float) -> Column:
    """Entry floor(n * p / 100) of the sorted array, the last one at most."""
    n = F.size(values)
    at = F.least(n - 1, F.greatest(F.lit(0), F.floor(n * p / 100))).cast("int")
    return F.when(n > 0, F.get(F.array_sort(values), at))
