"""Running maxima in arrival order without sorting everything in one task.

Rows are dealt to buckets of arrival time, whose width is chosen from the counted
rows so that a bucket has some BUCKET_ROWS of them on average, however many there
are. Inside a bucket a window gives the maximum of the earlier rows; across buckets the maxima of whole buckets, of
which there is one row each, are accumulated and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS = 20_000


def bucket_width(events: DataFrame, column: str, rows: int = BUCKET_ROWS) -> Column:
    """The width of buckets of ``column`` that hold ``rows`` rows on average."""
    span = F.max(column) - F.min(column) + 1
    return events.agg(F.greatest(F.lit(1), F.ceil(span * rows / F.count(F.lit(1)))).alias("w")).select("w").scalar()


def prior_max(events: DataFrame, by: list[str] | None = None, value: str = "et_ms", order: tuple[str, ...] = ("arrival_ms", "event_id"), bucket_ms: int | None = None, inclusive: bool = False, seq: bool = False) -> DataFrame:
    """Adds ``prior_max``: the greatest ``value`` of the rows before (null: none), in each group of ``by``.

    ``inclusive`` counts the row itself; ``seq`` adds the number of rows before, found in the same pass.
    """
    by = by or []
    bucketed = events.withColumn("_bucket", F.floor(F.col(order[0]) / (bucket_width(events, order[0]) if bucket_ms is None else bucket_ms)).cast("long"))
    tops = bucketed.groupBy(*by, "_bucket").agg(F.max(value).alias("_top"), *[F.count(F.lit(1)).alias("_n")] * seq)
    whole = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = tops.select(*by, "_bucket", F.max("_top").over(whole).alias("_before"), *[F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_rows")] * seq)
    ordered = W.partitionBy(*by, "_bucket").orderBy(*order)
    local = bucketed.withColumn("_local", F.max(value).over(ordered.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)))
    if seq:
        local = local.withColumn("_rank", F.row_number().over(ordered))
    out = local.join(before, [*by, "_bucket"]).withColumn("prior_max", F.greatest("_local", "_before"))
    if seq:
        out = out.withColumn("seq", F.col("_rows") + F.col("_rank") - 1).drop("_rank", "_rows")
    return out.drop("_bucket", "_local", "_before")
