"""A mergeable quantile sketch of logarithmic buckets, as DataFrames.

A value's bucket is ``ceil(ln(v / least) / ln(gamma))``, gamma = (1+a)/(1-a).
A sketch is the counts of its buckets, so merging is adding and Spark's partial
aggregation builds it. ``upper`` estimates give the bucket's upper edge (up to
gamma - 1 too high); ``middle`` gives the relative midpoint, within a.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALPHA = 0.01
LEAST, MOST = 1e-3, 3600.0
MAX_BUCKETS = 1024


def gamma(alpha: float = ALPHA) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket(value: Column, alpha: float = ALPHA, least: float = LEAST, most: float = MOST) -> Column:
    """Bucket number of a value in seconds; null for negative ones, which a sketch leaves out."""
    inside = F.least(F.greatest(value, F.lit(least)), F.lit(most))
    return F.when(value >= 0, F.ceil(F.ln(inside / least) / math.log(gamma(alpha))).cast("long"))


def build(values: DataFrame, value: str, by: list[str] | None = None, **bounds) -> DataFrame:
    by = by or []
    return values.withColumn("bucket", bucket(F.col(value), **bounds)).where("bucket IS NOT NULL").groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(*sketches: DataFrame, by: list[str] | None = None, bounds: list[tuple] | None = None) -> DataFrame:
    """The sum of sketches that were built with the same bounds.

    ``bounds`` may name those of each (alpha, least, most, buckets): buckets of
    unlike sketches mean other values, so they are refused.
    """
    by = by or []
    if bounds is not None and (len(bounds) != len(sketches) or len(set(bounds)) > 1):
        raise ValueError(f"sketches of unlike bounds cannot be merged: {bounds}")
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def collapse(sketch: DataFrame, most: int = MAX_BUCKETS, by: list[str] | None = None) -> DataFrame:
    """At most ``most`` buckets: the lowest fold into the lowest that stays."""
    by = by or []
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("bucket")))
    ranked = sketch.withColumn("_r", rank)
    floor = F.min(F.when(F.col("_r") <= most, F.col("bucket"))).over(W.partitionBy(*by))
    return ranked.withColumn("bucket", F.greatest("bucket", floor)).groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, qs, by: list[str] | None = None, alpha: float = ALPHA, least: float = LEAST, mode: str = "upper") -> DataFrame:
    """by..., q, bucket, estimate_s: the first bucket whose running count reaches max(1, ceil(q N))."""
    by = by or []
    run = sketch.withColumn("upto", F.sum("n").over(W.partitionBy(*by).orderBy("bucket"))).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    picks = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * q)), F.col("bucket"))).alias(f"_q{i}") for i, q in enumerate(qs)]
    wide = run.groupBy(*by).agg(*picks)
    rows = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"_q{i}").alias("bucket")) for i, q in enumerate(qs)])
    g = gamma(alpha)
    edge = F.lit(least) * F.pow(F.lit(g), F.col("bucket"))
    return wide.select(*by, F.inline(rows)).withColumn("estimate_s", F.round(edge if mode == "upper" else edge * 2 / (g + 1), 6))


def sliding(values: DataFrame, value: str, clock_ms: str, window_s: int = 60, slice_s: int = 1) -> DataFrame:
    """second, in_window: how many values of the last ``window_s`` seconds a sliding sketch holds at each second."""
    second = F.floor(F.col(clock_ms) / (1000 * slice_s)).cast("long")
    counts = values.where(F.col(value) >= 0).groupBy(second.alias("second")).agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy("second").rangeBetween(-(window_s // slice_s), 0)
    return counts.select("second", F.sum("n").over(w).alias("in_window"))


def sliding_quantiles(values: DataFrame, value: str, clock_ms: str, q: float = 0.99, window_s: int = 60, alpha: float = ALPHA, least: float = LEAST) -> DataFrame:
    """second, n, bucket, estimate_s: the quantile of a sliding sketch at each second that has a value.

    Each second's counts are dealt to the seconds whose window has them, so the
    work is the distinct buckets of a second times the window's seconds.
    """
    second = F.floor(F.col(clock_ms) / 1000).cast("long")
    counts = values.withColumn("bucket", bucket(F.col(value), alpha, least)).where("bucket IS NOT NULL").groupBy(second.alias("second"), "bucket").agg(F.count(F.lit(1)).alias("n"))
    dealt = counts.withColumn("second", F.explode(F.sequence(F.col("second"), F.col("second") + window_s)))
    held = dealt.groupBy("second", "bucket").agg(F.sum("n").alias("n")).join(counts.select("second").distinct(), "second", "left_semi")
    w = W.partitionBy("second")
    run = held.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    picked = run.groupBy("second").agg(F.max("total").alias("n"), F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * q)), F.col("bucket"))).alias("bucket"))
    return picked.withColumn("estimate_s", F.round(F.lit(least) * F.pow(F.lit(gamma(alpha)), F.col("bucket")), 6))
