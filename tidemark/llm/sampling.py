"""Bounded, seeded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUCKETS = 1 << 30


def labelled_sample(rows: DataFrame, label: str, wanted: dict, seed: str) -> DataFrame:
    """About ``wanted[v]`` rows with the label v, chosen by a hash of doc_id.

    No more than twice the wanted rows are returned; the counts of the wanted
    labels are the only other thing that reaches the driver.
    """
    counts = {r[0]: r["count"] for r in rows.where(F.col(label).isin(*wanted)).groupBy(label).count().collect()}
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(_BUCKETS))
    keep = F.lit(False)
    for value, n in sorted(counts.items()):
        keep = keep | ((F.col(label) == F.lit(value)) & (spot < int(min(1.0, wanted[value] / n) * _BUCKETS)))
    return rows.where(keep).limit(2 * sum(wanted.values()))
