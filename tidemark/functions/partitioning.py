"""Stable assignment of hosts to partitions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_partition_of(key: str, n: int = 12) -> int:
    """An 8-byte BLAKE2b digest of the key, big-endian, modulo ``n``."""
    return int.from_bytes(hashlib.blake2b(str(key).encode(), digest_size=8).digest(), "big") % n


def stable_partition(host: Column, n: int = 12) -> Column:
    @F.pandas_udf("int")
    def assign(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: stable_partition_of(k, n), na_action="ignore").astype("Int32")

    return assign(host)


def with_stable_partition(events: DataFrame, n: int = 12) -> DataFrame:
    """Adds partition_id. The digest is taken once per distinct host, not per event.

    Hosts are joined by Spark's choice: a broadcast only if they turn out small.
    """
    hosts = events.select("host").distinct().withColumn("partition_id", stable_partition(F.col("host"), n))
    return events.drop("partition_id").join(hosts, "host", "left")
