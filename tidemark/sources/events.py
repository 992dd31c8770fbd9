"""Event tables: the driver's fixture and the file dialects that feed the engine.

Canonical columns: event_id, host, partition_id, et_ms, arrival_ms, lateness_ms,
status, bytes. Times are whole milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeline import micros, window_start

PARTITIONS = 12
COMPRESSION = 60
#: Lag of events without an arrival time.
SIMULATED_LAG_MS = 2_000

CSV_SCHEMA = "idx string, host string, time double, method string, url string, response int, bytes long, arrival double"
ACCESS_SCHEMA = "idx string, remote_addr string, timestamp string, method string, path string, status int, body_bytes_sent long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(events: DataFrame, compression: int = COMPRESSION, partitions: int = PARTITIONS, size_ms: int = 5_000) -> DataFrame:
    """The driver's ``events`` as out-of-order arrivals: compressed event time, ``value`` seconds late."""
    us = micros(F.col("ts"))
    first = events.agg(F.min(us).alias("t0")).select("t0").scalar()
    et = F.floor((us - first) / (1000 * compression)).cast("long")
    late = F.round(F.col("value") * 1000).cast("long")
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("host"),
        F.pmod(F.col("user_id"), F.lit(partitions)).cast("int").alias("partition_id"),
        et.alias("et_ms"),
        late.alias("lateness_ms"),
        (et + late).alias("arrival_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
    ).withColumn("ws", window_start(F.col("et_ms"), size_ms))


def _cleaned(rows: DataFrame) -> DataFrame:
    """Defaults of the engine dialect: 200, 0 bytes, arrival two seconds after the event, no negative lateness."""
    et = F.round(F.col("time") * 1000).cast("long")
    arrival = F.coalesce(F.round(F.col("arrival") * 1000).cast("long"), et + SIMULATED_LAG_MS)
    return (
        rows.where(F.col("time").isNotNull())
        .select(
            "host",
            "method",
            "url",
            F.coalesce("response", F.lit(200)).alias("status"),
            F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
            et.alias("et_ms"),
            F.greatest(arrival, et).alias("arrival_ms"),
        )
        .withColumn("lateness_ms", F.col("arrival_ms") - F.col("et_ms"))
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Engine CSV: ``,host,time,method,url,response,bytes,arrival``."""
    return _cleaned(spark.read.csv(path, header=True, schema=CSV_SCHEMA))


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Access-log CSV: ``,remote_addr,timestamp,method,path,status,body_bytes_sent``."""
    rows = spark.read.csv(path, header=True, schema=ACCESS_SCHEMA)
    at = F.unix_micros(F.to_timestamp("timestamp", "dd/MMM/yyyy:HH:mm:ss Z")) / 1e6
    named = rows.withColumnsRenamed({"remote_addr": "host", "path": "url", "status": "response", "body_bytes_sent": "bytes"})
    return _cleaned(named.withColumn("time", at).withColumn("arrival", F.lit(None).cast("double")))


def read_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """Either CSV dialect, told apart by its header."""
    header = spark.read.text(path).limit(1).collect()
    return read_access_log(spark, path) if header and "remote_addr" in header[0][0] and "timestamp" in header[0][0] else read_csv(spark, path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON event a line, either schema version; rows without event_time are dropped."""
    from tidemark.functions.schemas import EVENT_ANY, normalised

    return normalised(spark.read.json(path, schema=EVENT_ANY)).where(F.col("event_time").isNotNull())


def read_taxi(spark: SparkSession, path: str, month: tuple[str, str] = ("2024-01-01", "2024-02-01"), compression: int = COMPRESSION, rows: int | None = None) -> DataFrame:
    """Trips as events: pickup is event time, drop-off arrival, both compressed."""
    trips = spark.read.parquet(path).select("tpep_pickup_datetime", "tpep_dropoff_datetime", "PULocationID", "DOLocationID", "total_amount")
    return trips_to_events(trips.limit(rows) if rows else trips, month, compression)


def trips_to_events(trips: DataFrame, month: tuple[str, str], compression: int = COMPRESSION, longest_s: int = 6 * 3600) -> DataFrame:
    """Null drop, duration and month filters, time compression and column mapping."""
    up, down = micros(F.col("tpep_pickup_datetime")), micros(F.col("tpep_dropoff_datetime"))
    long_enough = (down > up) & (down - up <= longest_s * 1_000_000)
    in_month = (F.col("tpep_pickup_datetime") >= F.lit(month[0]).cast("timestamp_ntz")) & (F.col("tpep_dropoff_datetime") < F.lit(month[1]).cast("timestamp_ntz"))
    good = trips.dropna().where(long_enough & in_month)
    first = good.agg(F.min(up).alias("t0")).select("t0").scalar()
    return good.select(
        F.col("PULocationID").cast("string").alias("host"),
        F.round((up - first) / (1000 * compression)).cast("long").alias("et_ms"),
        F.round((down - first) / (1000 * compression)).cast("long").alias("arrival_ms"),
        F.lit("GET").alias("method"),
        F.concat(F.lit("/zone/"), F.col("DOLocationID").cast("string")).alias("url"),
        F.lit(200).alias("status"),
        F.greatest(F.lit(0), F.col("total_amount") * 100).cast("long").alias("bytes"),
    )


def drawn(seed: int, *values) -> F.Column:
    """A number in [0, 1) from an MD5 digest of the seed and the values, the same in any engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(v).cast("string") for v in values])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / float(1 << 32)


def synthetic(spark: SparkSession, n: int = 1_000, partitions: int = PARTITIONS, seed: int = 42) -> DataFrame:
    """Events up to five seconds old, a fifth of them errors."""
    late = F.floor(drawn(seed, "id") * 5_000).cast("long")
    return spark.range(n).select(
        F.concat(F.lit("syn-"), F.col("id").cast("string")).alias("event_id"),
        F.pmod(F.col("id"), F.lit(partitions)).cast("int").alias("partition_id"),
        (F.col("id") * 10).alias("arrival_ms"),
        (F.col("id") * 10 - late).alias("et_ms"),
        F.when(drawn(seed + 1, "id") < 0.2, 500).otherwise(200).alias("status"),
    )


def shuffled_arrivals(events: DataFrame, share: float = 0.3, most_ms: int = 30_000, seed: int = 42, remap_ms: int | None = None) -> DataFrame:
    """Arrival order disturbed: a share of the rows sorts later by up to ``most_ms`` (drawn from the id, so reruns agree).

    With ``remap_ms``, event time is stretched or squeezed onto 0 to that.
    """
    delay = F.floor(drawn(seed + 1, "event_id") * most_ms).cast("long")
    out = events.withColumn("sort_ms", F.col("arrival_ms") + F.when(drawn(seed, "event_id") < share, delay).otherwise(0))
    if remap_ms is None:
        return out
    ends = events.agg(F.min("et_ms").alias("lo"), F.max("et_ms").alias("hi"))
    place = F.floor((F.col("et_ms") - F.col("lo")) * remap_ms / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).cast("long")
    return out.join(F.broadcast(ends)).withColumn("et_ms", place).drop("lo", "hi")


def write_csv(events: DataFrame, path: str) -> None:
    """Events in the engine dialect, times in seconds."""
    events.select(F.col("event_id").cast("string").alias("idx"), "host", (F.col("et_ms") / 1000.0).alias("time"), F.lit("GET").alias("method"), F.lit("/").alias("url"), F.col("status").alias("response"), F.col("bytes").alias("bytes"), (F.col("arrival_ms") / 1000.0).alias("arrival")).write.csv(path, header=True)


def write_access_log(events: DataFrame, path: str) -> None:
    """Events in the access-log dialect, whose clock has whole seconds."""
    at = F.date_format(F.timestamp_seconds(F.floor(F.col("et_ms") / 1000)), "dd/MMM/yyyy:HH:mm:ss Z")
    events.select(F.col("event_id").cast("string").alias("idx"), F.col("host").alias("remote_addr"), at.alias("timestamp"), F.lit("GET").alias("method"), F.lit("/").alias("path"), "status", F.col("bytes").alias("body_bytes_sent")).write.csv(path, header=True)
