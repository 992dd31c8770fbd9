"""Shared intermediate tables and checked broadcasts.

Intermediate results that several later steps read are written as Parquet to
the folder that the cluster names in ``spark.checkpoint.dir``; every executor
sees it, so a lost executor costs a re-read and not a recomputation. Only when
the session names none (tests, a laptop) is a local folder set.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a table may be broadcast; counted, never assumed.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; if it is unset, a local one for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, deleted when the session ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextmanager
def _without_leftovers(spark: SparkSession):
    """Queries begun within delete their shuffle files at their end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and no shuffle file of it is left.

    ``few``, for tables known to be small: at most a file for each core. Hadoop's
    local files cost a process for each file and its checksum to set their modes,
    and each such process begins with all of the executor's memory as its own.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if few:
        df = df.coalesce(spark.sparkContext.defaultParallelism)
    with _without_leftovers(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nobody reads again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and, written as JSON, bytes; both are counted."""
    sized = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("bytes")).first()
    return sized["n"] <= rows and (sized["bytes"] or 0) <= most_bytes


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; beyond the bounds Spark joins by shuffle."""
    return F.broadcast(df) if is_small(df, rows) else df


def give_back() -> None:
    """Return memory that this process has freed to the system; glibc would keep it for later."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until none of ``columns`` is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Files of our own in the shared folder, which may be a mounted folder or any store that pyarrow can open.


def _store(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """A new file to write to, with the folders above it."""
    store, path = _store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def opened(uri: str):
    """A file to read from at any place."""
    store, path = _store(uri)
    return store.open_input_file(path)


def read_whole(uri: str) -> bytes:
    with opened(uri) as file:
        return file.read()
