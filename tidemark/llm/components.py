"""Connected components of a large graph by alternating large and small stars.

Edges are first dealt out, so many to a task, and each task's are replaced by
links of its nodes to the smallest that they reach by them: the same components
with fewer and shorter paths, and all of them if one task had all edges. Else
each round is two joins on narrow rows; every few links a node keeps shrink the
diameter by a constant factor, so rounds grow with the logarithm of the longest
path. Rounds end in the shared folder, so no lineage builds up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import dropped, unused, written

#: Edges of a task that replaces them by links to the smallest node.
EDGES = 1 << 18


def _to_least(batches):
    """u, v: each node of the edges in ``batches`` that reaches a smaller one by them, and the smallest."""
    held = list(batches)
    if not held:
        return
    ends = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("u", "v")]
    nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
    above = list(range(len(nodes)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for a, b in zip(*(x.tolist() for x in np.split(place, 2)), strict=True):
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    least = nodes[np.array(list(map(top, above)), np.int64)]
    moved = nodes != least
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(least[moved])], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = both.join(least, "u")
    if large:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (u, v: long, not null)."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = state(now)
    tasks = -(-seen[0] // EDGES)
    if tasks:
        folded = written(now.repartition(tasks).mapInArrow(_to_least, "u long, v long"), "links")
        dropped(now)
        now = folded
        # What one task made is the result.
        seen = state(now) if tasks > 1 else (0,)
    while seen[0]:
        after = written(_star(_star(now, True), False), "links")
        dropped(now)
        now, before = after, seen
        seen = state(now)
        if seen == before:
            break
    # Every edge now joins a node to the smallest one of its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def one_of_each(docs: DataFrame, grouped) -> DataFrame:
    """``docs`` with one row of each component: its least by doc_id, then by a hash of the row.

    ``grouped`` names components: from (doc_id, text) it makes doc_id and
    component_id, the least doc_id of the component. It is given a doc_id of
    each different row, so rows that share a doc_id or have none (which counts
    as the smallest) keep components of their own; of equal rows one stays.
    """
    columns, key = docs.columns, unused(docs.columns, "_key")
    # The hash skips nulls, so it is told where they are.
    row = F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])
    named = docs.withColumn(key, F.struct(F.col("doc_id"), row.alias("row")))
    found = grouped(named.select(F.col(key).alias("doc_id"), "text"))
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    return named.join(kept, key, "left_semi").dropDuplicates([key]).select(*columns)
