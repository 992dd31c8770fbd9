"""Exact top-k inner-product search: ball-tree branch and bound per shard.

Vectors near the same pivot form a cluster, cut into shards of bounded size;
pivots come from a bounded sample and say only where a vector lives. The ball
tree of each shard is built once and kept as a file in the shared folder. A node
knows its centre and radius, so no vector below it scores more than
<q, centre> + |q| * radius; the same bound holds for a whole cluster.

Queries travel in waves. In the first, each goes to the shards of the cluster of
its highest bound; in each later one to four times as many of the next clusters,
as long as their bound reaches the query's kth score. That score is what the
waves share: it also bounds the search in every tree. A query is never sent to a
cluster that cannot hold one of its k best.

Scores are inner products of whole numbers and exact: vectors are split into
limbs whose products float64 holds, as many as their largest component needs;
beyond 64 bits scores wrap as a Java long does.
"""

from __future__ import annotations

import heapq
import io
import uuid
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import broadcast_if_small, create, new_path, read_whole, written

K = 20
#: Vectors and bytes of a shard, and queries that search a tree together.
SHARD_ROWS = 16_384
SHARD_BYTES = 16 << 20
QUERY_ROWS = 4_096
LEAF = 128
SCALE = 64
#: Clusters of vectors of one length at most, and sampled vectors (expected number) for each pivot.
CLUSTERS = 1_024
SAMPLED = 16
#: How many times more clusters each wave takes than the one before.
WIDER = 4
_LOWEST = np.iinfo(np.int64).min
_FOUND = "asked long, query_id long, vec_id long, score long"


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` (int64 rows) as float64 arrays, lowest first, each below 2^(bits - 1) in size; see ``limb_bits``."""
    bits = limb_bits(x.shape[1])
    half, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    while True:
        low = ((x + half) & mask) - half
        out.append(low.astype(np.float64))
        # x - low may wrap by one limb at the very end of the range; the last limb's carry is beyond 64 bits then.
        x = (x >> bits) + ((x >> (bits - 1)) & 1)
        if not x.any() or len(out) * bits >= 64:
            return out


def limb_bits(dim: int) -> int:
    """Bits of a limb such that float64 holds sums of ``dim`` products."""
    return (54 - max(1, dim).bit_length()) // 2


def products(q: list[np.ndarray], c: list[np.ndarray], bits: int) -> np.ndarray:
    """Inner products (int64, wrapping) of all rows, given as limbs."""
    total = np.zeros((len(q[0]), len(c[0])), np.uint64)
    for i, a in enumerate(q):
        for j, b in enumerate(c):
            if bits * (i + j) < 64:
                total += (a @ b.T).astype(np.int64).view(np.uint64) << np.uint64(bits * (i + j))
    return total.view(np.int64)


class BallTree:
    """A tree over the rows of ``vectors`` (int64) with ``ids``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order, floats = np.arange(len(ids)), vectors.astype(np.float64)
        lo_, hi_, left, right, centres, radii = [], [], [], [], [], []
        todo = [(0, len(ids), None, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node = len(lo_)
            if parent is not None:
                (right if side else left)[parent] = node
            rows = floats[order[lo:hi]]
            centre = rows.mean(axis=0)
            away = np.sqrt(np.maximum(((rows - centre) ** 2).sum(axis=1), 0))
            for kept, x in zip((lo_, hi_, left, right, centres, radii), (lo, hi, -1, -1, centre, float(away.max(initial=0.0))), strict=True):
                kept.append(x)
            if hi - lo > leaf and away.max() > 0:
                # Split between two far points: the farthest from the centre, and the farthest from that.
                a = rows[int(away.argmax())]
                b = rows[int(((rows - a) ** 2).sum(axis=1).argmax())]
                middle = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(rows @ (b - a), middle)]
                todo += [(lo, lo + middle, node, 0), (lo + middle, hi, node, 1)]
        self._hold(ids[order], vectors[order], np.array([lo_, hi_, left, right], np.int64).reshape(4, -1), np.array(centres), np.array(radii))

    def _hold(self, ids, vectors, nodes, centre, radius):
        self.ids, self.vectors, self.nodes, self.centre, self.radius = ids, vectors, nodes, centre, radius
        self.limbs = limbs(vectors)
        self.longest = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0))

    def dump(self) -> bytes:
        out, most = io.BytesIO(), int(max(-self.vectors.min(initial=0), self.vectors.max(initial=0)))
        small = next((t for t in (np.int8, np.int16, np.int32) if 0 <= most <= np.iinfo(t).max), np.int64)
        np.savez(out, self.ids, self.vectors.astype(small), self.nodes, self.centre, self.radius)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            ids, vectors, *rest = (z[k] for k in ("arr_0", "arr_1", "arr_2", "arr_3", "arr_4"))
        tree._hold(ids, vectors.astype(np.int64), *rest)
        return tree

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        """(query row, id, score) of every candidate that may be among the k best.

        ``q`` has int64 rows; ``floor`` has for each query a score that k
        candidates are known to reach (-inf: none). Nodes are visited for all
        queries at once, in descending order of the best bound any of them has.
        """
        floats, bits, own = q.astype(np.float64), limb_bits(q.shape[1]), limbs(q)
        norm = np.sqrt((floats * floats).sum(axis=1))
        # A little more than the bound, for rounding in centres and radii.
        upper = floats @ self.centre.T + norm[:, None] * self.radius + 1e-6 * (1 + norm[:, None] * (np.abs(self.centre).max(initial=0.0) + self.radius))
        # Where scores may wrap there is no bound.
        upper[norm * self.longest >= 2.0**62] = np.inf
        best_s, best_i = np.full((len(q), k), _LOWEST), np.full((len(q), k), np.iinfo(np.int64).max)
        filled = np.zeros(len(q), np.int64)
        kth = floor.astype(np.float64).copy()
        left, right = self.nodes[2], self.nodes[3]
        heap = [(-float(upper[:, 0].max()), 0, np.arange(len(q)))]
        while heap:
            _, node, rows = heapq.heappop(heap)
            rows = rows[upper[rows, node] >= kth[rows]]
            if not len(rows):
                continue
            if left[node] >= 0:
                for child in (int(left[node]), int(right[node])):
                    inside = rows[upper[rows, child] >= kth[rows]]
                    if len(inside):
                        heapq.heappush(heap, (-float(upper[inside, child].max()), child, inside))
                continue
            here = slice(int(self.nodes[0][node]), int(self.nodes[1][node]))
            ids, held = self.ids[here], [x[here] for x in self.limbs]
            for at in range(0, len(rows), 1024):
                part = rows[at : at + 1024]
                scores = products([x[part] for x in own], held, bits)
                others = qid[part][:, None] != ids[None, :]
                all_s = np.concatenate([best_s[part], np.where(others, scores, _LOWEST)], axis=1)
                all_i = np.concatenate([best_i[part], np.where(others, ids[None, :], np.iinfo(np.int64).max)], axis=1)
                # ~s falls as s rises, without the overflow of -s; places without a candidate come last.
                top = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
                best_s[part], best_i[part] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
                filled[part] = np.minimum(k, filled[part] + others.sum(axis=1))
                full = part[filled[part] == k]
                kth[full] = np.maximum(kth[full], best_s[full, -1].astype(np.float64))
        at, rank = np.nonzero(np.arange(k)[None, :] < filled[:, None])
        return at, best_i[at, rank], best_s[at, rank]


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in column], np.int64).reshape(len(column), -1 if len(column) else 0)


# Clusters


def pivots(sample: np.ndarray, wanted: int, rounds: int = 4) -> np.ndarray:
    """``wanted`` centres at most, by a few rounds of k-means from evenly spread rows of the sample."""
    found = np.unique(sample, axis=0)
    found = found[np.linspace(0, len(found) - 1, min(wanted, len(found))).astype(int)].astype(np.float64) if len(found) else found.astype(np.float64)
    for _ in range(rounds if len(found) > 1 else 0):
        near = nearest(sample, found)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(found))
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of least distance for each row, the first of equal ones."""
    out = np.zeros(len(rows), np.int64)
    for at in range(0, len(rows), 4096):
        out[at : at + 4096] = ((centres * centres).sum(axis=1) - 2 * (rows[at : at + 4096].astype(np.float64) @ centres.T)).argmin(axis=1)
    return out


def _by_length(frames, columns: list[str]):
    """(dim, part) for the rows of each length in each frame."""
    for frame in frames:
        for dim, part in frame.groupby(frame["v"].map(len), sort=False):
            yield int(dim), part[columns]


def _placed(frames, centres: dict):
    for dim, part in _by_length(frames, ["vec_id", "v"]):
        yield part.assign(dim=np.int32(dim), cluster=nearest(_matrix(part["v"]), centres[dim]).astype(np.int32))


def _built(key, shard: pd.DataFrame, folder: str, centres: dict, leaf: int = LEAF) -> pd.DataFrame:
    """Builds the tree of a shard and writes it."""
    dim, cluster, _ = key
    vectors, ids = _matrix(shard["v"]), shard["vec_id"].to_numpy(np.int64)
    away = np.sqrt(((vectors - centres[dim][cluster]) ** 2).sum(axis=1)).max(initial=0.0)
    # A name of its own for each attempt, so a retried task leaves at most a file that nobody reads.
    name = f"{folder}/{uuid.uuid4().hex}.npz"
    with create(name) as out:
        out.write(BallTree(ids, vectors, leaf).dump())
    return pd.DataFrame({"dim": [dim], "cluster": [cluster], "file": [name], "radius": [float(away)], "longest": [float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0))]})


# Waves


def _sent(frames, centres: dict, radii: dict, wave: tuple[int, int]):
    """A row for each query and cluster, from place wave[0] to wave[1] in the order of the query's bounds."""
    for dim, part in _by_length(frames, ["asked", "vec_id", "v", "floor"]):
        if dim not in radii:
            continue
        radius, longest = radii[dim]
        q = _matrix(part["v"]).astype(np.float64)
        norm = np.sqrt((q * q).sum(axis=1))
        c = centres[dim]
        upper = q @ c.T + norm[:, None] * radius + 1e-6 * (1 + norm[:, None] * (np.abs(c).max(initial=0.0) + radius))
        upper[norm * longest.max(initial=0.0) >= 2.0**62] = np.inf
        upper[:, radius < 0] = -np.inf  # no vector lives there
        order = np.argsort(-upper, axis=1, kind="stable")[:, wave[0] : wave[1]]
        bound = np.take_along_axis(upper, order, 1)
        floor = part["floor"].to_numpy(np.float64, na_value=-np.inf)
        row, place = np.nonzero((bound >= floor[:, None]) & (bound > -np.inf))
        yield part.iloc[row].assign(dim=np.int32(dim), cluster=order[row, place].astype(np.int32))


def _searched(key, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best of one shard for a block of queries."""
    tree, qid = BallTree.load(read_whole(key[0])), queries["vec_id"].to_numpy(np.int64)
    at, ids, scores = tree.search(qid, _matrix(queries["v"]), k, queries["floor"].to_numpy(np.float64, na_value=-np.inf))
    return pd.DataFrame({"asked": queries["asked"].to_numpy(np.int64)[at], "query_id": qid[at], "vec_id": ids, "score": scores})


def whole(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, clusters: int = CLUSTERS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates other than itself.

    Both inputs have vec_id and v (whole numbers as double). Vectors of another
    length than the query's are no candidates of it; a query without candidates
    has no rows. Ties go to the smaller vec_id. Rows that are equal in vec_id and
    vector are one. Other rows of one vec_id are queries and candidates of their
    own, ranked each by itself, but never candidates of a query of that vec_id.
    """
    spark, v = vectors.sparkSession, F.transform("v", lambda x: x.cast("long")).alias("v")
    held = vectors.select("vec_id", v).dropDuplicates(["vec_id", "v"])
    asked = queries.select(F.xxhash64("vec_id", "v").alias("asked"), "vec_id", v).dropDuplicates(["asked"])
    asked = written(asked, "top-queries")
    n_asked = asked.count()
    counts = {r["dim"]: r["n"] for r in held.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows_of = {d: max(1, min(shard_rows, SHARD_BYTES // (8 * max(1, d)))) for d in counts}
    wanted = {d: min(clusters, -(-n // rows_of[d])) for d, n in counts.items()}
    centres = {d: np.zeros((1, d)) for d in counts}
    several = [d for d in counts if wanted[d] > 1]
    if several:
        spot, keep = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)), F.lit(False)
        for d in several:
            keep = keep | ((F.size("v") == d) & (spot < int(min(1.0, SAMPLED * wanted[d] / counts[d]) * (1 << 30))))
        drawn = held.where(keep).select("v").toPandas()["v"]
        for d in several:
            sample = [x for x in drawn if len(x) == d]
            centres[d] = pivots(_matrix(sample), wanted[d]) if sample else centres[d]
    placed = written(held.mapInPandas(partial(_placed, centres=centres), "vec_id long, v array<long>, dim int, cluster int"), "top-vectors")
    per_shard = F.lit(1)
    for d, n in rows_of.items():
        per_shard = F.when(F.col("dim") == d, n).otherwise(per_shard)
    shards = placed.groupBy("dim", "cluster").agg(F.ceil(F.count(F.lit(1)) / F.max(per_shard)).alias("shards"))
    dealt = placed.join(broadcast_if_small(shards), ["dim", "cluster"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")))
    folder = new_path(spark, "ball-trees")
    trees = written(dealt.groupBy("dim", "cluster", "shard").applyInPandas(partial(_built, folder=folder, centres=centres), "dim int, cluster int, file string, radius double, longest double"), "top-trees")
    # One line for each cluster, of which there are ``clusters`` for a length at most.
    radii = {d: (np.full(len(c), -1.0), np.zeros(len(c))) for d, c in centres.items()}
    for r in trees.groupBy("dim", "cluster").agg(F.max("radius").alias("radius"), F.max("longest").alias("longest")).collect():
        radii[r["dim"]][0][r["cluster"]], radii[r["dim"]][1][r["cluster"]] = r["radius"], r["longest"]
    files = broadcast_if_small(trees.select("dim", "cluster", "file"))
    blocks = max(1, -(-n_asked // query_rows))

    def best(found: DataFrame) -> DataFrame:
        """At most k rows a query come from each shard, so a query's rows are few."""
        ordered = F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("low"), F.col("vec_id"))))
        return found.groupBy("asked", "query_id").agg(F.slice(ordered, 1, k).alias("top"))

    found, at, size, most = spark.createDataFrame([], _FOUND), 0, 1, max((len(c) for c in centres.values()), default=0)
    while at < most:
        floors = best(found).where(F.size("top") >= k).select("asked", F.bitwise_not(F.element_at("top", k)["low"]).cast("double").alias("floor"))
        bounded = asked.join(floors, "asked", "left") if at else asked.withColumn("floor", F.lit(None).cast("double"))
        sent = bounded.mapInPandas(partial(_sent, centres=centres, radii=radii, wave=(at, at + size)), "asked long, vec_id long, v array<long>, floor double, dim int, cluster int")
        sent = sent.join(files, ["dim", "cluster"]).withColumn("block", F.pmod(F.xxhash64("asked", F.lit(1)), F.lit(blocks)))
        wave = written(sent.groupBy("file", "block").applyInPandas(partial(_searched, k=k), _FOUND), "top-found")
        found = found.unionByName(wave)
        at, size = at + size, size * WIDER
    ranked = best(found).select("query_id", F.posexplode("top").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.bitwise_not(F.col("x.low")).alias("score"))


def usable(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v of the rows whose vector holds finite components only."""
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale).alias("v"))
