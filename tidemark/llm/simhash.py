"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints within ``radius`` bits agree, for every split of the bits into
m parts and all thresholds t_i >= -1 with sum(t_i + 1) = radius + 1, within t_i
bits in some part. Correlated bits go to the same part, so the parts are as
independent as can be; each fingerprint gets its own thresholds by a dynamic
program over the parts that minimises estimated probes and candidates. Probes
are the part's keys within t_i flips; they meet the index of unprobed keys in
an equi-join, and the whole fingerprints are compared there.

Only distinct fingerprints take part, so exact copies never meet each other.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components, one_of_each
from tidemark.llm.fingerprint import fingerprints
from tidemark.llm.store import written

RADIUS = 3
BITS = 64
#: A candidate costs a comparison; a probe is a row to be shuffled.
PROBE_COST, CANDIDATE_COST = 1.0, 0.25
_SCHEMA = "part int, key long, fp long, probe boolean"


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _co_counts(batches):
    """Counts of bits i and j being set together, one row for each pair and task."""
    total, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        b = _bits(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
        total += b.T @ b
        n += len(b)
    if n:
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])


def correlations(fps: DataFrame, n: int) -> np.ndarray:
    """Absolute correlations of the bits over all fingerprints; 2,080 sums reach the driver."""
    co = np.zeros((BITS, BITS))
    for r in fps.mapInArrow(_co_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        co[r["i"], r["j"]] = co[r["j"], r["i"]] = r["n"] / max(n, 1)
    mean = np.diag(co).copy()
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    found = np.abs((co - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(found, 0)
    return found


def grouped_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal size, correlated bits together."""
    left, groups = set(range(len(corr))), []
    sizes = [len(corr) // parts + (k < len(corr) % parts) for k in range(parts)]
    for size in sizes:
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.remove(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].mean())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _project(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (np.int64(1) << np.arange(len(group), dtype=np.int64))


def _halves(group: list[int], most: int = 11) -> list[list[int]]:
    pieces = -(-len(group) // most)
    return [list(x) for x in np.array_split(group, pieces)]


def _histograms(batches, groups):
    """Counts of the values of each piece of each part, one row for each and task."""
    pieces = [(p, h, piece) for p, g in enumerate(groups) for h, piece in enumerate(_halves(g))]
    counts = [np.zeros(1 << len(piece), np.int64) for _, _, piece in pieces]
    for batch in batches:
        b = _bits(batch.column("fp").to_numpy(zero_copy_only=False))
        for c, (_, _, piece) in zip(counts, pieces, strict=True):
            c += np.bincount(_project(b, piece), minlength=len(c))
    for c, (p, h, _) in zip(counts, pieces, strict=True):
        at = np.flatnonzero(c)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(np.full(len(at), h, np.int32)), pa.array(at), pa.array(c[at])], ["part", "piece", "value", "n"])


def histograms(fps: DataFrame, groups: list[list[int]], n: int) -> list[list[np.ndarray]]:
    """Shares of each value of each piece: at most 2^11 numbers a piece reach the driver."""
    shares = [[np.zeros(1 << len(x)) for x in _halves(g)] for g in groups]
    found = fps.mapInArrow(partial(_histograms, groups=groups), "part int, piece int, value long, n long").groupBy("part", "piece", "value").agg(F.sum("n").alias("n"))
    for r in found.collect():
        shares[r["part"]][r["piece"]][r["value"]] = r["n"] / max(n, 1)
    return shares


def _at_distance(shares: np.ndarray, radius: int) -> list[np.ndarray]:
    """Share of values at exactly d flips of each value, d = 0..radius."""
    width = len(shares).bit_length() - 1
    values, out = np.arange(len(shares)), [shares]
    for d in range(1, radius + 1):
        total = np.zeros(len(shares))
        for flip in combinations(range(width), d):
            total += shares[values ^ sum(1 << f for f in flip)]
        out.append(total)
    return out


def estimates(shares: list[list[np.ndarray]], n: int, radius: int = 2) -> list[list[list[np.ndarray]]]:
    """For each part and piece, expected shares at 0..radius flips (pieces taken as independent)."""
    return [[_at_distance(s, radius) for s in part] for part in shares]


def _part_estimate(tables, values: list[np.ndarray], radius: int) -> list[np.ndarray]:
    """Expected share of fingerprints within t flips in a part, t = 0..radius."""
    exact = [t[values[0]] for t in tables[0]]
    for piece, v in zip(tables[1:], values[1:], strict=True):
        exact = [sum(exact[a] * piece[d - a][v] for a in range(d + 1)) for d in range(radius + 1)]
    return list(np.cumsum(exact, axis=0))


def allocate(bits: np.ndarray, groups, tables, n: int, radius: int = RADIUS, most: int = 2) -> np.ndarray:
    """Thresholds (rows: fingerprints, columns: parts) of least estimated cost.

    A dynamic program over the parts: best[b] is the least cost with b of the
    radius + 1 units of t_i + 1 given out so far. ``most`` bounds a threshold.
    """
    rows, units = len(bits), radius + 1
    best = np.full((rows, units + 1), np.inf)
    best[:, 0] = 0
    chosen = []
    for group, part in zip(groups, tables, strict=True):
        near = _part_estimate(part, [_project(bits, x) for x in _halves(group)], most)
        keys = np.cumsum([len(list(combinations(range(len(group)), d))) for d in range(most + 1)])
        cost = [np.zeros(rows)] + [PROBE_COST * keys[t] + CANDIDATE_COST * n * near[t] for t in range(most + 1)]
        after, pick = np.full_like(best, np.inf), np.zeros((rows, units + 1), np.int8)
        for used in range(units + 1):
            for give in range(min(units - used, most + 1) + 1):
                total = best[:, used] + cost[give]
                better = total < after[:, used + give]
                after[better, used + give] = total[better]
                pick[better, used + give] = give
        best = after
        chosen.append(pick)
    out, left = np.zeros((rows, len(groups)), np.int8), np.full(rows, units)
    for k in range(len(groups) - 1, -1, -1):
        give = chosen[k][np.arange(rows), left]
        out[:, k] = give - 1
        left = left - give
    return out


def _flips(width: int, distance: int) -> np.ndarray:
    return np.array([sum(1 << f for f in c) for d in range(distance + 1) for c in combinations(range(width), d)], np.int64)


def _probes(batches, groups, tables, n, radius):
    """Index rows (probe false) and probe rows (probe true) of each fingerprint."""
    flips = {(len(g), t): _flips(len(g), t) for g in groups for t in range(3)}
    for batch in batches:
        every = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(every), 2048):
            fps = every[at : at + 2048]
            bits = _bits(np.ascontiguousarray(fps))
            thresholds = allocate(bits, groups, tables, n, radius)
            for p, group in enumerate(groups):
                keys = _project(bits, group)
                rows = [(keys, fps, False)]
                for t in range(3):
                    some = thresholds[:, p] == t
                    if some.any():
                        masks = flips[len(group), t]
                        rows.append(((keys[some, None] ^ masks).ravel(), np.repeat(fps[some], len(masks)), True))
                for k, f, probe in rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), p, np.int32)), pa.array(k), pa.array(f), pa.array(np.full(len(k), probe))], ["part", "key", "fp", "probe"])


def parts_for(n: int, radius: int = RADIUS) -> int:
    """Parts of least expected cost for n spread fingerprints, one threshold above 0 at least.

    With radius + 1 parts all thresholds would be 0, whose candidates grow
    fastest; fewer, wider parts cost probes but keep candidates few.
    """
    units, costs = radius + 1, {}
    for m in range(2, radius + 1):
        width = BITS // m
        give = [units // m + (k < units % m) for k in range(m)]
        keys = sum(sum(len(list(combinations(range(width), d))) for d in range(g)) for g in give)
        costs[m] = keys * (PROBE_COST + CANDIDATE_COST * n / 2.0**width)
    return min(costs, key=costs.get)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: every pair of the distinct fingerprints in ``fps`` (fp: long) within ``radius`` bits."""
    n = fps.count()
    if not n:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    groups = grouped_bits(correlations(fps, n), parts_for(n, radius))
    tables = estimates(histograms(fps, groups, n), n)
    dealt = fps.mapInArrow(partial(_probes, groups=groups, tables=tables, n=n, radius=radius), _SCHEMA)
    # One pass makes both sides; the written table is read for each.
    dealt = written(dealt, "simhash-probes")
    asked = dealt.where("probe").select("part", "key", F.col("fp").alias("u"))
    held = dealt.where("not probe").select("part", "key", F.col("fp").alias("v"))
    near = asked.join(held, ["part", "key"]).where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
    return near.select("u", "v").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs`` (doc_id, text).

    Null text is empty text: fingerprint zero, linked like any other. Repeated
    rows are answered each; a null doc_id is never a component_id unless a
    component has no other. An empty table gives no rows.
    """
    marked = written(docs.select("doc_id", "text").mapInArrow(fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long"), "simhash-prints")
    firsts = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(firsts.select("fp"), radius))
    linked = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, all columns as they are: see ``one_of_each``."""
    return one_of_each(docs, partial(near_duplicates, radius=radius))
