"""Suffix-array dedup: remove every byte covered by a long string that starts anywhere else.

Equal windows of ``width`` bytes have equal anchors at equal offsets (see
``anchors``), so only windows of an equal anchor can be equal. The windows that
share one anchor in one place span its context, about 1.3 windows long. Equal
contexts are counted and kept once; a context that occurs again is repeated as a
whole. The distinct contexts of one anchor go to one shard, where a suffix array
over blocks of ``STEP`` bytes, cut at the anchor's offset, puts equal strings next
to each other. Blocks that agree over all but STEP bytes of a window are then
compared at each of the STEP ways that a window can lie around them, byte for
byte, so results are exact at every offset.

An anchor may have more distinct contexts than fit a shard. Their windows are then
parted once more, by where they start before the anchor (in ranges of so many
bytes) and by the bytes that all windows of the range have in common: equal
windows agree in both. Ranges get narrower until every part fits; a range of one
byte has equal windows only, so that is always reached.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.anchors import GRAM, anchors
from tidemark.llm.store import written
from tidemark.llm.suffixes import suffix_array

WIDTH = 400
STEP = 16
#: Bytes of contexts in a shard, on average, and distinct contexts of an anchor that fit one (some 4 MB).
SHARD_BYTES = 6 << 20
HOT = 8_000
#: By what part of a window, and then of a range, the ranges of starts get narrower.
NARROWER = 4


def _bytes(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _runs(batches, width: int, gram: int):
    """Each anchor of each text: key, gram, ctx (hash of context), first and last window, offset of the anchor."""
    for batch in batches:
        rows, parts = [], []
        for i, text in enumerate(batch.column("text")):
            data = _bytes(text)
            found = anchors(np.frombuffer(data, np.uint8), width, gram)
            if len(found.at):
                offset = found.at - found.first
                digest = [xxhash.xxh3_64_intdigest(data[a:b], o) for a, b, o in zip(found.first.tolist(), (found.last + width).tolist(), offset.tolist(), strict=True)]
                rows.append(np.full(len(digest), i))
                parts.append((found.gram.view(np.int64), np.array(digest, np.uint64).view(np.int64), found.first, found.last, offset))
        if rows:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), *map(pa.array, columns)], ["key", "gram", "ctx", "first", "last", "offset"])


def _cut(batches, width: int):
    """The wanted contexts of each text as bytes."""
    for batch in batches:
        rows, out, size = [], [], 0
        names = ("gram", "n", "offset", "first")

        def made(rows, out, batch=batch):
            return pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), *(pa.array([x[c] for x, _ in out], pa.int64()) for c in names), pa.array([d for _, d in out], pa.binary())], ["key", *names, "data"])

        for i, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("wanted"), strict=True)):
            data = _bytes(text)
            for x in wanted.as_py():
                rows.append(i)
                out.append((x, data[x["first"] : x["last"] + width]))
                size += len(out[-1][1])
                if size > 4 << 20:
                    yield made(rows, out)
                    rows, out, size = [], [], 0
        if rows:
            yield made(rows, out)


def _numbers(blocks: np.ndarray) -> np.ndarray:
    """A number for each row of 16 bytes, equal for equal rows."""
    words = np.ascontiguousarray(blocks).view(np.uint64).reshape(len(blocks), 2)
    _, a = np.unique(words[:, 0], return_inverse=True)
    _, b = np.unique(words[:, 1], return_inverse=True)
    _, out = np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)
    return out


def repeated_windows(contexts: list[bytes], offsets: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each context, the starts of its windows that also stand in another of the contexts.

    ``offsets`` are the places of the anchors; equal windows must have equal ones.
    """
    if len(contexts) < 2:
        return [np.zeros(0, np.int64) for _ in contexts]
    sizes = np.array([len(c) for c in contexts])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + STEP
    text = np.frombuffer(b"\0" * STEP + b"".join(contexts) + b"\0" * (width + STEP), np.uint8)
    lead = np.array(offsets) % STEP
    blocks = (sizes - lead) // STEP
    # Block j of context c starts at base + lead + j * STEP; a separator, the least symbol, follows each context.
    owner = np.repeat(np.arange(len(contexts)), blocks + 1)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks + 1) - (blocks + 1), blocks + 1)
    real = number < blocks[owner]
    starts = (base + lead)[owner] + number * STEP
    symbols = np.zeros(len(owner), np.int64)
    symbols[real] = _numbers(text[starts[real][:, None] + np.arange(STEP)]) + 1
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    # Blocks that lie in a window however it begins; what remains are STEP bytes around them.
    inner = (width - STEP + 1) // STEP
    order = order[number[order] + inner <= blocks[owner[order]]]
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(inner):
        same &= symbols[order[1:] + k] == symbols[order[:-1] + k]
    near = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    part = np.concatenate([[0], np.cumsum(~same)])[near]
    order = order[near]
    found: list[np.ndarray] = []
    rest = width - inner * STEP
    lo = 0
    while lo < len(order):
        # Some 200,000 blocks at once, never cutting a run of equal ones.
        hi = min(len(order), lo + 200_000)
        while hi < len(order) and part[hi] == part[hi - 1]:
            hi += 1
        at = starts[order[lo:hi]]
        begin, end = base[owner[order[lo:hi]]], (base + sizes)[owner[order[lo:hi]]]
        around = np.concatenate([text[at[:, None] + np.arange(-rest, 0)], text[at[:, None] + inner * STEP + np.arange(rest)]], axis=1)
        keys, places = [], []
        for left in range(STEP):
            start = at - left
            fits = (start >= begin) & (start + width <= end)
            if not fits.any():
                continue
            flank = np.ascontiguousarray(around[fits, rest - left : 2 * rest - left])
            padded = np.zeros((len(flank), -(-rest // 8) * 8), np.uint8)
            padded[:, :rest] = flank
            keys.append((part[lo:hi][fits].astype(np.int64) * STEP + left, *padded.view(np.uint64).T))
            places.append(start[fits])
        if keys:
            columns = [np.concatenate(x) for x in zip(*keys, strict=True)]
            place = np.concatenate(places)
            by = np.lexsort(columns[::-1])
            equal = np.ones(len(by) - 1, bool)
            for x in columns:
                equal &= x[by[1:]] == x[by[:-1]]
            found.append(place[by][np.concatenate([equal, [False]]) | np.concatenate([[False], equal])])
        lo = hi
    hits = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    limits = np.searchsorted(hits, np.concatenate([base, [base[-1] + sizes[-1]]]))
    return [hits[limits[i] : limits[i + 1]] - base[i] for i in range(len(contexts))]


def _joined(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal spans that windows at the sorted ``starts`` cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + width) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), (starts[np.concatenate([cut - 1, [len(starts) - 1]])] + width).tolist(), strict=True))


def _shard(table: pa.Table, width: int) -> pa.Table:
    """Spans of repeated windows in the contexts of a shard that occur once."""
    data, offsets = table.column("data").to_pylist(), table.column("offset").to_pylist()
    first, n = table.column("first").to_pylist(), table.column("n").to_pylist()
    rows, starts, ends = [], [], []
    for i, hits in enumerate(repeated_windows(data, offsets, width)):
        if n[i] == 1:
            for a, b in _joined(hits, width):
                rows.append(i)
                starts.append(first[i] + a)
                ends.append(first[i] + b)
    keys = table.column("key").combine_chunks().take(pa.array(rows, pa.int64()))
    return pa.Table.from_arrays([keys, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["key", "start", "end"])


def _parts(data: bytes, gram: int, first: int, last: int, offset: int, width: int, span: int):
    """A context of ``data`` cut up by ranges of ``span`` starts: what each range has in common as a hash, first and last window, offset."""
    # Window s begins offset - s bytes before the anchor; range c has those of c * span to (c + 1) * span - 1.
    for c in range((offset - (last - first)) // span, offset // span + 1):
        latest, earliest = offset - c * span, offset - (c + 1) * span + 1
        lo, hi = max(0, earliest), min(last - first, latest)
        common = data[first + latest : first + earliest + width]
        part = xxhash.xxh3_64_intdigest(common, (gram + c * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        yield part - (part >> 63 << 64), first + lo, first + hi, offset - lo


def _parted(batches, width: int, gram: int, levels: list[tuple[frozenset[int], int]]):
    """Parts of the contexts of crowded anchors, rows as of ``_runs``.

    ``levels`` has the crowded keys and the span that parts them, of anchors and
    then of the parts before. Texts are read again where they are, since dealing
    them out once more would cost as much disk as all of them.
    """
    anchors_, _ = levels[0]
    wanted = np.array(sorted(anchors_), np.int64)
    for batch in batches:
        rows, parts = [], []
        for i, text in enumerate(batch.column("text")):
            data = _bytes(text)
            found = anchors(np.frombuffer(data, np.uint8), width, gram)
            grams = found.gram.view(np.int64)
            some = np.isin(grams, wanted)
            held = list(zip(grams[some].tolist(), found.first[some].tolist(), found.last[some].tolist(), (found.at - found.first)[some].tolist(), strict=True))
            for crowded, span in levels:
                held = [p for x in held if x[0] in crowded for p in _parts(data, *x, width, span)]
            for part, lo, hi, offset in held:
                rows.append(i)
                parts.append((part, xxhash.xxh3_64_intdigest(data[lo : hi + width], offset), lo, hi, offset))
        if rows:
            part, ctx, *rest = zip(*parts, strict=True)
            columns = [pa.array(part, pa.int64()), pa.array(np.array(ctx, np.uint64).view(np.int64)), *(pa.array(x, pa.int64()) for x in rest)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), *columns], ["key", "gram", "ctx", "first", "last", "offset"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("text_id")))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """key (doc_id, text_id), spans (start, end in bytes, unordered, may overlap) of texts with repeats.

    ``docs`` has key and text. Rows that are equal altogether share a key, and
    each still counts as a place where its strings start.
    """
    key = f"key {docs.schema['key'].dataType.simpleString()}"
    rows = f"{key}, gram long, ctx long, first long, last long, offset long"
    runs = written(docs.select("key", "text").mapInArrow(partial(_runs, width=width, gram=gram), rows), "repeat-runs")

    def search(table: pa.Table) -> pa.Table:
        return _shard(table, width)

    def cut(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("key").agg(F.collect_list(F.struct("gram", "n", "offset", "first", "last")).alias("wanted"))
        return docs.select("key", "text").join(wanted, "key").mapInArrow(partial(_cut, width=width), f"{key}, gram long, n long, offset long, first long, data binary")

    spans, levels, span = None, [], width
    while True:
        # n: places of a context; one of more than one is repeated as a whole.
        contexts = written(runs.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "last", "offset")).alias("one")), "repeat-contexts")
        grams = contexts.groupBy("gram").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("kinds")).where("places > 1")
        again = written(contexts.join(grams, "gram").select("gram", "ctx", "n", "kinds", "one.*"), "repeat-candidates")
        whole = runs.join(again.where("n > 1").select("gram", "ctx"), ["gram", "ctx"], "left_semi").select("key", F.col("first").alias("start"), (F.col("last") + width).alias("end"))
        many = again.where("kinds > 1")
        sized = many.agg(F.sum(F.when(F.col("kinds") <= hot, F.col("last") - F.col("first") + width)).alias("bytes"), F.max("kinds").alias("most")).first()
        shards = max(1, -(-(sized["bytes"] or 0) // shard_bytes))
        dealt = cut(many.where(F.col("kinds") <= hot)).withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
        found = whole.unionByName(dealt.groupBy("shard").applyInArrow(search, f"{key}, start long, end long"))
        spans = found if spans is None else spans.unionByName(found)
        if (sized["most"] or 0) <= hot:
            return spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        span = max(1, span // NARROWER)
        # One number for each ``hot`` contexts at most reaches the driver.
        crowded = frozenset(r[0] for r in many.where(F.col("kinds") > hot).select("gram").distinct().collect())
        levels.append((crowded, span))
        runs = written(docs.select("key", "text").mapInArrow(partial(_parted, width=width, gram=gram, levels=list(levels)), rows), "repeat-parts")


def merged(spans: list[dict] | None) -> list[list[int]]:
    """Maximal runs of covered bytes, in order; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def kept(data: bytes, runs: list[list[int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _removed(batches):
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data, runs = _bytes(text), merged(spans.as_py())
            rest = kept(data, runs)
            rows.append((len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest))
        if rows:
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, width: int = WIDTH, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) for each row of ``docs`` (doc_id, text).

    A text shorter than ``width`` bytes, empty or null loses nothing. Equal rows
    count as places of their own, so a text of ``width`` bytes or more that is
    there twice loses all its bytes in both. An empty table gives no rows.
    """
    if width < 2 * STEP:
        raise ValueError(f"width must be {2 * STEP} or more")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Texts are dealt out by key once: both joins with them read the same exchange.
    docs = _keyed(docs.select("doc_id", "text")).select("key", "text")
    spans = repeated_spans(docs, width, **limits)
    rows = docs.join(spans, "key", "left").select(F.col("key.doc_id").alias("doc_id"), "text", "spans")
    return rows.mapInArrow(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
