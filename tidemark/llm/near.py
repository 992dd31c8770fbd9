"""The SimHash near-dedup stage: texts of a Jaccard similarity of 0.8 or more, on sets of five-word shingles.

Candidates come from two searches, and every one is verified on the sets
themselves. SimHash fingerprints of the sets, linked by the generalised
pigeonhole search (see ``simhash``), find near copies within three of 64 bits.
Sets of similarity 0.8 differ in ten bits on average and in up to twenty, which
no split of 64 bits into parts can search (README has figures), so MinHash keys
find the rest: a set has 128 MinHash values, and bands of four of them are keys;
two sets of similarity 0.8 share none of the 32 keys with probability 5e-8. Sets
under a key are compared by one bit of each value (two of similarity 0.8 or more
differ in over 28 of 128 bits with probability below 1e-4) and by size; in the
second pass also, under the first of the keys that they share, by their least
hashes, which are the whole set if it has ``LEAST`` elements or fewer (of larger
ones, two of similarity 0.8 or more look less similar than 0.7 with probability
below 1e-4). What is left is verified.

Under each key all sets are first compared with its least and its greatest one;
then those that are not yet in one component are compared with each other, so a
large group of near copies is mostly joined by a number of pairs that grows with
its rows. Only distinct sets take part, so exact copies never meet each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components, one_of_each
from tidemark.llm.fingerprint import _LOWER, bits_set
from tidemark.llm.store import dropped, written

SHINGLE = 5
#: Similarity that links, as a fraction, so that it is compared in whole numbers.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 4
#: Bits in which the sketches of two similar sets may differ.
APART = 28
#: Least hashes by which sets are compared, and the similarity that they show at least in sets of more elements.
LEAST = 256
LOOKS = (7, 10)
SEED = 42
#: Shingles whose MinHash values are found at once.
CHUNK = 1 << 12
_RANDOM = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, (3, BANDS * ROWS), dtype=np.uint64)
_FLIP, _ODD, _MIX = _RANDOM[0][:, None], _RANDOM[1][:, None] | np.uint64(1), _RANDOM[2] | np.uint64(1)
_SHIFTS = np.arange(64, dtype=np.uint64)
_SET = np.uint64(1) << _SHIFTS
_PRINT = "fp long, size int, low long, high long, simhash long, bands array<long>"


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts, stops = (ends - lengths)[: len(words) - SHINGLE + 1].tolist(), (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def least_hashes(found: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        least = np.minimum(least, ((found[None, at : at + CHUNK] ^ _FLIP) * _ODD).min(axis=1))
    return least


def _print(text: str | None) -> dict:
    found = shingles(text)
    if not len(found):
        return {"fp": 0, "size": 0, "low": 0, "high": 0, "simhash": 0, "bands": []}
    least = least_hashes(found)
    mixed = least * _MIX
    mixed ^= mixed >> np.uint64(32)
    sketch = ((mixed * _MIX) >> np.uint64(63)).reshape(2, 64)
    low, high = (sketch << _SHIFTS).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()
    bands = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))]
    whole = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    over_half = _SET[2 * bits_set(found) > len(found)].sum(dtype=np.uint64)
    return {"fp": int(np.uint64(whole).view(np.int64)), "size": len(found), "low": low, "high": high, "simhash": int(over_half.view(np.int64)), "bands": np.array(bands, np.uint64).view(np.int64).tolist()}


def _prints(batches):
    for batch in batches:
        made = [_print(x.as_py()) for x in batch.column("text")]
        kinds = {"fp": pa.int64(), "size": pa.int32(), "low": pa.int64(), "high": pa.int64(), "simhash": pa.int64(), "bands": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([x[k] for x in made], t) for k, t in kinds.items()]], ["doc_id", *kinds])


def _sets(batches):
    for batch in batches:
        made = [shingles(x.as_py()).view(np.int64) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(made, pa.list_(pa.int64()))], ["fp", "found"])


def _may(a: Column, b: Column) -> Column:
    """Whether sizes and sketches leave it open that two sets are similar."""
    p, q = SIMILAR
    apart = F.bit_count(a["low"].bitwiseXOR(b["low"])) + F.bit_count(a["high"].bitwiseXOR(b["high"]))
    return (F.least(a["size"], b["size"]) * q >= F.greatest(a["size"], b["size"]) * p) & (apart <= APART)


def _least(found: Column) -> Column:
    """The least elements of a set, ascending as unsigned numbers, cut to 31 bits."""
    return F.transform(F.slice(found, 1, LEAST), lambda x: F.shiftrightunsigned(x, 33).cast("int"))


def _look(a: Column, b: Column) -> Column:
    """Whether the least elements leave it open that two sets (size, least) are similar.

    Up to the smaller of the last ones that were cut off, both lists are whole.
    Two elements of a whole set may be equal in 31 bits, so one is allowed for.
    """
    (p, q), (r, t) = SIMILAR, LOOKS
    last = lambda x: F.when(x["size"] > LEAST, F.element_at(x["least"], -1)).otherwise((1 << 31) - 1)
    upto, whole = F.least(last(a), last(b)), F.greatest(a["size"], b["size"]) <= LEAST
    count = lambda x: F.size(F.filter(x, lambda y: y <= upto))
    shared = count(F.array_intersect(a["least"], b["least"]))
    allowed = F.when(whole, p + q).otherwise(0)
    return shared * F.when(whole, p + q).otherwise(r + t) + allowed >= (count(a["least"]) + count(b["least"])) * F.when(whole, p).otherwise(r)


def _pairs(met: DataFrame, further: Column | None = None) -> DataFrame:
    """u, v: the different sets of ``met`` (a, b) that may be similar, and for which ``further`` holds."""
    some = met.where((F.col("a.fp") != F.col("b.fp")) & _may(F.col("a"), F.col("b")))
    # Looked at last, since it costs more.
    some = some if further is None else some.where(further)
    return some.select(F.least("a.fp", "b.fp").alias("u"), F.greatest("a.fp", "b.fp").alias("v")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar: of a + b elements, at least p / (p + q) are shared in each."""
    p, q = SIMILAR
    held = pairs.join(sets.select(F.col("fp").alias("u"), F.col("found").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("found").alias("b")), "v")
    return held.where(F.size(F.array_intersect("a", "b")) * (p + q) >= (F.size("a") + F.size("b")) * p).select("u", "v")


def _by_simhash(firsts: DataFrame) -> DataFrame:
    """a, b: sets of equal fingerprints with the least of them, and the least sets of linked fingerprints."""
    each = firsts.where("size > 0").select("simhash", F.struct("fp", "size", "low", "high").alias("x"))
    least = written(each.groupBy("simhash").agg(F.min("x").alias("least")), "near-simhash")
    equal = each.join(least, "simhash").where("x.fp <> least.fp").select(F.col("x").alias("a"), F.col("least").alias("b"))
    near = simhash.links(least.select(F.col("simhash").alias("fp")))
    near = near.join(least.select(F.col("simhash").alias("u"), F.col("least").alias("a")), "u").join(least.select(F.col("simhash").alias("v"), F.col("least").alias("b")), "v")
    return equal.unionByName(near.select("a", "b"))


def links(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """u, v: similar sets of ``firsts`` (first_id and a print), enough of them to join all that are similar.

    ``docs`` (doc_id, text) has the text of every first_id.
    """
    each = firsts.select(F.explode("bands").alias("band"), F.struct("fp", "size", "low", "high").alias("x"))
    ends = each.groupBy("band").agg(F.min("x").alias("least"), F.max("x").alias("most")).where("least.fp < most.fp")
    shared = written(each.join(ends, "band"), "near-shared")
    close = written(_by_simhash(firsts), "near-close")
    wanted = shared.select(F.col("x.fp").alias("fp")).union(close.select("a.fp")).union(close.select("b.fp")).distinct()
    texts = firsts.join(wanted, "fp", "left_semi").select("fp", F.col("first_id").alias("doc_id"))
    # Equal rows have equal ids, so one of each id is enough.
    asked = docs.join(texts, "doc_id").select("fp", "text").dropDuplicates(["fp"])
    sets = written(asked.mapInArrow(_sets, "fp long, found array<long>"), "near-sets")
    with_ends = shared.select(F.col("x").alias("a"), "least").union(shared.select("x", "most")).select("a", F.col("least").alias("b"))
    near = written(_similar(_pairs(with_ends.unionByName(close)), sets), "near-links")
    roots = components(near)
    placed = shared.select("band", "x").join(roots, F.col("x.fp") == F.col("node"), "left").select("band", "x", F.coalesce("root", "x.fp").alias("root"))
    # A key whose sets are in one component has nothing left to compare.
    split = placed.groupBy("band").agg(F.min("root").alias("first_root"), F.max("root").alias("last_root")).where("first_root < last_root").select("band")
    open_ = written(placed.join(split, "band"), "near-open")
    for done in (shared, close):
        dropped(done)
    # All keys and the least elements of a set go with it: a pair is compared under the first key that both have.
    wide = firsts.join(open_.select(F.col("x.fp").alias("fp")).distinct(), "fp", "left_semi").join(sets, "fp").select("fp", "size", "low", "high", "bands", _least(F.col("found")).alias("least"))
    keyed = open_.select("band", "root", F.col("x.fp").alias("fp")).join(wide, "fp").select("band", "root", F.struct("fp", "size", "low", "high", "bands", "least").alias("x"))
    left, right = (keyed.select("band", F.col("x").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    shared_key = F.zip_with("a.bands", "b.bands", lambda x, y: x == y)
    first = F.get("a.bands", (F.array_position(shared_key, True) - 1).cast("int")) == F.col("band")
    more = written(_similar(_pairs(left.join(right, "band").where("a_root < b_root"), first & _look(F.col("a"), F.col("b"))), sets), "near-links")
    for done in (sets, open_):
        dropped(done)
    return near.unionByName(more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the least doc_id) for each row of ``docs`` (doc_id, text).

    Components are those of the links between texts whose sets of shingles have
    a Jaccard similarity of 0.8 or more; sets are told apart by a 64-bit hash.
    Null text is empty text, and texts without words are equal.
    """
    docs = docs.select("doc_id", "text")
    marked = written(docs.mapInArrow(_prints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_PRINT}"), "near-prints")
    same = [F.first(c).alias(c) for c in ("size", "low", "high", "simhash", "bands")]
    firsts = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), *same), "near-distinct")
    roots = components(links(firsts, docs))
    linked = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    return marked.select("doc_id", "fp").join(named, "fp").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns as they are: see ``one_of_each``."""
    return one_of_each(docs, near_duplicates)
