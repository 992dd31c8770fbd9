"""Mixing sources to target weights by Sainte-Laguë apportionment (SQL functions only).

The corpus is cut into equal-token blocks. Sources get blocks by the highest
quotients ``target / (2k - 1)``; each source's integer seats are dealt in the
same way to its shards, and each shard takes its quota of blocks from a seeded
start in a seeded document order, wrapping round. Quotas beyond the shard's
length are whole passes, so a document is taken at most ``cap`` times.

Only quotients that can decide a seat are built. With house size N and S
parties, every divisor that fills the house lies between votes/(N-S) and
votes/(N+S), so each party's seats are known up to a few candidates and at most
about 4S quotients are ranked, whatever N is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.store import broadcast_if_small, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: Words in a block. Small, so that a source's share is met within a few words.
BLOCK = 4
#: Words in a shard of a source, until a source has MAX_SHARDS shards.
SHARD_WORDS = 1 << 20
MAX_SHARDS = 100_000
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: rank, source_size, weight, target (double).

    ``sizes`` has ``source`` and ``source_size``. Sources are ranked by code
    point, null last; ``weights`` repeat along that order. Targets share the
    corpus size by weight, stop at ``cap`` times the source's size, and the
    excess goes to the others by weight until none is above (water-filling:
    in order of cap/weight, sources are capped while the common level exceeds
    their cap). Sources are few next to documents, so one window holds them.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name).cast("long")).withColumn(
        "weight", F.element_at(pattern, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    fill = W.orderBy((F.col("source_size") * cap / F.col("weight")).asc(), F.col("rank").asc())
    before, rest = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(rest))
        .withColumn("level_here", (F.col("total") - F.col("capped_before")).cast("double") / F.col("weight_left"))
        .withColumn("capped", F.col("source_size") * cap / F.col("weight") <= F.col("level_here"))
    )
    level = F.max(F.when(~F.col("capped"), F.col("level_here"))).over(everything)
    return ranked.withColumn("level", level).select(
        "source",
        "rank",
        "source_size",
        "total",
        F.when(F.col("capped"), (F.col("source_size") * cap).cast("double"))
        .otherwise(F.least((F.col("source_size") * cap).cast("double"), F.col("level") * F.col("weight")))
        .alias("target"),
    )


def sainte_lague(parties: DataFrame, house: str | None, votes: str, seats: str, limit: str, key: str) -> DataFrame:
    """``parties`` with a column ``won``: seats by highest quotients votes/(2k-1).

    ``house`` names the column that separates elections (None: one election),
    ``seats`` the house size, ``limit`` the most seats a party may hold, ``key``
    a column that orders parties on ties. Parties without votes win nothing.
    """
    over = W.partitionBy(house) if house else W.partitionBy()
    v, n = F.col(votes).cast("double"), F.col(seats).cast("double")
    sure = F.floor(v * (n - F.col("_s")) / F.col("_v") + 0.5) - 1
    most = F.floor(v * (n + F.col("_s")) / F.col("_v") + 0.5) + 1
    bounds = (
        parties.withColumn("_s", F.count(F.lit(1)).over(over).cast("double"))
        .withColumn("_v", F.sum(v).over(over))
        .withColumn("_low", F.when(F.col("_v") > 0, F.greatest(F.lit(0), F.least(F.col(limit), sure))).otherwise(0).cast("long"))
        .withColumn("_high", F.when(F.col("_v") > 0, F.greatest(F.col("_low"), F.least(F.col(limit), most))).otherwise(0).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_low").over(over))
    )
    quotients = (
        bounds.where((F.col("_high") > F.col("_low")) & (v > 0))
        .withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
        .withColumn("_q", v / (2 * F.col("_k") - 1))
    )
    by_quotient = (W.partitionBy(house) if house else W.partitionBy()).orderBy(F.col("_q").desc(), F.col(key).asc(), F.col("_k").asc())
    on = [house, key] if house and house != key else [key]
    won = quotients.withColumn("_r", F.row_number().over(by_quotient)).where("_r <= _open").groupBy(*on).agg(F.count(F.lit(1)).alias("_won"))
    return bounds.join(won, on, "left").withColumn("won", F.col("_low") + F.coalesce(F.col("_won"), F.lit(0))).drop("_s", "_v", "_low", "_high", "_open", "_won")


def seeded(seed: int, *cols) -> Column:
    """A 32-bit hash of the values, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *cols)), 1, 8), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    cap: int = CAP,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    max_shards: int = MAX_SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source).

    Null text has size 0 and is taken 0 times; a null source is a source of its
    own, ranked last; repeated rows count each; an empty table gives no rows.
    Order and start are MD5 of the seed and doc_id, so reruns agree; rows with
    equal doc_id are ordered by size (equal rows are interchangeable).
    """
    docs = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    docs = written(docs, "mix-sizes")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, cap)
    sources = sources.withColumn("_seats", F.floor(F.col("total") / block)).withColumn("_limit", F.floor(F.col("source_size") * cap / block))
    sources = sainte_lague(sources, None, "target", "_seats", "_limit", "rank")
    shards_of = F.greatest(F.lit(1), F.least(F.lit(max_shards), F.ceil(F.col("source_size") / shard_words)))
    sources = written(sources.select("source", "rank", "source_size", "target", F.col("won").alias("seats"), shards_of.cast("long").alias("shards")), "mix-sources")

    named = broadcast_if_small(sources.withColumnRenamed("source", "_source"))
    dealt = docs.join(named, docs["source"].eqNullSafe(named["_source"])).withColumn("shard", seeded(seed, F.lit("shard"), F.col("doc_id").cast("string")) % F.col("shards"))
    shards = dealt.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"))
    shards = shards.withColumn("_limit", F.floor(F.col("words") * cap / block))
    shards = sainte_lague(shards, "rank", "words", "seats", "_limit", "shard")
    start = seeded(seed, F.lit("start"), F.col("rank").cast("string"), F.col("shard").cast("string")) % F.greatest(F.lit(1), F.ceil(F.col("words") / block)) * block
    shards = written(shards.select("rank", "shard", "words", (F.col("won") * block).alias("quota"), start.alias("start")), "mix-shards")

    order = W.partitionBy("rank", "shard").orderBy(seeded(seed, F.lit("order"), F.col("doc_id").cast("string")), "doc_id", "size")
    placed = dealt.withColumn("_to", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_from", F.col("_to") - F.col("size"))
    placed = placed.join(broadcast_if_small(shards), ["rank", "shard"])
    passes = F.floor(F.col("quota") / F.greatest(F.lit(1), F.col("words")))
    rest = F.col("quota") - passes * F.col("words")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_to"), high) - F.greatest(F.col("_from"), low))

    taken = passes * F.col("size") + overlap(F.col("start"), F.least(F.col("start") + rest, F.col("words"))) + overlap(F.lit(0), F.col("start") + rest - F.col("words"))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
