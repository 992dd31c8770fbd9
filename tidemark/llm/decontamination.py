"""Benchmark decontamination by a prefix-filtered set join (SQL functions only).

A benchmark item is cut into windows of ``width`` consecutive words (an item of
fewer is one window). A document contains a window exactly if the same words
stand in it in the same order. Containment of a whole window leaves a prefix of
one token: after ordering a window's words by rarity in the corpus, its rarest
word must occur. Document words are joined on that word; the window's offset
gives the only place where it could stand, length and position bounds drop what
would stick out of the document, and the words in that place are compared.

Words meet by 64-bit hashes, which only choose what is compared: counts that two
words share change the order of rarity at most, and every hit is verified on the
words. Joins that are too large for a broadcast deal each word to SALTS keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import BROADCAST_ROWS, broadcast_if_small, is_small, unused, written

#: What parts words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters beyond A-Z that lower() would change: upper and title case, letter numbers, circled letters.
OTHER_UPPER = r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"
WIDTH = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that a word is dealt to where a join is not broadcast.
SALTS = 16


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased, in order; none for null.

    Cutting at single spaces is several times faster than extracting by a
    pattern, and lower() than translate(), which is left to texts that need it.
    """
    low = F.when(text.rlike(OTHER_UPPER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.coalesce(F.array_remove(F.split(F.regexp_replace(low, BETWEEN, " "), " ", -1), ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(windows: window_id, win) of distinct contents, (members: window_id, item_id)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - width, F.lit(0))
    cut = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item_id", F.slice("w", F.col("at") + 1, width).alias("win"))
    cut = written(cut.withColumn("window_id", F.sha2(F.concat_ws(" ", "win"), 256)).distinct(), "leak-windows", few=is_small(benchmark.select("item_id", "text")))
    return cut.select("window_id", "win").dropDuplicates(["window_id"]), cut.select("window_id", "item_id").distinct()


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))


def _for_each_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def with_anchor(windows: DataFrame, seen: DataFrame, small: bool) -> DataFrame:
    """window_id, win, size, h (of the rarest word; ties to the smaller word, then place), offset."""
    placed = windows.select("window_id", "win", F.posexplode("win").alias("offset", "word")).withColumn("h", F.xxhash64("word"))
    if small:
        ranked = placed.join(F.broadcast(seen), "h")
    else:
        ranked = _salted(placed, "window_id").join(_for_each_salt(seen), ["h", "salt"])
    # A word that no document has rules its window out, and is then missing here.
    first = F.min(F.struct("n", "word", "offset", "h")).alias("best")
    best = ranked.groupBy("window_id").agg(first, F.first("win").alias("win"), F.count(F.lit(1)).alias("found"))
    return best.where(F.col("found") == F.size("win")).select("window_id", "win", F.size("win").alias("size"), F.col("best.h").alias("h"), F.col("best.offset").alias("offset"))


def occurrences(docs: DataFrame, windows: DataFrame, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """row_id, start, size, window_id of every occurrence of a window in a document.

    Corpus counts order the words; they are taken over all documents. Tables
    made from the benchmark are broadcast only when their counted rows and bytes
    are within bounds; beyond, words are joined by shuffle, salted, and carry the
    words around them, which bounds a row by the window's width.
    """
    few = is_small(windows, broadcast_rows)
    vocabulary = written(windows.select(F.explode("win").alias("word")).select(F.xxhash64("word").alias("h")).distinct(), "leak-vocabulary", few)
    small = few and is_small(vocabulary, broadcast_rows)
    tokens = docs.select("row_id", words(F.col("text")).alias("w"))
    # Outer generators: before others Spark cuts each text three times, to leave out those without words.
    every = tokens.select(F.explode_outer("w").alias("word")).where("word IS NOT NULL").select(F.xxhash64("word").alias("h"))
    if small:
        seen = every.join(F.broadcast(vocabulary), "h").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    else:
        # Counted before the join, so a common word is one row of each task.
        seen = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "h", "left_semi")
    anchors = written(with_anchor(windows, written(seen, "leak-counts", small), small), "leak-anchors", small)
    each = tokens.select("row_id", "w", F.posexplode_outer("w").alias("at", "word")).where("word IS NOT NULL").withColumn("h", F.xxhash64("word"))
    start = F.col("at") - F.col("offset")
    if small:
        same, total = F.slice("w", start + 1, F.col("size")), F.size("w")
        met = each.join(F.broadcast(anchors), "h")
    else:
        near = F.slice("w", F.greatest(F.col("at") + 2 - width, F.lit(1)), 2 * width - 1)
        same, total = F.slice("near", F.col("lead") - F.col("offset") + 1, F.col("size")), F.col("n_words")
        each = each.select("row_id", "at", "h", F.size("w").alias("n_words"), near.alias("near"), F.least(F.col("at"), F.lit(width - 1)).alias("lead"))
        met = _salted(each, "row_id").join(_for_each_salt(anchors), ["h", "salt"])
    fits = (start >= 0) & (start + F.col("size") <= total)
    found = met.where(fits).where(F.when(fits, same == F.col("win")))
    return found.select("row_id", start.alias("start"), "size", "window_id")


def _covered(places: Column) -> Column:
    """How many words the spans (start, size), sorted by start, cover."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(so_far: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        return F.struct((so_far["n"] + F.greatest(F.lit(0), end - F.greatest(x["start"], so_far["end"]))).alias("n"), F.greatest(end, so_far["end"]).alias("end"))

    return F.aggregate(places, none, add, lambda so_far: so_far["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or wordless text has no words and no hits. Items with null or wordless
    text have no window; a null item_id is counted as the empty name. Repeated
    rows of ``docs`` are judged each; an empty benchmark hits nothing.
    """
    docs = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_id")).alias("row_id"), "text")
    windows, members = item_windows(benchmark, width)
    # Every hit of a document in one row, at most ``width`` for each of its words; made once, so nothing of the corpus is written.
    places, of = F.array_sort(F.collect_set(F.struct("start", "size"))), F.collect_set("window_id")
    found = occurrences(docs, windows, width).groupBy("row_id").agg(places.alias("places"), of.alias("windows"))
    hits = found.select("row_id", _covered(F.col("places")).alias("n_hit"), F.explode("windows").alias("window_id"))
    joined = hits.join(broadcast_if_small(members), "window_id").groupBy("row_id").agg(F.first("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    counted = docs.select("row_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return counted.join(joined, "row_id", "left").select(
        F.col("row_id.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns as they are.

    Null and empty texts and repeated rows without a hit stay, each as often as
    it is there; an empty benchmark leaves ``docs`` as it is. Columns may have any names.
    """
    columns, row = docs.columns, unused(docs.columns, "row_id")
    named = docs.withColumn(row, F.struct("doc_id", F.xxhash64("text").alias("text_id")))
    windows, _ = item_windows(benchmark, width)
    hit = written(occurrences(named.select(F.col(row).alias("row_id"), "text"), windows, width).select(F.col("row_id").alias(row)).distinct(), "leak-rows")
    return named.join(broadcast_if_small(hit), row, "left_anti").select(*columns)
