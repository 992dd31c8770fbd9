"""Words of decontamination against their pattern, and clashing names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination
from tidemark.llm.store import is_small, unused

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def test_words_are_what_the_pattern_finds(spark):
    r = random.Random(6)
    alphabet = "aZ09 .,-\t\n\x00\x1f/:@[`{\x7f\x80\xa0éÉßİΣςⅣⅳⒶⓐǅ😀𐐀中' "
    texts = [None, "", " ", "A", "É É", "a.b", *["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(400)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {x["id"]: x["w"] for x in df.select("id", decontamination.words(F.col("text")).alias("w")).collect()}
    assert got == {i: WORD.findall((t or "").translate(LOWER)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("rows", [200_000, 0])
def test_common_words_and_clashing_names(spark, monkeypatch, rows):
    """A benchmark whose words are all over the corpus, in both ways to join."""
    monkeypatch.setattr(decontamination.occurrences, "__defaults__", (decontamination.WIDTH, rows))
    item = "the of the of the of the of the of the"
    texts = [item, "the of " * 40, "of the", None, "", "The OF the, of the of the of the of THE!", "the of the of"]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, row_id int, _row_id int, word int")
    bench = spark.createDataFrame([("b", item), ("a", "the of"), ("none", None)], "item_id string, text string")
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontamination.decontaminate(docs, bench).collect()}
    assert got == {0: (11, 11, 2), 1: (80, 80, 2), 2: (2, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (11, 11, 2), 6: (4, 4, 1), 7: (11, 11, 2)}


def test_small_tables_are_counted_in_rows_and_bytes(spark):
    df = spark.range(10).withColumn("x", F.lit("y" * 100))
    assert is_small(df) and not is_small(df, 9) and not is_small(df, most_bytes=1_000) and is_small(df.where("false"), 0)
    assert unused(["a", "_A"], "a") == "__a"


def test_crowded_anchors_do_not_deal_texts_out_again(spark, monkeypatch):
    """Parts of crowded anchors come from the texts where they are, and give the same rows as one round."""
    import random

    from tidemark.llm import repeats

    r = random.Random(8)
    line = "".join(r.choice("abcdefgh ") for _ in range(60))
    texts = ["".join(r.choice("xyz ") for _ in range(r.randrange(90))) + line + r.choice(("tail one here and more of it", "")) + "".join(r.choice("uvw ") for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:7] + [None])], "doc_id long, text string")
    plans, keep = {}, repeats.written

    def spied(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(repeats, "written", spied)
    rows = lambda **limits: sorted(map(tuple, repeats.remove_repeats(docs, 48, gram=16, **limits).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    want = rows()
    assert "repeat-parts" not in plans
    assert rows(hot=3) == want and any(x[2] for x in want)
    assert plans["repeat-parts"] and not any("Exchange" in p for p in plans["repeat-parts"])


def test_small_tables_make_few_files_and_hits_none(spark, monkeypatch):
    """Each file costs processes that begin with the executor's memory; 64 shuffle partitions give no more of them than cores."""
    rows, keep = {}, decontamination.written

    def spied(df, name, *few, **named):
        out = keep(df, name, *few, **named)
        rows[name] = (len(out.inputFiles()), out.count())
        return out

    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    monkeypatch.setattr(decontamination, "written", spied)
    item = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame([(i, f"before {item} after") for i in range(40)] + [(40, "clean"), (41, None)], "doc_id long, text string").repartition(20)
    bench = spark.createDataFrame([("a", item), ("b", "word5 word6"), ("c", "not there")], "item_id string, text string")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontamination.decontaminate(docs, bench).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: (302, 300, 2) for i in range(40)} | {40: (1, 0, 0), 41: (0, 0, 0)}
    assert max(n for n, _ in rows.values()) <= spark.sparkContext.defaultParallelism and "leak-hits" not in rows
    assert max(n for _, n in rows.values()) >= 290


def test_covered_words_of_spans_that_overlap_touch_or_repeat(spark):
    spans = [[], [(0, 10)], [(0, 2), (1, 10), (3, 2), (11, 1)], [(5, 3), (8, 2), (20, 1), (20, 4)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(spans)], "id int, x array<struct<start:int,size:int>>")
    got = {r["id"]: r["n"] for r in df.select("id", decontamination._covered(F.col("x")).alias("n")).collect()}
    assert got == {i: len({p for a, n in x for p in range(a, a + n)}) for i, x in enumerate(spans)}
