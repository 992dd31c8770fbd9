"""The pipeline's near-duplicates against brute force over all pairs."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components, near, toxicity
from tidemark.llm.store import written


def replaced(words, n, r):
    out = list(words)
    for i in r.sample(range(len(words)), n):
        out[i] = f"new{r.random()}"
    return " ".join(out)


def made(seed=4):
    r = random.Random(seed)
    out = ["", None, " .", "one two", "One  two", "one two three"]
    for n in (30, 100, 400):
        for g in range(6):
            base = [f"w{n}-{g}-{i}" for i in range(n)]
            out += [" ".join(base), *[replaced(base, max(1, int(n * x)), r) for x in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06)]]
    return out


def similar(a, b):
    a, b = (set(near.shingles(x).tolist()) for x in (a, b))
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_stage_keeps_one_of_each_group_of_similar_texts(spark):
    texts = made()
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if root[i] != root[j] and similar(a, b):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    docs = spark.createDataFrame([(None if i == 0 else i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s")], "doc_id long, text string, source string")
    kept = corpus_pipeline.keep_one_copy(spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(set(root))
    assert near.keep_one(docs.where("false")).count() == 0


def test_sketches_and_bands_of_similar_sets():
    r = random.Random(5)
    apart, missed = [], 0
    for g in range(200):
        base = [f"v{g}-{i}" for i in range(200)]
        a, b = near._print(" ".join(base)), near._print(replaced(base, 4, r))
        missed += not set(a["bands"]) & set(b["bands"])
        apart.append(sum(((a[k] ^ b[k]) & (2**64 - 1)).bit_count() for k in ("low", "high")))
    assert missed == 0 and max(apart) <= near.APART and 7 < sum(apart) / len(apart) < 17


def test_simhash_search_brings_its_links_to_verification(spark):
    """Near copies within three bits reach verification by the SimHash search alone, and unlike ones do not link."""
    r = random.Random(6)
    base = [f"s{i}" for i in range(2000)]
    texts = [" ".join(base), replaced(base, 1, r), " ".join(f"t{i}" for i in range(2000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    firsts = docs.mapInArrow(near._prints, f"doc_id long, {near._PRINT}").withColumnRenamed("doc_id", "first_id")
    prints = [near._print(t) for t in texts]
    assert ((prints[0]["simhash"] ^ prints[1]["simhash"]) & (2**64 - 1)).bit_count() <= 3
    assert {frozenset((x["a"]["fp"], x["b"]["fp"])) for x in near._by_simhash(firsts).collect()} == {frozenset(p["fp"] for p in prints[:2])}
    # Without any key in common the link is still found.
    apart = firsts.withColumn("bands", F.array(F.col("fp")))
    assert [{x["u"], x["v"]} for x in near.links(apart, docs).collect()] == [{p["fp"] for p in prints[:2]}]


def test_least_elements_leave_no_similar_pair_out(spark):
    """Sets on both sides of LEAST elements: all similar pairs pass, dissimilar ones of few elements do not."""
    r = random.Random(7)
    rows, want, close = [], {}, {}
    for g in range(120):
        n = (60, 250, 300, 1500)[g % 4]
        base = [f"x{g}-{i}" for i in range(n)]
        a, b = near.shingles(" ".join(base)), near.shingles(replaced(base, max(1, round(n * (0.012, 0.02, 0.04)[g % 3])), r))
        rows.append((g, [x.view("int64").tolist() for x in (a, b)]))
        want[g] = 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)), max(len(a), len(b)) <= near.LEAST
        close[g] = 9 * (len(set(a) & set(b)) + 1) >= 4 * (len(a) + len(b))
    df = spark.createDataFrame(rows, "g int, s array<array<long>>")
    a, b = (F.struct(F.size(F.col("s")[i]).alias("size"), near._least(F.col("s")[i]).alias("least")) for i in (0, 1))
    got = {x["g"]: x["may"] for x in df.select("g", near._look(a, b).alias("may")).collect()}
    assert all(got[g] for g, (similar_, _) in want.items() if similar_)
    assert not any(got[g] for g, (similar_, whole) in want.items() if whole and not similar_ and not close[g])
    assert len({x for x in want.values()}) == 4


def test_written_tables_leave_no_shuffle_files(spark):
    """What a table was shuffled through goes with its query, not when the driver collects its garbage."""
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for d in folders for p in Path(d).rglob("shuffle_*")}
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_to = spark.conf.get(name, None)
    made_of = spark.range(50_000).select((F.col("id") % 1000).alias("k"), F.xxhash64("id").alias("h"))
    assert written(made_of.join(made_of.groupBy("k").agg(F.min("h").alias("least")), "k"), "test-written").count() == 50_000
    assert spark.conf.get(name, None) == set_to
    late = time.time() + 20
    # Deleted in the background; the count's own file holds a number for each task.
    while (left := {p for p in files() - before if p.exists() and p.stat().st_size > 1000}) and time.time() < late:
        time.sleep(0.2)
    assert not left


def test_components_of_edges_that_fit_a_task_take_no_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components, "written", lambda df, name: (made.append(name), written(df, name))[1])
    path = [(i, i + 1) for i in range(200)] + [(300, 301), (5, 5)]
    edges = spark.createDataFrame(path, "u long, v long").repartition(7)
    whole = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert whole == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}
    assert len(made) == 2
    # Tasks of 20 edges each: rounds join what they made.
    monkeypatch.setattr(components, "EDGES", 20)
    got = components.components(edges).collect()
    assert len(got) == len(whole) and {r["node"]: r["root"] for r in got} == whole


def test_driver_keeps_no_memory_of_the_sample(spark, monkeypatch):
    d, models = "/root/testdata/sf0.001", []
    learn = toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda *a: (models.append(learn(*a)), models[0])[1])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.reject_toxic(spark, docs, d)
    assert models[0].tagger._seen is None and models[0].tagger._rows is None
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in toxicity.reject(docs, models[0]).collect())
