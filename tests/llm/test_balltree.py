"""Ball-tree search in cases that are hard on numbers, ids and skew."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import balltree


def wrapped(x):
    return (x + 2**63) % 2**64 - 2**63


@pytest.mark.parametrize("most", [3, 1 << 20, 1 << 31, 1 << 45, (1 << 63) - 1])
@pytest.mark.parametrize("dim", [1, 3, 64])
def test_products_are_exact_at_every_size(most, dim):
    r = random.Random(most + dim)
    q, c = ([[r.choice([0, most, -most, r.randint(-most, most)]) for _ in range(dim)] for _ in range(7)] for _ in range(2))
    got = balltree.products(balltree.limbs(np.array(q)), balltree.limbs(np.array(c)), balltree.limb_bits(dim))
    assert got.tolist() == [[wrapped(sum(a * b for a, b in zip(x, y, strict=True))) for y in c] for x in q]


@pytest.mark.parametrize("most", [40, 1 << 40, 1 << 62])
def test_tree_against_all_products(most):
    r = random.Random(most)
    vectors = np.array([[r.randint(-most, most) for _ in range(4)] for _ in range(500)] + [[7, 7, 7, 7]] * 40)
    ids = np.arange(len(vectors)) * 3 - 50
    tree = balltree.BallTree.load(balltree.BallTree(ids, vectors, 16).dump())
    at, found, scores = tree.search(ids[:30], vectors[:30], 5, np.full(30, -np.inf))
    for row in range(30):
        every = sorted((-wrapped(sum(int(a) * int(b) for a, b in zip(vectors[row], v, strict=True))), int(i)) for i, v in zip(ids, vectors, strict=True) if i != ids[row])[:5]
        assert sorted(zip((-scores[at == row]).tolist(), found[at == row].tolist(), strict=True)) == every


def test_repeated_ids_and_hot_rows_and_few_candidates(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randint(-9, 9)) for _ in range(3)]) for i in range(60)]
    rows += [(20, [1.0, 2.0, 3.0]), (7, [9.0, 9.0, 9.0]), (40, rows[40][1])] + [(5, [2.0, 2.0, 2.0])] * 30 + [(300 + i, [1.0, 1.0, 1.0]) for i in range(40)] + [(100, [1.0, 2.0]), (101, [4.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = collections.Counter(tuple(x) for x in balltree.top_k(df, df.where("vec_id % 20 = 0"), k=4, shard_rows=8, query_rows=2, clusters=6).collect())
    distinct, want = sorted({(i, tuple(v)) for i, v in rows}), collections.Counter()
    for i, v in distinct:
        if i % 20 == 0:
            found = sorted((-int(sum(a * b for a, b in zip(v, w, strict=True))), j) for j, w in distinct if j != i and len(w) == len(v))[:4]
            want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(found))
    assert got == want


def test_queries_go_only_where_their_best_can_be(spark):
    """Vectors in far groups: the trees that hold a query's best are found, and known scores keep it from all others."""
    r = random.Random(4)
    rows = [(g * 1_000 + i, [float(1_000 * (g == j) + r.randint(0, 5)) for j in range(8)]) for g in range(8) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    assert balltree.top_k(df, df.where("vec_id % 100 = 0"), k=3, shard_rows=60, clusters=8).where("query_id DIV 1000 <> vec_id DIV 1000").count() == 0
    asked = df.select("vec_id", F.transform("v", lambda x: x.cast("long")).alias("v")).toPandas()
    asked["asked"], asked["floor"] = asked["vec_id"], 900_000.0
    centres = {8: np.array([[1_000.0 * (g == j) + 2 for j in range(8)] for g in range(8)])}
    sent = list(balltree._sent([asked], centres=centres, radii={8: (np.full(8, 20.0), np.full(8, 1_100.0))}, wave=(0, 8)))
    assert sum(map(len, sent)) == len(asked)
