"""Registered queries on the driver's tables, against SQL where there is any."""

import collections

import pandas as pd
import pytest

import corpus_pipeline
from tidemark.llm import decontamination, mixing, near, registry, secrets, toxicity
from tidemark.llm.store import table


def rows(frame):
    def text(v):
        if pd.isna(v):
            return "~"
        return str(v) if isinstance(v, str) else f"{float(v):.9g}"

    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, data, name):
    got, want = registry.queries()[name](spark, data).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_ten_operators_and_a_row_for_each_document(spark, data):
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    docs = table(spark, data, "documents")
    for n in ("op2_scan_secrets", "op3_remove_repeats", "op7_mix_sources", "op10_simhash_duplicates"):
        assert names[n](spark, data).select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        assert names[n](spark, data).count() == docs.count()


def test_no_model_sees_the_held_out_rows(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.score(docs, toxicity.learn(docs, x)).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert a.equals(b)


def test_pipeline_is_its_stages_done_by_hand(spark, data):
    docs = table(spark, data, "documents")
    pandas = docs.toPandas().set_index("doc_id")
    model = toxicity.learn(docs, table(spark, data, "labels"))
    left = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["predicted"] == 0}
    found = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs.where(docs["doc_id"].isin(list(left)))).collect()}
    left = {i for i, c in found.items() if i == c}
    bench = table(spark, data, "benchmark")
    left -= {r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect() if r["contaminated"]}
    rest = docs.where(docs["doc_id"].isin(list(left)))
    model = secrets.train(rest)
    clean = {}
    for r in secrets.scan(rest, model).select("doc_id", "spans").collect():
        text, out, at = pandas.text[r["doc_id"]], [], 0
        merged = []
        for s in r["spans"]:
            if merged and s["start"] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s["end"])
            else:
                merged.append([s["start"], s["end"]])
        for a, b in merged:
            out += [text[at:a], "[SECRET]"]
            at = b
        clean[r["doc_id"]] = "".join([*out, text[at:]])
    made = spark.createDataFrame([(i, t, pandas.source[i]) for i, t in clean.items()], "doc_id long, text string, source string")
    got = collections.Counter(map(tuple, corpus_pipeline.run(spark, data).collect()))
    assert got == collections.Counter(map(tuple, mixing.mix(made).collect()))


def test_stages_keep_the_columns(spark, data):
    docs = table(spark, data, "documents").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == table(spark, data, "documents").columns
