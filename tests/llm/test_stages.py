"""Stages and operators on nulls, empty tables, repeated and string ids, and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near, pii, repeats, simhash
from tidemark.llm.store import table

CLASHES = ("row_id", "_row_id", "key", "_key", "spans", "base", "_text", "m_markov", "at_markov", "fp", "band", "w", "word", "h", "size", "score", "row", "_t", "_m")


@pytest.mark.parametrize("k", range(4))
def test_stages_on_clashing_names_and_empty_tables(spark, data, k):
    docs = table(spark, data, "documents").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "b", 0), (99999999, "same text here", None, None, 14), (99999999, "another text there", None, None, 18)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd.withColumn("n_chars", F.col("n_chars").cast(docs.schema["n_chars"].dataType)))
    docs = docs.withColumns({c: F.lit("mine") for c in CLASHES})
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, data)
    assert out.columns == docs.columns and out.where(" OR ".join(f"`{c}` <> 'mine'" for c in CLASHES)).count() == 0
    assert {r["text"] for r in out.where("doc_id = 99999999").collect()} == {"same text here", "another text there"}
    assert stage(spark, docs.where("false"), data).count() == 0


def test_string_ids(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([("b", text), ("a", text), (None, "other words stand here alone in this line"), ("x9", None)], "doc_id string, text string")
    assert sorted(r["doc_id"] or "" for r in near.keep_one(docs).collect()) == ["", "a", "x9"]
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).where("doc_id IS NOT NULL").collect()} == {"b": "a", "a": "a", "x9": "x9"}
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs, 48, gram=16).collect()}
    assert got == {"b": len(text), "a": len(text), None: 0, "x9": 0}


def test_pseudonyms_need_a_key_and_real_area_codes(spark):
    docs = spark.createDataFrame([(1, "000-000-0000 and 1999/12/31, 555-123-4567"), (2, None)], "doc_id long, text string").withColumns({c: F.lit("mine") for c in CLASHES if c != "spans"})
    with pytest.raises(ValueError):
        pii.pseudonymised(docs)
    out = {r["doc_id"]: r for r in pii.pseudonymised(docs, "k").collect()}
    text = docs.first()["text"]
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in out[1]["spans"]] == [("date", "1999/12/31"), ("phone", "555-123-4567")]
    assert out[1]["text"].startswith("000-000-0000 and ") and out[1]["text"][17:27] != "1999/12/31" and out[2]["text"] is None
    assert all(out[1][c] == "mine" for c in CLASHES if c != "spans")
