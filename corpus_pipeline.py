"""The corpus pipeline: reject toxic documents, keep one of each near-duplicate
group, drop benchmark leaks, redact secrets, and mix sources to target weights.

Each stage reads what its predecessor wrote. All but the last return the columns
of ``documents``; the last returns the mix, one row a document with the words it
takes (0: not in the mix).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, mixing, near, secrets, toxicity
from tidemark.llm.store import give_back, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below one half, from a model of the labelled rows of ``docs``; null and empty texts have no evidence and stay."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    # The driver's memory is shared by all stages, and learning takes the most of it.
    model.tagger.forget()
    give_back()
    return toxicity.reject(docs, model)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, Jaccard 0.8 or more; found by SimHash, and by MinHash what that misses); texts without words are one group."""
    return near.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark window occurs; rows without words stay, and an empty benchmark drops nothing."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each span of a secret replaced; n_chars follows the text, and a null text stays null."""
    found = secrets.redact(docs, secrets.train(docs))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row with the words that the mix takes of it; null texts have none, null sources are a source."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", keep_one_copy),
    ("benchmark decontamination", drop_leaks),
    ("secret scan", redact_secrets),
    ("source mix", mix_sources),
]

#: A learned stage has no SQL; tests compare the pipeline with its stages done by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
