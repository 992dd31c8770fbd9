"""Secret scans with character Markov models (SQL functions only).

Fixed patterns give the base spans: assignments, access keys and hex runs. On
top, every maximal run of token characters is scored by two first-order
character models, one of random strings and one of ordinary identifiers; the
log-likelihood ratio of the run's most random stretch decides. Both are counted
from labelled samples: random strings generated from digests of a counter and
base matches of sampled documents; the other words of those documents, the names
and the prose of the libraries that this runs on, and identifiers of usual shapes
made of both. The least ratio that counts is set on labelled strings of the two
kinds that the models never saw. The scan reads every whole text once
and needs no shuffle; offsets come from the lengths of matches and of the gaps
that ``split`` leaves between them.
"""

from __future__ import annotations

import errno
import http
import logging
import math
import os
import re
import signal
import socket
import unittest
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import written

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Characters of tokens, in code point order.
ALPHABET = "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
TOKEN_CLASS = "[A-Za-z0-9+/_=-]"
#: Shortest run that the models judge.
LEAST = 12
#: The threshold is the ratio that this share of the held-out random strings, cut to LEAST characters, miss, or
#: the one that this share of the held-out ordinary strings reach if that is larger.
MISSED_SHARE, FALSE_SHARE = 0.02, 0.002
#: Identifiers that look random but name things; a run is scored without them.
UUID = "(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])"
#: Labelled samples: documents (expected number, chosen by hash of doc_id) and generated strings.
SAMPLE_DOCS = 2_000
SAMPLE_STRINGS = 4_000
LIBRARY_WORDS = 20_000
#: Weight of a character's own frequency in its transitions, in counts.
BACK_OFF = 4.0
_SPAN = "array<struct<start:bigint,no:int,end:bigint>>"


def prefix_sums(lengths: Column, block: int = 128) -> Column:
    """Exclusive running sums of an array of long, in blocks so that long arrays stay cheap."""
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, block))
    zero = F.array(F.lit(0).cast("long"))

    def run(head: Column, xs: Column) -> Column:
        return F.aggregate(xs, head, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    heads = run(zero, F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)))
    summed = F.transform(blocks, lambda x, b: F.slice(run(F.array(F.element_at(heads, b + 1)), x), 1, F.size(x)))
    return F.when(n > 0, F.flatten(summed)).otherwise(F.array().cast("array<bigint>"))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _located(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds ``at_<name>``: the start of each entry of the column ``m_<name>``."""
    m, gap, length, head = f"m_{name}", f"_g_{name}", f"_l_{name}", f"_p_{name}"
    some = F.size(m) > 0
    df = df.withColumn(gap, F.when(some, F.transform(F.split("_text", pattern, -1), lambda x: F.length(x).cast("long"))))
    df = df.withColumn(length, F.when(some, F.zip_with(F.slice(gap, 1, F.size(m)), F.col(m), lambda g, x: g + F.length(x))))
    df = df.withColumn(head, F.when(some, prefix_sums(F.col(length))))
    at = F.zip_with(F.col(head), F.slice(gap, 1, F.size(m)), lambda p, g: p + g)
    return df.withColumn(f"at_{name}", F.when(some, at).otherwise(F.array().cast("array<bigint>"))).drop(gap, length, head)


def _spans(name: str, keep: Column | None = None) -> Column:
    """Spans (start, kind number, end) of the matches in ``m_<name>``; ``keep`` is an array of booleans."""
    spans = F.zip_with(
        F.col(f"at_{name}"),
        F.col(f"m_{name}"),
        lambda s, x: F.struct(s.alias("start"), F.lit(KINDS.index(name)).alias("no"), (s + F.length(x)).alias("end")),
    )
    if keep is not None:
        spans = F.filter(F.zip_with(spans, keep, lambda s, k: F.when(k, s)), lambda s: s.isNotNull())
    return spans.cast(_SPAN)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text`` (null: empty) and ``base``: spans by start, then kind."""
    df = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        df = _located(df.withColumn(f"m_{name}", _all(F.col("_text"), pattern)), name, pattern)
    # A value is the end of its match, so its length tells whether the match holds.
    values = F.when(F.size("m_assign") > 0, F.transform(_all(F.col("_text"), ASSIGN, 2), lambda v: F.length(v) >= ASSIGN_LEAST)).otherwise(F.array().cast("array<boolean>"))
    base = F.array_sort(F.concat(_spans("assign", values), _spans("access"), _spans("hex")))
    return df.withColumn("base", base).drop(*[f"{p}_{k}" for p in ("m", "at") for k in KINDS[:3]])


def _bigrams(tokens: DataFrame) -> DataFrame:
    """label, pair, n from label, token, n."""
    tokens = tokens.where(F.length("token") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))
    return tokens.select("label", "n", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    weights: list[float]  # log-ratio of transition probabilities, random over ordinary, row by row of ALPHABET
    threshold: float


def random_strings(numbers: DataFrame, seed: str) -> DataFrame:
    """token: strings as keys and tokens have them, made from digests of ``id``."""
    i = F.concat(F.lit(seed), F.col("id").cast("string"))
    digest = F.sha2(i, 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "\\s", "")
    alnum = F.regexp_replace(base64, "[^A-Za-z0-9]", "")
    made = [base64, alnum, F.translate(base64, "+/=", "-_"), F.lower(alnum), F.md5(i), F.translate(F.upper(F.substring(digest, 1, 20)), "0123456789", "QRSTUVWXYZ")]
    return numbers.select("id", F.explode(F.array(*made)).alias("token"))


def identifiers(words: Column) -> Column:
    """Each three consecutive words joined in one of eight usual shapes, which take turns."""
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))

    def joined(i: Column) -> Column:
        three = [F.lower(F.get(words, 3 * i + j)) for j in range(3)]
        number = F.pmod(F.xxhash64(three[0]), F.lit(1_000)).cast("string")
        shapes = [
            F.concat_ws("_", *three),
            F.upper(F.concat_ws("_", *three)),
            F.concat(three[0], *map(capital, three[1:])),
            F.concat(*map(capital, three)),
            F.concat_ws("-", *three),
            F.concat_ws("/", F.lit(""), *three),
            F.concat_ws("_", three[0], three[1], number),
            F.concat(capital(three[0]), capital(three[1]), number),
        ]
        return F.element_at(F.array(*shapes), (F.pmod(i, F.lit(len(shapes))) + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(words) / 3).cast("int"), F.lit(1)) - 1), joined)


def library_sample(most_words: int = LIBRARY_WORDS) -> tuple[list[str], list[str]]:
    """(names, words of the descriptions) of libraries that are always there: ordinary identifiers and prose."""
    sources = [F, os, socket, errno, signal, logging, unittest.TestCase, http.HTTPStatus]
    names = sorted({n for m in sources for n in dir(m) if not n.startswith("_")})
    prose = " ".join(getattr(F, n).__doc__ or "" for n in sorted(dir(F)) if not n.startswith("_") and callable(getattr(F, n)))
    return names, re.findall("(?<![A-Za-z0-9_])[A-Za-z][a-z]+(?![A-Za-z0-9_])", prose)[:most_words]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS) -> Model:
    """The model of the two kinds of strings, counted and held against samples of bounded size.

    Three quarters of the sampled documents (about ``sample_docs``, chosen by a
    hash of doc_id) are counted, the others and strings from other digests set
    the threshold. What reaches the driver is one count for each label and pair
    of characters, and two ratios.
    """
    spark = docs.sparkSession
    total = max(1, docs.count())
    part = min(1.0, sample_docs / total)
    buckets = 1 << 20
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("secrets")), F.lit(buckets))
    drawn = docs.where(spot < int(part * buckets)) if part < 1 else docs
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " ")
    found = drawn.select(
        (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("secrets held out")), F.lit(4)) == 0).alias("held"),
        F.concat(_all(text, HEX), _all(text, ACCESS), F.filter(_all(text, ASSIGN, 2), lambda v: F.length(v) >= LEAST)).alias("random"),
        # Runs with a digit or mixed letters that could be judged are no sure examples of ordinary ones.
        _all(plain, f"(?<!{TOKEN_CLASS}){TOKEN_CLASS}{{2,{LEAST - 1}}}(?!{TOKEN_CLASS})").alias("short"),
        _all(plain, "(?<![A-Za-z0-9])[A-Za-z]?[a-z]{1,30}(?![A-Za-z0-9])").alias("words"),
    )
    names, words = library_sample()
    none = F.array().cast("array<string>")
    library = spark.createDataFrame([(False, [], names, words)], "held boolean, random array<string>, short array<string>, words array<string>")
    made_of = F.concat("short", "words", F.when(F.size("words") >= 3, identifiers(F.col("words"))).otherwise(none))
    labelled = found.unionByName(library).select("held", F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("random").alias("t")), F.struct(F.lit(0).alias("label"), made_of.alias("t")))).alias("x"))
    labelled = labelled.select("held", "x.label", F.explode("x.t").alias("token")).groupBy("held", "label", "token").agg(F.count(F.lit(1)).alias("n"))
    once = lambda df, label, held: df.select(F.lit(held).alias("held"), F.lit(label).alias("label"), "token", F.lit(1).cast("long").alias("n"))
    numbers = spark.range(sample_strings)
    labelled = written(
        labelled.unionByName(once(random_strings(numbers, "random "), 1, False))
        .unionByName(once(random_strings(numbers, "held out ").withColumn("token", F.substring("token", 1, LEAST)), 1, True))
        .unionByName(once(dates(numbers), 0, False)),
        "secret-samples",
    )
    weights = _weights({(r["label"], r["pair"]): r["n"] for r in _bigrams(labelled.where(~F.col("held")).drop("held")).collect()})
    judged = labelled.where(F.col("held") & (F.length("token") >= LEAST)).withColumn("score", ratio(F.col("token"), weights))
    edges = judged.agg(
        F.percentile(F.when(F.col("label") == 0, F.col("score")), 1 - FALSE_SHARE, F.col("n")).alias("ordinary"),
        F.percentile(F.when(F.col("label") == 1, F.col("score")), MISSED_SHARE, F.col("n")).alias("random"),
    ).first()
    return Model(weights, max(edges["ordinary"] or 0.0, edges["random"]))


def dates(numbers: DataFrame) -> DataFrame:
    """token: days, times and numbers as they are written."""
    day = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 37 % 20_000).cast("int"))
    forms = [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyyMMdd"), F.date_format(day, "yyyy/MM/dd"), (F.pmod(F.xxhash64("id"), F.lit(10_000_000))).cast("string")]
    return numbers.select(F.explode(F.array(*forms)).alias("token"))


def _weights(counts: dict[tuple[int, str], int]) -> list[float]:
    logs = []
    for label in (1, 0):
        row = {a: sum(counts.get((label, a + b), 0) for b in ALPHABET) for a in ALPHABET}
        column = {b: sum(counts.get((label, a + b), 0) for a in ALPHABET) for b in ALPHABET}
        total = sum(column.values())
        # Transitions rarely seen fall back on how often the second character is seen at all.
        alone = {b: (column[b] + 0.5) / (total + 0.5 * len(ALPHABET)) for b in ALPHABET}
        logs.append([math.log((counts.get((label, a + b), 0) + BACK_OFF * alone[b]) / (row[a] + BACK_OFF)) for a in ALPHABET for b in ALPHABET])
    return [p - q for p, q in zip(*logs, strict=True)]


def ratio(token: Column, weights: list[float]) -> Column:
    """Log-likelihood ratio (random over ordinary) of the stretch of a token that has the largest."""
    table = F.split(F.lit(" ".join(f"{x:.6f}" for x in weights)), " ").cast("array<double>")
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.position(c, F.lit(ALPHABET)))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: F.element_at(table, (a - 1) * len(ALPHABET) + b))
    zero = F.struct(F.lit(0.0).alias("here"), F.lit(0.0).alias("best"))

    def longer(s: Column, x: Column) -> Column:
        here = F.greatest(s["here"] + x, F.lit(0.0))
        return F.struct(here.alias("here"), F.greatest(s["best"], here).alias("best"))

    return F.aggregate(pairs, zero, longer, lambda s: s["best"])


def scan(docs: DataFrame, model: Model, threshold: float | None = None, least: int = LEAST) -> DataFrame:
    """``docs`` (text and any other columns but base and spans) with ``base`` and ``spans``.

    Both are arrays of (start, no, end) by start, then kind; ``no`` numbers
    KINDS, offsets are code points, end exclusive. Null text is empty text;
    repeated rows are scanned each; an empty table gives no rows. A judged run
    inside a base span is left to it; one that reaches beyond is a span of its own.
    """
    threshold = model.threshold if threshold is None else threshold
    pattern = f"(?<!{TOKEN_CLASS}){TOKEN_CLASS}{{{least},}}"
    df = base_spans(docs)
    df = _located(df.withColumn("m_markov", _all(F.col("_text"), pattern)), "markov", pattern)
    likely = F.transform("m_markov", lambda t: ratio(F.regexp_replace(t, UUID, ""), model.weights) >= threshold)
    df = df.withColumn("_found", F.when(F.size("m_markov") > 0, _spans("markov", likely)).otherwise(F.array().cast(_SPAN)))
    free = F.filter("_found", lambda r: ~F.exists("base", lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))
    return df.withColumn("spans", F.array_sort(F.concat("base", free))).drop("_found", "m_markov", "at_markov")


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["no"] + 1), s["start"], s["end"])))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for every row of ``docs``.

    Repeated rows are scanned each; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    found = scan(docs, train(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["no"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), count("markov"))


def redact(docs: DataFrame, model: Model, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``, all other columns as they are.

    Spans that meet are one. A null text stays null; repeated rows are redacted
    each; an empty table gives no rows. Columns may have any names: only the
    text itself goes through the scan, next to a struct of all columns.
    """
    found = scan(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), model)
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def join(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        meets = F.coalesce(last["end"] >= s["start"], F.lit(False))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.array_append(acc, F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    found = found.withColumn("_cut", F.when(F.size("spans") > 0, F.aggregate("spans", empty, join)))
    tails = F.concat(F.transform(F.slice("_cut", 2, F.size("_cut")), lambda s: s["start"]), F.array(F.length("_text").cast("bigint")))
    pieces = F.zip_with("_cut", tails, lambda s, to: F.concat(F.lit(mark), F.substring(F.col("_text"), (s["end"] + 1).cast("int"), (to - s["end"]).cast("int"))))
    head = F.substring(F.col("_text"), F.lit(1), F.element_at("_cut", 1)["start"].cast("int"))
    clean = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.concat(head, F.concat_ws("", pieces)))
    return found.select(*[clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
