"""Toxicity: a linear-chain CRF tags toxic words, its marginals make document scores.

Labels are of documents, so words are labelled from them: a word of a toxic
document is toxic if more of the sampled documents that have the word, or its
beginning, are toxic than chance would allow. The CRF learns these labels from
words, beginnings and shape, with transitions. Forward-backward gives each word's
probability; a logistic curve, fitted on the same rows, turns the strongest
word and the expected number of toxic words into the document's score.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import crf
from tidemark.llm.sampling import labelled_sample

WORD = re.compile(r"\w+")
#: Learning: labelled documents of each class (expected number at most), their longest text, words in a piece.
TOXIC_DOCS, CLEAN_DOCS = 600, 2_000
LONGEST = 20_000
PIECE = 200
#: A word or beginning marks toxic words if it is in MIN_DOCS toxic documents, MIN_RATIO times more often
#: than in clean ones, and that has at most this chance (binomial tail), were it independent of the label.
CHANCE = 1e-6
#: Letters of the beginnings that are features of longer words.
BEGINNINGS = (4, 5, 6, 7)
MIN_DOCS = 4
MIN_RATIO = 12.0
FOLDS = 5
#: Texts of the sample that are judged at once.
SLICE = 128


def features(word: str) -> list[str]:
    """Any word (the prior of words never seen), the word, its beginnings, and whether it is all letters."""
    out = ["any", "w:" + word]
    if len(word) > 4:
        out += [f"{n}:{word[:n]}" for n in BEGINNINGS if n < len(word)]
    if not word.isalpha():
        out.append("k:mixed")
    return out


def evident(word: str) -> list[str]:
    """The features that can mark a word: itself and its beginnings."""
    return [f for f in features(word)[1:] if f != "k:mixed"]


@dataclass
class Model:
    tagger: crf.Crf
    curve: np.ndarray  # weights of 1, the strongest word's log-odds, log of 1 + expected toxic words

    def judge(self, texts: list[str]) -> list[tuple[float, np.ndarray]]:
        """The score of each text and the probability of each of its words (WORD.finditer order)."""
        words = [WORD.findall(t.lower()) for t in texts]
        found = self.tagger.marginals(words)
        return [(float(1 / (1 + np.exp(-np.clip(self.curve @ evidence(m), -30, 30)))), m[:, 1]) for m in found]

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int]]:
        """(start, end) of maximal runs of words whose probability is ``least`` or more."""
        _, p = self.judge([text])[0]
        out: list[tuple[int, int]] = []
        before = False
        # Lower-casing may change a text's length, so offsets come from the text as it is.
        for m, x in zip(WORD.finditer(text), p, strict=False):
            if x >= least:
                out.append((out.pop()[0], m.end()) if before else (m.start(), m.end()))
            before = x >= least
        return out


def evidence(marginal: np.ndarray) -> np.ndarray:
    """What a document's score is made of; a text without words has no evidence at all."""
    p = marginal[:, 1] if len(marginal) else np.zeros(0)
    top = min(max(float(p.max()) if len(p) else 0.0, 1e-6), 1 - 1e-6)
    return np.array([1.0, np.log(top / (1 - top)), np.log1p(float(p[p >= 0.5].sum()))])


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A model from labelled texts; without toxic ones every score is the prior's."""
    # Equal words share one string, which keeps the sample small in the driver.
    words = [list(map(sys.intern, WORD.findall((t or "").lower()))) for t in texts]
    seen = {0: Counter(), 1: Counter()}
    for w, y in zip(words, toxic, strict=True):
        seen[y].update({f for v in set(w) for f in evident(v)})
    n = {y: max(1, sum(1 for t in toxic if t == y)) for y in (0, 1)}
    share = n[1] / (n[0] + n[1])
    marked = {f for f, c in seen[1].items() if c >= MIN_DOCS and c / n[1] >= MIN_RATIO * (seen[0][f] + 0.5) / n[0] and _tail(c, seen[0][f], share) <= CHANCE}
    # A beginning speaks for words that no clean document has; the others speak for themselves.
    bad = {v for w, y in zip(words, toxic, strict=True) if y for v in set(w) if ("w:" + v in marked) or (not seen[0]["w:" + v] and not marked.isdisjoint(evident(v)))}
    del seen  # the driver holds these counts no longer than it must
    cuts = [p for w, y in zip(words, toxic, strict=True) for p in crf.cut(w, [int(y == 1 and v in bad) for v in w], PIECE)]
    tagged, plain = [p for p in cuts if any(p[1])], [p for p in cuts if not any(p[1])]
    # Of the pieces without a toxic word those that have a word like one, and as many others, evenly spread, as there
    # are pieces with a toxic word (some if there is none).
    like = [any(not marked.isdisjoint(evident(v)) for v in x) for x, _ in plain]
    others = [p for p, near in zip(plain, like, strict=True) if not near]
    plain = [p for p, near in zip(plain, like, strict=True) if near] + others[:: max(1, len(others) // max(200, len(tagged)))]
    tagger = crf.train([x for x, _ in tagged + plain], [z for _, z in tagged + plain], [0, 1], features, least=MIN_DOCS)
    found = [evidence(m) for at in range(0, len(words), SLICE) for m in tagger.marginals(words[at : at + SLICE])]
    seen_evidence = np.array(found).reshape(-1, 3)
    return Model(tagger, _logistic(seen_evidence, np.array(toxic, float)))


def _tail(toxic: int, clean: int, share: float) -> float:
    """Chance that ``toxic`` or more of the word's documents are toxic."""
    n = toxic + clean
    if toxic <= share * n:
        return 1.0
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)) for k in range(toxic, n + 1))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps on the regularised likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (y - p) - l2 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def remainder(column: str = "doc_id", folds: int = FOLDS):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def learn(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, longest: int = LONGEST) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    The sample has about ``toxic_docs`` and ``clean_docs`` documents, none longer
    than ``longest`` characters; a document labelled twice is toxic if once labelled so.
    """
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(remainder() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labelled_sample(known, "toxic", {1: toxic_docs, 0: clean_docs}, "toxicity")
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= longest))
    # The sample is bounded by its parameters, so its ids may be broadcast.
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def _judged(batches, model):
    for batch in batches:
        for part in crf.slices(batch):
            found = model.judge([x.as_py() or "" for x in part.column("text")])
            n = [int((p >= 0.5).sum()) for _, p in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array(n, pa.int64())], ["doc_id", "score", "n_toxic_words"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic_words for each row of ``docs``.

    Null text is empty text, whose score is the curve's value without evidence;
    repeated rows are scored each; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(partial(_judged, model=model), f"doc_id {kind}, score double, n_toxic_words long")
    return rows.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_words")


def _clean(batches, model):
    for batch in batches:
        for part in crf.slices(batch):
            found = model.judge([x.as_py() or "" for x in part.column("text")])
            yield part.filter(pa.array([s < 0.5 for s, _ in found]))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, all columns as they are.

    Null and empty texts have the score of no evidence; repeated rows are judged
    each; an empty table gives no rows. Columns may have any names.
    """
    return docs.mapInArrow(partial(_clean, model=model), docs.schema)


def _spanned(batches, model):
    for batch in batches:
        texts = [x.as_py() or "" for x in batch.column("text")]
        spans = [[{"start": a, "end": b} for a, b in model.spans(t)] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])


def offending(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the offsets (code points, end exclusive) of toxic spans, a row for each row of ``docs``.

    Null and empty texts have no spans; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_spanned, model=model), f"doc_id {kind}, spans array<struct<start:bigint,end:bigint>>")
