"""Language identification: a linear-chain CRF labels the words of code-switched text.

A word's features are its affixes, its character trigrams and, for frequent
words, the word itself (the lexicon is what the sample holds). Transitions are
learned from sequences in which pieces of documents in different languages
follow each other, as they do in code-switched text. Forward-backward gives
each word's probabilities; a document's language is the one with the largest
sum over its words, weighted by their letters.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import crf
from tidemark.llm.sampling import labelled_sample
from tidemark.llm.toxicity import remainder

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
#: Learning: documents of each language and of all (expected numbers at most, though one of each language at
#: least), characters of a document (a longer one gives a stretch of it), words in a piece.
PER_LANG = 250
SAMPLE_DOCS = 50_000
LONGEST = 20_000
PIECE = 60
#: Words of a document used for learning, at most: evenly spread pieces of it.
TRAIN_WORDS = 240


def features(word: str) -> list[str]:
    """The word, prefixes and suffixes of up to three letters, and trigrams (all with the word's edges marked)."""
    w = f"^{word}$"
    return [w, w[:2], w[:3], w[:4], w[-2:], w[-3:], w[-4:], *[w[i : i + 3] for i in range(len(w) - 2)]]


@dataclass
class Model:
    tagger: crf.Crf

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share of the letters it is given) of each text; ``und`` without letters."""
        words = [WORD.findall((t or "").lower()) for t in texts]
        out = []
        for ws, m in zip(words, self.tagger.marginals(words), strict=True):
            if not ws or not self.tagger.labels:
                out.append((UNKNOWN, 0.0))
                continue
            letters = np.fromiter(map(len, ws), np.float64, len(ws))
            share = letters @ m / letters.sum()
            best = int(np.argmax(share))
            out.append((self.tagger.labels[best], float(min(1.0, max(0.0, share[best])))))
        return out

    def tags(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, probability) of each word of a text."""
        found = list(WORD.finditer(text))
        m = self.tagger.marginals([[x.group().lower() for x in found]])[0]
        return [(x.start(), x.end(), self.tagger.labels[int(p.argmax())], float(p.max())) for x, p in zip(found, m, strict=True)]


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Model:
    """A model from labelled texts. Ties and order do not depend on the rows' order given sorted rows."""
    labels = sorted(set(langs))
    draw = random.Random(seed)
    pieces: list[tuple[list[str], int]] = []
    for text, lang in zip(texts, langs, strict=True):
        words = WORD.findall(text.lower())
        cuts = [x for x, _ in crf.cut(words, words, PIECE)]
        step = max(1, -(-len(cuts) * PIECE // TRAIN_WORDS))
        pieces += [(x, labels.index(lang)) for x in cuts[::step]]
    draw.shuffle(pieces)
    # Two or three pieces, often of different languages, make one sequence.
    sequences, tags, at = [], [], 0
    while at < len(pieces):
        group = pieces[at : at + draw.choice((1, 2, 3))]
        at += len(group)
        sequences.append([w for x, _ in group for w in x])
        tags.append([y for x, y in group for _ in x])
    return Model(crf.train(sequences, tags, labels, features, rounds=40, rate=0.2, least=3))


def learn(docs: DataFrame, per_lang: int = PER_LANG, sample_docs: int = SAMPLE_DOCS, longest: int = LONGEST) -> Model:
    """Fit on a bounded sample: about ``per_lang`` documents of every language, fewer if those are over ``sample_docs``.

    Of a document longer than ``longest`` characters, a stretch of so many from
    a place chosen by a hash of the text is used.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(folds=FOLDS) != HELD_OUT))
    langs = [r[0] for r in known.select("lang").distinct().collect()]
    if not langs:
        return fit([], [])
    wanted = max(1, min(per_lang, sample_docs // len(langs)))
    rows = labelled_sample(known, "lang", {x: wanted for x in langs}, "langid")
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - longest + 1, F.lit(1))) + 1
    rows = rows.select("doc_id", "lang", F.substring(F.col("text"), start.cast("int"), F.lit(longest)).alias("text")).collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def _judged(batches, model):
    for batch in batches:
        # A label is a number for each word, so the more there are, the fewer bytes go together.
        for part in crf.slices(batch, most_bytes=max(1 << 16, 4 * crf.SLICE_BYTES // max(4, len(model.tagger.labels)))):
            found = model.judge([x.as_py() for x in part.column("text")])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    Null text and text without a letter are ``und`` with score 0, as is every
    text if no language could be learned; repeated rows are answered each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(partial(_judged, model=model), f"doc_id {kind}, lang_pred string, score double")
    return rows.select("doc_id", (remainder(folds=FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
