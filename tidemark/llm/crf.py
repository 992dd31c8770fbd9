"""A linear-chain conditional random field over words, in NumPy.

A word's features are strings; its emission scores are the sums of their
weights, so scores are computed once per distinct word and looked up after
that. Forward-backward runs over many sequences at once, step by step, with
scaled probabilities; sequences are ordered by length so that a step touches
the unfinished ones only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow.compute as pc

#: Padded cells (sequences times steps) worked on at once, words in a piece, and words remembered.
CELLS = 1 << 18
STEP = 128
REMEMBERED = 600_000
#: Numbers in the matrices of pieces that are held at once, and bytes and texts that ``slices`` puts together.
MATRIX_CELLS = 1 << 22
SLICE_BYTES, SLICE_TEXTS = 4 << 20, 512


@dataclass
class Crf:
    labels: list
    features: Callable[[str], list[str]]
    weights: dict[str, np.ndarray]
    transitions: np.ndarray
    start: np.ndarray
    _rows: np.ndarray | None = field(default=None, repr=False)
    _seen: dict | None = field(default=None, repr=False)
    _table: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_rows": None, "_seen": None, "_table": None}

    def forget(self) -> None:
        """Drop what is remembered of words; it is found anew when it is needed."""
        self._rows = self._seen = self._table = None

    def scores(self, words: Sequence[str]) -> np.ndarray:
        """Scores of each word (rows) for each label, computed from the features."""
        if self._table is None:
            place = {f: i for i, f in enumerate(self.weights)}
            self._table = place, np.vstack([*self.weights.values(), np.zeros(len(self.labels))])
        place, table = self._table
        out = np.zeros((len(words), len(self.labels)))
        for at in range(0, len(words), 4096):
            lists = list(map(self.features, words[at : at + 4096]))
            none, get = len(table) - 1, place.get
            ids = np.fromiter((get(f, none) for fs in lists for f in fs), np.int64)
            ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
            out[at : at + len(lists)] = np.add.reduceat(table[ids], np.concatenate([[0], ends[:-1]]), axis=0)
        return out

    def _numbered(self, words: Sequence[str]) -> np.ndarray:
        """The place of each word's scores in ``_rows``, a bounded memory of words."""
        if self._seen is None or len(self._seen) + len(words) > max(REMEMBERED, len(words)):
            # What a call needs always fits: the memory starts anew with room for it.
            self._seen, self._rows = {}, np.zeros((min(1 << 12, max(REMEMBERED, len(words))), len(self.labels)))
        fresh = list(set(words).difference(self._seen))
        if fresh:
            at, need = len(self._seen), len(self._seen) + len(fresh)
            if need > len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros((max(need - len(self._rows), len(self._rows)), len(self.labels)))])
            self._rows[at:need] = self.scores(fresh)
            self._seen.update(zip(fresh, range(at, need), strict=True))
        return np.fromiter(map(self._seen.__getitem__, words), np.int64, len(words))

    def emissions(self, words: Sequence[str]) -> np.ndarray:
        """``scores`` through a bounded memory of words."""
        if not len(words):
            return np.zeros((0, len(self.labels)))
        place = self._numbered(words)
        return self._rows[place]

    def marginals(self, texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """For each sequence of words, the probabilities of the labels at each word.

        Sequences are cut into pieces of ``STEP`` words, and pieces of all
        sequences go side by side. A first pass finds what each piece does to
        any distribution before it (a matrix); chaining these gives the messages
        at the cuts, so the result is that of the uncut sequences, at a number
        of steps that long texts do not raise. No more than MATRIX_CELLS numbers
        of matrices are held: pieces are taken in blocks, forward for the
        messages from the left and backward for those from the right.
        """
        k = len(self.labels)
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
        begins = ends - np.array([len(x) for x in texts], np.int64)
        out = np.zeros((int(ends[-1]) if len(ends) else 0, k), np.float32)
        if not len(out) or not k:
            return [out[lo:hi] for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True)]
        counts = -(-(ends - begins) // STEP)
        order = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        first = np.repeat(begins, counts) + order * STEP
        length = np.minimum(np.repeat(ends, counts) - first, STEP)
        last = order == np.repeat(counts, counts) - 1
        a = np.exp(self.transitions - self.transitions.max())
        place = self._numbered([w for x in texts for w in x])
        used, at_used = np.unique(place, return_inverse=True)
        rows = self._rows[used]
        rows -= rows.max(axis=1, keepdims=True)
        np.exp(rows, out=rows)

        def padded(group: np.ndarray) -> np.ndarray:
            """Emissions of pieces, the longest first: step, piece, label."""
            at = np.arange(int(length[group[0]]))[:, None]
            emit = rows[at_used[np.minimum(first[group] + at, first[group] + length[group] - 1)]]
            emit[at >= length[group]] = 1
            return emit

        def alive(group: np.ndarray) -> np.ndarray:
            """How many of the pieces, the longest first, have each step."""
            return np.searchsorted(-length[group], -np.arange(int(length[group[0]])), side="left")

        def through(block: np.ndarray) -> np.ndarray:
            """The matrix of each piece of ``block``, up to a factor; a sequence's first word has no transition before it."""
            found = np.empty((len(block), k, k))
            by_length = np.argsort(-length[block], kind="stable")
            for part in np.array_split(by_length, -(-len(by_length) * STEP // CELLS)):
                group = block[part]
                emit = padded(group)
                now = np.tile(np.eye(k), (len(group), 1, 1))
                for t, n in enumerate(alive(group).tolist()):
                    now[:n] = (now[:n] if t == 0 else now[:n] @ a) * emit[t, :n, None, :]
                    if t % 16 == 15:
                        now[:n] /= now[:n].sum(axis=(1, 2), keepdims=True)
                found[part] = now / now.sum(axis=(1, 2), keepdims=True)
            later = order[block] > 0
            found[later] = a @ found[later]
            return found / found.sum(axis=(1, 2), keepdims=True)

        # What is known of the label before a piece (of a sequence's first word: the start), and after it.
        inward, outward = np.tile(np.exp(self.start - self.start.max()), (len(first), 1)), np.ones((len(first), k))
        chained = np.flatnonzero(~last | (order > 0))
        size = max(1, MATRIX_CELLS // (k * k))
        blocks = [chained[i : i + size] for i in range(0, len(chained), size)]
        kept = through(blocks[0]) if len(blocks) == 1 else None

        def by_depth(block: np.ndarray) -> list[np.ndarray]:
            depth = np.argsort(order[block], kind="stable")
            return np.split(depth, np.flatnonzero(np.diff(order[block][depth])) + 1)

        for block in blocks:
            matrices = through(block) if kept is None else kept
            for depth in by_depth(block):
                depth = depth[~last[block[depth]]]
                m = (inward[block[depth]][:, None, :] @ matrices[depth])[:, 0]
                inward[block[depth] + 1] = m / m.sum(axis=1, keepdims=True)
        for block in reversed(blocks):
            matrices = through(block) if kept is None else kept
            for depth in reversed(by_depth(block)):
                depth = depth[order[block[depth]] > 0]
                m = (matrices[depth] @ outward[block[depth]][:, :, None])[:, :, 0]
                outward[block[depth] - 1] = m / m.sum(axis=1, keepdims=True)
        by_length = np.argsort(-length, kind="stable")
        for group in np.array_split(by_length, -(-len(by_length) * STEP // CELLS)):
            emit, active = padded(group), alive(group)
            alpha = np.zeros_like(emit)
            now, later = inward[group], order[group, None] > 0
            for t, n in enumerate(active.tolist()):
                now = (np.where(later, now @ a, now) if t == 0 else now[:n] @ a) * emit[t, :n]
                now /= now.sum(axis=1, keepdims=True)
                alpha[t, :n] = now
            beta = outward[group]
            for t in range(len(emit) - 1, -1, -1):
                n = active[t]
                alpha[t, :n] *= beta[:n]
                ahead = (emit[t, :n] * beta[:n]) @ a.T
                beta[:n] = ahead / ahead.sum(axis=1, keepdims=True)
            alpha /= np.maximum(alpha.sum(axis=2, keepdims=True), 1e-300)
            for j, (f, n) in enumerate(zip(first[group].tolist(), length[group].tolist(), strict=True)):
                out[f : f + n] = alpha[:n, j]
        return [out[lo:hi] for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True)]


def slices(batch, column: str = "text", most_bytes: int = SLICE_BYTES, most_texts: int = SLICE_TEXTS) -> Iterable:
    """An Arrow batch in slices of so many texts and bytes at most; a longer text is one slice."""
    sizes = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (held + n > most_bytes or i - at == most_texts):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def forward_backward(given: Sequence[np.ndarray], transitions: np.ndarray, start: np.ndarray):
    """Marginals (step, sequence, label), expected transitions and starts, log-likelihood parts.

    ``given`` has the emissions of each sequence, the longest first, none empty.
    """
    lengths = np.array([len(g) for g in given])
    steps, rows, k = int(lengths[0]), len(given), len(start)
    emit = np.zeros((steps, rows, k))
    for j, g in enumerate(given):
        emit[: len(g), j] = g
    shift = emit.max(axis=2, keepdims=True)
    emit -= shift
    np.exp(emit, out=emit)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    a = np.exp(transitions)
    alpha, scale = np.zeros_like(emit), np.ones((steps, rows))
    now = np.exp(start) * emit[0]
    for t in range(steps):
        n = active[t]
        if t:
            now = (alpha[t - 1, :n] @ a) * emit[t, :n]
        total = now.sum(axis=1)
        scale[t, :n] = total
        alpha[t, :n] = now / total[:, None]
    marginal, pairs = np.zeros_like(emit), np.zeros((k, k))
    beta = np.ones((rows, k))
    for t in range(steps - 1, -1, -1):
        n = active[t]
        if t + 1 < steps:
            m = active[t + 1]
            ahead = emit[t + 1, :m] * beta[:m] / scale[t + 1, :m, None]
            pairs += alpha[t, :m].T @ ahead
            beta[:m] = ahead @ a.T
        p = alpha[t, :n] * beta[:n]
        marginal[t, :n] = p / p.sum(axis=1, keepdims=True)
    return marginal, pairs * a, marginal[0].sum(axis=0), float(np.log(scale).sum() + shift.sum())


def train(
    texts: Sequence[Sequence[str]],
    tags: Sequence[Sequence[int]],
    labels: list,
    features: Callable[[str], list[str]],
    rounds: int = 50,
    rate: float = 0.4,
    l2: float = 1e-5,
    least: int = 3,
) -> Crf:
    """Maximum-likelihood weights (Adam, L2) for features seen in ``least`` distinct places or more."""
    k = len(labels)
    pairs = sorted(((list(x), list(y)) for x, y in zip(texts, tags, strict=True) if len(x)), key=lambda p: -len(p[0]))
    if not pairs:
        return Crf(labels, features, {}, np.zeros((k, k)), np.zeros(k))
    place: dict[str, int] = {}
    ids = [np.array([place.setdefault(w, len(place)) for w in x]) for x, _ in pairs]
    counts = np.bincount(np.concatenate(ids), minlength=len(place))
    number: dict[str, int] = {}
    tally: list[int] = []
    rows, cols = [], []
    for w, i in place.items():
        for f in features(w):
            j = number.setdefault(f, len(number))
            if j == len(tally):
                tally.append(0)
            tally[j] += int(counts[i])
            rows.append(i)
            cols.append(j)
    keep = np.array(tally) >= least
    rows_a, cols_a = np.array(rows), np.array(cols)
    rows_a, cols_a = rows_a[keep[cols_a]], cols_a[keep[cols_a]]
    n_words, n_features = len(place), len(number)

    gold = np.zeros((n_words, k))
    gold_pairs, gold_start = np.zeros((k, k)), np.zeros(k)
    for x, (_, y) in zip(ids, pairs, strict=True):
        y = np.array(y)
        np.add.at(gold, (x, y), 1)
        np.add.at(gold_pairs, (y[:-1], y[1:]), 1)
        gold_start[y[0]] += 1
    groups, at = [], 0
    while at < len(ids):
        size = max(1, CELLS // len(ids[at]))
        groups.append(ids[at : at + size])
        at += size
    total = sum(map(len, ids))
    w = np.zeros((n_features, k))
    trans, start = np.zeros((k, k)), np.zeros(k)
    params = [w, trans, start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        table = np.stack([np.bincount(rows_a, weights=w[cols_a, c], minlength=n_words) for c in range(k)], axis=1)
        expected, exp_pairs, exp_start = np.zeros((n_words, k)), np.zeros((k, k)), np.zeros(k)
        for group in groups:
            p, q, s, _ = forward_backward([table[x] for x in group], trans, start)
            exp_pairs += q
            exp_start += s
            for c in range(k):
                expected[:, c] += np.bincount(np.concatenate(group), weights=np.concatenate([p[: len(x), j, c] for j, x in enumerate(group)]), minlength=n_words)
        diff = gold - expected
        grad_w = np.stack([np.bincount(cols_a, weights=diff[rows_a, c], minlength=n_features) for c in range(k)], axis=1)
        for i, g in enumerate((grad_w / total - l2 * w, (gold_pairs - exp_pairs) / total - l2 * trans, (gold_start - exp_start) / total - l2 * start)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] += rate * (first[i] / (1 - 0.9**r)) / (np.sqrt(second[i] / (1 - 0.99**r)) + 1e-9)
    names = list(number)
    return Crf(labels, features, {names[j]: w[j].copy() for j in np.flatnonzero(keep)}, trans, start)


def cut(words: Sequence[str], tags: Sequence[int], size: int) -> Iterable[tuple[Sequence[str], Sequence[int]]]:
    """A sequence in consecutive pieces of at most ``size`` words."""
    for at in range(0, len(words), size):
        yield words[at : at + size], tags[at : at + size]
