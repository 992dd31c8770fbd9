"""The CRF in cases that are hard on numbers and memory."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import crf


def compared(m, texts):
    for x, got in zip(texts, m.marginals(texts), strict=True):
        if x:
            want, *_ = crf.forward_backward([m.emissions(x)], m.transitions, m.start)
            assert np.allclose(want[:, 0], got, atol=1e-5)
        else:
            assert got.shape == (0, len(m.labels))


@pytest.mark.parametrize("step", [1, 2, 50, 128])
@pytest.mark.parametrize("matrix_cells", [1, 40, 1 << 22])
def test_marginals_with_singular_transitions_and_few_matrices(monkeypatch, step, matrix_cells):
    monkeypatch.setattr(crf, "STEP", step)
    monkeypatch.setattr(crf, "MATRIX_CELLS", matrix_cells)
    rng = np.random.default_rng(7)
    texts = [[str(x) for x in rng.integers(0, 20, n)] for n in (3, 0, 130, 1, 2, 57, 51)]
    for transitions in (np.zeros((3, 3)), np.log(np.array([[0.2, 0.3, 0.5], [0.2, 0.3, 0.5], [0.6, 0.3, 0.1]])), rng.normal(size=(3, 3)) * 8):
        compared(crf.Crf([0, 1, 2], lambda w: ["w:" + w], {f"w:{i}": rng.normal(size=3) * 3 for i in range(20)}, transitions, rng.normal(size=3)), texts)


def test_slices_have_every_row_once():
    texts = ["a" * n for n in (5, 0, 9, 30, 1, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"text": texts, "i": list(range(9))})
    parts = [p.column("i").to_pylist() for p in crf.slices(batch, most_bytes=10, most_texts=3)]
    assert sum(parts, []) == list(range(9)) and all(len(p) <= 3 for p in parts) and [3] in parts
    assert list(crf.slices(batch.slice(0, 0))) == []


def test_memory_of_words_grows_and_starts_anew(monkeypatch):
    monkeypatch.setattr(crf, "REMEMBERED", 10)
    m = crf.Crf([0, 1], lambda w: ["w:" + w], {f"w:{i}": np.array([i, -i]) for i in range(40)}, np.zeros((2, 2)), np.zeros(2))
    for words in (["1", "2"], [str(i) for i in range(30)], ["3", "39", "3"]):
        assert m.emissions(words)[:, 0].tolist() == [float(w) for w in words]
