"""64-bit SimHash fingerprints of word shingles, Arrow batches in and out."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE = 3
SEED = 42
#: Shingles hashed at once, so that a very long text needs bounded memory.
CHUNK = 1 << 15
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SHIFTS = np.arange(64, dtype=np.uint64)


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the uint64 ``hashes`` have each bit set, lowest bit first."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS_OF for i in range(8)])


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half of the shingles' hashes.

    Shingles are runs of ``shingle`` words joined by a space, repeats included;
    a text of fewer words is one shingle, one without words has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    # bytes.split() cuts at space and \t-\r, which is the word rule.
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    total, n, digest = np.zeros(64, np.int64), len(starts), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        hashes = [digest(line[a:b], seed) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)]
        total += bits_set(np.array(hashes, np.uint64))
    return int((np.uint64(1) << _SHIFTS)[2 * total > n].sum(dtype=np.uint64))


def fingerprints(batches):
    """Arrow batches (doc_id, text) to (doc_id, fp): the fingerprint as a signed long."""
    for batch in batches:
        found = np.array([simhash(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])
