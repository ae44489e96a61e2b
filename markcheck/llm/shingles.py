"""Hashed word shingles of whole texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

#: Words of a shingle.
WIDTH = 5
#: Word hashes that a worker remembers; beyond it the memory is emptied.
MEMO = 100_000
#: Documents and bytes of text that a task turns into arrays at a time.
SLICE, SLICE_BYTES = 1_000, 1_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASH = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def starts_of(group: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)


def words_of(text: bytes | None) -> list[bytes]:
    """ASCII-lower-cased runs of anything but ASCII white space."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of every run of ``width`` words, by its first word."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * (_ODD[k % 5] + np.uint64(2 * (k // 5)))
    return mix(total)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, one without words none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(gram_hashes(word_hashes(words), width))


def shingle_sets(texts: Sequence[bytes | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The ``shingle_set`` of every text, one after the other, and their sizes."""
    words = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter(map(_HASH.__getitem__, chain.from_iterable(words)), np.uint64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    runs = gram_hashes(hashes, width)
    whole = np.arange(len(runs)) + width <= np.repeat(ends, lengths)[: len(runs)]
    counts = np.maximum(0, lengths - width + 1)
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    counts[short] = 1
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    long = np.ones(len(out), bool)
    long[starts[short]] = False
    out[long] = runs[whole]
    for k in short:
        out[starts[k]] = xxhash.xxh64_intdigest(b" ".join(words[k]), seed=len(words[k]))
    for lo, n in zip(starts.tolist(), counts.tolist(), strict=True):
        out[lo : lo + n].sort()
    doc = np.repeat(np.arange(len(counts)), counts)
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[fresh], np.bincount(doc[fresh], minlength=len(counts))


def slices(batches: Iterator[pa.RecordBatch], rows: int, n_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, and of few enough text bytes that what is made of them stays small."""
    for b in batches:
        sizes = np.fromiter((x or 0 for x in pa.compute.binary_length(b.column(b.schema.get_field_index(column))).to_pylist()), np.int64, b.num_rows)
        lo, held = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if k > lo and (k - lo >= rows or held + size > n_bytes):
                yield b.slice(lo, k - lo)
                lo, held = k, 0
            held += size
        if lo < b.num_rows:
            yield b.slice(lo)
