"""What a bounded sample of texts shows to be frequent: it settles orders and how rows are dealt, never a result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markcheck.llm.shingles import SLICE, SLICE_BYTES, slices

#: Documents of the sample, about, and hashes that are held to be frequent at most.
SAMPLE, FREQUENT = 20_000, 400_000

Frequencies = tuple[np.ndarray, np.ndarray]


def frequent(texts: DataFrame, rows: int, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[Frequencies, float]:
    """Sorted hashes that occur three times or more in a sample, their times, and the rows that one of it stands for.

    ``texts(doc_id, text)`` has ``rows`` rows; the sample is of about ``SAMPLE`` of them, those whose hash is low.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE, SLICE_BYTES):
            found, times = np.unique(hashes(b), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["hash", "times"])

    share = min(1.0, SAMPLE / max(1, rows))
    sample = texts if share == 1 else texts.where(F.xxhash64("doc_id") < int(-(2**63) + share * 2**64))
    times = sample.mapInArrow(count, "hash long, times long").groupBy("hash").agg(F.sum("times").alias("times")).where("times > 2")
    found = times.orderBy(F.desc("times"), "hash").limit(FREQUENT).toPandas()
    hashed = found["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashed)
    return (hashed[order], found["times"].to_numpy(np.int64)[order]), 1 / share


def times_of(hashes: np.ndarray, frequencies: Frequencies) -> np.ndarray:
    """How often the sample has each of ``hashes``, 0 where that is seldom."""
    seen, times = frequencies
    if not len(seen):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)
    return np.where(seen[at] == hashes, times[at], 0)
