"""Passages that repeat across documents, by sparse suffixes at minimisers.

Minimisers are the word 8-grams with the least hash among those of any 50 consecutive words. A stretch of 50 words
holds the same one at the same place wherever it stands, so equal stretches meet where suffixes are kept only at
minimisers. A suffix there is extended left and right by hashing the stretches of 50 words around it, one for each
number of words before it; those of one minimiser are sorted, and neighbours compared. This finds every pair, which
comparing whole suffixes with their neighbours does not: of two copies that share little behind the minimiser and
much before it, others stand between. Equal stretches that overlap are merged.

Each stretch belongs to one minimiser, so it is sent once, as 8 bytes, and what repeats comes back as spans of whole
runs. Stretches of a minimiser that very many documents hold are dealt by their own hashes, and those that are
themselves so frequent are not brought together at all: their smallest documents are aggregated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markcheck.llm._sample import Frequencies, frequent, times_of
from markcheck.llm.shingles import SLICE, SLICE_BYTES, gram_hashes, mix, slices, starts_of, word_hashes
from markcheck.scratch import materialize

#: Words that a repeat has at least, and words of the gram that stands for a suffix.
MIN_WORDS, GRAM = 50, 8
#: Stretches that one group of the comparing step holds on average; what is so frequent by itself is dealt apart.
BUCKET = 500_000
#: Stretches that a task holds before it deals them to groups, so that rows stay few however many groups there are.
HELD = 200_000

_PACKED = "bucket long, docs binary, starts binary, lengths binary, stretches binary"
_FOUND = "doc_id long, start int, end int, other long, frequent long"
_NONE = np.iinfo(np.int64).max
_U = np.uint64


def _minimisers(hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every stretch of a text, given as word hashes, the place of its minimiser, and the hashes of all grams."""
    grams, span = gram_hashes(hashes, GRAM), min_words - GRAM + 1
    return np.arange(len(grams) - span + 1) + np.lib.stride_tricks.sliding_window_view(grams, span).argmin(1), grams


def _runs(batch: pa.RecordBatch, min_words: int) -> tuple[np.ndarray, ...]:
    """Runs of stretches with one minimiser: document, first word, length and minimiser of each, then all stretches."""
    ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
    parts: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.uint64, np.uint64))]
    for doc, text in zip(ids, texts, strict=True):
        words = text.split() if text else []
        if doc is None or len(words) < min_words:
            continue
        hashes = word_hashes(words)
        at, grams = _minimisers(hashes, min_words)
        first = starts_of(at)
        parts.append((np.full(len(first), doc), first.astype(np.int32), np.diff(first, append=len(at)).astype(np.int32), mix(grams[at[first]]), gram_hashes(hashes, min_words)))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _pack(min_words: int, buckets: int, frequencies, least: int):
    """Per bucket and some slices one row with runs and their stretches."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bucket, doc, start, length, stretches = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        first, order = np.cumsum(length) - length, np.argsort(bucket, kind="stable")
        bucket, doc, start, length, first = (x[order] for x in (bucket, doc, start, length, first))
        stretches = stretches[np.repeat(first - (np.cumsum(length) - length), length) + np.arange(len(stretches))]
        cut = starts_of(bucket)
        ends = np.append(cut[1:], len(bucket))
        sent = np.concatenate(([0], np.cumsum(length)))
        columns = [pa.array([x[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()) for x in (doc, start, length.astype(np.int32))]
        columns.append(pa.array([stretches[sent[i] : sent[j]].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), *columns], ["bucket", "docs", "starts", "lengths", "stretches"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in slices(batches, SLICE, SLICE_BYTES):
            doc, start, length, gram, stretches = _runs(b, min_words)
            if not len(doc):
                continue
            # runs of frequent minimisers fall into single stretches, and frequent ones of these go to any bucket
            single = times_of(gram, frequencies.value) >= least
            pieces = np.where(single, length, 1)
            runs = np.repeat(np.arange(len(doc)), pieces)
            inside = np.arange(len(runs)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = (np.cumsum(length) - length)[runs] + inside
            doc, start, length, single = doc[runs], start[runs] + inside.astype(np.int32), np.where(single, 1, length)[runs], single[runs]
            bucket = (gram[runs] % _U(buckets)).astype(np.int64)
            bucket[single] = (mix(stretches[first[single]]) % _U(buckets)).astype(np.int64)
            apart = np.flatnonzero(single)
            apart = apart[times_of(stretches[first[apart]], frequencies.value) >= least]
            bucket[apart] = buckets + (mix(doc[apart].view(_U)) % _U(buckets)).astype(np.int64)
            held.append((bucket, doc, start, length, stretches))
            if sum(len(h[-1]) for h in held) >= HELD:
                yield flush(held)
        if held:
            yield flush(held)

    return run


def _match(min_words: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        """Repeated spans of a bucket; of the frequent stretches all, with their hash."""
        apart = group.column("bucket")[0].as_py() >= buckets
        doc, start, length, stretch = (np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in (("docs", np.int64), ("starts", np.int32), ("lengths", np.int32), ("stretches", np.int64)))
        group = None
        if apart:
            return _table(doc, start, start + min_words, None, stretch)
        runs = np.repeat(np.arange(len(doc)), length)
        place = start[runs] + (np.arange(len(runs)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
        order = np.argsort(stretch, kind="stable")
        stretch = stretch[order]
        equal = stretch[1:] == stretch[:-1]
        several = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
        order, stretch = order[several], stretch[several]
        cut = starts_of(stretch)
        at = np.repeat(np.arange(len(cut)), np.diff(cut, append=len(stretch)))
        of = doc[runs[order]]
        least = np.minimum.reduceat(of, cut) if len(cut) else of
        mine = of == least[at]
        second = np.minimum.reduceat(np.where(mine, _NONE, of), cut) if len(cut) else of
        other = np.where(mine, second[at], least[at])
        order, other = order[second[at] != _NONE], other[second[at] != _NONE]
        back = np.argsort(order)
        order, other = order[back], other[back]
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(order) != 1) | (np.diff(runs[order]) != 0))))[: len(order)]
        last = np.append(cut[1:], len(order))[: len(cut)] - 1
        return _table(doc[runs[order[cut]]], place[order[cut]], place[order[last]] + min_words, np.minimum.reduceat(other, cut) if len(cut) else other, None)

    return run


def _table(doc: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray | None, stretch: np.ndarray | None) -> pa.Table:
    none = pa.nulls(len(doc), pa.int64())
    return pa.table({"doc_id": doc, "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()), "other": none if other is None else other, "frequent": none if stretch is None else stretch})


def _both(min_words: int):
    def run(batch: pa.RecordBatch) -> np.ndarray:
        *_, gram, stretches = _runs(batch, min_words)
        return np.concatenate([gram, stretches])

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated stretch: ``doc_id, start_word, end_word, n_words, other_id``.

    ``start_word`` (from 0) and ``end_word`` (exclusive) count white-space separated words; overlapping matches of
    a document are one stretch, ``other_id`` is the smallest document that shares some of it. Repeats within one
    document do not count. Texts of fewer words, nulls and rows without an id give nothing; rows that repeat an id
    are one document; words are compared by hash. Other columns are ignored. A text of any length is
    read whole, and its stretches are spread like those of many short ones.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    frequencies, weight = frequent(texts, rows, _both(min_words))
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)
    buckets, least = max(16, size // 6 // BUCKET), max(3, int(BUCKET / 25 / weight))
    packed = texts.mapInArrow(_pack(min_words, buckets, shared, least), _PACKED)
    found = materialize(packed.groupBy("bucket").applyInArrow(_match(min_words, buckets), _FOUND), "repeats")
    spans = found.where("frequent is null").select("doc_id", "start", "end", "other").unionByName(_of_frequent(found.where("frequent is not null")))
    return _merged(spans)


def _of_frequent(rows: DataFrame) -> DataFrame:
    """Spans of the frequent stretches that several documents hold, with the smallest other document."""
    least = rows.groupBy("frequent").agg(F.min("doc_id").alias("least"))
    second = rows.join(F.broadcast(least), "frequent").where("doc_id <> least").groupBy("frequent", "least").agg(F.min("doc_id").alias("second"))
    found = rows.join(F.broadcast(second), "frequent")  # a row for each that the sample holds to be frequent
    return found.select("doc_id", "start", "end", F.when(F.col("doc_id") == F.col("least"), F.col("second")).otherwise(F.col("least")).alias("other"))


def _merged(spans: DataFrame) -> DataFrame:
    spans = spans.groupBy("doc_id", "start", "end").agg(F.min("other").alias("other"))
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    run = fresh.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy("doc_id", "run").agg(F.min("start").cast("long").alias("start_word"), F.max("end").cast("long").alias("end_word"), F.min("other").alias("other_id"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_id")


def cut_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` whose texts lack the stretches that a document with a smaller id shares; cut texts are single-spaced."""
    cuts = spans.where("other_id < doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("__cuts")).withColumnRenamed("doc_id", "__id")
    joined = docs.join(cuts, docs[id_col] == cuts["__id"], "left")
    words = F.regexp_extract_all(F.col(text_col), F.lit("[^ \\t\\n\\x0B\\f\\r]+"), 0)
    left = F.filter(words, lambda _, i: ~F.exists("__cuts", lambda c: (c["start_word"] <= i) & (i < c["end_word"])))
    return joined.withColumn(text_col, F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(F.array_join(left, " "))).select(*docs.columns)
