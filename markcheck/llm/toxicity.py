"""Compression-distance classification of toxic text.

Two zstandard dictionaries are trained apart, each on the labelled text of one class alone: a dictionary holds the
windows that most documents of its class have. Every window of a text is compressed with both; one that the toxic
dictionary shortens by some bytes more is toxic material. How many windows pass each of several byte thresholds, per
document length, is calibrated to a probability on the labelled sample.

A window is a run of letters. A fixed frame, which both dictionaries end with, follows it: zstandard starts no
match within the last bytes of its input, and the frame keeps the words out of that zone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markcheck.llm._labels import Logistic, fold, labelled_sample
from markcheck.llm.shingles import SLICE, SLICE_BYTES, slices
from markcheck.scratch import materialize

#: Labelled documents that the fit reads at most.
SAMPLE = 20_000
#: Documents that hold a window of a dictionary: three, or this share of the documents of the smaller class. A dictionary
#: has all such windows, so it is bounded by the sample and the share alone.
SUPPORT = 0.01
#: Byte thresholds that are calibrated.
THRESHOLDS = (2, 3, 4, 5, 6, 7, 8)
LEVEL = 12
#: Windows whose distance a worker remembers; beyond it the memory is emptied, which changes no score.
MEMO = 100_000

_FRAME = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ[]{}"
_windows = re.compile(r"[^\W\d_]+").findall


def windows(text: str | None) -> list[str]:
    return _windows(text.lower()) if text else []


class Distance(dict):
    """Bytes by which the toxic dictionary compresses a window better, filled on demand."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)

    @staticmethod
    def _compressor(content: bytes):
        import zstandard

        trained = zstandard.ZstdCompressionDict(content + _FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        trained.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __missing__(self, window: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        data = b" " + window.encode() + b" " + _FRAME
        gain = self[window] = len(self.ordinary.compress(data)) - len(self.toxic.compress(data))
        return gain

    def features(self, text: str | None) -> list[float]:
        gains = Counter(map(self.__getitem__, windows(text)))
        n = sum(gains.values())
        out = [float(max(gains, default=0)), math.log1p(n)]
        for t in THRESHOLDS:
            k = sum(c for g, c in gains.items() if g >= t)
            out += [math.log1p(k), math.log((k + 0.2) / (n + 20))]
        return out


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    calibrate: Logistic | None = None

    def distance(self) -> Distance:
        return Distance(self.toxic, self.ordinary)


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, SLICE, SLICE_BYTES):
        seen = (Counter(), Counter())
        for text, label in zip(_texts(b), b.column(b.schema.get_field_index("label")).to_pylist(), strict=True):
            seen[label > 0].update(set(windows(text)))
        words = sorted({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_arrays([pa.array(words), *(pa.array([s[w] for w in words], pa.int64()) for s in seen)], ["window", "ordinary", "toxic"])


def _features(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = model.value.distance()
        for b in slices(batches, SLICE, SLICE_BYTES):
            x = pa.array([distance.features(t) for t in _texts(b)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, b.column(b.schema.get_field_index("label"))], ["x", "label"])

    return run


def _trained(seen: DataFrame, documents: str, least: int) -> bytes:
    """A dictionary of the windows of most documents; those come last, where offsets are shortest."""
    top = seen.where(F.col(documents) >= least).select(documents, "window").collect()
    top.sort(key=lambda r: (-r[0], r.window))
    return b"".join(b" " + r.window.encode() + b" " for r in reversed(top))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Trains dictionaries and thresholds on at most ``sample`` labelled documents outside the held-out fold."""
    rows = labelled_sample(docs, labels, label, folds, held_out, sample, id_col, text_col)
    seen = rows.mapInArrow(_count_windows, "window string, ordinary long, toxic long").groupBy("window").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    seen = materialize(seen, "windows")
    n = {bool(r.label > 0): r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    least = max(3, math.ceil(SUPPORT * min(n.get(True, 0), n.get(False, 0))))
    toxic, ordinary = (_trained(seen, c, least) for c in ("toxic", "ordinary"))
    model = ToxicityModel(toxic, ordinary)
    known = rows.mapInArrow(_features(rows.sparkSession.sparkContext.broadcast(model)), "x array<double>, label int").collect()
    model.calibrate = Logistic(np.array([r.x for r in known]), np.array([float(r.label > 0) for r in known]))
    return model


def _scores(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = model.value.distance()
        for b in slices(batches, SLICE, SLICE_BYTES):
            x = np.array([distance.features(t) for t in _texts(b)]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["text"]).columns, pa.array(model.value.calibrate(x), pa.float64())], [*(n for n in b.schema.names if n != "text"), "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``; no shuffle.

    Null and empty texts get the score of a text without windows. Without both kinds of labels every score is the
    share of toxic labels. Repeated rows stay; other columns are ignored. A text of any length is
    scored whole.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), folds) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    made = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double"
    out = rows.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model)), made)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model predicts to be toxic, each by itself; columns stay as they are.

    Nulls and empty texts count as texts without windows; without both kinds of labels the more frequent kind decides.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = shared.value.distance()
        for b in slices(batches, SLICE, SLICE_BYTES, text_col):
            x = np.array([distance.features(t) for t in b.column(names.index(text_col)).to_pylist()]).reshape(b.num_rows, -1)
            yield b.filter(pa.array(shared.value.calibrate(x) < 0.5))

    return docs.mapInArrow(run, docs.schema)
