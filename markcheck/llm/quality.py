"""Attention-based multiple-instance learning of document quality.

A document is a bag of passages and only the bag has a label. Every passage is encoded; a gated attention network
learns which passages speak for the document's label; the attention-weighted passage representation is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markcheck.llm._labels import fold, labelled_sample
from markcheck.llm.shingles import SLICE_BYTES, slices

#: Labelled documents, and bytes of their texts, that the fit reads at most; half as many bytes reach the driver.
SAMPLE, SAMPLE_BYTES = 4_000, 64_000_000
#: UTF-8 bytes of a passage; a shorter rest joins the passage before it.
PASSAGE, REST = 1_000, 250
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 32, 16, 12, 64, 4e-3, 1e-4

_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "%$", "#*", "&@", "'\"-", "<>/=:;()[]{}")
CLASSES = len(_GROUPS) + 2


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES - 2, np.uint16)  # other ASCII
    table[128:] = CLASSES - 1
    for k, chars in enumerate(_GROUPS):
        table[[ord(c) for c in chars]] = k
    return table


_TABLE = _class_table()
FEATURES = CLASSES * CLASSES + 5


def passages(text: bytes | None) -> np.ndarray:
    """One row per passage: root shares of neighbouring byte classes, then word statistics."""
    data = np.frombuffer(text or b"", np.uint8)
    n = max(1, (len(data) - REST + PASSAGE - 1) // PASSAGE)
    out = np.zeros((n, FEATURES), np.float32)
    if not len(data):
        return out
    of = np.minimum(np.arange(len(data)) // PASSAGE, n - 1)
    classes = _TABLE[data]
    if len(data) > 1:
        pairs = np.bincount(of[1:] * (CLASSES * CLASSES) + classes[:-1] * CLASSES + classes[1:], minlength=n * CLASSES * CLASSES)
        pairs = pairs.reshape(n, -1).astype(np.float32)
        out[:, : CLASSES * CLASSES] = np.sqrt(pairs / np.maximum(1, pairs.sum(1, keepdims=True)))
    for i in range(n):
        words = text[i * PASSAGE : (i + 1) * PASSAGE if i < n - 1 else len(data)].lower().split()
        if words:
            seen = Counter(words)
            size = sum(map(len, words)) / len(words)
            out[i, CLASSES * CLASSES :] = (len(seen) / len(words), max(seen.values()) / len(words), size / 10, sum(len(w) < 4 for w in words) / len(words), np.log1p(len(words)) / 6)
    return out


@dataclass
class QualityModel:
    """Weights of encoder, gate and scorer; ``constant`` stands in when there was nothing to learn."""

    weights: dict[str, np.ndarray] | None
    constant: float = 0.5

    def __call__(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(starts), self.constant)
        return _forward(self.weights, (x - self.weights["mean"]) / self.weights["scale"], starts)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict, x: np.ndarray, starts: np.ndarray) -> dict:
    """``starts``: the first passage of each bag."""
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ w["enc"] + w["enc_b"])
    t, g = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    e = (t * g) @ w["att"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["out"] + w["out_b"])}


def _gradients(w: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(w, x, starts)
    ds = (f["p"] - y) / len(y)
    dz = ds[:, None] * w["out"]
    da = (f["h"] * dz[f["bag"]]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
    dg = de[:, None] * w["att"]
    dt, du = dg * f["g"] * (1 - f["t"] ** 2), dg * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz[f["bag"]] + dt @ w["v"].T + du @ w["u"].T
    dpre = dh * (1 - f["h"] ** 2)
    return {
        "enc": x.T @ dpre, "enc_b": dpre.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ du,
        "att": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ ds, "out_b": ds.sum(),
    }


def train(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> QualityModel:
    """Adam over shuffled batches of bags."""
    share = float(np.mean(y)) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return QualityModel(None, share)
    everything = np.concatenate(bags)
    mean, scale = everything.mean(0), everything.std(0) + 1e-2
    bags = [((b - mean) / scale).astype(np.float32) for b in bags]
    rng = np.random.default_rng(seed)
    shape = {"enc": (FEATURES, HIDDEN), "enc_b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "att": (GATE,), "out": (HIDDEN,), "out_b": ()}
    w = {k: (rng.normal(size=s) / np.sqrt(max(1, s[0] if s else 1)) * (not k.endswith("_b"))).astype(np.float32) for k, s in shape.items()}
    m, v, step = {k: 0 * x for k, x in w.items()}, {k: 0 * x for k, x in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            ids = order[lo : lo + BATCH]
            x = np.concatenate([bags[i] for i in ids])
            starts = np.cumsum([0, *(len(bags[i]) for i in ids[:-1])])
            grads, step = _gradients(w, x, starts, y[ids]), step + 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in w:
                g = grads[k] + DECAY * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-8)
    return QualityModel(w | {"mean": mean, "scale": scale})


def _bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bags = [passages(t).astype(np.float16).tobytes() for t in _bytes(b, "text")]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bags, pa.binary()), b.column(b.schema.get_field_index("label"))], ["id", "bag", "label"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Learns from at most ``sample`` labelled documents outside the held-out fold; passages are encoded on the executors."""
    known = labelled_sample(docs, labels, label, folds, held_out, sample, id_col, text_col, SAMPLE_BYTES)
    encoded = known.mapInArrow(_encode, f"id {known.schema['id'].dataType.simpleString()}, bag binary, label int")
    rows = sorted(encoded.collect(), key=lambda r: (str(r.id), r.bag))  # the order of batches is part of the fit
    bags = [np.frombuffer(r.bag, np.float16).reshape(-1, FEATURES).astype(np.float32) for r in rows]
    return train(bags, np.array([float(r.label > 0) for r in rows], np.float32))


def _scores(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256, SLICE_BYTES):
            bags = [passages(t) for t in _bytes(b, "text")]
            scores = model.value(np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])])).tolist()
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), pa.array(scores, pa.float64())], [*keep, "score"])

    return run


def score(docs: DataFrame, model: QualityModel, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``; no shuffle.

    Null and empty texts are a bag of one empty passage; a text of any length is read whole, passage by passage.
    Without both labels every score is the share of good ones. Repeated rows stay; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), folds) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    made = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double"
    out = rows.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model)), made)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
