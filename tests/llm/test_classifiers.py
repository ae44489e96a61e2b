import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from markcheck.llm import quality, toxicity
from markcheck.llm._labels import labelled_sample

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(scores, labels, label):
    rows = scores.join(labels.select("doc_id", label), "doc_id").where("held_out").select("predicted", label).collect()
    return np.array([tuple(r) for r in rows]).T


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    predicted, true = held_out(toxicity.score(docs, toxicity.fit(docs, labels)), labels, "toxic")
    assert len(true) > 500
    assert predicted[true == 1].mean() > 0.8 and predicted[true == 0].mean() < 0.02


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    predicted, true = held_out(quality.score(docs, quality.fit(docs, labels)), labels, "quality")
    assert (predicted == true).mean() > 0.95 and (1 - predicted[true == 0]).mean() > 0.85


@pytest.mark.parametrize("module,label,folds,out", [(toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)])
def test_edge_rows(spark, module, label, folds, out):
    rows = [(i, f"plain words number {i}", 0, "x") for i in range(60)] + [(i, f"awful horrid words {i}", 1, "x") for i in range(60, 120)]
    docs = spark.createDataFrame([(i, t, "en", s) for i, t, _, s in rows] + [(500, None, None, None), (501, "", "en", None), (None, "x y", "en", "s"), (502, "long " * 40000, "en", "s"), (501, "", "en", None)], "doc_id long, text string, score string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows] + [(None, 1), (700, 1), (3, None)], f"doc_id long, {label} int")
    model = module.fit(docs, labels)
    scored = module.score(docs, model).collect()
    assert len(scored) == 125 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % folds == out) for r in scored)
    assert module.score(docs.limit(0), model).count() == 0
    again = {(r.doc_id, r.score) for r in module.score(docs.repartition(5), module.fit(docs.repartition(5), labels)).collect()}
    assert {(i, round(s, 9)) for i, s in again} == {(r.doc_id, round(r.score, 9)) for r in scored}
    none = module.fit(docs, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in module.score(docs, none).collect())
    only = module.fit(docs, labels.where(F.col(label) == 0))
    assert all(r.predicted == 0 for r in module.score(docs, only).collect())


def test_attention_gradients():
    rng = np.random.default_rng(0)
    w = {k: rng.normal(size=s) for k, s in {"enc": (quality.FEATURES, quality.HIDDEN), "enc_b": (quality.HIDDEN,), "v": (quality.HIDDEN, quality.GATE), "u": (quality.HIDDEN, quality.GATE), "att": (quality.GATE,), "out": (quality.HIDDEN,), "out_b": ()}.items()}
    w["enc"] *= 0.05
    x, starts, y = rng.normal(size=(7, quality.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality._forward(w, x, starts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = quality._gradients(w, x, starts, y)
    for name in ("enc", "v", "u", "att", "out"):
        at = tuple(0 for _ in w[name].shape)
        old, eps = w[name][at], 1e-5
        w[name][at] = old + eps
        up = loss()
        w[name][at] = old - eps
        down = loss()
        w[name][at] = old
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 1e-6


def test_distances_equal_plain_compression(spark):
    docs = spark.createDataFrame([(k, ("you utter moron " if k % 2 else "a calm word ") * 3 + f"text {k % 7}") for k in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as toxic")
    model = toxicity.fit(docs, labels)
    assert b" moron " in model.toxic and b" moron " not in model.ordinary and b" calm " in model.ordinary and b" calm " not in model.toxic
    distance, text = model.distance(), "You calm moron, unseen wörd text"

    def size(content, window):
        trained = zstandard.ZstdCompressionDict(content + toxicity._FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(compressor.compress(b" " + window.encode() + b" " + toxicity._FRAME))

    gains = [size(model.ordinary, w) - size(model.toxic, w) for w in ("you", "calm", "moron", "unseen", "wörd", "text")]
    assert [distance[w] for w in toxicity.windows(text)] == gains and gains[2] > 0 > gains[1]
    features = distance.features(text)
    assert features[0] == max(gains) and features[2] == pytest.approx(math.log1p(sum(g >= toxicity.THRESHOLDS[0] for g in gains)))
    assert {r.predicted for r in toxicity.score(docs, model).where("doc_id % 2 = 1").collect()} == {1}


def test_the_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * (50 + k)) for k in range(100)] + [(200, "y" * 5000)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as quality")
    kept = labelled_sample(docs, labels, "quality", 3, 1, 1000, n_bytes=2000).collect()
    assert 10 < len(kept) and sum(len(r.text) for r in kept) <= 2000
