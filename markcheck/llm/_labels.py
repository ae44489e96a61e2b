"""Bounded, repeatable samples of labelled documents for fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markcheck.scratch import materialize


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; an unknown id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int, id_col: str = "doc_id", text_col: str = "text", n_bytes: int | None = None) -> DataFrame:
    """At most ``bound`` rows ``id, text, label`` outside the held-out fold: those whose id hashes lowest.

    ``n_bytes`` bounds their texts as well: rows are taken in that order as long as they fit.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("label is not null and id is not null")
    known = known.where(fold(F.col("id"), folds) != held_out).groupBy("id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(bound)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "id")  # of ``bound`` ids
    sample = materialize(texts.select("id", "text", "label"), f"sample-{label}")
    if n_bytes is None or (sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= n_bytes:
        return sample
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id", "size").rowsBetween(Window.unboundedPreceding, 0))  # of the sample's rows
    sizes = sample.select("id", F.octet_length("text").cast("long").alias("size")).where(F.col("size") <= n_bytes).withColumn("upto", upto).where(F.col("upto") <= n_bytes)
    return sample.join(F.broadcast(sizes.select("id").distinct()), "id", "left_semi")


class Logistic:
    """Ridge logistic regression by Newton steps; standardises its inputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40):
        self.constant = float(np.mean(y)) if len(y) else 0.0
        self.fitted = 0 < self.constant < 1
        if not self.fitted:
            return
        x = np.asarray(x, float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._design(x)
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
            w -= np.linalg.solve(hessian, z.T @ (p - y) / len(y) + ridge * w)
        self.w = w

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -30, 30)))
