"""Clusters equal plain rounds over all centroids; the tree equals comparing with each of them."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from markcheck.llm import registry, vantage

SF = "/root/testdata/sf0.001"


def plain(rows, k, rounds, dims):
    """Vectors ``(id, components)`` clustered by definition."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for n in range(len(centres)):
            if members := [v for (_, v), (_, m) in zip(kept, own) if m == n]:
                centres[n] = [sum(x) // len(members) for x in zip(*members)]
    own = assign()
    inertia = [sum(d for d, m in own if m == n) for n in range(len(centres))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), n, d, inertia[n], sum(inertia), shas[n]) for (i, _), (d, n) in zip(kept, own))


def spark_rows(frame):
    return sorted((str(r[0]), *r[1:]) for r in frame.collect())


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_the_nearest_and_smallest(seed):
    rng = np.random.default_rng(seed)
    dims, k = int(rng.integers(1, 6)), int(rng.integers(1, 60))
    centroids = rng.integers(-4, 5, (k, dims)) * (1 if seed % 2 else 20_000_000)
    vectors = rng.integers(-5, 6, (500, dims)) * (1 if seed % 2 else 20_000_000)
    far = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    number, best = vantage.Tree(centroids).nearest(vectors)
    assert (number == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_a_tree_leaves_subtrees_out(monkeypatch):
    rng = np.random.default_rng(1)
    centroids, seen = rng.integers(-1000, 1000, (64, 2)), []
    tree, plainly = vantage.Tree(centroids), vantage.squared
    monkeypatch.setattr(vantage, "squared", lambda v, c: (seen.append(len(v)), plainly(v, c))[1])
    tree.nearest(rng.integers(-1000, 1000, (300, 2)))
    assert sum(seen) < 300 * 64 / 2


def test_query_equals_sql_and_definition(spark):
    mine = spark_rows(registry.QUERIES["op11_centroid_clusters"](spark, SF))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert mine == sorted((str(r[0]), *r[1:]) for r in duck.execute(registry.ORACLES["op11_centroid_clusters"]).fetchall())
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    assert mine == plain(rows, 16, 3, 64)


def test_odd_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [0.0, -3.5]), (None, [5.0, 5.0]), (2, [-5.0, 0.01]), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, None), (9, []), (10, [-0.01, -0.01]), (11, [5.0, 5.0])]
    shape = "vec_id long, embedding array<double>, cluster string, v int"
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], shape)
    for k, rounds in ((2, 1), (3, 3), (16, 2), (16, 0)):
        assert spark_rows(vantage.clusters(frame, k=k, rounds=rounds, dims=2)) == plain(rows, k, rounds, 2)
    assert vantage.clusters(spark.createDataFrame([], shape), dims=2).collect() == []
    with pytest.raises(Exception, match="squared distances may pass 64 bits"):
        vantage.clusters(spark.createDataFrame([(1, [1e8, 0.0])], "vec_id long, embedding array<double>"), dims=2).collect()
