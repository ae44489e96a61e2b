"""Centroid clustering through a vantage-point tree.

Each round builds a tree over the centroids, broadcasts it and assigns every vector by best-first branch and bound:
the open subtree with the lowest bound is visited next, and a subtree is left out only where its bound lies beyond the
nearest centroid so far, the radius itself included, so that ties reach the smaller number. Vectors of a batch walk
the tree in step, each along its own order. Distances that decide are exact integers; bounds are floats with a margin.
Sums of each round are combined inside tasks and leave them as one row per centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markcheck.scratch import materialize

#: Centroids of a leaf, and cells (vectors by open nodes, or components) that a task works on at a time.
LEAF, CELLS = 3, 1 << 20
#: Bytes of centroids that are broadcast at most, and components that keep every distance in 64 bits.
BROADCAST_BYTES, LARGEST = 64_000_000, 1 << 27
#: Relative margin of float bounds, far above their rounding.
MARGIN = 1e-9


class Tree:
    """Vantage-point tree over the rows of ``centroids``, as arrays by node."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids = centroids
        self.vantage: list[int] = []
        self.cut: list[tuple[float, float, float]] = []  # largest distance inside, smallest and largest outside
        self.below: list[tuple[int, int]] = []
        self.members: list[np.ndarray | None] = []
        self._grow(np.arange(len(centroids)), leaf)

    def _grow(self, numbers: np.ndarray, leaf: int) -> int:
        at = len(self.members)
        self.members.append(None)
        self.vantage.append(-1)
        self.cut.append((0.0, 0.0, 0.0))
        self.below.append((-1, -1))
        if len(numbers) <= max(2, leaf):
            self.members[at] = numbers
            return at
        first, rest = int(numbers[0]), numbers[1:]
        far = np.sqrt(squared(self.centroids[rest], self.centroids[first]).astype(np.float64))
        order = np.argsort(far, kind="stable")
        half = len(rest) // 2
        inside, outside = order[:half], order[half:]
        self.vantage[at] = first
        self.cut[at] = (float(far[inside].max()), float(far[outside].min()), float(far[outside].max()))
        self.below[at] = (self._grow(np.sort(rest[inside]), leaf), self._grow(np.sort(rest[outside]), leaf))
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each vector's nearest centroid (the smallest of equally near ones) and its squared distance."""
        rows = max(1, CELLS // max(len(self.members), vectors.shape[1]))
        parts = [self._search(vectors[lo : lo + rows]) for lo in range(0, len(vectors), rows)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(vectors)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.centroids))
        bounds = np.full((n, len(self.members)), np.inf)
        bounds[:, 0] = 0.0
        live = np.arange(n)

        def offer(who: np.ndarray, candidate: int) -> np.ndarray:
            far = squared(vectors[who], self.centroids[candidate])
            nearer = (far < best[who]) | ((far == best[who]) & (candidate < number[who]))
            best[who[nearer]], number[who[nearer]] = far[nearer], candidate
            return far

        while len(live):
            node = bounds[live].argmin(axis=1)
            bound = bounds[live, node]
            reach = np.sqrt(best[live].astype(np.float64))
            going = np.isfinite(bound) & (bound <= reach * (1 + MARGIN))
            live, node, bound = live[going], node[going], bound[going]
            bounds[live, node] = np.inf
            for at in np.unique(node).tolist():
                here = node == at
                who = live[here]
                if self.members[at] is not None:
                    for candidate in self.members[at].tolist():
                        offer(who, candidate)
                    continue
                far = np.sqrt(offer(who, self.vantage[at]).astype(np.float64))
                inner, nearest, farthest = self.cut[at]
                slack = MARGIN * (far + farthest)
                bounds[who, self.below[at][0]] = np.maximum(bound[here], far - inner - slack)
                bounds[who, self.below[at][1]] = np.maximum(bound[here], np.maximum(nearest - far, far - farthest) - slack)
        return number, best


def squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = vectors - centre
    return np.einsum("ij,ij->i", d, d)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a batch as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
    if len(values) and (values.max() >= LARGEST or values.min() < -LARGEST):
        raise ValueError(f"a component reaches {LARGEST}: squared distances may pass 64 bits")
    return values


def _sums(tree, k: int, dims: int):
    """Per task and centroid: count, and sum by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            vectors = _matrix(b.column(b.schema.get_field_index("v")), dims)
            number, _ = tree.value.nearest(vectors)
            count += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            if len(order):
                starts = np.flatnonzero(np.diff(number[order], prepend=-1))
                total[number[order][starts]] += np.add.reduceat(vectors[order], starts, axis=0)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, dims)), pa.array(np.tile(np.arange(dims), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], dims))], ["cluster", "pos", "total", "n"])

    return run


def _assigned(tree, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, best = tree.value.nearest(_matrix(b.column(b.schema.get_field_index("v")), dims))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("vec_id")), pa.array(number, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])

    return run


def _kept(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that take part, as integers."""
    v = F.col(vector_col)
    finite: Column = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where((F.size(v) == dims) & finite).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors of exactly ``dims`` components, none null or not finite, take part, as floor(``scale`` * x). Centroids
    start as the ``k`` vectors of lowest sha256 of ``<seed>:<vec_id>`` (a null id counts as empty; rows that repeat an
    id stand in the order of their components), fewer where the table has fewer. Each round assigns every vector to
    the nearest centroid, the smaller number on ties, and takes floor(sum / count) by component; a centroid without
    vectors stays. Repeated rows are vectors of their own; other columns are ignored; an empty table gives no rows.
    A component of 2^27 or more in magnitude fails the query, as its squared distance may not fit a long.
    """
    spark = vectors.sparkSession
    kept = materialize(_kept(vectors, dims, scale, id_col, vector_col), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    if centroids.nbytes > BROADCAST_BYTES:
        raise ValueError(f"{k} centroids are over {BROADCAST_BYTES} bytes")
    k = len(centroids)
    for _ in range(rounds if k else 0):
        tree = spark.sparkContext.broadcast(Tree(centroids))
        parts = kept.select("v").mapInArrow(_sums(tree, k, dims), "cluster long, pos long, total long, n long")
        rows = parts.groupBy("cluster", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        centroids = centroids.copy()
        for r in rows:  # k times dims of them
            centroids[r["cluster"], r["pos"]] = int(r["total"]) // r["n"]
        tree.destroy()
    id_type = kept.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {id_type}, cluster int, distance long"
    if not k:
        found = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        found = materialize(kept.mapInArrow(_assigned(spark.sparkContext.broadcast(Tree(centroids)), dims), shape), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in range(k)]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3) -> str:
    near = """
a{r} AS (
  SELECT rid, c, dist FROM (
    SELECT v.rid, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS dist FROM x v JOIN c{r} c USING (pos) GROUP BY v.rid, c.c
  ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1
)"""
    move = """
m{n} AS (
  SELECT a.c, x.pos, sum(x.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} a JOIN x USING (rid) GROUP BY a.c, x.pos
),
c{n} AS (
  SELECT c.c, c.pos, CASE WHEN m.n IS NULL THEN c.x WHEN m.s >= 0 THEN m.s // m.n ELSE -((m.n - 1 - m.s) // m.n) END::BIGINT AS x
  FROM c{r} c LEFT JOIN m{n} m ON c.c = m.c AND c.pos = m.pos
)"""
    start = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda y: floor(64 * y::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64
),
x AS (SELECT rid, unnest(range(64)) AS pos, unnest(q) AS x FROM v),
f AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c FROM v
  QUALIFY c < {k}
),
c0 AS (SELECT f.c, x.pos, x.x FROM f JOIN x USING (rid))"""
    steps = [start]
    for r in range(rounds):
        steps += [near.format(r=r), move.format(r=r, n=r + 1)]
    steps.append(near.format(r=rounds))
    return (
        ",".join(steps)
        + f""",
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT v.vec_id, a.c::INT AS cluster, a.dist AS distance, sum(a.dist) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
       sum(a.dist) OVER ()::BIGINT AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN h USING (c)
"""
    )


ORACLE = _oracle()
