"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash. Per source, sizes are summed by hash bucket, the bucket in which the running sum
crosses the budget is found, and only its documents are summed again by finer buckets. What results is one hash
threshold per source, so the selection is a plain filter: no document is ever sorted, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markcheck.scratch import materialize

#: Bits of hash and bits added by each refinement.
BITS, STEP = 60, 12


def _keys(id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """Source (null sorts last), size and hash of a row."""
    return {
        "src": F.coalesce(F.concat(F.lit("a"), F.col(source_col).cast("string")), F.lit("b")),
        "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long"),
        "h": F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long"),
    }


def _ranked(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Adds ``w`` by global position of ``src``: range partitions are numbered apart, then offset by what precedes them."""
    ranged = sources.repartitionByRange("src").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "mix-sources")
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))  # a row per partition
    pos = F.row_number().over(Window.partitionBy("part").orderBy("src")) - 1 + F.col("offset")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(pos, F.lit(len(weights))) + 1).cast("int"))
    return ranged.join(before, "part").select("src", "source_size", w.alias("w"))


def _level(ranked: DataFrame, cap: float) -> float:
    """The weight unit at which targets, stopped at ``cap`` times their source, add up to all sizes."""
    stop = F.col("source_size") * F.lit(cap)
    total, unit, known = None, None, -1
    while True:
        over = F.col("w") * F.lit(unit) > stop if unit is not None else F.lit(False)
        row = _totals(ranked, over, stop)
        total = row["total"] if total is None else total
        if row["capped"] == known or not row["rest"]:
            return unit or 0.0
        known, unit = row["capped"], (total - row["stopped"]) / row["rest"]


def _totals(ranked: DataFrame, over, stop):
    return ranked.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
        F.count_if(over).alias("capped"),
        F.coalesce(F.sum(F.when(over, stop)), F.lit(0.0)).alias("stopped"),
        F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)).alias("rest"),
    ).first()


def _plan(base: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """``src, source_size, target, whole, under`` of ``base(src, size, h)``: one row per source.

    A document is taken ``whole`` times, and once more if its hash is lower than ``under``.
    """
    hist = materialize(base.groupBy("src", F.shiftright("h", BITS - STEP).alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n")), "mix-hist")
    ranked = _ranked(hist.groupBy("src").agg(F.sum("s").alias("source_size")), weights)
    ranked = materialize(ranked, "mix-ranked")
    unit = _level(ranked, cap)
    stop = F.col("source_size") * F.lit(float(cap))
    target = F.least(F.col("w") * F.lit(float(unit)), stop)
    whole = F.when(F.col("source_size") == 0, 0).when(target >= stop, cap).otherwise(F.floor(target / F.col("source_size"))).cast("long")
    plan = ranked.select("src", "source_size", target.alias("target"), whole.alias("whole"), (target - whole * F.col("source_size")).alias("rest"))

    cuts, shift = _cut(hist.join(plan.select("src", "rest"), "src").withColumn("base", F.lit(0).cast("long"))), BITS - STEP
    cuts = materialize(cuts, "mix-cuts")
    while shift > 0 and (cuts.agg(F.max("n")).first()[0] or 0) > 1:
        inside = base.join(cuts.select("src", "b", "rest", F.col("before").alias("base")), (base["src"] == cuts["src"]) & (F.shiftright(base["h"], shift) == cuts["b"]))
        shift -= STEP
        finer = inside.groupBy(base["src"], F.shiftright(base["h"], shift).alias("b"), "rest", "base").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        cuts = materialize(_cut(finer), "mix-cuts")
    takes = (2 * F.col("before") + F.col("s") <= 2 * F.col("rest")).cast("long")
    plan = plan.join(cuts.select("src", (F.shiftleft(F.col("b") + takes, shift)).alias("under")), "src", "left")
    return materialize(plan.select("src", "source_size", "target", "whole", F.coalesce("under", F.lit(0)).alias("under")), "mix-plan")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, repeats``.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes (words); a
    target stops at ``cap`` times its source and the excess is shared again. A document is taken as often as its
    source fits whole into the target, and once more if its hash is under the source's threshold. The document at
    the threshold is taken when that leaves the sum nearer to the target. Null and empty texts have size 0; a null
    source is a source; rows that repeat an id share its hash and so its fate; an empty table gives no rows. A text of any length is
    counted whole and read once; only its size goes on.
    """
    base = materialize(docs.select(F.col(id_col).alias("doc_id"), *(c.alias(n) for n, c in _keys(id_col, text_col, source_col).items())), "mix-base")
    rows = base.join(_plan(base, weights, cap), "src")
    repeats = (F.col("whole") + (F.col("h") < F.col("under")).cast("long")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``size, source_size, target, taken, repeats`` added.

    An added column whose name ``docs`` has is named ``mix_`` and that name. Every row has its own size, also where
    rows repeat an id; texts are not shuffled, as only one row per source is joined.
    """
    keys = _keys(id_col, text_col, source_col)
    base = materialize(docs.select(*(c.alias(n) for n, c in keys.items())), "mix-base")
    plan = _plan(base, weights, cap)
    plan = plan.select(*(F.col(c).alias(f"__{c}") for c in plan.columns))
    rows = docs.withColumns({f"__{n}": c for n, c in keys.items()}).join(plan, "__src")
    repeats = (F.col("__whole") + (F.col("__h") < F.col("__under")).cast("long")).cast("long")
    added = {"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"), "taken": F.col("__size") * repeats, "repeats": repeats}
    return rows.where(repeats > 0).select(*docs.columns, *(c.alias(f"mix_{n}" if n in docs.columns else n) for n, c in added.items()))


def _cut(buckets: DataFrame) -> DataFrame:
    """Per source the bucket in which the running sum of sizes passes ``rest``."""
    upto = F.sum("s").over(Window.partitionBy("src").orderBy("b")) + F.col("base")
    return buckets.withColumn("before", upto - F.col("s")).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("s") > F.col("rest"))).select("src", "b", "s", "n", "before", "rest")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src
), r AS (
  SELECT src, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS w FROM s
), o AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         sum(w) OVER (ORDER BY 3.0 * source_size / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0 * source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
         (SELECT sum(source_size) FROM s)::DOUBLE AS total
  FROM r
), u AS (
  SELECT (total - stopped) / rest_w AS unit FROM o WHERE (total - stopped) / rest_w * w <= cap
  ORDER BY 3.0 * source_size / w, src LIMIT 1
), t AS (
  SELECT src, source_size, cap, least(w * unit, cap) AS target FROM o, u
), p AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN target >= cap THEN 3 ELSE floor(target / source_size) END::BIGINT AS whole FROM t
), q AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(size) OVER (PARTITION BY src ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY src, h) AS own
  FROM d JOIN p USING (src)
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * (upto - own) + own <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q
"""
