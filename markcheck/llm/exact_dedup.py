"""Exact deduplication by skew-safe combining.

Copies are first combined inside each map task, then per (digest, salt), then per digest; every stage groups on
the digest *and* the full normalised text, so a digest collision can never merge two texts. A hot group reaches
the shuffle as at most one row per map task and salt.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markcheck.llm._drop import without
from markcheck.scratch import materialize

#: Characters that do not count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
_TOP = Decimal(2**63)
_STEP = Decimal(10**20)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One decimal that orders by most code points, then smallest id; an unknown id comes last.

    A decimal is a fixed-width aggregation buffer, so max() of it stays a hash aggregate beside a long text key.
    """
    by_id = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(Decimal(0)))
    return (n_chars.cast("decimal(12,0)") * F.lit(_STEP).cast("decimal(21,0)") + by_id.cast("decimal(20,0)")).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    by_id = rank % F.lit(_STEP).cast("decimal(38,0)")
    return F.when(by_id > 0, (F.lit(_TOP).cast("decimal(38,0)") - by_id).cast("long"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=_sha256) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without blanks; null counts as empty, and all empty texts form one group. The
    row with the most code points stays, then the smallest id; a null id loses every tie. Rows that repeat one id
    are one document and are kept or dropped together. Other columns are ignored, an empty table gives an empty
    result. ``digest`` may be any Column function; its collisions cost time, never correctness. Texts of any
    length are compared whole.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        norm.alias("norm"),
        digest(norm).alias("digest"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_cp"),
    )
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.max(_rank(F.col("n_cp"), F.col("doc_id"))).alias("best"), F.count("*").alias("n"))
    )
    groups = (
        salted.repartition("digest")  # serves both the grouping and the collision count below
        .groupBy("digest", "norm")
        .agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
        .selectExpr("digest", "norm", "best", "group_size", "count(*) over (partition by digest) as variants")
        .select(F.col("digest").alias("g_digest"), _id_of(F.col("best")).alias("keep_id"), "group_size", F.when(F.col("variants") > 1, F.col("norm")).alias("g_norm"))
    )
    groups = materialize(groups, "exact-groups")
    by_digest = F.col("digest") == F.col("g_digest")
    singles = groups.where("g_norm is null").drop("g_norm")
    collided = groups.where("g_norm is not null")
    if collided.isEmpty():
        joined = rows.drop("norm", "n_cp").join(singles, by_digest)
    else:
        joined = rows.join(singles, by_digest).unionByName(rows.join(collided, by_digest & (F.col("norm") == F.col("g_norm"))), allowMissingColumns=True)
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row keeps; columns stay as they are, rows without an id stay.

    All empty texts and nulls are copies of each other; rows that repeat an id go together if one of them goes.
    """
    return without(docs, exact_groups(docs, id_col, text_col).where("not kept and doc_id is not null").select("doc_id"), id_col)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
