"""Choosing and applying text edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Decisions that the fold over overlapping edits gathers before it puts them aside.
RUN = 1024


def pick_edits(edits: DataFrame, by: str = "doc") -> DataFrame:
    """Edits (start, end, ord, ...) in order of start, then ``ord``, without invalid ones and those that begin before the last kept end.

    Touching edits stay; ``ord`` names an edit of its document; an edit with a null start or end is invalid. An edit that
    begins where all earlier ones have ended is kept whatever was chosen before, so a document falls into stretches of
    overlapping edits that are chosen apart: running maxima find them, and one fold goes over each. The fold carries the
    end reached and one character for each decision, in runs of a fixed length, so that a step copies no more than a run.
    """
    valid = edits.select(by, "start", "ord", "end").where("start >= 0 and end >= start")
    before = Window.partitionBy(by).orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(by).orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))
    stretches = valid.withColumn("__fresh", fresh.cast("long")).withColumn("__stretch", F.sum("__fresh").over(upto))
    ordered = stretches.groupBy(by, "__stretch").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "end"))).alias("__e"))
    state = F.struct(F.lit(0).cast("long").alias("reach"), F.lit("").alias("run"), F.expr("cast(array() as array<string>)").alias("runs"))

    def step(s, e):
        ok = e["start"] >= s["reach"]
        run = F.concat(s["run"], F.when(ok, "1").otherwise("0"))
        full = F.octet_length(run) >= RUN
        return F.struct(
            F.when(ok, e["end"]).otherwise(s["reach"]).cast("long").alias("reach"),
            F.when(full, "").otherwise(run).alias("run"),
            F.when(full, F.concat(s["runs"], F.array(run))).otherwise(s["runs"]).alias("runs"),
        )

    decided = F.aggregate("__e", state, step, lambda s: F.split(F.concat(F.array_join(s["runs"], ""), s["run"]), ""))
    both = ordered.select(by, F.explode(F.arrays_zip(F.col("__e.ord").alias("ord"), decided.alias("kept"))).alias("z"))
    return edits.join(both.where("z.kept = '1'").select(by, "z.ord"), [by, "ord"], "left_semi")


def apply_edits(docs: DataFrame, edits: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``docs`` with ``edits(doc, start, end, replacement)`` applied; they must not overlap; offsets count characters."""
    parts = edits.groupBy(F.col("doc").alias("__d")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("__e"))
    joined = docs.join(parts, F.col(doc) == F.col("__d"), "left")
    size = F.size("__e")

    def piece(e, i):
        before = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("__e", i - 1)["end"])
        return F.concat(F.substring(F.col(text), (before + 1).cast("int"), (e["start"] - before).cast("int")), e["replacement"])

    tail = F.substring(F.col(text), (F.get("__e", size - 1)["end"] + 1).cast("int"), F.length(text))
    edited = F.concat(F.array_join(F.transform("__e", piece), ""), tail)
    return joined.withColumn(text, F.when(size > 0, edited).otherwise(F.col(text))).drop("__d", "__e")
