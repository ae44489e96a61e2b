"""Joins and algebra over half-open spans ``[start, end)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markcheck.operators.lines import as_of

#: A cell of the finest level covers 2 ** CELL positions, one of the next level 2 ** STEP times as many.
CELL, STEP = 10, 7
#: Levels of cells: with these no span of up to 2 ** 30 positions touches more than 65 cells.
LEVELS = 3


def contains(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (at < end)


def contains_span(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    """An empty span lies in a span that it touches."""
    return (start <= inner_start) & (inner_end <= end)


def cover(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.struct(F.least(a_start, b_start).alias("start"), F.greatest(a_end, b_end).alias("end"))


def _cell(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at.cast("long"), (CELL + STEP * level).cast("int"))


def _in_cells(spans: DataFrame, start: str, end: str, levels: int) -> DataFrame:
    """Spans with ``__level``, by their length, once per ``__cell`` of that level that they touch; empty ones go."""
    bits = F.length(F.bin(F.greatest(F.col(end) - F.col(start), F.lit(1)).cast("long") - 1))
    level = F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor((bits - CELL) / STEP))).cast("int")
    placed = spans.where(F.col(end) > F.col(start)).withColumn("__level", level)
    return placed.withColumn("__cell", F.explode(F.sequence(_cell(F.col(start), F.col("__level")), _cell(F.col(end) - 1, F.col("__level")))))


def point_in_span(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, by: str = "doc", how: str = "inner", levels: int = LEVELS) -> DataFrame:
    """Every point with every span of the same ``by`` that contains it; ``how`` is inner, left, left_semi or left_anti.

    Both sides meet in cells of positions, so the range condition is an equi-join that shuffles and splits like any
    other. Long spans go to levels of wider cells, so that a span is repeated a few times whatever its length; a point
    looks into its cell of each level. ``levels`` changes the plan only: one level does where all spans are short.
    Columns of the sides must differ but for ``by``. Points and spans with nulls, and empty spans, meet nothing.
    """
    if how != "inner":
        hits = point_in_span(points.select(by, at).distinct(), spans.select(by, start, end), at, start, end, by, "inner", levels).select(by, at).distinct()
        if how in ("left_semi", "left_anti"):
            return points.join(hits, [by, at], how).select(*points.columns)
        if how != "left":
            raise ValueError(f"how: {how}")
        return point_in_span(points, spans, at, start, end, by, "inner", levels).unionByName(points.join(hits, [by, at], "left_anti"), allowMissingColumns=True)
    placed = _in_cells(spans, start, end, levels)
    probes = points.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in range(levels)]))).withColumn("__cell", _cell(F.col(at), F.col("__level")))
    meet = (F.col(f"p.{by}") == F.col(f"s.{by}")) & (F.col("p.__level") == F.col("s.__level")) & (F.col("p.__cell") == F.col("s.__cell"))
    joined = probes.alias("p").join(placed.alias("s"), meet & contains(F.col(f"s.{start}"), F.col(f"s.{end}"), F.col(f"p.{at}")))
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{c}") for c in spans.columns if c != by])


def to_original(points: DataFrame, span_map: DataFrame, at: str = "offset") -> DataFrame:
    """Adds ``original``: position of a generated one in the source, null where no mapping holds it."""
    found = as_of(points, span_map, "doc", at, "gen_start", ["gen_start", "gen_end", "orig_start"])
    inside = contains(F.col("gen_start"), F.col("gen_end"), F.col(at))
    return found.withColumn("original", F.when(inside, F.col("orig_start") + F.col(at) - F.col("gen_start"))).drop("gen_start", "gen_end", "orig_start")


def to_generated(points: DataFrame, span_map: DataFrame, at: str = "offset") -> DataFrame:
    """Adds ``generated``: the first mapping, in generated order, whose original span holds the point."""
    hits = point_in_span(points.select("doc", at).distinct(), span_map, at, "orig_start", "orig_end")
    first = hits.groupBy("doc", at).agg(F.min_by(F.col("gen_start") + F.col(at) - F.col("orig_start"), "gen_start").alias("generated"))
    return points.join(first, ["doc", at], "left")


def fragment_spans(fragments: DataFrame, by: str = "doc", order: str = "ord", text: str = "text", is_source: str = "is_source") -> DataFrame:
    """``doc, ord, gen_start, gen_end, orig_start, orig_end`` of ordered fragments; synthetic ones only move the generated side."""
    size = F.octet_length(text).cast("long")
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = fragments.withColumn("gen_end", F.sum(size).over(w)).withColumn("orig_end", F.sum(F.when(F.col(is_source), size).otherwise(0)).over(w))
    return rows.where(F.col(is_source)).select(by, order, (F.col("gen_end") - size).alias("gen_start"), "gen_end", (F.col("orig_end") - size).alias("orig_start"), "orig_end")


def _shifts(edits: DataFrame) -> DataFrame:
    """Cumulated shift from each edit position on."""
    sums = edits.groupBy("doc", "at").agg(F.sum("delta").cast("long").alias("delta"))
    return sums.withColumn("shift", F.sum("delta").over(Window.partitionBy("doc").orderBy("at")))


def shift_spans(span_map: DataFrame, edits: DataFrame) -> DataFrame:
    """The span map after ``edits(doc, at, delta)`` of the generated text.

    A span that an edit falls strictly into is split there; what starts at or after an edit moves by its delta;
    empty pieces go and positions never fall below zero.
    """
    shifts = _shifts(edits)
    columns = ["doc", "gen_start", "gen_end", "orig_start"]
    inner = point_in_span(shifts.select("doc", "at"), span_map.select(*columns), "at", "gen_start", "gen_end").where("at > gen_start")
    cuts = span_map.select(*columns, F.col("gen_start").alias("piece")).unionByName(inner.select(*columns, F.col("at").alias("piece")))
    w = Window.partitionBy(*columns).orderBy("piece")
    cuts = cuts.withColumn("stop", F.coalesce(F.lead("piece").over(w), "gen_end")).where("stop > piece")
    moved = as_of(cuts, shifts, "doc", "piece", "at", ["shift"])
    shift = F.coalesce("shift", F.lit(0))
    origin = F.col("orig_start") + F.col("piece") - F.col("gen_start")
    return moved.select(
        "doc",
        F.greatest(F.lit(0), F.col("piece") + shift).cast("long").alias("gen_start"),
        F.greatest(F.lit(0), F.col("stop") + shift).cast("long").alias("gen_end"),
        origin.cast("long").alias("orig_start"),
        (origin + F.col("stop") - F.col("piece")).cast("long").alias("orig_end"),
    )


def drop_overlapped(spans: DataFrame, edits: DataFrame) -> DataFrame:
    """Spans (doc, start, end) that no edit (doc, edit_start, edit_end, delta) overlaps, moved by the edits before them.

    With the edits' ends running ahead monotonously (as non-overlapping edits do), the last edit that starts before
    a span's end is the only one that can overlap it.
    """
    reach = edits.withColumn("reach", F.max("edit_end").over(Window.partitionBy("doc").orderBy("edit_start").rowsBetween(Window.unboundedPreceding, 0)))
    probed = as_of(spans.withColumn("__last", F.col("end") - 1), reach, "doc", "__last", "edit_start", ["reach"])
    kept = probed.where("reach is null or reach <= start").drop("reach", "__last")
    shifts = _shifts(edits.select("doc", F.col("edit_end").alias("at"), "delta"))
    moved = as_of(kept, shifts, "doc", "start", "at", ["shift"])
    shift = F.coalesce("shift", F.lit(0))
    return moved.select("doc", (F.col("start") + shift).cast("long").alias("start"), (F.col("end") + shift).cast("long").alias("end"))


def interpolate(points: DataFrame, anchors: DataFrame, by: str, at: str, anchor_at: str, anchor_to: str) -> DataFrame:
    """Adds ``mapped``: the last anchor's target plus the distance from it; null before the first anchor."""
    found = as_of(points, anchors.select(by, F.col(anchor_at).alias("__from"), F.col(anchor_to).alias("__to")), by, at, "__from", ["__from", "__to"])
    return found.withColumn("mapped", F.col("__to") + F.col(at) - F.col("__from")).drop("__from", "__to")
