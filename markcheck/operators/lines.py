"""Line tables and conversions between byte offsets and lines.

Texts are partitioned by document before they are split, so one shuffle of the compact text serves the split, the
running offsets and every later window on the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of text that a task splits into rows; what it then sorts is some ten times as much.
SHARE = 8 << 20


def by_document(rows: DataFrame, texts: DataFrame, text: str, doc: str = "doc") -> DataFrame:
    """``rows`` dealt by ``doc`` to so many tasks that each has ``SHARE`` bytes of the ``texts``, whatever these add up to.

    Rows of equal texts are dealt alike. Counted in a job of its own, as adaptive execution goes by packed bytes, which
    say little of the rows that they are split into.
    """
    if texts.isStreaming:
        return rows.repartition(doc)
    total = texts.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return rows.repartition(total // SHARE + 1, doc)


def line_table(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``doc, line, start, end, text``: lines from 0 with byte spans; a last line feed opens one more, empty line."""
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("__t"))
    parts = by_document(texts, texts, "__t").select("doc", F.posexplode(F.split("__t", "\n", -1)).alias("line", "text"))
    size = F.octet_length("text").cast("long")
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(size + 1).over(w) - size - 1
    return parts.withColumn("start", start).select("doc", F.col("line").cast("long").alias("line"), "start", (F.col("start") + size).alias("end"), "text")


def as_of(points: DataFrame, marks: DataFrame, by: str, at: str, mark_at: str, values: list[str]) -> DataFrame:
    """``points`` with ``values`` of the last mark of the same ``by`` at or before ``at``: one sort per key, no inequality join."""
    fields = F.struct(*[F.col(v) for v in values])
    union = points.select(F.col(by), F.col(at).alias("__at"), F.lit(1).alias("__is"), F.struct(*points.columns).alias("__point"), F.lit(None).cast(marks.select(fields.alias("m")).schema["m"].dataType).alias("__mark")).unionByName(
        marks.select(F.col(by), F.col(mark_at).alias("__at"), F.lit(0).alias("__is"), F.lit(None).cast(points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType).alias("__point"), fields.alias("__mark"))
    )
    w = Window.partitionBy(by).orderBy("__at", "__is").rowsBetween(Window.unboundedPreceding, 0)
    found = union.withColumn("__mark", F.last("__mark", ignorenulls=True).over(w)).where("__is = 1")
    return found.select("__point.*", *[F.col("__mark")[v].alias(v) for v in values])


def line_col(lines: DataFrame, points: DataFrame, at: str = "offset") -> DataFrame:
    """Adds ``line`` and byte ``col`` (both from 0) of each offset; past the end it is the last line."""
    found = as_of(points, lines.select("doc", "line", F.col("start").alias("line_start")), "doc", at, "line_start", ["line", "line_start"])
    return found.withColumn("col", F.col(at) - F.col("line_start")).drop("line_start")


def offset_of(lines: DataFrame, points: DataFrame) -> DataFrame:
    """Adds ``offset`` of (doc, line, col), bytes from 0; a line that is not there gives null."""
    return points.join(lines.select("doc", "line", "start"), ["doc", "line"], "left").withColumn("offset", F.col("start") + F.col("col")).drop("start")


def offset_of_clamped(lines: DataFrame, points: DataFrame) -> DataFrame:
    """Adds ``offset`` of (doc, line, col) from 1 with character columns; a missing column gives the line's start, a missing line the end of the text."""
    ends = lines.groupBy("doc").agg(F.max("end").alias("__end"))
    joined = points.join(lines.select("doc", (F.col("line") + 1).alias("line"), "start", F.col("text").alias("__line"), F.col("end").alias("__stop")), ["doc", "line"], "left").join(ends, "doc", "left")
    last = F.col("__stop") == F.col("__end")
    width = F.char_length("__line") + F.when(last, 0).otherwise(1)  # the line feed is a column too
    inside = F.octet_length(F.substring(F.col("__line"), F.lit(1), (F.col("col") - 1).cast("int")))
    offset = F.when(F.col("start").isNull(), F.col("__end")).when((F.col("col") >= 1) & (F.col("col") <= width), F.col("start") + inside).otherwise(F.col("start"))
    return joined.withColumn("offset", F.coalesce(offset, F.lit(0)).cast("long")).drop("start", "__line", "__stop", "__end")


def enriched(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """Adds ``start`` and ``end``, byte offsets of (start_line, start_col) and (end_line, end_col), all from 0.

    Without the document or the line a start is 0, and an end is the start.
    """
    at = {x: lines.select("doc", F.col("line").alias(f"{x}_line"), F.col("start").alias(f"__{x}")) for x in ("start", "end")}
    joined = findings.join(at["start"], ["doc", "start_line"], "left").join(at["end"], ["doc", "end_line"], "left")
    start, end = F.col("__start") + F.col("start_col"), F.col("__end") + F.col("end_col")
    return joined.select(*findings.columns, F.coalesce(start, F.lit(0)).cast("long").alias("start"), F.coalesce(end, start, F.lit(0)).cast("long").alias("end"))


def placed(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """Adds ``start_line, start_col, end_line, end_col`` and ``snippet``, the text of the line that a finding starts on."""
    marks = lines.select("doc", "line", F.col("start").alias("at"), F.col("text").alias("snippet"))
    begun = as_of(findings, marks.withColumnsRenamed({"line": "start_line", "at": "start_at"}), "doc", "start", "start_at", ["start_line", "start_at", "snippet"])
    ended = as_of(begun, marks.select("doc", F.col("line").alias("end_line"), F.col("at").alias("end_at")), "doc", "end", "end_at", ["end_line", "end_at"])
    return ended.withColumns({"start_col": F.col("start") - F.col("start_at"), "end_col": F.col("end") - F.col("end_at")}).drop("start_at", "end_at")


def snippet(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """Adds ``snippet``, the text of the line a finding starts on."""
    return findings.join(lines.select("doc", F.col("line").alias("start_line"), F.col("text").alias("snippet")), ["doc", "start_line"], "left")
