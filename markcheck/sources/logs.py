"""Checker output and small configuration files as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POSITIONED = r"^(.*)\((\d+),(\d+)\):\s*(error|warning)\s+([^:]+):\s*(.*)$"
_GLOBAL = r"^\s*(error|warning)\s+(TS[0-9]+)\s*:\s*(.*\S)\s*$"


def parse_log(lines: DataFrame, default_file: str = "", line: str = "value") -> DataFrame:
    """``file, start_line, start_col, end_col, severity, code, message, position_unknown`` of checker output.

    ``file(line,col): error CODE: message``, where the path may hold parentheses, and ``error TS123: message``,
    which goes to ``default_file`` at 0:0; other lines go. The log has no end, so a span is one column wide.
    """
    text = F.col(line)
    placed = text.rlike(_POSITIONED)
    glob = ~placed & text.rlike(_GLOBAL)

    def pick(i: int, j: int | None, other: Column) -> Column:
        return F.when(placed, F.regexp_extract(text, _POSITIONED, i)).otherwise(other if j is None else F.regexp_extract(text, _GLOBAL, j))

    row = lines.where(placed | glob).select(
        pick(1, None, F.lit(default_file)).alias("file"),
        pick(2, None, F.lit("0")).cast("long").alias("start_line"),
        pick(3, None, F.lit("0")).cast("long").alias("start_col"),
        pick(4, 1, F.lit("")).alias("severity"),
        F.trim(pick(5, 2, F.lit(""))).alias("code"),
        F.trim(pick(6, 3, F.lit(""))).alias("message"),
        glob.alias("position_unknown"),
    )
    return row.withColumn("end_col", F.col("start_col") + F.when(F.col("position_unknown"), 0).otherwise(1))


def parse_results(rows: DataFrame, schema: str | T.StructType, text: str = "value") -> DataFrame:
    """JSON lines as ``r`` with a fixed schema; a row that carries ``error`` fails the batch."""
    parsed = rows.withColumn("r", F.from_json(text, schema))
    failed = F.get_json_object(text, "$.error")
    return parsed.where(F.when(failed.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("checker failed: "), failed)).cast("boolean")))


def compiler_place(line: Column, col: Column) -> tuple[Column, Column]:
    """Line of at least 1 and column from 1 of a position with columns from 0."""
    return F.greatest(line, F.lit(1)), col + 1


def word_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """``word``: distinct trimmed lines, without blank ones and ``#`` comments."""
    return lines.select(F.trim(line).alias("word")).where("word <> '' and word not like '#%'").distinct()


def parse_commented_json(text: Column, schema: str | T.StructType) -> Column:
    """JSON with ``//`` and ``/* */`` comments; bad JSON gives null fields."""
    return F.from_json(text, schema, {"allowComments": "true", "mode": "PERMISSIVE"})


def from_marker(lines: DataFrame, marker: str, by: str = "doc", order: str = "line", text: str = "text") -> DataFrame:
    """Lines from the first that begins with ``marker`` on; documents without one give nothing."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("__on", F.max(F.col(text).startswith(marker)).over(w)).where("__on").drop("__on")
