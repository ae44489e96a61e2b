"""Reports: counts, summaries and the output formats of findings.

Findings here have ``file, severity, message, code, start_line, start_col, end_line, end_col, start, end`` with
positions from 0; what is printed counts lines and columns from 1 and offsets from 0. The wording of summaries, warnings
and findings below are fixed values that readers of reports rely on.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def severity_counts(findings: DataFrame, counts_as: str = "severity") -> DataFrame:
    return findings.agg(F.count_if(F.col(counts_as) == "error").alias("errors"), F.count_if(F.col(counts_as) == "warning").alias("warnings"))


def files_with_findings(findings: DataFrame, file: str = "file") -> DataFrame:
    return findings.agg(F.count_distinct(file).alias("files"))


def _count_of(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def summary(findings: DataFrame, fail_on_warnings: bool = False, file: str = "file") -> DataFrame:
    """One row: ``text, failed``; the divider and the file part go when no file has findings."""
    row = findings.agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"), F.count_distinct(file).alias("f"))
    head = F.concat(F.lit("found "), _count_of(F.col("e"), "error"), F.lit(" and "), _count_of(F.col("w"), "warning"))
    text = F.when(F.col("f") == 0, head).otherwise(F.concat(F.lit("=" * 36 + "\n"), head, F.lit(" in "), _count_of(F.col("f"), "file")))
    return row.select(text.alias("text"), ((F.col("e") > 0) | (F.lit(fail_on_warnings) & (F.col("w") > 0))).alias("failed"))


def skipped_by_suffix(files: DataFrame, suffixes: list[str], name: str = "name") -> DataFrame:
    """``label, files, text`` in order of label: by the longest given suffix a name ends with, else its last extension, else the whole name."""
    longest = sorted(suffixes, key=lambda s: (-len(s), s))
    known = F.coalesce(*[F.when(F.col(name).endswith(s), s) for s in longest]) if longest else F.lit(None).cast("string")
    last = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    label = F.coalesce(known, F.when(last != "", last), F.col(name))
    rows = files.groupBy(label.alias("label")).agg(F.count("*").alias("files"))
    return rows.withColumn("text", F.concat(F.lit("warning: "), _count_of(F.col("files"), "file"), F.lit(" with unregistered extension ("), F.col("label"), F.lit(") skipped"))).orderBy("label")


def _place(prefix: str, offset: str) -> Column:
    return F.struct((F.col(f"{prefix}_line") + 1).alias("line"), (F.col(f"{prefix}_col") + 1).alias("column"), F.col(offset).alias("offset"))


def as_json(findings: DataFrame, source: str) -> DataFrame:
    """``json``: one object per finding."""
    return findings.select(F.to_json(F.struct(F.initcap("severity").alias("type"), F.col("file").alias("filename"), _place("start", "start").alias("start"), _place("end", "end").alias("end"), "message", "code", F.lit(source).alias("source"))).alias("json"))


def as_line(findings: DataFrame, code_family: str | None = None) -> DataFrame:
    """``line``: ``SEVERITY path:l:c:l:c message (code)``; a code family shows as ``family(code)``."""
    code = F.col("code") if code_family is None else F.concat(F.lit(f"{code_family}("), F.col("code"), F.lit(")"))
    places = [(F.col(c) + 1).cast("string") for c in ("start_line", "start_col", "end_line", "end_col")]
    return findings.select(F.concat(F.upper("severity"), F.lit(" "), F.concat_ws(":", "file", *places), F.lit(" "), "message", F.lit(" ("), code, F.lit(")")).alias("line"))


def _human(findings: DataFrame) -> Column:
    return F.concat(F.concat_ws(":", "file", (F.col("start_line") + 1).cast("string"), (F.col("start_col") + 1).cast("string")), F.lit("\n"), F.initcap("severity"), F.lit(": "), F.col("message"), F.lit(" ("), F.col("code"), F.lit(")\n"))


def as_text(findings: DataFrame) -> DataFrame:
    """``text``: place, then severity and message, then an empty line."""
    return findings.select(F.concat(_human(findings), F.lit("\n")).alias("text"))


def as_text_with_source(findings: DataFrame) -> DataFrame:
    """``text`` with the source line (``snippet``) and a caret under the start column, which counts bytes."""
    number = (F.col("start_line") + 1).cast("string")
    shown = F.concat(F.lit("  "), number, F.lit(" | "), F.col("snippet"), F.lit("\n  "), F.repeat(F.lit(" "), F.length(number)), F.lit(" | "), F.repeat(F.lit(" "), F.col("start_col").cast("int")), F.lit("^\n"))
    return findings.select(F.concat(_human(findings), F.coalesce(shown, F.lit("")), F.lit("\n")).alias("text"))


class Phases(dict):
    """Durations in ms by phase: ``with phases("scan"): ...`` measures one; a phase that did not run is not in it."""

    @contextmanager
    def __call__(self, phase: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self[phase] = self.get(phase, 0.0) + (time.perf_counter() - began) * 1000


    def job(self, phase: str, rows: DataFrame, write: Callable[[DataFrame], None], **counts: Column) -> dict[str, int]:
        """Has ``rows`` written and measures that; ``counts`` are aggregated from the rows as they pass by, in the same job."""
        seen = Observation(f"{phase}-{uuid.uuid4().hex}")
        with self(phase):
            write(rows.observe(seen, *[c.alias(n) for n, c in counts.items()]))
            return seen.get


def run_metrics(counts: DataFrame, phases: Sequence[str], measured: Mapping[str, float] | None = None) -> DataFrame:
    """``json``: one nested object of counts and of the durations of ``phases``, null for one that was not measured."""
    durations = F.struct(*[F.lit((measured or {}).get(p)).cast("double").alias(p) for p in phases])
    return counts.select(F.to_json(F.struct(F.struct(*counts.columns).alias("counts"), durations.alias("ms")), {"ignoreNullFields": "false"}).alias("json"))


def coverage_counts(left: DataFrame, right: DataFrame, code: str = "code") -> DataFrame:
    """``left_codes, right_codes, both, left_only, right_only`` of two code sets, kebab and snake case being equal."""
    a = left.select(F.translate(F.col(code), "-", "_").alias("c")).distinct().withColumn("l", F.lit(1))
    b = right.select(F.translate(F.col(code), "-", "_").alias("c")).distinct().withColumn("r", F.lit(1))
    j = a.join(b, "c", "full_outer")
    is_l, is_r = F.col("l").isNotNull(), F.col("r").isNotNull()
    return j.agg(F.count_if(is_l).alias("left_codes"), F.count_if(is_r).alias("right_codes"), F.count_if(is_l & is_r).alias("both"), F.count_if(is_l & ~is_r).alias("left_only"), F.count_if(is_r & ~is_l).alias("right_only"))
