"""Corpora as rows: files or tables, selected by suffix, glob and kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markcheck.functions import paths
from markcheck.sources import listing

#: Directories that no corpus wants.
DEFAULT_IGNORES = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/.cache/**")
#: Globs up to which one regular expression per filter is used.
INLINE_GLOBS = 20


def scan_files(spark: SparkSession, root: str, suffixes: Sequence[str], ignores: Sequence[str] = ()) -> DataFrame:
    """``path, text, bytes``: one row per file under ``root`` whose name ends with a suffix; others are not read.

    Folders that ``ignores`` has are not even listed.
    """
    files = listing.with_text(listing.listed(spark, root, suffixes, ignores).select("path"))
    return files.select("path", "text", F.octet_length("text").cast("long").alias("bytes"))


def from_table(rows: DataFrame, doc: Column, path: Column, text: str) -> DataFrame:
    """``doc, path, bytes, text`` of rows that hold whole texts."""
    return rows.select(doc.alias("doc"), path.alias("path"), F.octet_length(text).cast("long").alias("bytes"), F.col(text).alias("text"))


def with_suffix(files: DataFrame, native: Sequence[str], extra: Sequence[str] = (), path: str = "path") -> DataFrame:
    """Files whose path ends with one of the suffixes."""
    wanted = suffix_union(native, extra)
    return files.where(F.greatest(*[F.col(path).endswith(s) for s in wanted], F.lit(False)))


def distinct_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Every path once, in order."""
    return files.select(path).distinct().orderBy(path)


def suffix_union(native: Sequence[str], extra: Sequence[str]) -> list[str]:
    """Native suffixes first, then the extra ones, each once."""
    return list(dict.fromkeys([*native, *extra]))


def without_ignored(files: DataFrame, globs: Sequence[str] = DEFAULT_IGNORES, path: str = "path") -> DataFrame:
    """Files that no glob matches, nor a folder that they are in; many globs go as a table, a few as one expression."""
    patterns = [paths.glob_regex(g)[:-1] + "(?:/.*)?$" for g in globs]
    if not patterns:
        return files
    if len(patterns) <= INLINE_GLOBS:
        return files.where(~F.col(path).rlike("|".join(f"(?:{p})" for p in patterns)))
    table = files.sparkSession.createDataFrame([(p,) for p in patterns], "__re string")
    return files.join(F.broadcast(table), F.expr(f"{path} rlike __re"), "left_anti")  # as many rows as the caller listed


def kind(path: Column, longest_first: Sequence[tuple[str, str]], other: str = "unsupported") -> Column:
    """Kind by the first suffix that fits."""
    out = F.lit(other)
    for suffix, name in reversed(longest_first):
        out = F.when(path.endswith(suffix), name).otherwise(out)
    return out


def classified(path: Column, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """Class by ordered regular expressions over the path; the first that matches wins."""
    out = F.lit(other)
    for pattern, name in reversed(rules):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def path_cascade(lookups: DataFrame, keys: DataFrame, path: str = "path", key: str = "key") -> DataFrame:
    """``path, found, how``: exact, then the longest key the path ends with, then a basename that only one key has, else the cleaned path.

    Suffixes are tried as equal strings: a path is spelled out from each of its segments on, so no key is compared
    with every path.
    """
    asked = lookups.select(path).distinct()
    known = keys.select(F.col(key).alias("__key")).distinct()
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    tails = asked.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("__tail"))
    exact = asked.join(known, F.col(path) == F.col("__key")).select(path, F.col("__key").alias("found"), F.lit(1).alias("rank"))
    suffix = tails.join(known, F.col("__tail") == F.col("__key")).groupBy(path).agg(F.max_by("__key", F.struct(F.length("__key"), "__key")).alias("found")).withColumn("rank", F.lit(2))
    single = known.groupBy(paths.basename(F.col("__key")).alias("__base")).agg(F.min("__key").alias("found"), F.count("*").alias("n")).where("n = 1")
    base = asked.withColumn("__base", paths.basename(F.col(path))).where("__base <> ''").join(single, "__base").select(path, "found", F.lit(3).alias("rank"))
    best = exact.unionByName(suffix).unionByName(base).groupBy(path).agg(F.min_by(F.struct("found", "rank"), "rank").alias("best"))
    rank = F.col("best.rank")
    how = F.when(rank == 1, "exact").when(rank == 2, "suffix").when(rank == 3, "basename").otherwise("none")
    cleaned = F.when(F.col(path).startswith("/"), F.col(path)).otherwise(paths.normalized(F.col(path)))
    return asked.join(best, path, "left").select(path, F.coalesce("best.found", cleaned).alias("found"), how.alias("how"))
