"""Re-checking only what changed, by content fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markcheck.scratch import materialize
from markcheck.sources import versions


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of all parts, each ended by NUL; an unknown part counts as ``unknown``."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("unknown")), F.lit("\0")) for p in parts]), 256)


def reuse_split(current: DataFrame, stored: DataFrame, key: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """Rows whose result is stored, and rows to compute."""
    return current.join(stored.select(key).distinct(), key, "left_semi"), current.join(stored.select(key).distinct(), key, "left_anti")


def reused(current: DataFrame, stored: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "fingerprint", result: str = "result", order: str | None = "ordinal") -> DataFrame:
    """``current`` with ``result`` and ``reused``: stored results, and what ``compute`` gives for the rest; sorted by ``order`` if that is given.

    ``stored`` is (key, result); ``compute`` adds ``result`` to the rows it is given. Both halves come of one join, whose
    shuffles they share.
    """
    once = stored.groupBy(key).agg(F.first(F.struct(result)).alias("__stored"))
    joined = current.join(once, key, "left")
    kept = joined.where("__stored is not null").select(*current.columns, f"__stored.{result}").withColumn("reused", F.lit(True))
    fresh = compute(joined.where("__stored is null").select(*current.columns)).withColumn("reused", F.lit(False))
    out = kept.unionByName(fresh.select(*kept.columns))
    return out if order is None else out.orderBy(order)


def change_classes(new: DataFrame, old: DataFrame, key: str, content: str = "fingerprint") -> DataFrame:
    """``key, change``: added, changed, unchanged or removed."""
    n, o = new.select(key, F.col(content).alias("__new")), old.select(key, F.col(content).alias("__old"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__new") == F.col("__old"), "unchanged").otherwise("changed")
    return n.join(o, key, "full_outer").select(key, change.alias("change"))


def stale_keys(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return stored.join(current.select(key).distinct(), key, "left_anti")


def group_fingerprints(rows: DataFrame, group: str, name: str, content: str, fallback: Column | None = None) -> DataFrame:
    """``group, members, manifest``: hash of a group's members by name; ``fallback`` members count only where there are no others.

    Members hash to one sum per group that combines before the shuffle and does not depend on order, so a group of
    any size never meets in one task: the digest is taken over count and four 60-bit sums of member hashes.
    """
    member = F.sha2(F.concat(F.col(name).cast("string"), F.lit("\0"), F.col(content)), 256)
    part = [F.conv(F.substring(member, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    later = F.lit(False) if fallback is None else F.coalesce(fallback, F.lit(False))
    sums = rows.groupBy(group).agg(*(agg for to, which in (("", ~later), ("f", later)) for agg in (F.count_if(which).alias(f"__n{to}"), *(F.sum(F.when(which, p)).alias(f"__s{to}{i}") for i, p in enumerate(part)))))
    fields = ("__n", *(f"__s{i}" for i in range(4)))
    used = sums.select(group, *(F.when(F.col("__n") > 0, F.col(f)).otherwise(F.col(f.replace("__n", "__nf").replace("__s", "__sf"))).alias(f) for f in fields))
    return used.select(group, F.col("__n").alias("members"), F.sha2(F.concat_ws("|", *[F.col(f).cast("string") for f in fields]), 256).alias("manifest"))


def invalidated(stored: DataFrame, old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Stored rows of groups whose manifest is not the one they were stored under."""
    same = old.select(group, "manifest").join(new.select(group, "manifest"), [group, "manifest"]).select(group)
    return stored.join(same, group, "left_anti")


def dependents(changed: DataFrame, references: DataFrame, key: str = "path", target: str = "target") -> DataFrame:
    """``key`` of what has to be checked again when ``changed`` is: those, what refers to them, what refers to that, and so on.

    ``references`` is (key, target). Each round joins only what the last one found, and drops what was found before, so
    circles end and a reference is followed once. Rounds are written tables; their number is the longest chain.
    """
    edges = materialize(references.select(F.col(key).alias("__from"), F.col(target).alias("__to")).where("__from is not null and __to is not null").distinct(), "references")
    reached = fresh = materialize(changed.select(key).distinct(), "reached")
    while not fresh.isEmpty():
        next_ones = edges.join(fresh, edges["__to"] == fresh[key]).select(F.col("__from").alias(key)).distinct()
        fresh = materialize(next_ones.join(reached, key, "left_anti"), "reached")
        reached = reached.unionByName(fresh)
    return reached


def mirror_plan(source: DataFrame, mirror: DataFrame, key: str, content: str = "fingerprint") -> DataFrame:
    """``key, action``: copy, keep or delete."""
    classes = change_classes(source, mirror, key, content)
    return classes.select(key, F.when(F.col("change").isin("added", "changed"), "copy").when(F.col("change") == "removed", "delete").otherwise("keep").alias("action"))


def results_per_key(keys: DataFrame, results: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Every key with its ordered results; none is an empty list."""
    lists = results.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("results"))
    kind = lists.schema["results"].dataType.simpleString()
    return keys.select(key).distinct().join(lists, key, "left").withColumn("results", F.coalesce("results", F.expr(f"cast(array() as {kind})")))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that stand at ``path``, None before the first version."""
    return versions.read(spark, path)


def write_changed(rows: DataFrame, path: str, key: str, content: str, prune: bool = True) -> dict[str, int]:
    """Adds a version with the rows that differ from the snapshot at ``path``; gives how many were written, skipped and removed.

    Nothing is written where nothing differs. With ``prune`` the snapshot becomes ``rows``, without it rows of other keys
    stay. A writer that another one was faster than compares again with what that left, so no row is lost and the
    numbers are those of what was written; one that fails leaves the snapshot as it was.
    """
    rows = rows.select(key, *(c for c in rows.columns if c != key))
    new = rows.withColumn("__fp", fingerprint(F.col(content)))
    counts: dict[str, int] = {}

    def change(last: DataFrame | None) -> tuple[DataFrame, DataFrame] | None:
        old = rows.limit(0) if last is None else last.select(*rows.columns)
        classes = materialize(change_classes(new, old.withColumn("__fp", fingerprint(F.col(content))), key, "__fp"), "changes")
        found = {r["change"]: r["count"] for r in classes.groupBy("change").count().collect()}
        removed = found.get("removed", 0) if prune else 0
        counts.update(written=found.get("added", 0) + found.get("changed", 0), skipped=found.get("unchanged", 0), removed=removed)
        if not (counts["written"] or removed):
            return None
        gone = classes.where("change = 'removed'") if prune else classes.limit(0)
        return rows.join(classes.where("change in ('added', 'changed')"), key, "left_semi"), gone.select(key)

    versions.replace(rows.sparkSession, path, key, change)
    return counts


def correlate(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """``key, answers, state``: answered, repeated, missing or unknown."""
    asked = requests.groupBy(key).agg(F.count("*").alias("__asked"))
    got = responses.groupBy(key).agg(F.count("*").alias("answers"))
    n = F.coalesce("answers", F.lit(0))
    state = F.when(F.col("__asked").isNull(), "unknown").when(n == 0, "missing").when(n == 1, "answered").otherwise("repeated")
    return asked.join(got, key, "full_outer").select(key, n.cast("long").alias("answers"), state.alias("state"))


def assert_correlated(states: DataFrame) -> DataFrame:
    """Passes rows on, and fails on a request without or with several answers, or an answer to none."""
    return states.where(F.when(F.col("state") == "answered", True).otherwise(F.raise_error(F.concat(F.lit("not answered exactly once: "), F.col("state"))).cast("boolean")))
