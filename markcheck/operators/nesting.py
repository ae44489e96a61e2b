"""Depth, pairing and order of nested events as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def depth(events: DataFrame, step: Column, by: str, order: list[str]) -> DataFrame:
    """Adds ``depth`` after each event: the running sum of ``step`` (+1 push, -1 pop) that never falls below zero."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("__s", F.sum(step).over(w))
    return summed.withColumn("depth", (F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).cast("long")).drop("__s")


def tag_depth(events: DataFrame) -> DataFrame:
    """Depth of tag events; a close tag pops whatever its name, void and self-closing tags never push."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    return depth(events, step, "doc", ["start", "end"])  # a synthetic close is empty and comes first


def pairs(events: DataFrame) -> DataFrame:
    """Open and close events with ``level``, the ``opener`` (name, start) of each close and ``closed`` of each open.

    Stray closes, at depth zero, are removed before pairing, else they would pair with elements closed already.
    """
    deep = tag_depth(events.where("kind in ('open', 'close')"))
    w = Window.partitionBy("doc").orderBy("start", "end")
    live = deep.withColumn("__before", F.lag("depth", 1, 0).over(w)).where("kind = 'open' or __before > 0")
    live = live.withColumn("level", F.when(F.col("kind") == "open", F.col("depth")).otherwise(F.col("depth") + 1))
    at_level = Window.partitionBy("doc", "level").orderBy("start", "end")
    opener = F.last(F.when(F.col("kind") == "open", F.struct("name", "start")), ignorenulls=True).over(at_level.rowsBetween(Window.unboundedPreceding, -1))
    return live.withColumn("opener", F.when(F.col("kind") == "close", opener)).withColumn("closed", F.when(F.col("kind") == "open", F.lead("start").over(at_level).isNotNull())).drop("__before")


def framed(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tag events with ``frame``: where the innermost block or part of a block that holds them begins, -1 outside of all.

    Blocks nest among themselves, whatever tags stand between; an end without a block, and a part outside of any, count
    for nothing. An element is opened and closed in one frame.
    """
    marks = blocks.select("doc", "start", "end", "kind").withColumn("__block", F.lit(True))
    step = F.when(F.col("__block") & (F.col("kind") == "block"), 1).when(F.col("__block") & (F.col("kind") == "end"), -1).otherwise(0)
    rows = depth(events.unionByName(marks, allowMissingColumns=True), step, "doc", ["start", "end"])
    at_level = Window.partitionBy("doc", "depth").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.when(F.col("__block") & F.col("kind").isin("block", "part"), F.col("start"))
    frame = F.when(F.col("depth") > 0, F.last(begins, ignorenulls=True).over(at_level)).otherwise(F.lit(-1).cast("long"))
    return rows.withColumn("frame", frame).where("__block is null").drop("__block", "depth")


def level_skips(rows: DataFrame, by: str, order: list[str], level: str) -> DataFrame:
    """Rows whose level exceeds the previous row's by more than one, with ``previous``; the first may be any level."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("previous", F.lag(level).over(w)).where(F.col(level) > F.col("previous") + 1)


#: Close tags that end an open item whose end tag was left out; another item does, too.
_LISTS = ("ul", "ol", "menu")
#: What the fold notes of an item, by how its name is written.
_ITEMS = {"li": "a", "LI": "b", "Li": "c", "lI": "d"}
#: Notes that the fold gathers before it puts them aside.
RUN = 1024


def _below(stack: Column) -> Column:
    return F.substring(stack, 2, 2**31 - 1)


def implicit_closes(events: DataFrame) -> DataFrame:
    """``doc, start, end, kind, name, synthetic``: tag events with synthetic closes where an end tag was left out.

    What is closed depends on the stack, so documents with items are folded, one group each, as large as the document.
    The stack is a string, innermost element first, in which only items are told apart; no more than one item ends at
    a tag, as an item never stands directly in an item. Events that lie by document are not shuffled again.
    """
    item = (F.col("kind") == "open") & (F.lower("name") == "li")
    grouped = events.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "name"))).alias("__e"), F.max(item).alias("__items"))
    state = F.struct(F.lit("").alias("stack"), F.lit("").alias("run"), F.expr("cast(array() as array<string>)").alias("runs"))

    def step(s: Column, e: Column) -> Column:
        name, opens, closes = F.lower(e["name"]), e["kind"] == "open", e["kind"] == "close"
        top = F.substring(s["stack"], 1, 1)
        ends = ~top.isin("", ".") & ((opens & (name == "li")) | (closes & name.isin(*_LISTS)))
        rest = F.when(ends, _below(s["stack"])).otherwise(s["stack"])
        mark = F.coalesce(F.create_map(*[F.lit(x) for kv in _ITEMS.items() for x in kv])[e["name"]], F.lit("."))
        run = F.concat(s["run"], F.when(ends, top).otherwise("."))
        full = F.octet_length(run) >= RUN
        return F.struct(
            F.when(opens, F.concat(mark, rest)).when(closes, _below(rest)).otherwise(rest).alias("stack"),
            F.when(full, "").otherwise(run).alias("run"),
            F.when(full, F.concat(s["runs"], F.array(run))).otherwise(s["runs"]).alias("runs"),
        )

    noted = F.aggregate("__e", state, step, lambda s: F.split(F.concat(F.array_join(s["runs"], ""), s["run"]), ""))
    noted = F.when(F.col("__items"), noted).otherwise(F.expr("cast(array() as array<string>)"))
    rows = grouped.select("doc", F.explode(F.arrays_zip(F.col("__e").alias("e"), noted.alias("note"))).alias("z")).where("z.e is not null")
    left_out = F.create_map(*[F.lit(x) for n, mark in _ITEMS.items() for x in (mark, n)])[F.col("z.note")]
    own = F.struct("z.e.start", "z.e.end", "z.e.kind", "z.e.name", F.lit(False).alias("synthetic"))
    close = F.struct("z.e.start", F.col("z.e.start").alias("end"), F.lit("close").alias("kind"), left_out.alias("name"), F.lit(True).alias("synthetic"))
    return rows.select("doc", F.explode(F.when(left_out.isNull(), F.array(own)).otherwise(F.array(close, own))).alias("e")).select("doc", "e.*")


def with_optional_ends(events: DataFrame) -> DataFrame:
    """``doc, start, end, kind, name`` of tag events and of the ends that were left out."""
    return implicit_closes(events).drop("synthetic")


def attach_nearest(rows: DataFrame, is_host: Column, is_pending: Column, by: str, order: str, host: str) -> DataFrame:
    """Pending rows with ``attached``: the next host's value, else the previous one's; without any host they go."""
    w = Window.partitionBy(by).orderBy(order)
    value = F.when(is_host, F.col(host))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("attached", F.coalesce(after, before)).where(is_pending & F.col("attached").isNotNull())


