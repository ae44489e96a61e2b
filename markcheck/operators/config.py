"""Layered configuration as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markcheck.scratch import materialize


def layered(settings: DataFrame, root: str = "root", layer: str = "layer", name: str = "name", value: str = "value", base: str = "base") -> DataFrame:
    """``root, name, value, base``: of the layers that set a value the last one wins, and its base stays with it."""
    set_by = settings.where(F.col(value).isNotNull())
    return set_by.groupBy(root, name).agg(F.max_by(F.struct(F.col(value), F.col(base)), layer).alias("v")).select(root, name, f"v.{value}", f"v.{base}")


def chain(parents: DataFrame) -> DataFrame:
    """``node, ancestor, distance`` along ``parents(node, parent)``; a cycle ends where it returns.

    Steps double: what a node reaches within n steps and where it stands after n give what it reaches within 2n, so
    a chain of any length takes the logarithm of its length in rounds.
    """
    jumps = materialize(parents.where("parent is not null").select("node", F.col("parent").alias("to")).distinct(), "jumps")
    nodes = parents.select("node").unionByName(jumps.select(F.col("to").alias("node"))).distinct()
    reach = materialize(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance")), "reach")
    steps, known = 1, None
    while (rows := reach.count()) != known:
        known = rows
        behind = jumps.join(reach.select(F.col("node").alias("to"), "ancestor", "distance"), "to").select("node", "ancestor", F.col("distance") + steps)
        reach = materialize(reach.union(behind).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), "reach")
        jumps = materialize(jumps.join(jumps.toDF("to", "next"), "to").select("node", F.col("next").alias("to")).distinct(), "jumps")
        steps *= 2
    return reach.join(parents.select("node").distinct(), "node", "left_semi")
