"""Breadth-first levels of a link graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def levels(edges: DataFrame, seeds: DataFrame, most: int | None = 1000) -> DataFrame:
    """(node, level): what can be reached from seeds(node) by edges(from_node, to_node), and in how many steps at least; at
    most in `most` steps, or in any number if that is None.

    A turn joins the last level alone with the edges; each level is cut from its lineage in the shared folder.
    """
    shared_dir(edges.sparkSession)
    now = seeds.select("node").filter("node IS NOT NULL").distinct().withColumn("level", F.lit(0)).checkpoint()
    found = now
    for level in count(1) if most is None else range(1, most + 1):
        step = edges.join(now.select(F.col("node").alias("from_node")), "from_node").select(F.col("to_node").alias("node")).filter("node IS NOT NULL").distinct()
        now = step.join(found.select("node"), "node", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        if now.isEmpty():
            break
        found = found.union(now)
        if level % 32 == 0:  # else the plan grows with each level
            found = found.checkpoint()
    return found
