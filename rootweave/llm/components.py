"""Connected components of a link table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.llm.session import spread_join, stored


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node that links (a, b) reach. Nodes without links have no row.

    Each round every node points to its smallest neighbour, pointers are shortened twice, and links are carried over to
    the targets: what is left of the graph at least halves. Every round is written to the shared folder. A node that a
    large part of all others link or point to is joined apart, so that its rows don't meet in one task.
    """
    both = links.select("a", "b").where("a <> b")
    links = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    whole = None
    while True:
        step = stored(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "pointers")
        for _ in range(2):
            onward = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = stored(spread_join(step, onward, "to").select("node", F.col("next").alias("to")), "pointers")
        if whole is None:
            whole = step
        else:
            onward = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            ended = whole.select("to").distinct().join(onward.select("to"), "to", "left_anti").withColumn("next", F.col("to"))
            whole = stored(spread_join(whole, onward.unionByName(ended), "to").select("node", F.col("next").alias("to")), "components")
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        begun = stored(spread_join(links, left, "a"), "begun")
        links = stored(spread_join(begun, right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return whole.select("node", F.col("to").alias("component"))
