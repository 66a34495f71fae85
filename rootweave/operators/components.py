"""Connected components of links, scope by scope (area, window), by rounds of contraction in a random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.session import settle

#: Below so many rows nothing is joined apart; a key with more than a thousandth of all rows is a hub.
FEW_ROWS, HUB = 100_000, 1000


def hub_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left by right, which has one row for each key: hubs of left (a thousand keys at most) meet a broadcast of their rows."""
    total = left.count()
    if total < FEW_ROWS:
        return left.join(right, keys, how)
    hubs = settle(left.groupBy(keys).agg(F.count("*").alias("_n")).where(F.col("_n") * HUB > total).select(keys), "hubs")
    if hubs.isEmpty():
        return left.join(right, keys, how)
    few = F.broadcast(settle(hubs.join(right, keys), "hub_rows"))
    apart = left.join(F.broadcast(hubs), keys, "left_semi").join(few, keys, how)
    return apart.unionByName(left.join(F.broadcast(hubs), keys, "left_anti").join(right, keys, how))


def components(links: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """scope, node and root: the smallest node that the links (scope, a, b) reach from it. A node without links has no row.

    In each round every node points to the first of its neighbours in an order drawn for that round. Two that point to each
    other, as no more can in a circle, agree on the first of them; pointers are shortened, and links move on to the targets.
    A star goes in one round; as the order is drawn anew, at least about half of the nodes go in any, also from a chain that
    is numbered from end to end. Minima are taken before links are dealt, and hubs are joined apart, so that no node's
    links meet in one task.

    Nodes with one neighbour take no part in the rounds: they follow it, and it stands for the least of them.
    """
    keys = scope or []
    some = settle(links.select(*keys, "a", "b").where("a <> b"), "given")
    turned = some.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    ends = settle(some.unionByName(turned).groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("to"), F.max("b").alias("_to")), "ends")
    leaves, inner = ends.where(F.col("to") == F.col("_to")).drop("_to"), ends.where(F.col("to") != F.col("_to")).select(*keys, "node")
    for end in "ab":
        some = some.join(inner.withColumnRenamed("node", end), [*keys, end], "left_semi")
    some = settle(some, "inner")
    left = settle(some.unionByName(some.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    whole, turn = None, 0
    while not left.isEmpty():

        def drawn(node: str, turn: int = turn) -> Column:
            return F.struct(F.xxhash64(F.lit(turn), *keys, node).alias("draw"), F.col(node).alias("id"))

        points = left.groupBy(*keys, F.col("a").alias("node")).agg(F.min(drawn("b"))["id"].alias("to"))
        points = settle(points, "pointers")
        for jump in range(2):
            onward = points.select(*keys, F.col("node").alias("to"), F.col("to").alias("next"))
            far = F.col("next")
            if not jump:
                far = F.when(F.col("next") == F.col("node"), F.least(drawn("node"), drawn("to"))["id"]).otherwise(far)
            points = settle(hub_join(points, onward, [*keys, "to"]).select(*keys, "node", far.alias("to")), "pointers")
        if whole is None:
            whole = points.withColumnRenamed("to", "root")
        else:
            onward = points.select(*keys, F.col("node").alias("root"), F.col("to").alias("next"))
            whole = settle(hub_join(whole, onward, [*keys, "root"], "left").select(*keys, "node", F.coalesce("next", "root").alias("root")), "roots")
        begin, end = (points.select(*keys, F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in "ab")
        left = settle(hub_join(left, begin, [*keys, "a"]).select(*keys, F.col("_a").alias("a"), "b").distinct(), "moved")
        left = settle(hub_join(left, end, [*keys, "b"]).where("a <> _b").select(*keys, "a", F.col("_b").alias("b")).distinct(), "links")
        turn += 1
    inner = inner.withColumn("root", F.col("node")) if whole is None else inner.join(whole, [*keys, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    low = inner.join(leaves.groupBy(*keys, F.col("to").alias("node")).agg(F.min("node").alias("leaf")), [*keys, "node"], "left")
    low = settle(low.select(*keys, "node", "root", F.least("node", "leaf").alias("low")), "low")
    least = low.groupBy(*keys, "root").agg(F.min("low").alias("least"))
    inner = settle(hub_join(low, least, [*keys, "root"]).select(*keys, "node", F.col("least").alias("root")), "roots")
    # a leaf of no inner node is one of two that have only each other
    led = hub_join(leaves, inner.withColumnRenamed("node", "to"), [*keys, "to"], "left")
    return inner.unionByName(led.select(*keys, "node", F.coalesce("root", F.least("node", "to")).alias("root")))
