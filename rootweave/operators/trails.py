"""Trails: overlapping, area-bounded closures of a dependency graph.

Each node that is no risk group seeds a trail in its own area, or, without one, in every area that it connects. A trail
of an area is what the seed reaches over nodes of that area and connectors that touch it: the seed's connected component
of the area's own subgraph, so all trails of an area come from one round of components. Risk groups whose members share
a fate pull all their members into every trail that holds one. Equal member sets are one trail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.functions.ids import trail_id
from rootweave.operators.components import components
from rootweave.session import settle

GROUP = "SRLG"


def linked(vertices: DataFrame, edges: DataFrame, relations: list[str]) -> DataFrame:
    """a, b and their own areas x and y for edges of the policy's relations whose ends are known and differ."""
    some = edges.where(F.col("relation").isin(relations)).select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    known = some.join(vertices.select(F.col("id").alias("a"), F.col("area").alias("x")), "a").join(vertices.select(F.col("id").alias("b"), F.col("area").alias("y")), "b")
    return settle(known.select("a", "b", "x", "y"), "linked")


def areas_of(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """id and area of every place where a node may stand: its own, or, without one, those next to it or one connector on.

    ``links`` as ``linked`` gives them.
    """
    own = vertices.where("area is not null").select("id", "area")
    ends = links.select(F.col("a").alias("id"), "x", F.col("b").alias("next"), F.col("y").alias("area"))
    ends = ends.union(links.select("b", "y", "a", "x")).where("x is null").drop("x")
    direct, free = ends.where("area is not null").select("id", "area"), ends.where("area is null").select("id", "next")
    places = own.union(direct)
    if not free.isEmpty():  # most connectors touch no other
        places = places.union(free.join(direct.select(F.col("id").alias("next"), "area").distinct(), "next").select("id", "area"))
    return places.distinct()


def components_by(ties: DataFrame, nodes: DataFrame) -> DataFrame:
    """area, id and root (the smallest id) of the components that (area, a, b) form among (area, id)."""
    linked = components(ties.select("area", "a", "b"), ["area"]).withColumnRenamed("node", "id")
    return settle(nodes.select("area", "id").join(linked, ["area", "id"], "left").select("area", "id", F.coalesce("root", "id").alias("root")), "labels")


def trails(vertices: DataFrame, edges: DataFrame, relations: list[str], domain: str, snapshot: str, groups: DataFrame | None = None) -> DataFrame:
    """trail_id, area (null if its members have several or none), seed (the smallest), risk_group and members (sorted).

    ``groups`` (group, member): risk groups of two members or more. Nodes with no area to stand in form whole components
    of the graph without bounds.
    """
    links = linked(vertices, edges, relations)
    placed = settle(areas_of(vertices, links), "areas")
    # two areas of their own must be one; next to an area a node without one stands in it
    shared = links.where("x = y or (x is null) <> (y is null)").select(F.coalesce("x", "y").alias("area"), "a", "b")
    free = links.where("x is null and y is null").select("a", "b")
    lost = vertices.where("area is null").select("id").join(placed.select("id"), "id", "left_anti").distinct()
    lost = settle(lost.where(~F.col("id").startswith(f"{GROUP}:")), "lost")
    whole = None
    if not free.isEmpty():  # only here a node can be lost and tied
        here, there = placed.select("area", F.col("id").alias("a")), placed.select("area", F.col("id").alias("b"))
        shared = shared.unionByName(free.join(here, "a").join(there, ["area", "b"]).select("area", "a", "b"))
        tied = settle(lost.join(free.select(F.col("a").alias("id")).union(free.select("b")), "id", "left_semi"), "tied")
        if not tied.isEmpty():
            lost = lost.join(tied, "id", "left_anti")
            nodes = links.select(F.lit("").alias("area"), F.col("a").alias("id")).union(links.select(F.lit(""), "b")).distinct()
            whole = components_by(links.select(F.lit("").alias("area"), "a", "b"), nodes)
            whole = whole.join(whole.join(tied, "id", "left_semi").select("root").distinct(), "root", "left_semi").select("area", "id", "root")
    every = components_by(shared, placed)
    members = (every if whole is None else every.unionByName(whole)).select(F.concat_ws("|", "area", "root").alias("trail"), "id")
    if groups is not None:
        large = groups.groupBy("group").agg(F.countDistinct("member").alias("n")).where("n >= 2").select("group")
        fate = settle(groups.join(large, "group").select("group", "member").distinct(), "fate")
        held = fate.select(F.col("member").alias("id"))
        members = members.unionByName(lost.join(held, "id", "left_semi").select(F.concat_ws("|", F.lit(""), "id").alias("trail"), "id"))
        lost = lost.join(held, "id", "left_anti")
        touched = members.join(fate, F.col("id") == F.col("member")).select("trail", "group").distinct()
        pulled = touched.join(fate, "group")
        members = members.union(pulled.select("trail", "member")).union(pulled.select("trail", "group"))
    described = members.join(vertices.where("area is not null").select("id", "area"), "id", "left")
    sets = described.groupBy("trail").agg(
        F.array_sort(F.collect_set("id")).alias("members"),
        F.when(F.min("area") == F.max("area"), F.min("area")).alias("area"),
        F.min(F.when(~F.col("id").startswith(f"{GROUP}:"), F.col("id"))).alias("seed"),
        F.min(F.when(F.col("id").startswith(f"{GROUP}:"), F.col("id"))).alias("risk_group"),
    ).where("seed is not null")
    named = lambda members: trail_id(F.lit(domain), F.lit(snapshot), members).alias("trail_id")
    one = sets.select(named(F.col("members")), "area", "seed", "risk_group", "members").groupBy("trail_id")
    one = one.agg(F.min("area").alias("area"), F.min("seed").alias("seed"), F.min("risk_group").alias("risk_group"), F.first("members").alias("members"))
    # what stands alone is in no other trail
    none = F.lit(None).cast("string")
    alone = lost.withColumn("members", F.array("id")).select(named(F.col("members")), none.alias("area"), F.col("id").alias("seed"), none.alias("risk_group"), "members")
    return one.unionByName(alone)


def trails_of(trails: DataFrame, objects: DataFrame) -> DataFrame:
    """id and trail_id of every trail that holds an object (id)."""
    return trails.select("trail_id", F.explode("members").alias("id")).join(objects.select("id"), "id", "left_semi").select("id", "trail_id")
