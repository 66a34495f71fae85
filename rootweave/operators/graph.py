"""Graph reads on vertices (id, object_type, ...) and edges (src, dst, relation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.functions.ids import edge_parts
from rootweave.session import settle


def node(vertices: DataFrame, moid: str) -> DataFrame:
    return vertices.where(F.col("id") == moid)


def nodes_of(vertices: DataFrame, kind: str | None = None) -> DataFrame:
    return vertices if kind is None else vertices.where(F.col("object_type") == kind)


def steps(edges: DataFrame, relations: list[str], direction: str = "out") -> DataFrame:
    """here, there and relation of edges that may be walked; no relations means all."""
    some = edges.where(F.col("relation").isin(relations)) if relations else edges
    out = some.select(F.col("src").alias("here"), F.col("dst").alias("there"), "relation")
    back = some.select(F.col("dst").alias("here"), F.col("src").alias("there"), "relation")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbours(vertices: DataFrame, edges: DataFrame, starts: DataFrame, relations: list[str] | None = None, direction: str = "out") -> DataFrame:
    """start, id, object_type and relation of the vertices one step from each start (id); missing vertices drop out."""
    walk = starts.select(F.col("id").alias("start")).join(steps(edges, relations or [], direction), F.col("start") == F.col("here"))
    return walk.join(vertices, F.col("there") == F.col("id")).select("start", "id", "object_type", "relation").distinct()


def traverse(vertices: DataFrame, edges: DataFrame, starts: DataFrame, relations: list[str], depth: int, direction: str = "out") -> DataFrame:
    """start, id and hops (the fewest, from 1) of the vertices that each start (id) reaches in at most ``depth`` steps.

    A start is among its own results only if a cycle leads back to it. All starts advance together, level by level.
    """
    walk = settle(steps(edges, relations, direction).select("here", "there"), "walk")
    front = settle(starts.select(F.col("id").alias("start"), F.col("id").alias("here")).distinct(), "front")
    reached = None
    for hops in range(1, depth + 1):
        found = front.join(walk, "here").select("start", F.col("there").alias("here")).distinct()
        if reached is not None:
            found = found.join(reached.select("start", F.col("id").alias("here")), ["start", "here"], "left_anti")
        front = settle(found, "front")
        if front.isEmpty():
            break
        level = front.select("start", F.col("here").alias("id"), F.lit(hops).alias("hops"))
        reached = level if reached is None else reached.unionByName(level)
    if reached is None:
        reached = front.select("start", F.col("here").alias("id"), F.lit(0).alias("hops")).limit(0)
    return reached.join(vertices.select("id"), "id").select("start", "id", "hops")


def orphans(graph: DataFrame, metadata: DataFrame, key: str = "snapshot") -> DataFrame:
    """Snapshots that the graph holds and the metadata doesn't know."""
    return graph.select(key).distinct().join(metadata.select(key), key, "left_anti")


def at_site(vertices: DataFrame, edges: DataFrame, sites: DataFrame) -> DataFrame:
    """site, id and object_type of what lies at each site (id)."""
    lies = edges.where("relation = 'LOCATED_AT'").join(sites.select(F.col("id").alias("site")), F.col("dst") == F.col("site"))
    return lies.join(vertices, F.col("src") == F.col("id")).select("site", "id", "object_type").distinct()


def edges_among(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges from a member (id) to a member, or to anything they are located at."""
    ids = members.select("id").distinct()
    there = ids.select(F.col("id").alias("member"))
    own = edges.join(ids, edges["src"] == ids["id"], "left_semi").join(there, F.col("dst") == F.col("member"), "left")
    return own.where("member is not null or relation = 'LOCATED_AT'").select("src", "dst", "relation")


def hierarchy_counts(edges: DataFrame) -> DataFrame:
    """relation, edges, sources and targets (different ones, null not counted); each end is counted by itself, so no edge is tripled."""
    none = F.lit(0).cast("long")
    by_source = edges.groupBy("relation", "src").agg(F.count("*").alias("edges")).select("relation", "edges", F.col("src").isNotNull().cast("long").alias("sources"), none.alias("targets"))
    by_target = edges.select("relation", "dst").distinct().select("relation", none.alias("edges"), none.alias("sources"), F.col("dst").isNotNull().cast("long").alias("targets"))
    return by_source.unionByName(by_target).groupBy("relation").agg(*[F.sum(c).alias(c) for c in ("edges", "sources", "targets")])


def area_count(vertices: DataFrame, area: str = "area") -> DataFrame:
    """areas: how many different ones there are; vertices without area don't count."""
    return vertices.agg(F.countDistinct(area).alias("areas"))


def counts_by_snapshot(vertices: DataFrame, edges: DataFrame, area: str = "area") -> DataFrame:
    """snapshot, nodes, edges, interfaces, sites and areas (distinct, those that are known) of each snapshot."""
    kind = F.col("object_type")
    nodes = vertices.groupBy("snapshot").agg(F.count("*").alias("nodes"), F.count_if(kind == "Interface").alias("interfaces"), F.countDistinct(F.when(kind == "Site", F.col("id"))).alias("sites"), F.countDistinct(area).alias("areas"))
    return nodes.join(edges.groupBy("snapshot").agg(F.count("*").alias("edges")), "snapshot", "left").na.fill(0, ["edges"]).select("snapshot", "nodes", "edges", "interfaces", "sites", "areas")


def edge(edges: DataFrame, snapshot: str, wanted: DataFrame) -> DataFrame:
    """edge_id, src, dst and relation of the edges with the ids in ``wanted`` (edge_id); an id of another snapshot has none."""
    parts = wanted.select("edge_id", edge_parts(F.col("edge_id")).alias("p")).where(F.col("p.snapshot") == snapshot).select("edge_id", "p.src", "p.relation", "p.dst")
    return edges.join(parts, ["src", "relation", "dst"]).select("edge_id", "src", "dst", "relation")


def site_view(vertices: DataFrame, edges: DataFrame, sites: DataFrame) -> DataFrame:
    """site, objects, ties and relations (their sorted names): what lies at each site (id), and the edges among it."""
    there = at_site(vertices, edges, sites)
    inner = edges.join(there.select("site", F.col("id").alias("src")), "src")
    known = there.select("site", F.col("id").alias("dst"), F.lit(True).alias("known"))
    ties = inner.join(known, ["site", "dst"], "left").where("known or relation = 'LOCATED_AT'")
    sizes = ties.groupBy("site").agg(F.count("*").alias("ties"), F.array_sort(F.collect_set("relation")).alias("relations"))
    return there.groupBy("site").agg(F.count("*").alias("objects")).join(sizes, "site", "left").na.fill(0, ["ties"])


def around(vertices: DataFrame, edges: DataFrame, kinds: list[str], relations: list[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges that seeds of the given types reach over the relations in either direction, each once.

    All seeds advance together; a vertex is walked from once.
    """
    some = edges.where(F.col("relation").isin(relations)).dropDuplicates(["src", "dst", "relation"])
    walk = settle(steps(some, [], "both").select("here", "there").distinct(), "walk")
    front = settle(vertices.where(F.col("object_type").isin(kinds)).select("id").distinct(), "front")
    seen = front
    while not front.isEmpty():
        new = front.join(walk, F.col("id") == F.col("here")).select(F.col("there").alias("id")).distinct().join(seen, "id", "left_anti")
        front = settle(new, "front")
        seen = seen.unionByName(front)
    seen = settle(seen, "seen")
    return vertices.join(seen, "id", "left_semi"), some.join(seen.select(F.col("id").alias("src")), "src", "left_semi").select(edges.columns)
