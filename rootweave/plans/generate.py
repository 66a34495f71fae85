"""Synthetic topologies and alarm corpora; seed and keys alone decide every random value, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootweave.functions.ids import bell, pick, uniform
from rootweave.session import settle
from rootweave.sources.adapters import SECOND

# Named sizes of demonstrations.
PROFILES = {"p1-demo": {"nodes": 50, "sites": 10, "areas": 3, "interfaces": 2}, "p2-demo": {"alarms": 1000}, "p3-demo": {"alarms": 500}}
FEWEST_NODES, MOST_NODES = 10, 200


def settings(profile: str | None = None, **given: int) -> dict[str, int]:
    """A profile's sizes; given ones win."""
    sizes = {"nodes": 20, "sites": 10, "areas": 3, "interfaces": 2, "alarms": 500} | PROFILES.get(profile or "", {}) | given
    if not FEWEST_NODES <= sizes["nodes"] <= MOST_NODES:
        raise ValueError(f"nodes must be from {FEWEST_NODES} to {MOST_NODES}")
    return sizes


def topology(spark: SparkSession, nodes: int, sites: int, areas: int, interfaces: int) -> tuple[DataFrame, DataFrame]:
    """Sites, nodes in a ring, a card and a port on each, interfaces on ports, links between ring neighbours over a fibre."""
    n = spark.range(nodes).withColumnRenamed("id", "i")
    key = lambda kind, *parts: F.concat_ws("-", F.concat(F.lit(f"{kind}:"), parts[0]), *parts[1:])
    i, text = F.col("i"), lambda c: c.cast("string")
    area = F.concat(F.lit("A"), text(i % areas))
    port = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(interfaces - 1))))
    none = F.lit(None).cast("string")
    layers = [
        (spark.range(sites).select(key("Site", text(F.col("id"))).alias("id")), "Site", none),
        (n.select(key("Node", text(i)).alias("id"), area.alias("area")), "Node", None),
        (n.select(key("LineCard", text(i)).alias("id"), area.alias("area")), "LineCard", None),
        (n.select(key("Port", text(i)).alias("id"), area.alias("area")), "Port", None),
        (port.select(key("Interface", text(i), text(F.col("k"))).alias("id"), area.alias("area")), "Interface", None),
        (n.select(key("IPLink", text(i)).alias("id")), "IPLink", none),
        (n.select(key("FiberSpan", text(i)).alias("id")), "FiberSpan", none),
    ]
    vertices = None
    for rows, kind, blank in layers:
        rows = rows if blank is None else rows.withColumn("area", blank)
        rows = rows.select("id", F.lit(kind).alias("object_type"), "area")
        vertices = rows if vertices is None else vertices.unionByName(rows)
    onward = text((i + 1) % nodes)
    ties = [
        (n, key("Node", text(i)), key("Site", text(i % sites)), "LOCATED_AT"),
        (n, key("LineCard", text(i)), key("Port", text(i)), "HOSTS"),
        (n, key("Node", text(i)), key("LineCard", text(i)), "HOSTS"),
        (port, key("Port", text(i)), key("Interface", text(i), text(F.col("k"))), "HOSTS"),
        (port.where("k = 0"), key("Interface", text(i), F.lit("0")), key("IPLink", text(i)), "TERMINATES"),
        (n, key("Interface", onward, F.lit("0")), key("IPLink", text(i)), "TERMINATES"),
        (n, key("FiberSpan", text(i)), key("IPLink", text(i)), "RIDES_ON"),
    ]
    edges = None
    for rows, src, dst, relation in ties:
        rows = rows.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"))
        edges = rows if edges is None else edges.unionByName(rows)
    return vertices, edges


def counts(signal: int, background: float, noise: float) -> tuple[int, int]:
    """Background and noise alarms so that they have their shares of all."""
    total = signal / max(1e-9, 1 - background - noise)
    return round(total * background), round(total * noise)


def instances(vertices: DataFrame, scenarios: DataFrame, count: int, span_us: int, seed: int) -> DataFrame:
    """scenario (scenario_type, origin_type, alarm_type) instances: instance, origin and start within the span.

    The origins of a type are numbered, and each instance takes a number.
    """
    numbered = vertices.withColumn("number", F.row_number().over(Window.partitionBy("object_type").orderBy("id")) - 1)
    sizes = vertices.groupBy(F.col("object_type").alias("origin_type")).agg(F.count("*").alias("size"))
    rows = scenarios.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(sizes, "origin_type")
    rows = rows.withColumn("instance", F.concat(F.lit("sc-"), "scenario_type", F.format_string("-%03d", "k")))
    rows = rows.withColumn("number", F.floor(uniform(seed, F.col("instance"), F.lit("origin")) * F.col("size")).cast("int")).withColumn("start_us", (uniform(seed, F.col("instance"), F.lit("start")) * span_us).cast("long"))
    return rows.join(numbered.select(F.col("object_type").alias("origin_type"), "number", F.col("id").alias("origin")), ["origin_type", "number"]).select("instance", "scenario_type", "origin", "alarm_type", "start_us")


def cascade(starts: DataFrame, edges: DataFrame, rules: DataFrame, seed: int, depth: int = 8) -> DataFrame:
    """Alarms of each instance: instance, alarm_id, moid, alarm_type, raised_us and is_root.

    rules: relation, effect_alarm, delay_ms, spread_ms. A rule fires for every edge of its relation out of an object that
    the cascade reached, an object is walked from once, and the clock runs on over all alarms of the instance.
    """
    rules = settle(rules.withColumn("rule", F.monotonically_increasing_id()), "rules")
    front = settle(starts.select("instance", F.col("origin").alias("moid"), "alarm_type"), "front")
    seen, every = front.select("instance", "moid"), front.select("instance", "moid", "alarm_type", F.lit(0).alias("level"), F.lit("").alias("cause"), F.lit(-1).cast("long").alias("rule"))
    for level in range(1, depth + 1):
        hits = front.select("instance", F.col("moid").alias("src")).distinct().join(edges, "src").join(F.broadcast(rules), "relation")
        new = settle(hits.select("instance", F.col("dst").alias("moid"), F.col("effect_alarm").alias("alarm_type"), F.lit(level).alias("level"), F.col("src").alias("cause"), "rule"), "hits")
        if new.isEmpty():
            break
        every = every.unionByName(new)
        front = settle(new.select("instance", "moid", "alarm_type").join(seen, ["instance", "moid"], "left_anti"), "front")
        seen = seen.unionByName(front.select("instance", "moid").distinct())
    timed = every.join(rules.select("rule", "delay_ms", "spread_ms"), "rule", "left").join(starts.select("instance", "start_us"), "instance")
    delay = F.greatest(F.lit(0.0), F.col("delay_ms") + F.col("spread_ms") * bell(seed, F.col("instance"), F.col("moid"), F.col("alarm_type"), F.col("cause")))
    order = Window.partitionBy("instance").orderBy("level", "cause", "moid", "rule")
    timed = timed.withColumn("step", F.row_number().over(order)).withColumn("clock", F.sum(F.coalesce(delay, F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return timed.select("instance", F.concat_ws("-", F.lit("ALM"), "instance", F.format_string("%04d", "step")).alias("alarm_id"), "moid", "alarm_type", (F.col("start_us") + F.col("clock") * 1000).cast("long").alias("raised_us"), (F.col("step") == 1).alias("is_root"))


def noise(vertices: DataFrame, alarms: DataFrame, types: list[str], count: int, span_us: int, seed: int, hard: float = 0.0) -> DataFrame:
    """Alarms that belong to nothing: the first ``hard`` share lies within 1.5 s of an instance's start."""
    spark = vertices.sparkSession
    objects = vertices.withColumn("number", F.row_number().over(Window.orderBy("id")) - 1).select("number", F.col("id").alias("moid"))
    roots = alarms.where("is_root").withColumn("root", F.row_number().over(Window.orderBy("raised_us", "alarm_id")) - 1).select("root", F.col("raised_us").alias("near_us"))
    n, r = objects.count(), roots.count()
    i = F.col("id")
    rows = spark.range(count).withColumn("number", F.floor(uniform(seed, i, F.lit("object")) * n).cast("int")).withColumn("root", F.floor(uniform(seed, i, F.lit("root")) * max(1, r)).cast("int"))
    rows = rows.join(objects, "number").join(roots, "root", "left").withColumn("is_hard", (i < hard * count) & F.col("near_us").isNotNull())
    offset = ((uniform(seed, i, F.lit("offset")) * 2 - 1) * 1.5 * SECOND).cast("long")
    at = F.when(F.col("is_hard"), F.greatest(F.lit(0), F.col("near_us") + offset)).otherwise((uniform(seed, i, F.lit("at")) * span_us).cast("long"))
    return rows.select(F.format_string("ALM-noise-%07d", "id").alias("alarm_id"), "moid", pick(F.array(*map(F.lit, types)), uniform(seed, i, F.lit("type"))).alias("alarm_type"), at.alias("raised_us"), "is_hard")


def labels(alarms: DataFrame) -> DataFrame:
    """instance, root_alarm_id, root_alarm_type and children of each instance."""
    child = F.when(~F.col("is_root"), F.col("alarm_id"))
    return alarms.groupBy("instance").agg(F.max(F.when(F.col("is_root"), F.col("alarm_id"))).alias("root_alarm_id"), F.max(F.when(F.col("is_root"), F.col("alarm_type"))).alias("root_alarm_type"), F.array_sort(F.collect_list(child)).alias("children"))
