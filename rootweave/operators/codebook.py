"""Codebook: forward propagation of faults over edges by rules, for all fault origins at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.functions.ids import object_type
from rootweave.operators import graph
from rootweave.session import settle

#: Foreign alarm types that the error of a compile names.
NAMED = 20


def scenarios(vertices: DataFrame, origins: DataFrame) -> DataFrame:
    """scenario_id, origin and alarm_type: one for each vertex of a fault-origin type (object_type, alarm_type)."""
    found = vertices.select("id", F.coalesce("object_type", object_type(F.col("id"))).alias("object_type")).join(origins, "object_type")
    if not origins.where("alarm_type is null").isEmpty():
        raise ValueError("an origin type has no alarm of its own")
    return found.select(F.concat(F.lit("sc-"), "id").alias("scenario_id"), F.col("id").alias("origin"), "alarm_type")


def propagate(scenarios: DataFrame, vertices: DataFrame, edges: DataFrame, templates: DataFrame, depth: int = 8) -> DataFrame:
    """scenario_id, position (from 0), alarm_type and moid: the symptoms of each scenario in the order they are reached.

    templates: relation, trigger_type, trigger_alarm, effect_type, effect_alarm. A rule fires where an edge of its
    relation leaves an object of the trigger type in the trigger's alarm for an object of the effect type. An object in
    one alarm is worked on once for a scenario; its symptom keeps its first place: by level, place of its cause, target
    and rule.
    """
    kinds = settle(vertices.select("id", F.coalesce("object_type", object_type(F.col("id"))).alias("kind")).distinct(), "kinds")
    rules = settle(templates.withColumn("rule", (F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1).cast("long")), "rules")
    pack = rules.collect()
    relations, many = sorted({r.relation for r in pack if r.relation is not None}), max(1, len(pack))
    walk = settle(edges.where(F.col("relation").isin(relations)).select("src", "dst", "relation"), "walk")
    alarms = {r.alarm_type for r in scenarios.join(rules, F.col("alarm_type") == F.col("trigger_alarm"), "left_semi").select("alarm_type").distinct().collect()}
    met = set(alarms)
    front = scenarios.select("scenario_id", F.col("origin").alias("moid"), "alarm_type", F.lit(0).cast("long").alias("place"), F.lit(0).alias("level"))
    triggers = {r.trigger_type for r in pack if r.trigger_alarm in alarms}
    known = kinds.where(F.col("kind").isin(triggers)).groupBy(F.col("id").alias("moid")).agg(F.collect_set("kind").alias("kinds"))
    done = settle(front, "front")
    front = done.join(known, "moid")
    by_scenario = Window.partitionBy("scenario_id").orderBy("place", "moid", "rule")
    near, level = None, 0
    while True:
        level += 1
        # only rules that the last level can set off, and only edges and types that these ask for
        live = [r for r in pack if r.trigger_alarm in alarms]
        alarms = {r.effect_alarm for r in live}
        if not live:
            break
        triggers = {r.trigger_type for r in pack if r.trigger_alarm in alarms}
        some = F.broadcast(rules.where(F.col("rule").isin([r.rule for r in live])).withColumnRenamed("relation", "by"))
        set_off = front.join(some, (F.col("alarm_type") == F.col("trigger_alarm")) & F.array_contains("kinds", F.col("trigger_type"))).select("scenario_id", F.col("moid").alias("src"), "by", "effect_type", "effect_alarm", (F.col("place") * many + F.col("rule")).alias("turn"))
        crossed = walk.where(F.col("relation").isin(sorted({r.relation for r in live if r.relation is not None})))
        new = set_off.join(crossed, "src").where("relation = by").groupBy("scenario_id", F.col("dst").alias("moid"), F.col("effect_alarm").alias("alarm_type"), "effect_type").agg(F.min("turn").alias("turn"))
        typed = kinds.where(F.col("kind").isin({r.effect_type for r in live} | triggers)).withColumnRenamed("id", "moid")
        first, goes_on = F.min(F.when(F.col("kind") == F.col("effect_type"), F.col("turn"))), F.collect_set(F.when(F.col("kind").isin(triggers), F.col("kind")))
        new = new.join(typed, "moid").groupBy("scenario_id", "moid", "alarm_type").agg(first.alias("turn"), goes_on.alias("kinds")).where("turn is not null")
        if met & alarms:
            earlier = done.where(F.col("alarm_type").isin(met & alarms)).select("scenario_id", "moid", "alarm_type")
            new = new.join(earlier, ["scenario_id", "moid", "alarm_type"], "left_anti")
        met |= alarms
        new = new.select("scenario_id", "moid", "alarm_type", "kinds", F.expr(f"turn div {many}").alias("place"), (F.col("turn") % many).alias("rule"))
        if level > depth:  # objects of earlier levels are no farther than their level
            if near is None:
                starts = scenarios.select(F.col("origin").alias("id")).distinct()
                walked = graph.traverse(vertices, edges, starts, relations, depth).select(F.col("start").alias("origin"), F.col("id").alias("moid"))
                near = walked.unionByName(starts.select(F.col("id").alias("origin"), F.col("id").alias("moid"))).distinct()
                near = settle(scenarios.select("scenario_id", "origin").distinct().join(near, "origin").select("scenario_id", "moid"), "closure")
            new = new.join(near, ["scenario_id", "moid"], "left_semi")
        front = settle(new.select("scenario_id", "moid", "alarm_type", "kinds", (F.row_number().over(by_scenario) - 1).cast("long").alias("place"), F.lit(level).alias("level")), "front")
        if front.isEmpty():
            break
        done = done.unionByName(front.drop("kinds"))
    order = Window.partitionBy("scenario_id").orderBy("level", "place")
    return done.select("scenario_id", (F.row_number().over(order) - 1).alias("position"), "alarm_type", "moid")


def relations_of(templates: DataFrame) -> DataFrame:
    """relations: the different relations that the templates use, sorted, in one row."""
    return templates.agg(F.array_sort(F.collect_set("relation")).alias("relations"))


def outside(signatures: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Symptoms whose alarm_type the vocabulary lacks; any stops the compile."""
    return signatures.join(vocabulary.select("alarm_type").distinct(), "alarm_type", "left_anti")


def complete(signatures: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The signatures, if the vocabulary has all their alarm types; else the compile stops and names those it lacks."""
    foreign = outside(signatures, vocabulary).select("alarm_type").distinct().orderBy("alarm_type").limit(NAMED + 1)
    names = [str(r.alarm_type) for r in foreign.collect()]
    if names:
        raise ValueError("alarm types outside the vocabulary: " + ", ".join(names[:NAMED]) + (", ..." if len(names) > NAMED else ""))
    return signatures


def reached(signatures: DataFrame, trails: DataFrame) -> DataFrame:
    """scenario_id, trail_id and position of every trail that a scenario reaches, with its first symptom there."""
    members = trails.select("trail_id", F.explode("members").alias("moid"))
    return signatures.join(members, "moid").groupBy("scenario_id", "trail_id").agg(F.min("position").alias("position"))


def tagged(signatures: DataFrame, trails: DataFrame) -> DataFrame:
    """scenario_id and trail_ids: trails of its symptoms' objects, in the order in which the symptoms reach them."""
    return reached(signatures, trails).groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("position", "trail_id"))).alias("t")).select("scenario_id", F.col("t.trail_id").alias("trail_ids"))


def root_tokens(signatures: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenario_id and root_alarm: the first symptom on the origin, else the first of all."""
    joined = signatures.join(scenarios.select("scenario_id", "origin"), "scenario_id")
    order = F.struct(F.when(F.col("moid") == F.col("origin"), 0).otherwise(1), "position")
    return joined.groupBy("scenario_id").agg(F.min_by("alarm_type", order).alias("root_alarm"))


def by_trail(codebook: DataFrame, trail: str | None = None) -> DataFrame:
    """One row for each scenario and trail of (scenario_id, trail_ids, ...), or for one trail only."""
    rows = codebook.withColumn("trail_id", F.explode("trail_ids")).drop("trail_ids")
    return rows if trail is None else rows.where(F.col("trail_id") == trail)


def trail_signatures(signatures: DataFrame, scenarios: DataFrame, trails: DataFrame, trail: str | None = None) -> DataFrame:
    """trail_id, scenario_id, root_alarm and symptoms (in order) of every scenario on every trail that it touches, or on one."""
    ordered = signatures.groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("position", "alarm_type", "moid"))).alias("symptoms"))
    whole = tagged(signatures, trails).join(root_tokens(signatures, scenarios), "scenario_id").join(ordered, "scenario_id")
    return by_trail(whole, trail).select("trail_id", "scenario_id", "root_alarm", "symptoms")
