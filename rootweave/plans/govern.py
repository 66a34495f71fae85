"""Governance of mined patterns: identity, root cause, structure, session windows, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootweave.functions.ids import name_uuid

SHORTEST_MS, LONGEST_MS, STEADY = 5000, 1_800_000, 0.5
STATES = ("draft", "approved", "rejected", "deprecated")


def pattern_id(domain: Column, trail: Column, sequence: Column) -> Column:
    return name_uuid(F.concat_ws("|", domain, trail, F.array_join(sequence, "|")))


def session_windows(timing: DataFrame) -> DataFrame:
    """Adds window_ms and window_type to rows with timeframe_ms, median_ms, max_gap_ms and stddev_ms.

    The larger of one and a half times the span and twice the largest gap, from 5 s to 30 min; fixed where the standard
    deviation is below half the median, else by gaps.
    """
    width = F.greatest(F.ceil(1.5 * F.coalesce("timeframe_ms", F.lit(0.0))), F.ceil(2 * F.coalesce("max_gap_ms", F.lit(0.0))))
    steady = F.try_divide(F.col("stddev_ms"), F.col("median_ms")) < STEADY
    return timing.withColumn("window_ms", F.greatest(F.lit(SHORTEST_MS), F.least(F.lit(LONGEST_MS), width)).cast("long")).withColumn("window_type", F.when(steady, "fixed").otherwise("gap-based"))


def root_causes(members: DataFrame, overrides: DataFrame | None = None, depth_weight: float = 1.0, time_weight: float = 0.5) -> DataFrame:
    """pattern_id and root_alarm_type: the member lowest in the dependency graph, then earliest, by weighted ranks.

    members: pattern_id, alarm_type, hops (distance to what depends on all), raised_us. A scenario's root token in
    overrides (pattern_id, root_alarm_type) goes first.
    """
    deep = F.percent_rank().over(Window.partitionBy("pattern_id").orderBy("hops"))
    early = F.percent_rank().over(Window.partitionBy("pattern_id").orderBy("raised_us"))
    scored = members.withColumn("score", depth_weight * deep + time_weight * early)
    best = scored.groupBy("pattern_id").agg(F.min_by("alarm_type", F.struct("score", "raised_us", "alarm_type")).alias("root_alarm_type"))
    if overrides is None:
        return best
    return best.join(overrides.select("pattern_id", F.col("root_alarm_type").alias("known")), "pattern_id", "left").select("pattern_id", F.coalesce("known", "root_alarm_type").alias("root_alarm_type"))


def unconnected(members: DataFrame, reached: DataFrame) -> DataFrame:
    """Members (pattern_id, root, moid) that their root does not reach: reached has (start, id) within the allowed hops."""
    ok = reached.select(F.col("start").alias("root"), F.col("id").alias("moid"))
    return members.where("root <> moid").join(ok, ["root", "moid"], "left_anti")


def verdicts(members: DataFrame, reached: DataFrame, strict: bool) -> DataFrame:
    """pattern_id, unconnected (members that the root does not reach) and verdict: 'ok', else 'reject' if strict, else 'flag'."""
    loose = unconnected(members, reached).groupBy("pattern_id").agg(F.countDistinct("moid").alias("unconnected"))
    every = members.select("pattern_id").distinct().join(loose, "pattern_id", "left").na.fill(0, ["unconnected"])
    return every.withColumn("verdict", F.when(F.col("unconnected") == 0, "ok").otherwise("reject" if strict else "flag"))


#: What a pattern's state may become.
MOVES = {"draft": ("approved", "rejected"), "approved": ("deprecated",), "rejected": (), "deprecated": ()}


def forbidden_moves(audit: DataFrame) -> DataFrame:
    """pattern_id, was, state and changed_us of changes that no pattern may make; repeats of a state are none."""
    order = Window.partitionBy("pattern_id").orderBy("changed_us", "state")
    moves = audit.withColumn("was", F.lag("state").over(order)).where(F.col("was").isNotNull() & (F.col("was") != F.col("state")))
    allowed = [F.lit(f"{a}>{b}") for a, to in MOVES.items() for b in to]
    return moves.where(~F.concat_ws(">", "was", "state").isin(*allowed)).select("pattern_id", "was", "state", "changed_us")


def lifecycle(audit: DataFrame) -> DataFrame:
    """pattern_id, state and changes of an audit log (pattern_id, state, changed_us): the latest state holds."""
    return audit.where(F.col("state").isin(list(STATES))).groupBy("pattern_id").agg(F.max_by("state", F.struct("changed_us", "state")).alias("state"), F.count("*").alias("changes"))


def with_optional(patterns: DataFrame) -> DataFrame:
    """elements: (token, optional) of each pattern, from sequence and optional (the indices that may be left out)."""
    return patterns.withColumn("elements", F.transform("sequence", lambda t, i: F.struct(t.alias("token"), F.array_contains(F.coalesce("optional", F.array().cast("array<int>")), i).alias("optional"))))
