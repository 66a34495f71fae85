"""Live alarm state: lifecycle from status changes, roles from incidents, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lifecycle(opened: DataFrame, changes: DataFrame) -> DataFrame:
    """alarm_id, status, since_us and n_changes: 'open' until a change; the latest change wins, repeats of an event count once.

    opened: alarm_id, raised_us; changes: event_id, alarm_id, new_status, changed_us. 'reverted-open' shows as 'open'.
    """
    latest = changes.dropDuplicates(["event_id"]).groupBy("alarm_id").agg(F.max(F.struct("changed_us", "event_id", "new_status")).alias("last"), F.count("*").alias("n"))
    first = opened.groupBy("alarm_id").agg(F.min("raised_us").alias("raised_us"))
    status = F.when(F.col("last.new_status") == "reverted-open", "open").otherwise(F.coalesce("last.new_status", F.lit("open")))
    return first.join(latest, "alarm_id", "left").select("alarm_id", status.alias("status"), F.coalesce("last.changed_us", "raised_us").alias("since_us"), F.coalesce("n", F.lit(0)).alias("n_changes"))


def roles(incidents: DataFrame) -> DataFrame:
    """alarm_id, incident_id and role: of an alarm in several incidents the latest (created_us, incident_id)."""
    rows = incidents.select("incident_id", "created_us", F.explode(F.concat(F.array(F.struct(F.col("root_alarm_id").alias("alarm_id"), F.lit("root").alias("role"))), F.transform("child_alarm_ids", lambda c: F.struct(c.alias("alarm_id"), F.lit("child").alias("role"))))).alias("x"))
    return rows.groupBy("x.alarm_id").agg(F.max(F.struct("created_us", "incident_id", F.col("x.role").alias("role"))).alias("m")).select("alarm_id", "m.incident_id", "m.role")


def state(lifecycle: DataFrame, roles: DataFrame) -> DataFrame:
    """Both together, whichever comes first."""
    return lifecycle.join(roles, "alarm_id", "full_outer")


def transitions(changes: DataFrame) -> DataFrame:
    """alarm_id and its statuses in the order of their change."""
    return changes.dropDuplicates(["event_id"]).groupBy("alarm_id").agg(F.array_sort(F.collect_list(F.struct("changed_us", "event_id", "new_status"))).alias("t")).select("alarm_id", F.col("t.new_status").alias("statuses"))


def opened_once(alarms: DataFrame) -> DataFrame:
    """The live rows that raises open: each alarm_id once, at its first raise; clears open nothing."""
    return alarms.where("state = 'raised'").groupBy("alarm_id").agg(F.min(F.struct("raised_us", "moid", "alarm_type")).alias("first")).select("alarm_id", "first.*", F.lit("open").alias("status"))


def clears(alarms: DataFrame) -> DataFrame:
    """event_id, alarm_id, new_status and changed_us of clears on the wire: they change an alarm's state like any status event."""
    event = F.concat(F.lit("clear/"), "alarm_id", F.lit("/"), F.col("raised_us").cast("string"))
    return alarms.where("state = 'cleared'").select(event.alias("event_id"), "alarm_id", F.lit("cleared").alias("new_status"), F.col("raised_us").alias("changed_us"))
