"""Enrichment of alarms: rule set, normal form, repeats, self-clears, flapping, known chatter, trails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.sources.adapters import SECOND

#: No defaults are given anywhere for these; they are parameters.
HOLD_US, FLAP_WINDOW_US, FLAPS = 60 * SECOND, 3600 * SECOND, 3


def with_ruleset(alarms: DataFrame, rulesets: DataFrame) -> DataFrame:
    """Adds ruleset: the one of the alarm's source, else that of 'default'. rulesets: source, ruleset (a few rows)."""
    own = rulesets.select("source", "ruleset")
    default = rulesets.where("source = 'default'").select(F.col("ruleset").alias("fallback"))
    return alarms.join(own, "source", "left").join(default, F.lit(True), "left").withColumn("ruleset", F.coalesce("ruleset", "fallback")).drop("fallback")


def normalised(alarms: DataFrame, mapping: DataFrame, name: str = "enricher") -> DataFrame:
    """Replaces severity by the mapping (ruleset, raw, severity), else leaves it; keeps the raw one; source is our own name."""
    table = mapping.select(F.col("ruleset").alias("r"), F.col("raw").alias("raw"), F.col("severity").alias("mapped"))
    rows = alarms.join(table, (F.col("ruleset") == F.col("r")) & (F.col("severity") == F.col("raw")), "left")
    return rows.withColumn("raw_severity", F.col("severity")).withColumn("severity", F.coalesce("mapped", "severity")).withColumn("source", F.lit(name)).drop("r", "raw", "mapped")


#: Fields that a rule set may map, each with the wire name under which its raw value is kept.
MAPPED = {"severity": "perceivedSeverity", "event_type": "eventType", "alarm_type": "alarmType"}


def normalised_fields(alarms: DataFrame, mapping: DataFrame, name: str = "enricher") -> DataFrame:
    """Maps severity, event_type and alarm_type by (ruleset, field, raw, value); what is not mapped stays.

    vendor_raw becomes JSON text of the raw values; source is our own name.
    """
    raw = F.to_json(F.struct(*[F.col(c).alias(n) for c, n in MAPPED.items()]))
    rows = alarms.withColumn("vendor_raw", raw)
    for field in MAPPED:
        some = mapping.where(F.col("field") == field).select("ruleset", F.col("raw").alias(field), F.col("value").alias("_new"))
        rows = rows.join(some, ["ruleset", field], "left").withColumn(field, F.coalesce("_new", field)).drop("_new")
    return rows.withColumn("source", F.lit(name))


def deduped(alarms: DataFrame, key: str = "alarm_id") -> DataFrame:
    """The earliest row of each key; of equal times the first by moid, type and state, as far as there are such columns."""
    order = Window.partitionBy(key).orderBy("raised_us", *[c for c in ("moid", "alarm_type", "state") if c in alarms.columns])
    return alarms.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def without_self_clears(alarms: DataFrame, hold_us: int = HOLD_US) -> DataFrame:
    """Drops a raise that its object clears within the hold time, and that clear."""
    order = Window.partitionBy("moid", "alarm_type").orderBy("raised_us", "alarm_id")
    step = alarms.withColumn("_next", F.lead("state").over(order)).withColumn("_at", F.lead("raised_us").over(order)).withColumn("_before", F.lag("state").over(order)).withColumn("_since", F.lag("raised_us").over(order))
    cancelled = (F.col("state") == "raised") & (F.col("_next") == "cleared") & (F.col("_at") - F.col("raised_us") <= hold_us)
    clears = (F.col("state") == "cleared") & (F.col("_before") == "raised") & (F.col("raised_us") - F.col("_since") <= hold_us)
    return step.where(~F.coalesce(cancelled, F.lit(False)) & ~F.coalesce(clears, F.lit(False))).drop("_next", "_at", "_before", "_since")


def without_flapping(alarms: DataFrame, window_us: int = FLAP_WINDOW_US, most: int = FLAPS) -> DataFrame:
    """Drops alarms of an object with over ``most`` changes of state in the window up to them."""
    by_object = Window.partitionBy("moid").orderBy("raised_us", "alarm_id")
    recent = Window.partitionBy("moid").orderBy("raised_us").rangeBetween(-window_us, 0)
    toggled = alarms.withColumn("_toggle", F.when(F.lag("state").over(by_object) != F.col("state"), 1).otherwise(0))
    return toggled.withColumn("_toggles", F.sum("_toggle").over(recent)).where(F.col("_toggles") <= most).drop("_toggle", "_toggles")


def without_chatter(alarms: DataFrame, chatter: DataFrame) -> DataFrame:
    """Drops alarms listed as chatter: (moid or null for any, alarm_type)."""
    anywhere = chatter.where("moid is null").select("alarm_type").distinct()
    return alarms.join(anywhere, "alarm_type", "left_anti").join(chatter.where("moid is not null").select("moid", "alarm_type").distinct(), ["moid", "alarm_type"], "left_anti").select(alarms.columns)


def tagged(alarms: DataFrame, members: DataFrame) -> DataFrame:
    """Adds trail_ids, sorted, of (trail_id, moid); an object on no trail has none."""
    trails = members.groupBy("moid").agg(F.array_sort(F.collect_set("trail_id")).alias("_trails"))
    return alarms.drop("trail_ids").join(trails, "moid", "left").withColumn("trail_ids", F.coalesce("_trails", F.array().cast("array<string>"))).drop("_trails")


def split_lookups(alarms: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tagged alarms, and rejects whose lookup failed: no alarm goes on without trails because nobody answered.

    answers: moid, ok and trail_ids of each object that was asked for; an answer may hold no trails.
    """
    said = answers.groupBy("moid").agg(F.max("ok").alias("_ok"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("trail_ids", F.array().cast("array<string>")))))).alias("_trails"))
    rows = alarms.drop("trail_ids").join(said, "moid", "left")
    good = rows.where("_ok").withColumn("trail_ids", F.col("_trails")).drop("_ok", "_trails")
    return good, rows.where("not coalesce(_ok, false)").drop("_ok", "_trails").withColumn("reject_reason", F.lit("trail lookup failed"))


def enrich(alarms: DataFrame, rulesets: DataFrame, mapping: DataFrame, chatter: DataFrame, members: DataFrame) -> DataFrame:
    """All steps in their fixed order."""
    rows = deduped(normalised(with_ruleset(alarms, rulesets), mapping))
    return tagged(without_chatter(without_flapping(without_self_clears(rows)), chatter), members)
