"""Figures for dashboards and for the truth of generated corpora. Ratios without a denominator are null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 5


def confidence_histogram(incidents: DataFrame) -> DataFrame:
    """bucket (0 to 4) and incidents, empty buckets included."""
    bucket = F.least(F.floor(F.col("confidence") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    counts = incidents.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = incidents.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("incidents"))


def incident_stats(incidents: DataFrame, alarms: DataFrame) -> DataFrame:
    """One row: incidents, by pattern, by codebook, alarms, correlated, reduction and share correlated."""
    totals = alarms.agg(F.count("*").alias("alarms"))
    members = incidents.select(F.explode(F.array_union(F.array("root_alarm_id"), "child_alarm_ids")).alias("alarm_id")).distinct()
    correlated = alarms.join(members, "alarm_id", "left_semi").agg(F.count("*").alias("correlated"))
    counts = incidents.agg(F.count("*").alias("incidents"), F.count("pattern_id").alias("by_pattern"), F.count_if(F.col("pattern_id").isNull()).alias("by_codebook"))
    row = counts.join(totals, F.lit(True)).join(correlated, F.lit(True))
    return row.withColumn("reduction", F.try_divide(F.col("alarms").cast("double"), F.col("incidents").cast("double"))).withColumn("share_correlated", F.try_divide(F.col("correlated").cast("double"), F.col("alarms").cast("double")))


def noise_metrics(alarms: DataFrame, kept: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: removal (share of noise dropped) and retention (share of real alarms kept). truth: alarm_id, is_noise."""
    k = kept.select("alarm_id", F.lit(1).alias("k")).distinct()
    joined = alarms.select("alarm_id").distinct().join(truth, "alarm_id").join(k, "alarm_id", "left")
    noise, real = F.col("is_noise"), ~F.col("is_noise")
    return joined.agg(
        F.try_divide(F.count_if(noise & F.col("k").isNull()).cast("double"), F.count_if(noise).cast("double")).alias("removal"),
        F.try_divide(F.count_if(real & F.col("k").isNotNull()).cast("double"), F.count_if(real).cast("double")).alias("retention"),
    )


def root_accuracy(incidents: DataFrame, labels: DataFrame, alarms: DataFrame) -> DataFrame:
    """One row: accuracy by type (root type among all label root types) and by incident (root alarm is a label's root)."""
    typed = incidents.join(alarms.select(F.col("alarm_id").alias("root_alarm_id"), "alarm_type"), "root_alarm_id", "left")
    kinds = labels.select(F.col("root_alarm_type").alias("alarm_type"), F.lit(1).alias("t")).distinct()
    roots = labels.select("root_alarm_id", F.lit(1).alias("r")).distinct()
    joined = typed.join(kinds, "alarm_type", "left").join(roots, "root_alarm_id", "left")
    return joined.agg(F.try_divide(F.count("t").cast("double"), F.count("*").cast("double")).alias("by_type"), F.try_divide(F.count("r").cast("double"), F.count("*").cast("double")).alias("by_incident"))


def accuracy_by_scenario(incidents: DataFrame, labels: DataFrame) -> DataFrame:
    """scenario, incidents and hit of each label (scenario, root_alarm_id): whether an incident has its root alarm as root."""
    found = incidents.groupBy("root_alarm_id").agg(F.count("*").alias("incidents"))
    return labels.join(found, "root_alarm_id", "left").select("scenario", F.coalesce("incidents", F.lit(0)).alias("incidents"), F.col("incidents").isNotNull().alias("hit"))


def accuracy(incidents: DataFrame, labels: DataFrame, evaluated: float | None = None) -> DataFrame:
    """One row: value and source: a given evaluation, else incidents whose root type is a label's, else neither."""
    spark = incidents.sparkSession
    if evaluated is not None:
        return spark.createDataFrame([(float(evaluated), "eval")], "value double, source string")
    kinds = labels.select(F.col("root_alarm_type").alias("k"), F.lit(1).alias("hit")).distinct()
    share = incidents.join(kinds, F.col("root_alarm_type") == F.col("k"), "left").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    known = share.join(labels.agg(F.count("*").alias("labels")), F.lit(True))
    value = F.when((F.col("labels") > 0) & (F.col("n") > 0), F.col("hits") / F.col("n"))
    return known.select(value.alias("value"), F.when(value.isNull(), "na").otherwise("client-side-join").alias("source"))


def noise_of(alarms: DataFrame, labels: DataFrame) -> DataFrame:
    """alarm_id and is_noise: an alarm in no label (root_alarm_id, children) is noise."""
    real = labels.select(F.explode(F.concat(F.array("root_alarm_id"), F.coalesce("children", F.array().cast("array<string>")))).alias("alarm_id")).distinct()
    return alarms.select("alarm_id").distinct().join(real.withColumn("real", F.lit(True)), "alarm_id", "left").select("alarm_id", F.col("real").isNull().alias("is_noise"))


def pattern_quality(mined: DataFrame, injected: DataFrame) -> DataFrame:
    """One row: quality, the share of injected sequences that were mined."""
    found = injected.select("sequence").distinct().join(mined.select("sequence").distinct().withColumn("m", F.lit(1)), "sequence", "left")
    return found.agg(F.try_divide(F.count("m").cast("double"), F.count("*").cast("double")).alias("quality"))


def handled(truth: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: coverage (alarms in some label, of all), removed (noise dropped, of all) and auto_handled (both together).

    truth: alarm_id and is_noise; kept: the alarm_ids that passed the noise filter.
    """
    k = kept.select("alarm_id").distinct().withColumn("k", F.lit(1))
    joined = truth.join(k, "alarm_id", "left")
    covered, removed = F.count_if(~F.col("is_noise")), F.count_if(F.col("is_noise") & F.col("k").isNull())
    n = F.count("*").cast("double")
    shares = joined.agg(F.try_divide(covered.cast("double"), n).alias("coverage"), F.try_divide(removed.cast("double"), n).alias("removed"))
    return shares.withColumn("auto_handled", F.col("coverage") + F.col("removed"))


def scenario_counts(labels: DataFrame) -> DataFrame:
    """scenario_type and instances of labels, with the number of distinct types in each row."""
    counts = labels.groupBy("scenario_type").agg(F.count("*").alias("instances"))
    return counts.join(labels.agg(F.countDistinct("scenario_type").alias("types")), F.lit(True))
