"""Snapshots, corpora and labels as JSON files; graphs as Parquet by domain and snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.functions.ids import is_object_id
from rootweave.operators.ranks import numbered
from rootweave.sources.wire import REQUIRED

SNAPSHOT = (
    "schemaVersion int, snapshotId string, domain string, "
    "nodes array<struct<managedObjectId: string, objectType: string, name: string, attributes: map<string, string>>>, "
    "edges array<struct<from: string, to: string, relation: string, attributes: map<string, string>>>"
)
LABEL = "scenarioId string, scenarioType string, rootCause string, rootCauseManagedObjectId string, rootCauseAlarmType string, children array<string>"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row a file; a file that is no such JSON stops the read."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def small_enough(text: Column, most: int) -> Column:
    """Whether a text has ``most`` bytes at most."""
    return F.octet_length(text) <= most


def unnested(rows: DataFrame, items: Column, name: str, *keep: str | Column) -> DataFrame:
    """``keep``, i and ``name``: a row for each item of an array, null items too.

    The outer form leaves the test for empty arrays here; else Spark puts it, and all parsing that it takes, before the
    shuffle that deals the texts over tasks.
    """
    return rows.select(*keep, F.posexplode_outer(items).alias("i", name)).where("i is not null")


def lift(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of snapshots, stamped with domain and snapshot; one of each key."""
    nodes = unnested(snapshots, F.col("nodes"), "n", "domain", F.col("snapshotId").alias("snapshot"))
    vertices = nodes.select("domain", "snapshot", F.col("n.managedObjectId").alias("id"), F.col("n.objectType").alias("object_type"), F.col("n.name").alias("name"), F.col("n.attributes").alias("attributes"))
    ties = unnested(snapshots, F.col("edges"), "e", "domain", F.col("snapshotId").alias("snapshot"))
    edges = ties.select("domain", "snapshot", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.relation").alias("relation"), F.col("e.attributes").alias("attributes"))
    return vertices.dropDuplicates(["domain", "snapshot", "id"]), edges.dropDuplicates(["domain", "snapshot", "src", "dst", "relation"])


def write_graph(rows: DataFrame, path: str) -> None:
    """Replaces the partitions of the snapshots that the rows hold, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "snapshot").parquet(path)


def without_snapshot(rows: DataFrame, snapshot: str) -> DataFrame:
    return rows.where(F.col("snapshot") != snapshot)


def delete_snapshot(spark: SparkSession, path: str, snapshot: str) -> int:
    """Removes a snapshot's partitions of all domains from a written graph; returns how many there were."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/domain=*/snapshot={snapshot}")
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in folder.globStatus(where) or []]
    for part in found:
        folder.delete(part, True)
    return len(found)


#: How our own lines begin; what follows up to the last brace is the envelope as it was written.
LINE = r'^\{"seq":[0-9]+,"topic":"[^"\\\\]*","envelope":(.*)\}$'


def read_corpus(spark: SparkSession, path: str, checked: bool = False) -> DataFrame:
    """seq, topic and envelope (JSON text) of a recorded corpus, in the order of seq; header and blank lines are skipped.

    ``checked``: a pass over all lines comes first, and the call fails with the first line, by seq and text, that is no JSON
    (its seq is 0), or whose envelope has no sound alarm as its payload.
    """
    line = F.col("value")
    lines = spark.read.text(path).where((F.trim(line) != "") & F.get_json_object(line, "$.corpusVersion").isNull())
    seq = F.coalesce(F.get_json_object(line, "$.seq").cast("long"), F.lit(0))
    own = F.regexp_extract(line, LINE, 1)
    rows = lines.select("value", seq.alias("seq"), F.get_json_object(line, "$.topic").alias("topic"), F.when(own != "", own).otherwise(F.get_json_object(line, "$.envelope")).alias("envelope"))
    if checked:
        payload = F.get_json_object("envelope", "$.payload")
        held = F.json_object_keys(payload)
        lacks = F.array_except(F.array(*map(F.lit, REQUIRED["AlarmEvent"])), F.coalesce(held, F.array().cast("array<string>")))
        wrong = (
            F.when(F.json_object_keys("value").isNull(), "bad JSON")
            .when(held.isNull(), "missing envelope.payload")
            .when(F.size(lacks) > 0, F.concat(F.lit("payload lacks "), F.get(lacks, 0)))
            .when(~is_object_id(F.get_json_object(payload, "$.managedObjectId")), "bad managed object id")
        )
        bad = rows.where(wrong.isNotNull()).agg(F.min(F.struct("seq", "value", wrong.alias("why"))).alias("bad")).first().bad
        if bad:
            raise ValueError(f"corpus line {bad.seq}: {bad.why}")
    return rows.drop("value").orderBy("seq")


def corpus_lines(events: DataFrame, run: str, phase: str) -> DataFrame:
    """Lines of a corpus file: a header with the count, then events numbered in the order of (raised_us, alarm_id) by topic.

    An event's envelope stands in its line as it is.
    """
    body = numbered(events, ["topic"], ["raised_us", "alarm_id"], "seq")
    text = F.concat(F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"topic":"'), F.col("topic"), F.lit('","envelope":'), F.col("envelope"), F.lit("}"))
    lines = body.select("topic", F.col("seq").cast("long").alias("line"), text.alias("value"))
    header = body.groupBy("topic").agg(F.count("*").alias("count")).select("topic", F.lit(-1).cast("long").alias("line"), F.to_json(F.struct(F.lit(1).alias("corpusVersion"), F.lit(run).alias("sourceRunId"), F.lit(phase).alias("phase"), "topic", "count")).alias("value"))
    return header.unionByName(lines)


def write_corpus(events: DataFrame, path: str, run: str, phase: str) -> None:
    """Writes corpus lines as text, a folder for each topic; the files of a topic are in the order of its lines."""
    lines = corpus_lines(events, run, phase).repartitionByRange("topic", "line").sortWithinPartitions("topic", "line")
    lines.select("topic", "value").write.mode("overwrite").partitionBy("topic").text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL).json(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").json(path)
