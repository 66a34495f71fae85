"""Events on the wire: envelope decoding with reject reasons, serialisation, topics, streams, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.functions.ids import is_object_id

# Payload types with their required fields, the only version, and the topics with their partitions.
REQUIRED = {
    "AlarmEvent": ["alarmId", "managedObjectId", "eventType", "alarmType", "perceivedSeverity", "raisedAt", "state"],
    "AlarmStatusChange": ["alarmId", "newStatus", "source", "changedAt"],
    "TransactionEvent": ["transactionId", "trailId", "snapshotId", "alarmIds", "alarms", "windowStart", "windowEnd"],
    "PatternMinedEvent": ["sequence", "support", "confidence", "lift", "trailId", "timing", "provenance"],
    "PatternDiscoveredEvent": ["patternId", "sequence", "rootCauseAlarmType", "support", "confidence", "lift", "timing", "sessionWindow", "lifecycle"],
    "PatternApprovedEvent": ["patternId", "sequence", "rootCauseAlarmType", "support", "confidence", "lift", "timing", "sessionWindow", "lifecycle"],
    "CorrelationResultEvent": ["incidentId", "rootCauseAlarmId", "childAlarmIds", "confidence", "trailId"],
    "TopologyChangedEvent": ["snapshotId", "changeType", "nodes", "edges"],
    "TrailsBuiltEvent": ["snapshotId", "trailIds", "trailCount"],
    "CodebookGeneratedEvent": ["snapshotId", "scenarioCount", "codebookId"],
    "KnowledgeUpdatedEvent": ["recordType", "version", "domain"],
}
ENVELOPE = ["eventId", "type", "schemaVersion", "occurredAt", "source", "traceId", "payload"]
VERSION = 1
TOPICS = {
    "topology.changed": 3, "trails.built": 3, "codebook.generated": 3, "knowledge.updated": 3, "alarms.history": 3, "alarms.live": 3,
    "alarms.enriched": 3, "alarms.enriched.live": 3, "alarms.persisted.live": 3, "alarms.status.changed": 3, "transactions.clean": 3,
    "patterns.mined": 3, "patterns.discovered": 3, "patterns.approved": 3, "correlation.results": 3,
    "topology.changed.dlq": 1, "trails.built.dlq": 1, "transactions.clean.dlq": 1, "alarms.history.dlq": 1, "alarms.live.dlq": 1,
    "alarms.enriched.live.dlq": 1, "alarms.persisted.live.dlq": 1, "alarms.status.changed.dlq": 1, "correlation.results.dlq": 1,
}


def decode(raw: DataFrame, column: str = "value") -> DataFrame:
    """Adds envelope fields, payload (JSON text) and reject_reason (null if sound).

    Checked in this order: JSON object, envelope fields (none missing or unknown), version, type, payload fields.
    """
    text = F.col(column).cast("string")
    fields = {f: F.get_json_object(text, f"$.{f}") for f in ENVELOPE}
    keys = F.json_object_keys(text)
    payload = fields["payload"]
    kind = fields["type"]
    missing = F.filter(F.array(*map(F.lit, ENVELOPE)), lambda f: ~F.array_contains(F.coalesce(keys, F.array()), f))
    unknown = F.array_except(keys, F.array(*map(F.lit, ENVELOPE)))
    needs = F.create_map(*[x for t, need in REQUIRED.items() for x in (F.lit(t), F.array(*map(F.lit, need)))])
    held = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    lacking = F.array_except(F.try_element_at(needs, kind), held)
    ids = F.get_json_object(payload, "$.managedObjectId")
    reason = (
        F.when(text.isNull() | keys.isNull(), "not a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing field "), F.get(missing, 0)))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.get(unknown, 0)))
        .when(~F.coalesce(fields["schemaVersion"].try_cast("int") == VERSION, F.lit(False)), "unsupported version")
        .when(~kind.isin(list(REQUIRED)), "unknown type")
        .when(F.size(lacking) > 0, F.concat(F.lit("payload lacks "), F.get(lacking, 0)))
        .when((kind == "AlarmEvent") & ~is_object_id(ids), "bad managed object id")
    )
    return raw.select("*", *[fields[f].alias(f) for f in ENVELOPE], reason.alias("reject_reason"))


def sound(decoded: DataFrame) -> DataFrame:
    return decoded.where("reject_reason is null")


def rejected(decoded: DataFrame, topic: str, column: str = "value") -> DataFrame:
    """Dead letters: the raw text, why it was refused, and where it was read."""
    return decoded.where("reject_reason is not null").select(F.lit(topic).alias("topic"), F.col(column).cast("string").alias("raw"), "reject_reason")


def envelope(kind: str, source: str, payload: Column, event_id: Column, at: Column, trace: Column) -> Column:
    """The JSON text of an event; nulls are left out."""
    fields = {"eventId": event_id, "type": F.lit(kind), "schemaVersion": F.lit(VERSION), "occurredAt": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "source": F.lit(source), "traceId": trace, "payload": payload}
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream of a Kafka topic from its beginning."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()


def write_topic(rows: DataFrame, servers: str, topic: str, checkpoint: str):
    """A stream of (key, value) to a Kafka topic."""
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def catalogue(spark: SparkSession) -> DataFrame:
    """topic, partitions and whether it holds dead letters."""
    return spark.createDataFrame([(t, n, t.endswith(".dlq")) for t, n in TOPICS.items()], "topic string, partitions int, is_dlq boolean")


def murmur2(text: Column) -> Column:
    """The unsigned 32-bit hash by which producers deal keys to partitions (public MurmurHash2, seed 0x9747b28c), of the UTF-8 bytes.

    Products of two 32-bit numbers fit into a long, as the multiplier has 31 bits.
    """
    data = F.hex(text.cast("binary"))
    size = F.length(data) / 2
    whole = F.floor(size / 4).cast("int")
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    times = lambda x: low(x * F.lit(0x5BD1E995))
    byte = lambda i: F.conv(F.substring(data, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    begin = low(F.lit(0x9747B28C).bitwiseXOR(size.cast("long")))

    def mixed(h: Column, i: Column) -> Column:
        k = times(F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0).cast("long"), lambda s, j: s + byte(4 * i + j) * F.pow(F.lit(256), j).cast("long")))
        return times(h).bitwiseXOR(times(k.bitwiseXOR(F.shiftrightunsigned(k, 24))))

    chunks = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(chunks, begin, mixed)
    rest = F.when(size.cast("int") > 4 * whole, F.sequence(F.lit(0), size.cast("int") - 4 * whole - 1)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(rest, F.lit(0).cast("long"), lambda s, j: s + byte(4 * whole + j) * F.pow(F.lit(256), j).cast("long"))
    h = F.when(F.size(rest) > 0, times(h.bitwiseXOR(tail))).otherwise(h)
    h = times(h.bitwiseXOR(F.shiftrightunsigned(h, 13)))
    return h.bitwiseXOR(F.shiftrightunsigned(h, 15))


def keyed(events: DataFrame, topic: Column, key: Column) -> DataFrame:
    """events with topic, key (text) and the partition that a producer deals the key to; an unknown topic has none."""
    sizes = catalogue(events.sparkSession).select("topic", "partitions")
    rows = events.withColumn("topic", topic).withColumn("key", key.cast("string"))
    return rows.join(sizes, "topic", "left").withColumn("partition", (murmur2(F.col("key")).bitwiseAND(F.lit(0x7FFFFFFF)) % F.col("partitions")).cast("int")).drop("partitions")


def replay(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """Recorded batches as a stream, a few files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
