"""Live alarm state as a table that a stream merges into: raises open, status events and clears change, each once.

The table is a folder of versions. A batch writes the buckets that it touches under its own number, then one small file, the
manifest, which says for each bucket which batch holds it. Readers take the newest manifest; a batch reads the newest one
before its own. A batch that is run again, after a failure at any point, therefore reads and writes what it did before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rootweave.plans import alarms as live

CHANGE = "alarm_id string, raise struct<raised_us:bigint,moid:string,alarm_type:string>, event struct<changed_us:bigint,event_id:string,new_status:string>"
STATE = "alarm_id string, first struct<raised_us:bigint,moid:string,alarm_type:string>, events array<struct<changed_us:bigint,event_id:string,new_status:string>>"


def changes_of(alarms: DataFrame, changes: DataFrame) -> DataFrame:
    """What alarms (raises and clears) and status changes do, as rows of one kind; streams or tables."""
    no_event, no_raise = (F.lit(None).cast(kind) for kind in ("struct<changed_us:bigint,event_id:string,new_status:string>", "struct<raised_us:bigint,moid:string,alarm_type:string>"))
    raised = alarms.where("state = 'raised'").select("alarm_id", F.struct("raised_us", "moid", "alarm_type").alias("raise"), no_event.alias("event"))
    event = F.struct("changed_us", "event_id", "new_status").alias("event")
    cleared = live.clears(alarms).select("alarm_id", no_raise.alias("raise"), event)
    return raised.unionByName(cleared).unionByName(changes.select("alarm_id", no_raise.alias("raise"), event))


def once(events: Column) -> Column:
    """Each event_id once, its first delivery by (changed_us, new_status), in the order of time."""
    ordered = F.array_sort(events)
    ids = F.transform(ordered, lambda e: e["event_id"])
    return F.filter(ordered, lambda e, i: F.array_position(ids, e["event_id"]) == i + 1)


class LiveTable:
    """State of all alarms, by buckets of their ids.

    ``buckets`` is fixed for a folder. What older manifests alone refer to can be deleted at any time.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """bucket: batch of the newest version, or of the newest one before a batch; one row for each bucket."""
        rows = self.manifests()
        rows = rows if before is None else rows.where(F.col("batch") < before)
        last = rows.agg(F.max("batch")).first()[0]
        return {} if last is None else {r.bucket: r.version for r in rows.where(F.col("batch") == last).collect()}

    def manifests(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "bucket int, version long, batch long")
        return self.spark.read.schema("bucket int, version long, batch long").parquet(f"{self.folder}/manifest")

    def rows(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/state/batch={version}/bucket={bucket}" for bucket, version in manifest.items()]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def merge(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch, over rows as ``changes_of`` gives them. Newly opened alarms are published once, under the batch's number."""
        bucket = F.pmod(F.xxhash64("alarm_id"), F.lit(self.buckets)).cast("int")
        new = batch.groupBy("alarm_id").agg(F.min("raise").alias("first"), F.collect_set("event").alias("events"))
        staged = f"{self.folder}/staged/batch={number}"
        new.write.mode("overwrite").parquet(staged)  # a source may be read only once
        new = self.spark.read.schema(STATE).parquet(staged)
        touched = [r.bucket for r in new.select(bucket.alias("bucket")).distinct().collect()]
        known = self.manifest(number)
        old = self.rows({b: known[b] for b in touched if b in known})
        merged = old.unionByName(new).groupBy("alarm_id").agg(F.min("first").alias("first"), once(F.flatten(F.collect_list("events"))).alias("events"))
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/state/batch={number}")
        opened = new.where("first is not null").join(old.where("first is not null").select("alarm_id"), "alarm_id", "left_anti")
        opened.select("alarm_id", "first.*", F.lit("open").alias("status")).write.mode("overwrite").parquet(f"{self.folder}/published/batch={number}")
        self.commit(known | dict.fromkeys(touched, number), number)

    def commit(self, manifest: dict[int, int], number: int) -> None:
        rows = self.spark.createDataFrame(sorted(manifest.items()), "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={number}")

    def current(self) -> DataFrame:
        return self.rows(self.manifest())

    def lifecycle(self) -> DataFrame:
        """As ``alarms.lifecycle`` of all that was merged; events of alarms that no raise has opened yet wait."""
        last = F.element_at("events", -1)
        some = F.size("events") > 0
        shown = F.when(~some | (last["new_status"] == "reverted-open"), "open").otherwise(last["new_status"])
        return self.current().where("first is not null").select("alarm_id", shown.alias("status"), F.when(some, last["changed_us"]).otherwise(F.col("first.raised_us")).alias("since_us"), F.size("events").cast("long").alias("n_changes"))

    def transitions(self) -> DataFrame:
        return self.current().where(F.size("events") > 0).select("alarm_id", F.col("events.new_status").alias("statuses"))

    def published(self) -> DataFrame:
        return self.spark.read.schema("alarm_id string, raised_us long, moid string, alarm_type string, status string, batch long").parquet(f"{self.folder}/published")


def follow(changes: DataFrame, table: LiveTable, checkpoint: str) -> StreamingQuery:
    """Merges a stream of changes into the table, all that is there, then stops."""
    return changes.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
