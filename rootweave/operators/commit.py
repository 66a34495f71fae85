"""Committed snapshots: what an ingest writes counts from its manifest on, and not before.

An ingest writes vertices, edges and what it has taken under a number of its own, then one manifest of all snapshots that are
kept: where each lies, and which is current. A manifest is whole by itself: what is kept is read off the newest, older ones say
what was kept before. An ingest that fails leaves files that no manifest names, and its number is taken again; one that is
repeated finds all its snapshots known, those evicted since too, and changes nothing. Events are read off the manifests, so that
none is there before its commit, or twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootweave.operators.ingest import checked, lifted
from rootweave.session import settle

KEPT = 2
ENTRY = "domain string, snapshot string, built_at long, nodes int, edges int, version long, current boolean"
TAKEN = "domain string, snapshot string, built_at long"


class SnapshotStore:
    """``keep`` newest snapshots of each domain; older ones are evicted by leaving the manifest."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = KEPT) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def read(self, part: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{schema}, ingest long")
        return self.spark.read.schema(f"{schema}, ingest long").parquet(f"{self.folder}/{part}")

    def write(self, rows: DataFrame, part: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{part}/ingest={number}")

    def newest(self) -> int | None:
        return self.read("manifest", ENTRY).agg(F.max("ingest")).first()[0]

    def manifest(self) -> DataFrame:
        """The snapshots that are kept: all of them stand in the newest manifest."""
        return self.read("manifest", ENTRY).where(F.col("ingest") == F.lit(self.newest())).drop("ingest")

    def taken(self) -> DataFrame:
        """Every snapshot that was committed, evicted ones too, with the time that it last came with."""
        commits = self.read("manifest", ENTRY).select("ingest").distinct()
        rows = self.read("snapshots", TAKEN).join(commits, "ingest", "left_semi")
        return rows.groupBy("domain", "snapshot").agg(F.max_by("built_at", "ingest").alias("built_at"))

    def commit(self, raw: DataFrame, vocabulary: DataFrame, at: Column) -> DataFrame:
        """Takes snapshot texts (key, value) and returns the rejects. ``at``: when a snapshot was built.

        A snapshot that is known with the same time is left as it is; with another time it is replaced. One that was evicted
        is known too, and is only taken again where it would now be kept. The current snapshot of a domain is the one built
        last, whenever it is ingested.
        """
        last = self.newest()
        number = 0 if last is None else last + 1
        known = settle(self.manifest(), "known")
        taken, rejects = checked(raw, vocabulary)
        parts = lifted(settle(taken, "taken"), at)
        same = known.select("domain", "snapshot", "built_at")
        fresh = settle(parts["snapshots"].join(same, ["domain", "snapshot", "built_at"], "left_anti"), "fresh")
        if fresh.isEmpty():
            return rejects
        every = known.drop("current").join(fresh, ["domain", "snapshot"], "left_anti").unionByName(fresh.withColumn("version", F.lit(number).cast("long")))
        age = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("built_at"), F.desc("snapshot")))
        kept = settle(every.withColumn("age", age).where(F.col("age") <= self.keep).withColumn("current", F.col("age") == 1).drop("age"), "kept")
        stays = kept.where(F.col("version") == number)
        evicted = fresh.join(self.taken(), ["domain", "snapshot", "built_at"], "left_semi").join(stays, ["domain", "snapshot"], "left_anti")
        news = settle(fresh.join(evicted, ["domain", "snapshot"], "left_anti"), "news")
        if not news.isEmpty():
            for part in ("vertices", "edges"):
                self.write(parts[part].join(news, ["domain", "snapshot"], "left_semi"), part, number)
            self.write(news.select("domain", "snapshot", "built_at"), "snapshots", number)
            self.publish(kept, number)
        return rejects

    def publish(self, kept: DataFrame, number: int) -> None:
        """The commit: one file, there or not."""
        self.write(kept.coalesce(1), "manifest", number)

    def graph(self, part: str, columns: str) -> DataFrame:
        """``vertices`` or ``edges`` of the current snapshots."""
        current = self.manifest().where("current").select("domain", "snapshot", F.col("version").alias("ingest"))
        return self.read(part, columns).join(current, ["domain", "snapshot", "ingest"], "left_semi").drop("ingest")

    def events(self, change: str = "full", trace: str = "trace") -> DataFrame:
        """The topology.changed payloads of all commits so far."""
        taken = self.read("manifest", ENTRY).where(F.col("version") == F.col("ingest"))
        return taken.select("ingest", F.col("snapshot").alias("snapshotId"), F.lit(change).alias("changeType"), "nodes", "edges", F.lit(trace).alias("traceId"))
