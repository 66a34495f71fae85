"""Streaming forms: run statistics, correlation with state, rejects; ``ordered`` has enrichment, ``state`` live alarm state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rootweave.plans.correlate import COLUMNS, EVENT, TOLERANCE, Instance

STATE = "opened long, last long, places array<int>, ids array<string>, types array<string>"


def timed(alarms: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Adds raised_at, with a watermark, to alarms with raised_us."""
    return alarms.withColumn("raised_at", F.timestamp_micros("raised_us")).withWatermark("raised_at", lateness)


def deduped(alarms: DataFrame, key: str = "alarm_id") -> DataFrame:
    return alarms.dropDuplicatesWithinWatermark([key])


def counts_by_window(alarms: DataFrame, width: str = "60 seconds") -> DataFrame:
    """trail_id, alarm_type, start_us and alarms of each tumbling window."""
    fanned = alarms.withColumn("trail_id", F.explode("trail_ids"))
    grouped = fanned.groupBy(F.window("raised_at", width), "trail_id", "alarm_type").agg(F.count("*").alias("alarms"))
    return grouped.select("trail_id", "alarm_type", F.unix_micros("window.start").alias("start_us"), "alarms")


class Correlator(StatefulProcessor):
    """An instance for each trail and pattern, advanced by timers in the order of event time.

    Alarms wait until the watermark has passed them, so that one that comes late, but within the watermark, takes its place
    among the others whatever batch brings it; a timer at the instance's deadline reverts what has not fired.
    """

    def __init__(self, tolerance: int = TOLERANCE) -> None:
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", STATE)
        self.waiting = handle.getListState("waiting", "at long, alarm_id string, alarm_type string")
        self.pattern = handle.getValueState("pattern", "sequence array<string>, root_type string, confidence double, window_us long, by_gap boolean")

    def restored(self) -> Instance:
        sequence, root, confidence, window, by_gap = self.pattern.get()
        instance = Instance(list(sequence), root, confidence, window, by_gap, self.tolerance)
        if self.progress.exists():
            opened, last, places, ids, types = self.progress.get()
            instance.opened, instance.last, instance.members = opened, last, {p: (a, t) for p, a, t in zip(places, ids, types, strict=True)}
        return instance

    def keep(self, instance: Instance) -> None:
        if instance.opened is None:
            self.progress.clear()
            return
        places = list(instance.members)  # in the order of admission
        self.progress.update((instance.opened, instance.last, places, [instance.members[p][0] for p in places], [instance.members[p][1] for p in places]))

    def schedule(self, rows: list[tuple[int, str, str]], deadline: int | None) -> None:
        """One timer, at what is due first."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [-(-min(rows)[0] // 1000)] if rows else []
        due += [deadline // 1000 + 1] if deadline is not None else []
        if due:
            self.handle.registerTimer(min(due))

    def held(self) -> list[tuple[int, str, str]]:
        return sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        first = batch.iloc[0]
        if not self.pattern.exists():
            self.pattern.update((list(first.sequence), first.root_type, float(first.confidence), int(first.window_us), bool(first.by_gap)))
        self.waiting.appendList([(int(at), a, t) for at, a, t in zip(batch.raised_us, batch.alarm_id, batch.alarm_type, strict=True)])
        self.schedule(self.held(), self.restored().deadline)
        yield pd.DataFrame([], columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        instance, held, out = self.restored(), self.held(), []
        ripe = [r for r in held if r[0] <= now]
        for at, alarm_id, alarm_type in ripe:
            end = instance.deadline
            if gone := instance.expire(at):
                out.append(("reverted", *key, end, None, gone, None))
            if got := instance.admit(alarm_id, alarm_type, at):
                out.append((got[0], *key, at, *got[1:]))
        end = instance.deadline
        if gone := instance.expire(now):
            out.append(("reverted", *key, end, None, gone, None))
        rest = held[len(ripe) :]
        if ripe:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        self.keep(instance)
        self.schedule(rest, instance.deadline)
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def correlated(rows: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Events of instances over a stream of relevant alarms with raised_at (see ``correlate.relevant``)."""
    return rows.groupBy("trail_id", "pattern_id").transformWithStateInPandas(Correlator(tolerance), outputStructType=EVENT, outputMode="append", timeMode="EventTime")


def use_state_store(spark: SparkSession) -> None:
    """Timers and value states need this store. A commit writes what has changed; whole snapshots are written beside the batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def split_rejects(decoded: DataFrame, good: str, bad: str, checkpoint: str):
    """Writes sound rows to one folder and the others to a second, once for each batch."""

    def both(batch: DataFrame, number: int) -> None:
        for rows, path in ((batch.where("reject_reason is null"), good), (batch.where("reject_reason is not null"), bad)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return decoded.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
