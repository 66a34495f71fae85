"""Correlation of alarms with known patterns, and decoding of what no pattern covers by the codebook.

An instance of a pattern on a trail opens with the pattern's first token, takes each further token once, and fires as
soon as all but ``tolerance`` tokens are there. It ends unfired once its window has passed: after window_ms without a new
member (gap-based), or window_ms after it opened (fixed). Time is event time, so results don't depend on when they are
computed. ``Instance`` is the one transition function of the batch and the streaming form.

In the batch form a trail's alarms are first cut where they pause for longer than the window; no instance outlives such
a pause, so the pieces are independent. Pieces are dealt to tasks, sorted by time, and streamed through: a task holds one
instance and one batch of rows, however long a piece is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.functions.ids import incident_id
from rootweave.plans.enrich import deduped
from rootweave.plans.mining import running_total, with_previous

TOLERANCE, MISSING, SPURIOUS, FLOOR = 1, 1.0, 2.0, 0.5
EVENT = "kind string, trail_id string, pattern_id string, at_us long, root_alarm_id string, alarm_ids array<string>, confidence double"
COLUMNS = ["kind", "trail_id", "pattern_id", "at_us", "root_alarm_id", "alarm_ids", "confidence"]


@dataclass
class Instance:
    """A pattern's progress on one trail."""

    sequence: list[str]
    root_type: str
    confidence: float
    window_us: int
    by_gap: bool
    tolerance: int = TOLERANCE
    opened: int | None = None
    last: int | None = None
    members: dict[int, tuple[str, str]] = field(default_factory=dict)

    @property
    def deadline(self) -> int | None:
        if self.opened is None:
            return None
        return (self.last if self.by_gap else self.opened) + self.window_us

    def clear(self) -> None:
        self.opened = self.last = None
        self.members = {}

    def expire(self, now: int) -> list[str] | None:
        """The alarms that go back to open if the window is over at ``now``."""
        if self.deadline is None or now <= self.deadline:
            return None
        alarms = [a for a, _ in self.members.values()]
        self.clear()
        return alarms

    def admit(self, alarm_id: str, alarm_type: str, at: int) -> tuple[str, str | None, list[str], float] | None:
        """('in-progress' or 'incident', root alarm, alarms, confidence), or nothing if the alarm has no place."""
        if self.opened is None and alarm_type != self.sequence[0]:
            return None
        if any(a == alarm_id for a, _ in self.members.values()):
            return None
        place = next((i for i, t in enumerate(self.sequence) if t == alarm_type and i not in self.members), None)
        if place is None:
            return None
        self.opened = at if self.opened is None else self.opened
        self.last = at
        self.members[place] = alarm_id, alarm_type
        if len(self.members) < max(1, len(self.sequence) - self.tolerance):
            return "in-progress", None, [alarm_id], 0.0
        alarms = [self.members[i] for i in sorted(self.members)]
        root = next((a for a, t in alarms if t == self.root_type), alarms[0][0])
        share = self.confidence * len(alarms) / len(self.sequence)
        self.clear()
        return "incident", root, [a for a, _ in alarms], min(1.0, share)


def relevant(alarms: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row for each alarm, trail and pattern of the trail whose sequence holds the alarm's type.

    alarms: alarm_id, alarm_type, raised_us, trail_ids; patterns: pattern_id, trail_id, sequence, root_type, confidence,
    window_us, by_gap.
    """
    fanned = alarms.select("alarm_id", "alarm_type", "raised_us", F.explode("trail_ids").alias("trail_id"))
    return fanned.join(patterns, "trail_id").where(F.array_contains("sequence", F.col("alarm_type")))


def correlate(alarms: DataFrame, patterns: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Events of all instances: kind 'in-progress', 'incident' or 'reverted' with trail, pattern, time and alarms."""
    rows = relevant(deduped(alarms), patterns)
    pause = F.when(F.col("raised_us") - F.col("_before") > F.col("window_us"), 1).otherwise(0)
    rows = with_previous(rows, ["trail_id", "pattern_id"]).withColumn("pause", pause)
    rows = running_total(rows, ["trail_id", "pattern_id"], "pause", "piece").drop("pause", "_before", "_stretch")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = p = state = None
        for batch in batches:
            out = []
            event = lambda kind, at, root, ids, c: out.append((kind, p.trail_id, p.pattern_id, at, root, ids, c))  # noqa: E731,B023
            for row in batch.itertuples(index=False):
                at = int(row.raised_us)
                if (row.trail_id, row.pattern_id, row.piece) != key:
                    if state and state.members:
                        event("reverted", state.deadline, None, [a for a, _ in state.members.values()], None)
                    key, p = (row.trail_id, row.pattern_id, row.piece), row
                    state = Instance(list(p.sequence), p.root_type, float(p.confidence), int(p.window_us), bool(p.by_gap), tolerance)
                end = state.deadline
                if gone := state.expire(at):
                    event("reverted", end, None, gone, None)
                if got := state.admit(row.alarm_id, row.alarm_type, at):
                    event(got[0], at, got[1], got[2], got[3])
            yield pd.DataFrame(out, columns=COLUMNS)
        if state and state.members:
            yield pd.DataFrame([("reverted", p.trail_id, p.pattern_id, state.deadline, None, [a for a, _ in state.members.values()], None)], columns=COLUMNS)

    keys = ["trail_id", "pattern_id", "piece"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "raised_us", "alarm_id").mapInPandas(run, EVENT)


def incidents(events: DataFrame) -> DataFrame:
    """incident_id, trail_id, pattern_id, created_us, root_alarm_id, child_alarm_ids and confidence; one for each id."""
    rows = events.where("kind = 'incident'")
    ids = incident_id(F.col("trail_id"), F.col("pattern_id"), F.col("alarm_ids"))
    rows = rows.select(ids.alias("incident_id"), "trail_id", "pattern_id", F.col("at_us").alias("created_us"), "root_alarm_id", F.array_except("alarm_ids", F.array("root_alarm_id")).alias("child_alarm_ids"), "confidence")
    return rows.dropDuplicates(["incident_id"])


def statuses(events: DataFrame) -> DataFrame:
    """alarm_id, new_status and changed_us that instances give to alarms."""
    name = F.expr("case kind when 'incident' then 'correlated' when 'reverted' then 'reverted-open' else 'in-progress' end")
    return events.select(F.explode("alarm_ids").alias("alarm_id"), name.alias("new_status"), F.col("at_us").alias("changed_us"))


def uncovered(alarms: DataFrame, incidents: DataFrame) -> DataFrame:
    """Alarms that no incident holds."""
    held = incidents.select(F.explode(F.array_union(F.array("root_alarm_id"), "child_alarm_ids")).alias("alarm_id"))
    return alarms.join(held, "alarm_id", "left_anti")


def decode(observed: DataFrame, scenarios: DataFrame, missing: float = MISSING, spurious: float = SPURIOUS, floor: float = FLOOR) -> DataFrame:
    """set_id, scenario_id, distance and score: the closest scenario of the trail for each set of alarms, above the floor.

    observed: set_id, trail_id, token; scenarios: scenario_id, trail_id, token; tokens count as bags. The distance weighs
    expected tokens that miss and others that are spurious; score is 1 less its share of the largest possible distance.
    """
    o = observed.groupBy("set_id", "trail_id", "token").agg(F.count("*").alias("o"))
    s = scenarios.groupBy("scenario_id", "trail_id", "token").agg(F.count("*").alias("s"))
    n_o = o.groupBy("set_id").agg(F.sum("o").alias("n_o"))
    n_s = s.groupBy("scenario_id", "trail_id").agg(F.sum("s").alias("n_s"))
    # scenarios that share no token score 0, so a shared token is what makes a candidate
    common = o.join(s, ["trail_id", "token"]).groupBy("set_id", "trail_id", "scenario_id").agg(F.sum(F.least("o", "s")).alias("c"))
    joined = common.join(n_o, "set_id").join(n_s, ["scenario_id", "trail_id"])
    distance = missing * (F.col("n_s") - F.col("c")) + spurious * (F.col("n_o") - F.col("c"))
    scored = joined.withColumn("distance", distance).withColumn("score", F.greatest(F.lit(0.0), 1 - distance / (missing * F.col("n_s") + spurious * F.col("n_o")))).where(F.col("score") > floor)
    best = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("score"), F.desc("n_s"), "scenario_id"))
    return scored.withColumn("_n", best).where("_n = 1").select("set_id", "scenario_id", "distance", "score")


def winners(candidates: DataFrame) -> DataFrame:
    """Of candidate incidents for one alarm (incident_id, alarm_id, size, confidence) the most specific, then surest."""
    order = Window.partitionBy("alarm_id").orderBy(F.desc("size"), F.desc("confidence"), "incident_id")
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def resolved(candidates: DataFrame) -> DataFrame:
    """Incidents that win all their alarms: incident_id."""
    won = winners(candidates).groupBy("incident_id").agg(F.count("*").alias("won"))
    return won.join(candidates.groupBy("incident_id").agg(F.count("*").alias("all")), "incident_id").where("won = all").select("incident_id")


def members(incidents: DataFrame, alarms: DataFrame) -> DataFrame:
    """incident_id, role and the alarm of every member that is known; members without a row of their own drop out."""
    child = F.transform("child_alarm_ids", lambda c: F.struct(c.alias("alarm_id"), F.lit("child").alias("role")))
    listed = incidents.select("incident_id", F.explode(F.concat(F.array(F.struct(F.col("root_alarm_id").alias("alarm_id"), F.lit("root").alias("role"))), child)).alias("m"))
    return listed.select("incident_id", "m.role", "m.alarm_id").distinct().join(alarms, "alarm_id")


def children(incidents: DataFrame, alarms: DataFrame) -> DataFrame:
    """Alarms that are a child of any incident."""
    return alarms.join(incidents.select(F.explode("child_alarm_ids").alias("alarm_id")), "alarm_id", "left_semi")


def leftover_sets(alarms: DataFrame, patterns: DataFrame, events: DataFrame, tick_us: int) -> DataFrame:
    """set_id, trail_id, due_us (the end of the tick or instance) and token of what the codebook decodes: alarms that no pattern of their trail takes in, by trail and
    tick, and the alarms of every instance that ended unfired."""
    fanned = alarms.select("alarm_id", "alarm_type", "raised_us", F.explode("trail_ids").alias("trail_id"))
    taken = events.where("kind <> 'reverted'").select("trail_id", F.explode("alarm_ids").alias("alarm_id")).distinct()
    free = fanned.join(taken, ["trail_id", "alarm_id"], "left_anti")
    tick = F.floor(F.col("raised_us") / tick_us)
    buffered = free.select(F.concat_ws("/", F.lit("tick"), "trail_id", tick.cast("string")).alias("set_id"), "trail_id", ((tick + 1) * tick_us).alias("due_us"), F.col("alarm_type").alias("token"))
    ended = events.where("kind = 'reverted'").select(F.concat_ws("/", F.lit("expired"), "trail_id", "pattern_id", F.col("at_us").cast("string")).alias("set_id"), "trail_id", F.col("at_us").alias("due_us"), F.explode("alarm_ids").alias("alarm_id"))
    salvaged = ended.join(alarms.select("alarm_id", F.col("alarm_type").alias("token")), "alarm_id").select("set_id", "trail_id", "due_us", "token")
    return buffered.unionByName(salvaged)


def latest_codebook(signatures: DataFrame) -> DataFrame:
    """Signatures (snapshot, trail_id, codebook_id, compiled_us, ...) of the codebook that came last for each snapshot and trail."""
    last = signatures.groupBy("snapshot", "trail_id").agg(F.max(F.struct("compiled_us", "codebook_id")).alias("last"))
    return signatures.join(last.select("snapshot", "trail_id", F.col("last.codebook_id").alias("codebook_id")), ["snapshot", "trail_id", "codebook_id"], "left_semi")


def decode_newest(sets: DataFrame, books: DataFrame) -> DataFrame:
    """set_id, codebook_id, scenario_id, distance and score: sets decoded against the codebook compiled last when they are due.

    sets: set_id, trail_id, due_us, token; books: trail_id, compiled_us, codebook_id, scenario_id, token. Of codebooks compiled
    at one time the largest id is the newest. A set without a codebook has no row.
    """
    editions = books.select("trail_id", "compiled_us", "codebook_id").distinct()
    due = sets.select("set_id", "trail_id", "due_us").distinct().join(editions, "trail_id").where("compiled_us <= due_us")
    newest = due.groupBy("set_id", "trail_id").agg(F.max(F.struct("compiled_us", "codebook_id")).alias("book"))
    edition = F.to_json(F.struct("trail_id", "compiled_us", "codebook_id"))
    observed = sets.join(newest.select("set_id", "trail_id", "book.*"), ["set_id", "trail_id"]).select("set_id", edition.alias("trail_id"), "token", "codebook_id")
    found = decode(observed, books.select(edition.alias("trail_id"), "scenario_id", "token"))
    return found.join(newest.select("set_id", "book.codebook_id"), "set_id").select("set_id", "codebook_id", "scenario_id", "distance", "score")
