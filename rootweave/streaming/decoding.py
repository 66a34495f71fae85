"""Decoding of leftovers on a stream, against the codebook that is newest when a set is due.

Two inputs share a key, the trail: tokens of sets that wait until the watermark has passed their due time, and codebooks,
each of which replaces the ones compiled before it. A set is decoded by a timer, with the codebook compiled last by then, so
that the result is that of ``correlate.decode_newest`` whatever order files come in, as long as nothing comes after the
watermark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rootweave.plans.correlate import FLOOR, MISSING, SPURIOUS

SCENARIOS = "array<struct<scenario_id:string,tokens:array<string>>>"
DECODED = "trail_id string, set_id string, codebook_id string, scenario_id string, distance double, score double"


def inputs(tokens: DataFrame, codebooks: DataFrame) -> DataFrame:
    """Tokens (trail_id, happened_us, due_us, set_id, token) and codebooks (trail_id, compiled_us, codebook_id, scenarios)
    as rows of one kind. A token happens no later than its set is due."""
    some = tokens.select("trail_id", "happened_us", "due_us", "set_id", "token", F.lit(None).cast("string").alias("codebook_id"), F.lit(None).cast(SCENARIOS).alias("scenarios"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("due_us", "long"), ("set_id", "string"), ("token", "string"))]
    return some.unionByName(codebooks.select("trail_id", F.col("compiled_us").alias("happened_us"), *none, "codebook_id", F.col("scenarios").cast(SCENARIOS)))


def closest(tokens: list[str], scenarios: list[tuple[str, list[str]]]) -> tuple[str, float, float] | None:
    """scenario_id, distance and score of the closest scenario above the floor; the larger, then the smaller id among equals."""
    seen, best = Counter(tokens), None
    for scenario_id, expected in scenarios:
        common = (seen & Counter(expected)).total()
        if not common:
            continue
        distance = MISSING * (len(expected) - common) + SPURIOUS * (len(tokens) - common)
        score = max(0.0, 1 - distance / (MISSING * len(expected) + SPURIOUS * len(tokens)))
        order = (-score, -len(expected), scenario_id)
        if score > FLOOR and (best is None or order < best[0]):
            best = order, (scenario_id, distance, score)
    return best and best[1]


class Decoder(StatefulProcessor):
    """The waiting sets of a trail and the codebooks that they may still need: the newest one behind the watermark, and later ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "due long, set_id string, token string")
        self.books = handle.getMapState("books", "compiled long, codebook_id string", f"scenarios {SCENARIOS}")

    def held(self) -> list[tuple[int, str, str]]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def schedule(self, held: list[tuple[int, str, str]]) -> None:
        """One timer, at the set that is due first."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer(-(-min(held)[0] // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for batch in rows:
            for x in batch.itertuples(index=False):
                if x.set_id is not None:
                    new.append((int(x.due_us), x.set_id, x.token))
                elif x.codebook_id is not None:
                    scenarios = [(s["scenario_id"], list(s["tokens"])) for s in x.scenarios]
                    self.books.updateValue((int(x.happened_us), x.codebook_id), (scenarios,))
        if new:
            self.waiting.appendList(new)
            self.schedule(self.held())
        yield pd.DataFrame([], columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.held()
        ripe: dict[tuple[int, str], list[str]] = {}
        for due, set_id, token in held:
            if due <= now:
                ripe.setdefault((due, set_id), []).append(token)
        books = sorted(tuple(k) for k in self.books.keys()) if self.books.exists() else []
        out = []
        for (due, set_id), tokens in sorted(ripe.items()):
            newest = max((b for b in books if b[0] <= due), default=None)
            if newest and (found := closest(tokens, [(s[0], list(s[1])) for s in self.books.getValue(newest)[0]])):
                out.append((*key, set_id, newest[1], *found))
        passed = [b for b in books if b[0] <= now]
        for old in passed[:-1]:
            self.books.removeKey(old)
        rest = [r for r in held if r[0] > now]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.schedule(rest)
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = ["trail_id", "set_id", "codebook_id", "scenario_id", "distance", "score"]


def decoded(rows: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """trail_id, set_id, codebook_id, scenario_id, distance and score of a stream of ``inputs``; sets without a scenario above
    the floor, or without a codebook, give no row. Needs ``live.use_state_store``."""
    timed = rows.withColumn("happened_at", F.timestamp_micros("happened_us")).withWatermark("happened_at", lateness)
    return timed.groupBy("trail_id").transformWithStateInPandas(Decoder(), outputStructType=DECODED, outputMode="append", timeMode="EventTime")
