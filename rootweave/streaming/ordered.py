"""Enrichment steps on a stream that give what their batch forms give: first deliveries, hold-down, flap damping.

Rows of one key wait in state until the watermark has passed them; then they are worked off in the order of event time, so
that the result does not depend on which batch brought which row. Rows behind the watermark are dropped before they
get here. Streams need event time in ``raised_at`` (``live.timed``) and the state store of ``live.use_state_store``.

Keys are dealt to buckets. A call for each key costs far more than its few rows, so state, timer and output are a bucket's:
what one batch brings it waits as one Arrow block, rows of all its keys are worked off together, column by column, and what is
remembered of its keys is kept in a few pieces of state, each read and written in one call.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rootweave.plans.enrich import FLAP_WINDOW_US, FLAPS, HOLD_US

#: Buckets of keys. A bucket's waiting rows are in memory when its timer fires.
BUCKETS = 4096

WAITING = pa.schema([("at", pa.int64()), *[(c, pa.string()) for c in ("key", "rank", "state", "body")]])


def packed(rows: pa.Table) -> tuple[int, bytes]:
    """The first time in rows, and rows as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WAITING, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(rows)
    return pc.min(rows["at"]).as_py(), sink.getvalue().to_pybytes()


class Ripe:
    """Rows of a bucket, each key's together and in order: ``of`` and ``state`` are places in ``names`` and ``states``, no state is -1."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.sort_by([(c, "ascending") for c in ("key", "at", "rank", "state", "body")]).combine_chunks()
        coded = {c: pc.dictionary_encode(rows[c].combine_chunks()) for c in ("key", "state")}
        self.body, self.at = rows["body"], rows["at"].to_numpy()
        self.names, self.of = coded["key"].dictionary.to_pylist(), coded["key"].indices.to_numpy()
        self.states, self.state = coded["state"].dictionary.to_pylist(), pc.fill_null(coded["state"].indices, -1).to_numpy()
        turns = self.of[1:] != self.of[:-1]
        self.firsts, self.lasts = np.flatnonzero(np.append(True, turns)), np.flatnonzero(np.append(turns, True))

    def before(self, values: np.ndarray, known: list) -> np.ndarray:
        """The value of the row before, which for the first row of each name is the known one."""
        found = np.append(values[:1], values[:-1])
        found[self.firsts] = known
        return found

    def given(self, outcome: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"body": self.body.to_pandas(), "outcome": outcome})


def kept(bodies: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"body": bodies, "outcome": "kept"})


class InOrder(StatefulProcessor):
    """Base: ``advance`` takes rows in order with what is remembered of their keys, gives outcomes and changes the memory."""

    #: Pieces in which a bucket's memory is kept. Pieces with rows are read and written whole.
    PIECES = 4
    #: Whether every memory has a deadline, so that it doesn't last.
    PENDING = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first long, rows binary")
        self.memory = handle.getMapState("memory", "piece int", "known string")

    def advance(self, rows: Ripe, known: dict[str, list]) -> pd.DataFrame:
        raise NotImplementedError

    def overdue(self, now: int, known: dict[str, list]) -> list[str]:
        """Bodies of what is kept once no row up to ``now`` can come any more; they leave the memory."""
        return []

    def deadlines(self, known: dict[str, list]) -> list[int]:
        """When ``overdue`` is to be asked, in microseconds."""
        return []

    def wake(self, at: list[int], timers: list[int]) -> None:
        """One timer, at the first of the given times and those set before."""
        due = min([-(-t // 1000) for t in at] + timers, default=None)
        if due is not None and due not in timers:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for part in rows:
            block = packed(pa.Table.from_pandas(part[WAITING.names], WAITING, preserve_index=False))
            self.waiting.appendValue(block)
            first.append(block[0])
        self.wake(first, list(self.handle.listTimers()))
        return iter(())

    def ripe(self, now: int) -> tuple[Ripe | None, int | None]:
        """Rows up to ``now``, which are taken from what waits; and the first time that still waits."""
        held = [(first, bytes(rows)) for first, rows in self.waiting.get()] if self.waiting.exists() else []
        left, found = [block for block in held if block[0] > now], None
        if len(left) < len(held):
            rows = pa.concat_tables([pa.ipc.open_stream(rows).read_all() for first, rows in held if first <= now])
            found = Ripe(rows.filter(pc.less_equal(rows["at"], now)))
            rest = rows.filter(pc.greater(rows["at"], now))
            left += [packed(rest)] if len(rest) else []
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        return found, min([block[0] for block in left], default=None)

    def piece(self, name: str) -> int:
        return crc32(name.encode()) % self.PIECES

    def recalled(self, names: list[str]) -> dict[int, str]:
        """Pieces that hold any of the names; all pieces, if memories have deadlines."""
        if not self.memory.exists():
            return {}
        if self.PENDING:
            return {k[0]: v[0] for k, v in self.memory.iterator()}
        return {k: self.memory.getValue((k,))[0] for k in sorted({self.piece(x) for x in names}) if self.memory.containsKey((k,))}

    def remember(self, known: dict[str, list], held: dict[int, str]) -> None:
        """Writes the pieces that are not as they were held."""
        pieces = {k: {} for k in held}
        for name, memory in known.items():
            pieces.setdefault(self.piece(name), {})[name] = memory
        for k, memories in pieces.items():
            text = json.dumps(memories, separators=(",", ":"))
            if memories and text != held.get(k):
                self.memory.updateValue((k,), (text,))
            elif not memories:
                self.memory.removeKey((k,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows, first = self.ripe(now)
        held = self.recalled(rows.names if rows else [])
        known = {name: memory for text in held.values() for name, memory in json.loads(text).items()}
        out = [self.advance(rows, known)] if rows else []
        out += [kept(bodies)] if (bodies := self.overdue(now, known)) else []
        self.remember(known, held)
        # the timer that fires is still listed, and goes when this is done
        self.wake(self.deadlines(known) + ([first] if first is not None else []), [t for t in self.handle.listTimers() if t * 1000 > now])
        yield from (frame for frame in out if len(frame))

    def close(self) -> None:
        pass


class FirstDelivery(InOrder):
    """The first row of a key is kept, all others are duplicates, however much later they come."""

    #: Ids only ever become more: about one to a piece, so that old ones are not written again.
    PIECES = 2**31

    def advance(self, rows, known):
        outcome = np.full(len(rows.of), "duplicate", object)
        outcome[rows.firsts[[name not in known for name in rows.names]]] = "kept"
        known.update((name, []) for name in rows.names)
        return rows.given(outcome)


class HoldDown(InOrder):
    """A raise is held until the next row of its key, or until the hold time is over; a clear in time takes it away with itself.

    Of a key whose last row is a raise, its time and body are remembered.
    """

    PENDING = True

    def __init__(self, hold_us: int) -> None:
        self.hold_us = hold_us

    def advance(self, rows, known):
        raised, cleared = ([x == state for x in rows.states] + [False] for state in ("raised", "cleared"))  # -1 is the last
        raised, cleared = np.array(raised)[rows.state], np.array(cleared)[rows.state]
        held = [known.pop(name, None) for name in rows.names]
        since = rows.before(rows.at, [x[0] if x else 0 for x in held])
        takes = cleared & rows.before(raised, [x is not None for x in held]) & (rows.at - since <= self.hold_us)
        stays = ~takes & ~(raised & np.append(takes[1:], False))
        open_ = rows.lasts[raised[rows.lasts]]
        stays[open_] = False
        known.update((rows.names[rows.of[i]], [int(rows.at[i]), rows.body[int(i)].as_py()]) for i in open_)
        bodies = [x[1] for x, gone in zip(held, takes[rows.firsts], strict=True) if x and not gone]
        return kept(bodies + rows.body.filter(pa.array(stays)).to_pylist())

    def deadlines(self, known):
        return [at + self.hold_us for at, _ in known.values()]

    def overdue(self, now, known):
        return [known.pop(name)[1] for name, (at, _) in list(known.items()) if at + self.hold_us <= now]


class FlapDamper(InOrder):
    """Rows of a key with over ``most`` changes of state in the window up to them are damped.

    The last state and the times of the last ``most`` + 1 changes are remembered: whether they lie in the window is all that counts.
    """

    def __init__(self, window_us: int, most: int) -> None:
        self.window_us, self.most = window_us, most

    def advance(self, rows, known):
        of, at, state = rows.of, rows.at, rows.state
        code = {x: i for i, x in enumerate(rows.states)} | {None: -1}
        old = [known.get(name, [None, []]) for name in rows.names]
        last = rows.before(state, [code.get(x, len(code)) for x, _ in old])
        toggle = (last >= 0) & (state >= 0) & (last != state)
        # changes of all keys, each key's in order of time
        old_of = np.repeat(np.arange(len(old)), [len(times) for _, times in old])
        whose = np.append(old_of, of[toggle])
        order = np.argsort(whose, kind="stable")
        whose, times = whose[order], np.append(np.array([t for _, x in old for t in x], np.int64), at[toggle])[order]
        ends = np.append(np.flatnonzero((of[1:] != of[:-1]) | (at[1:] != at[:-1])), len(of) - 1)
        moment = ends[np.searchsorted(ends, np.arange(len(of)))]  # rows of one moment count for each other
        place = np.searchsorted(old_of, of, "right") + np.cumsum(toggle)[moment] - self.most - 1
        damped = place >= np.searchsorted(whose, of)
        damped[damped] = times[place[damped]] >= at[damped] - self.window_us
        start, end = (np.searchsorted(whose, np.arange(len(old)), side) for side in ("left", "right"))
        for k, name in enumerate(rows.names):
            now = state[rows.lasts[k]]
            known[name] = [rows.states[now] if now >= 0 else None, times[max(start[k], end[k] - self.most - 1) : end[k]].tolist()]
        return rows.given(np.where(damped, "damped", "kept"))


def in_order(alarms: DataFrame, keys: list[str], rank: Column, processor: InOrder, buckets: int | None = None) -> DataFrame:
    """alarms with outcome, through a processor, key by key; columns are as they were."""
    columns = [c for c in alarms.columns if c != "raised_at"]
    schema = alarms.select(*columns).schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets or BUCKETS))
    rows = alarms.select(bucket.alias("bucket"), "raised_at", F.col("raised_us").alias("at"), F.to_json(F.struct(*keys)).alias("key"), rank.alias("rank"), "state", F.to_json(F.struct(*columns)).alias("body"))
    found = rows.groupBy("bucket").transformWithStateInPandas(processor, outputStructType="body string, outcome string", outputMode="append", timeMode="EventTime")
    return found.select(F.from_json("body", schema).alias("row"), "outcome").select("row.*", "outcome")


def first_deliveries(decoded: DataFrame) -> DataFrame:
    """Alarms with outcome: 'kept' for the first row of each alarm_id by (raised_us, moid, alarm_type, state), 'duplicate' for
    the others, and for rows with a reject_reason that reason: one pass, from which what is kept and the dead letters are cut."""
    sound = decoded.where("reject_reason is null").drop("reject_reason")
    # nulls first, as in the batch form; \x01 ends a value, so that a shorter one comes first
    rank = F.concat(*[F.concat(F.coalesce(F.concat(F.lit("="), c), F.lit("")), F.lit("\x01")) for c in ("moid", "alarm_type", "state")])
    found = in_order(sound, ["alarm_id"], rank, FirstDelivery())
    poison = decoded.where("reject_reason is not null").withColumn("outcome", F.col("reject_reason")).drop("reject_reason")
    return found.unionByName(poison.select(found.columns))


def without_self_clears(alarms: DataFrame, hold_us: int = HOLD_US, buckets: int | None = None) -> DataFrame:
    """The streaming form of ``enrich.without_self_clears``."""
    return in_order(alarms, ["moid", "alarm_type"], F.col("alarm_id"), HoldDown(hold_us), buckets).drop("outcome")


def without_flapping(alarms: DataFrame, window_us: int = FLAP_WINDOW_US, most: int = FLAPS, buckets: int | None = None) -> DataFrame:
    """The streaming form of ``enrich.without_flapping``."""
    return in_order(alarms, ["moid"], F.col("alarm_id"), FlapDamper(window_us, most), buckets).where("outcome = 'kept'").drop("outcome")
