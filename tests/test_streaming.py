"""Streams of recorded files give what the batch forms give."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rootweave import live_queries
from rootweave.plans import alarms as alarm_plans
from rootweave.plans import correlate, enrich
from rootweave.queries import patterns
from rootweave.session import shared_dir
from rootweave.sources import adapters, wire
from rootweave.streaming import decoding, live, ordered, state

SF = "/root/testdata/sf0.001"


def run(frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return frame.sparkSession.table(name)


def recorded(rows, path):
    ordered = rows.repartitionByRange(2, "raised_us").sortWithinPartitions("raised_us")
    ordered.write.parquet(str(path))
    return wire.replay(rows.sparkSession, str(path), rows.schema, 2)


def test_windows_and_repeats(spark, tmp_path):
    rows = adapters.alarms(spark, SF)
    stream = live.deduped(live.timed(recorded(rows.unionByName(rows), tmp_path / "a")))
    got = run(live.counts_by_window(stream, "1 hour"), "windows", "complete")
    assert got.agg(F.sum("alarms")).first()[0] == rows.select(F.explode("trail_ids")).count()


def test_correlation_equals_batch(spark, tmp_path):
    """Files come in another order than their alarms, as far as the watermark allows; the last alarm is long after all others."""
    live.use_state_store(spark)
    alarms = adapters.alarms(spark, SF)
    rows = correlate.relevant(alarms, patterns(spark))
    end = rows.orderBy(F.desc("raised_us")).limit(1).withColumn("trail_id", F.lit("end")).withColumn("raised_us", F.col("raised_us") + F.lit(10**13))
    for k in range(6):
        rows.where(F.pmod(F.xxhash64("alarm_id"), F.lit(6)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    recorded_rows = wire.replay(spark, str(tmp_path / "b"), rows.schema, 1)
    got = run(live.correlated(live.timed(recorded_rows, "100 days")), "events").where("trail_id <> 'end'")
    key = lambda f: sorted((r.kind, r.trail_id, r.pattern_id, r.at_us, tuple(r.alarm_ids)) for r in f.collect())
    batch = key(correlate.correlate(alarms, patterns(spark)))
    assert key(got) == batch and {b[0] for b in batch} == {"in-progress", "incident", "reverted"}


def test_rejects_are_split(spark, tmp_path):
    good = '{"eventId":"1","type":"AlarmStatusChange","schemaVersion":1,"occurredAt":"t","source":"s","traceId":"t","payload":{"alarmId":"a","newStatus":"open","source":"s","changedAt":"t"}}'
    spark.createDataFrame([(good,), ("{",)], "value string").write.parquet(str(tmp_path / "in"))
    decoded = wire.decode(wire.replay(spark, str(tmp_path / "in"), "value string"))
    live.split_rejects(decoded, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == spark.read.parquet(str(tmp_path / "bad")).count() == 1


SECOND = 1_000_000
ALARM = "alarm_id string, moid string, alarm_type string, state string, raised_us long, trail_ids array<string>"


def shuffled(spark, rows, schema, path, files=6, seed=1):
    """Rows in files in any order, then a last one long after all others, so that the watermark passes them."""
    r = random.Random(seed)
    rows = list(rows)
    r.shuffle(rows)
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(str(path))
    end = [("end", "end", "x", "raised", 10**15, [])]
    for i in range(2):
        spark.createDataFrame([(f"end{i}", *end[0][1:4], 10**15 + i * 10**14, []) + (None,) * (len(schema.split(", ")) - 6)], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.createDataFrame(rows, schema), live.timed(wire.replay(spark, str(path), schema, 1), "5000 days")


def flaps(seed, n=300):
    r = random.Random(seed)
    return [(f"a{i:04}", f"N:{r.randrange(6)}", r.choice("xy"), r.choice(["raised", "raised", "cleared"]), r.randrange(400) * SECOND // 2, [] if i % 2 else ["T"]) for i in range(n)]


def test_hold_down_and_flapping_equal_batch(spark, tmp_path):
    live.use_state_store(spark)
    batch, stream = shuffled(spark, flaps(3), ALARM, tmp_path / "a")
    key = lambda f: sorted((r.alarm_id, r.moid, r.state, r.raised_us, tuple(r.trail_ids)) for r in f.where("moid <> 'end'").collect())
    expected = key(enrich.without_self_clears(batch, 3 * SECOND))
    assert key(run(ordered.without_self_clears(stream, 3 * SECOND), "held")) == expected and 0 < len(expected) < 300
    expected = key(enrich.without_flapping(batch, 20 * SECOND, 4))
    assert key(run(ordered.without_flapping(stream, 20 * SECOND, 4), "damped")) == expected and 0 < len(expected) < 300


def test_first_deliveries_equal_batch(spark, tmp_path):
    """Repeated deliveries of one alarm differ; poison goes aside with its reason."""
    live.use_state_store(spark)
    rows = [(*x, None) for x in flaps(4, 80)]
    r = random.Random(9)
    rows += [(a, r.choice([m, "N:9", None]), t, s, at + r.choice([0, 0, 5, -5]), p, None) for a, m, t, s, at, p, _ in r.sample(rows, 50)]
    rows += [("bad", None, None, None, 5, None, "not an alarm")] * 2
    batch, stream = shuffled(spark, rows, f"{ALARM}, reject_reason string", tmp_path / "d")
    found = run(ordered.first_deliveries(stream.withColumn("state", F.coalesce("state", F.lit("raised")))), "first").where("coalesce(moid, '') <> 'end'").collect()
    best = enrich.deduped(batch.where("reject_reason is null"))
    assert sorted((x.alarm_id, x.raised_us, x.moid or "", x.state) for x in found if x.outcome == "kept") == sorted((x.alarm_id, x.raised_us, x.moid or "", x.state) for x in best.collect())
    assert sum(x.outcome == "duplicate" for x in found) == 50 and sum(x.outcome == "not an alarm" for x in found) == 2


def test_keys_share_state_and_timers(spark, tmp_path, monkeypatch):
    """Two buckets of 40 objects; the watermark passes a few rows at a time, and most objects have no more rows by then."""
    live.use_state_store(spark)
    monkeypatch.setattr(ordered, "BUCKETS", 2)
    r = random.Random(6)
    rows = [(f"a{i:04}", f"N:{i // 20 + r.randrange(10)}" if i % 9 else None, r.choice("xy"), r.choice(["raised", "raised", "cleared"]), (i + 1) * SECOND // 4, []) for i in range(600)]
    rows += [(f"z{i}", "end", "x", "raised", (160 + i * 10**4) * SECOND, []) for i in range(2)]
    batch = spark.createDataFrame(rows, ALARM)
    for i in range(0, len(rows), 100):
        spark.createDataFrame(r.sample(rows[i : i + 100], len(rows[i : i + 100])), ALARM).coalesce(1).write.mode("append").parquet(str(tmp_path / "k"))
    stream = lambda: live.timed(wire.replay(spark, str(tmp_path / "k"), ALARM, 1), "40 seconds")
    key = lambda f: sorted((x.alarm_id, x.moid or "", x.state, x.raised_us) for x in f.where("coalesce(moid, '') <> 'end'").collect())
    for step, plain, parameters in ((ordered.without_self_clears, enrich.without_self_clears, (3 * SECOND,)), (ordered.without_flapping, enrich.without_flapping, (20 * SECOND, 2))):
        frame, name = step(stream(), *parameters), f"shared_{step.__name__}"
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert key(spark.table(name)) == key(plain(batch, *parameters))
        assert q.recentProgress[0].stateOperators[0].numRowsTotal <= 12  # blocks, counts and timers of two buckets; once three rows or more an alarm


def test_memory_of_many_keys_is_a_few_rows(spark, tmp_path, monkeypatch):
    """200 objects in two buckets, over three firings: a row and a call an object, as it was, grow with the objects."""
    live.use_state_store(spark)
    monkeypatch.setattr(ordered, "BUCKETS", 2)
    r = random.Random(12)
    rows = [(f"a{i:04}", f"N:{r.randrange(200)}", "x", r.choice(["raised", "cleared"]), (i + 1) * SECOND // 4, []) for i in range(2400)]
    rows += [(f"z{i}", "end", "x", "raised", (10**4 + i * 10**4) * SECOND, []) for i in range(2)]
    for i in range(0, len(rows), 801):
        spark.createDataFrame(r.sample(rows[i : i + 801], len(rows[i : i + 801])), ALARM).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    stream = live.timed(wire.replay(spark, str(tmp_path / "m"), ALARM, 1), "250 seconds")
    q = ordered.without_flapping(stream, 200 * SECOND, 2).writeStream.format("memory").queryName("many").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    key = lambda f: sorted(x.alarm_id for x in f.where("moid <> 'end'").collect())
    expected = key(enrich.without_flapping(spark.createDataFrame(rows, ALARM), 200 * SECOND, 2))
    assert key(spark.table("many")) == expected and 0 < len(expected) < 2400
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 12  # four pieces of memory and what waits, in two buckets; once over 200


def test_state_partitions_follow_the_rows(spark):
    """Each partition costs a commit a batch: few rows don't pay for the partitions that a session has for its largest shuffles."""
    folders = lambda: set(Path(shared_dir(spark)).glob("streamed-*"))
    was, partitions = folders(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = live_queries.streamed_flapping(spark, SF)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    expected = enrich.without_flapping(adapters.alarms(spark, SF), 48 * 3600 * SECOND, 1)
    assert sorted(x.alarm_id for x in found.collect()) == sorted(x.alarm_id for x in expected.collect())
    (folder,) = folders() - was
    assert len([x for x in (folder / "checkpoint/state/0").iterdir() if x.name.isdigit()]) == 2 * spark.sparkContext.defaultParallelism  # once 40


class Killed(state.LiveTable):
    """Dies once, after the state is written and before the manifest is."""

    left = 1

    def commit(self, manifest, number):
        if number == 3 and self.left:
            self.left -= 1
            raise RuntimeError("killed")
        super().commit(manifest, number)


def test_live_state_after_a_restart_equals_batch(spark, tmp_path):
    r = random.Random(5)
    rows = [(f"a{r.randrange(60)}", "N:1", r.choice("xy"), r.choice(["raised", "cleared"]), r.randrange(1000), []) for _ in range(200)]  # raises and clears of one alarm
    events = [(f"e{r.randrange(90)}", f"a{r.randrange(70)}", r.choice(["in-progress", "correlated", "reverted-open"]), r.randrange(1000)) for _ in range(90)]
    events = list({e[0]: e for e in events}.values())
    events += r.sample(events, 20)  # delivered again
    kind = "event_id string, alarm_id string, new_status string, changed_us long"
    for i in range(6):
        spark.createDataFrame(rows[i::6], ALARM).coalesce(1).write.mode("append").parquet(str(tmp_path / "alarms"))
        spark.createDataFrame(events[i::6], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    table = Killed(spark, str(tmp_path / "live"), 4)

    def once():
        changes = state.changes_of(wire.replay(spark, str(tmp_path / "alarms"), ALARM, 1), wire.replay(spark, str(tmp_path / "events"), kind, 1))
        state.follow(changes, table, str(tmp_path / "cp")).awaitTermination(240)

    with pytest.raises(Exception, match="killed"):
        once()
    halfway = table.manifest()
    assert set(halfway.values()) <= {0, 1, 2}
    once()
    alarms, changes = spark.createDataFrame(rows, ALARM), spark.createDataFrame(events, kind).distinct()
    every = changes.unionByName(alarm_plans.clears(alarms).distinct())
    opened = alarm_plans.opened_once(alarms)
    key = lambda f: sorted(map(tuple, f.collect()))
    assert key(table.lifecycle()) == key(alarm_plans.lifecycle(opened, every.join(opened.select("alarm_id"), "alarm_id", "left_semi").select(every.columns)))
    assert key(table.transitions().select("alarm_id", F.array_join("statuses", ","))) == key(alarm_plans.transitions(every).select("alarm_id", F.array_join("statuses", ",")))
    assert key(table.published().select("alarm_id")) == key(opened.select("alarm_id"))  # each once, though one batch ran twice


def test_keys_go_where_producers_send_them(spark):
    """Known values of the hash, signed."""
    known = {"21": -973932308, "foobar": -790332482, "a-little-bit-long-string": -985981536, "a-little-bit-longer-string": -1486304829, "lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8": -58897971, "abc": 479470107}
    found = spark.createDataFrame([(k,) for k in known], "k string").select("k", wire.murmur2(F.col("k")).alias("h")).collect()
    assert {x.k: x.h for x in found} == {k: h % 2**32 for k, h in known.items()}


def test_decoding_against_the_newest_codebook_equals_batch(spark, tmp_path):
    """Sets and codebooks in any order of files; a codebook replaces the one before it for sets that are due later."""
    live.use_state_store(spark)
    r = random.Random(8)
    tick = 100 * SECOND
    tokens = [(f"t{r.randrange(3)}", at * SECOND, r.choice("abcd")) for at in (r.randrange(1000) for _ in range(160))]
    tokens = [(trail, at, (at // tick + 1) * tick, f"{trail}/{at // tick}", x) for trail, at, x in tokens]
    books = [(f"t{t}", at * SECOND, f"cb{k}", [(f"s{i}", r.choices("abcd", k=r.randrange(1, 9))) for i in range(4)]) for t in range(3) for k, at in enumerate((150, 400, 400, 700))]
    shape = "trail_id string, happened_us long, due_us long, set_id string, token string", f"trail_id string, compiled_us long, codebook_id string, scenarios {decoding.SCENARIOS}"
    both = decoding.inputs(spark.createDataFrame(tokens, shape[0]), spark.createDataFrame(books, shape[1]))
    rows = both.collect()
    r.shuffle(rows)
    for i in range(5):
        spark.createDataFrame(rows[i::5], both.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for i in range(2):
        spark.createDataFrame([("end", 10**15 + i * 10**14, 10**16, "end", "a", None, None)], both.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(decoding.decoded(wire.replay(spark, str(tmp_path / "in"), both.schema, 1), "5000 days"), "decoded").collect()
    sets = spark.createDataFrame(tokens, shape[0]).select("set_id", "trail_id", "due_us", "token")
    contents = spark.createDataFrame(books, shape[1]).select("trail_id", "compiled_us", "codebook_id", F.explode("scenarios").alias("s")).select("trail_id", "compiled_us", "codebook_id", "s.scenario_id", F.explode("s.tokens").alias("token"))
    expected = correlate.decode_newest(sets, contents).collect()
    key = lambda rows: sorted((x.set_id, x.codebook_id, x.scenario_id, x.distance, round(x.score, 9)) for x in rows)
    assert key(got) == key(expected) and {x.codebook_id for x in got} >= {"cb0", "cb2", "cb3"} and "cb1" not in {x.codebook_id for x in got}
