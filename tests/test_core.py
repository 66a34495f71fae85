"""Operators against worked examples and brute force."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from rootweave import queries, store_queries
from rootweave.functions import ids
from rootweave.operators import codebook, commit, graph, ingest, rules, tables, trails, validate
from rootweave.operators.components import components
from rootweave.operators.ranks import exact_percentile, numbered
from rootweave.plans import cluster, correlate, enrich, generate, govern, kpi, mining
from rootweave.plans.correlate import Instance
from rootweave.sources import files, wire
from rootweave.sources.adapters import alarms, edges, vertices

SECOND = 1_000_000


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_identifiers(spark):
    row = one(
        spark,
        ids.trail_id(F.lit("core-ip"), F.lit("snap"), F.array(F.lit("b"), F.lit("a"))).alias("trail"),
        ids.name_uuid(F.lit("x|y")).alias("uuid"),
        ids.object_type(F.lit("Port:a:b")).alias("kind"),
        ids.is_object_id(F.lit("Node:a b")).alias("good"),
        F.array(*[ids.is_object_id(F.lit(x)) for x in ("nothing", "Port:a:b", "Port:", ":a", "9:a", "Port:a:")]).alias("bad"),
        ids.edge_id(F.lit("s"), F.lit("A:1"), F.lit("RIDES_ON"), F.lit("Ü:2")).alias("edge"),
        ids.edge_rank(F.lit("a"), F.lit("b"), F.lit("c")).alias("rank"),
        ids.half_even(F.lit(2.5)).alias("half"),
    )
    assert row.trail == "trail-" + hashlib.sha256(b"core-ip|snap|a|b").hexdigest()[:24] == "trail-7d555f76364a0728c7a29ec2"
    assert row.uuid == str(uuid.uuid5(uuid.NAMESPACE_DNS, "x|y"))
    assert (row.kind, row.good, row.bad, row.half) == ("Port", True, [False] * 6, 2.0) and row.rank >= 0
    assert not set("+/=") & set(row.edge)
    parts = one(spark, ids.edge_parts(F.lit(row.edge)).alias("p"), ids.edge_parts(F.lit("%%%")).alias("q"))
    assert tuple(parts.p) == ("s", "A:1", "RIDES_ON", "Ü:2") and parts.q is None


def test_weighted_pick(spark):
    row = one(spark, *[ids.weighted_pick([("a", 1), ("b", -5), ("c", 3)], F.lit(s)).alias(f"x{i}") for i, s in enumerate((0.0, 0.2, 0.3, 0.99))])
    assert tuple(row) == ("a", "a", "c", "c")
    assert one(spark, ids.weighted_pick([("a", 0), ("b", 0)], F.lit(0.7)).alias("x")).x == "b"


def test_decode_rejects_in_order(spark):
    sound = '{"eventId":"1","type":"AlarmStatusChange","schemaVersion":%s,"occurredAt":"t","source":"s","traceId":"t","payload":{"alarmId":"a","newStatus":"open","source":"s","changedAt":"t"}%s}'
    raw = [None, "[1]", "{", sound % (1, ""), sound % (2, ""), sound % (0, ""), sound % (1, ',"more":1'), (sound % (1, "")).replace("StatusChange", "Thing"), (sound % (1, "")).replace('"alarmId":"a",', "")]
    got = [r.reject_reason for r in wire.decode(spark.createDataFrame([(x,) for x in raw], "value string")).collect()]
    assert got == ["not a JSON object"] * 3 + [None, "unsupported version", "unsupported version", "unknown field more", "unknown type", "payload lacks alarmId"]


def test_snapshot_round_trip(spark, tmp_path):
    path = tmp_path / "snap.json"
    path.write_text('{"schemaVersion": 1, "snapshotId": "S", "domain": "d", "nodes": [{"managedObjectId": "A:1", "objectType": "A"}, {"managedObjectId": "A:2", "objectType": "B"}], "edges": [{"from": "A:1", "to": "A:9", "relation": "R"}]}')
    vertices, edges = files.lift(files.read_snapshot(spark, str(path)))
    assert {tuple(r) for r in validate.prefix_violations(vertices).collect()} == {("A:2", "type differs from id")}
    assert [r["end"] for r in validate.dangling(edges, vertices).collect()] == ["dst"]
    files.write_graph(vertices, str(tmp_path / "graph"))
    files.write_graph(vertices.withColumn("snapshot", F.lit("T")), str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph")).groupBy("snapshot").count().count() == 2


def test_traversal_depth_and_relations(spark):
    chain = [("A", "B", "RIDES_ON"), ("B", "C", "RIDES_ON"), ("C", "D", "RIDES_ON"), ("A", "X", "SERVES")]
    vertices, edges = spark.createDataFrame([(x, "T") for x in "ABCDX"], "id string, object_type string"), spark.createDataFrame(chain, "src string, dst string, relation string")
    start = spark.createDataFrame([("A",)], "id string")
    for depth, reached in ((1, "B"), (2, "BC"), (3, "BCD"), (9, "BCD")):
        assert {r.id for r in graph.traverse(vertices, edges, start, ["RIDES_ON"], depth).collect()} == set(reached)
    with pytest.raises(ValueError):
        validate.check_traversal("A", [], 3)


def test_trails_overlap_at_connectors_and_groups_pull_members(spark):
    vertices = spark.createDataFrame([("N:1", "0"), ("N:2", "1"), ("N:3", "2"), ("H:x", None), ("L:1", None), ("SRLG:g", None)], "id string, area string").withColumn("object_type", F.lit("T"))
    edges = spark.createDataFrame([("H:x", f"N:{i}", "R") for i in (1, 2, 3)] + [("N:1", "L:1", "R")], "src string, dst string, relation string")
    got = trails.trails(vertices, edges, ["R"], "d", "s").collect()
    holding = [r for r in got if "H:x" in r.members]
    assert len(holding) == 3 and {r.area for r in holding} == {"0", "1", "2"}
    assert not any({"N:1", "N:2"} <= set(r.members) for r in got)
    assert not any(r.members == ["SRLG:g"] for r in got)
    groups = spark.createDataFrame([("SRLG:g", "L:1"), ("SRLG:g", "N:2")], "group string, member string")
    pulled = [r for r in trails.trails(vertices, edges, ["R"], "d", "s", groups).collect() if "L:1" in r.members]
    assert all({"N:2", "SRLG:g"} <= set(r.members) and r.risk_group == "SRLG:g" for r in pulled)


def test_propagation_order(spark):
    templates = spark.createDataFrame([("RIDES_ON", "FiberSpan", "FiberFault", "IPLink", "LinkDown"), ("CARRIES", "IPLink", "LinkDown", "LSP", "LSPDown"), ("SERVES", "LSP", "LSPDown", "VPN", "Loss")], "relation string, trigger_type string, trigger_alarm string, effect_type string, effect_alarm string")
    edges = spark.createDataFrame([("FiberSpan:f1", "IPLink:l1", "RIDES_ON"), ("IPLink:l1", "LSP:s1", "CARRIES"), ("LSP:s1", "VPN:v1", "SERVES"), ("VPN:v1", "LSP:s1", "SERVES")], "src string, dst string, relation string")
    vertices = spark.createDataFrame([(x, x.split(":")[0]) for x in ("FiberSpan:f1", "IPLink:l1", "LSP:s1", "VPN:v1")], "id string, object_type string")
    origins = spark.createDataFrame([("FiberSpan", "FiberFault")], "object_type string, alarm_type string")
    scenarios = codebook.scenarios(vertices, origins)
    found = codebook.propagate(scenarios, vertices, edges, templates)
    assert [f"{r.alarm_type}@{r.moid}" for r in found.orderBy("position").collect()] == ["FiberFault@FiberSpan:f1", "LinkDown@IPLink:l1", "LSPDown@LSP:s1", "Loss@VPN:v1"]
    assert codebook.root_tokens(found, scenarios).first().root_alarm == "FiberFault"
    assert codebook.outside(found, spark.createDataFrame([("FiberFault",)], "alarm_type string")).count() == 3


def test_a_long_cascade_goes_on_within_the_closure(spark):
    # A:0 to A:9 in a row, and a way back from A:8: alarm x turns to y there and goes round again; A:9 is nine steps away
    edges = spark.createDataFrame([(f"A:{i}", f"A:{i + 1}", "R") for i in range(9)] + [("A:8", "B:0", "S"), ("B:0", "A:0", "R")], "src string, dst string, relation string")
    vertices = spark.createDataFrame([(f"A:{i}", "A") for i in range(10)] + [("B:0", "B")], "id string, object_type string")
    rules = [("R", "A", "x", "A", "x"), ("R", "A", "y", "A", "y"), ("S", "A", "x", "B", "x"), ("R", "B", "x", "A", "y")]
    templates = spark.createDataFrame(rules, "relation string, trigger_type string, trigger_alarm string, effect_type string, effect_alarm string")
    start = spark.createDataFrame([("sc", "A:0", "x")], "scenario_id string, origin string, alarm_type string")
    got = lambda depth: [f"{r.alarm_type}@{r.moid}" for r in codebook.propagate(start, vertices, edges, templates, depth).orderBy("position").collect()]
    assert got(8) == [f"x@A:{i}" for i in range(9)]
    assert got(9) == [f"x@A:{i}" for i in range(9)] + ["x@A:9", "x@B:0"] + [f"y@A:{i}" for i in range(10)]


def test_scenario_trails_and_alarm_states_take_the_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    v, e = vertices(spark, d), edges(spark, d)
    found = codebook.propagate(codebook.scenarios(v, spark.createDataFrame([("Nation", "Down")], "object_type string, alarm_type string")), v, e, queries.templates(spark))
    members = trails.trails(v, e, ["HOSTED_ON"], "core", "SNAP").select("trail_id", F.explode("members").alias("moid"))
    wanted = {tuple(r) for r in found.join(members, "moid").select("scenario_id", "trail_id").distinct().collect()}
    assert found.where("moid like 'Order:%'").count() > 0
    assert {(r.scenario_id, r.trail_id) for r in queries.QUERIES["scenario_trails"](spark, d).collect()} == wanted
    changed = {r.alarm_id: r.n for r in alarms(spark, d).select(F.substring("alarm_id", 5, 20).cast("long").alias("i")).groupBy((F.col("i") - F.col("i") % 3).alias("i")).agg(F.count("*").alias("n")).select(F.concat(F.lit("ALM-"), "i").alias("alarm_id"), "n").collect()}
    assert queries.all_changes(spark, d).count() == alarms(spark, d).count() == sum(changed.values())
    assert {r.alarm_id: r.n_changes for r in queries.QUERIES["alarm_states"](spark, d).where("n_changes > 0").collect()} == changed


def test_fires_with_one_token_missing_and_expires():
    state = Instance(["A", "B", "C"], "A", 0.9, 30 * SECOND, True)
    assert state.admit("1", "B", 0) is None
    assert state.admit("1", "A", 0)[0] == "in-progress"
    kind, root, alarms, share = state.admit("2", "B", SECOND)
    assert (kind, root, alarms) == ("incident", "1", ["1", "2"]) and abs(share - 0.6) < 1e-9
    state.admit("3", "A", 0)
    assert state.expire(30 * SECOND) is None and state.expire(30 * SECOND + 1) == ["3"]
    fixed = Instance(["A", "B", "C"], "A", 0.9, 10 * SECOND, False, 0)
    fixed.admit("1", "A", 0)
    fixed.admit("2", "B", 9 * SECOND)
    assert fixed.expire(11 * SECOND) == ["1", "2"]


def test_correlation_of_a_table(spark):
    alarms = spark.createDataFrame([("1", "A", 0, ["T"]), ("2", "B", SECOND, ["T"]), ("3", "A", 99 * SECOND, ["T"]), ("3", "A", 99 * SECOND, ["T"])], "alarm_id string, alarm_type string, raised_us long, trail_ids array<string>")
    patterns = spark.createDataFrame([("P", "T", ["A", "B", "C"], "B", 0.9, 30 * SECOND, True)], "pattern_id string, trail_id string, sequence array<string>, root_type string, confidence double, window_us long, by_gap boolean")
    events = correlate.correlate(alarms, patterns)
    assert sorted((r.kind, r.at_us) for r in events.collect()) == [("in-progress", 0), ("in-progress", 99 * SECOND), ("incident", SECOND), ("reverted", 129 * SECOND)]
    found = correlate.incidents(events).first()
    assert (found.root_alarm_id, found.child_alarm_ids) == ("2", ["1"])
    assert [r.alarm_id for r in correlate.uncovered(alarms.dropDuplicates(), correlate.incidents(events)).collect()] == ["3"]


def test_a_trail_that_never_pauses_is_streamed(spark):
    kinds, n = "ABCX", 6000
    rows = [(f"{i:05}", kinds[i * i % 7 % 4], i * SECOND, ["T"] if i % 3 else ["T", "U"]) for i in range(n)]
    rows += [(f"z{i:05}", kinds[i % 3], i * 100 * SECOND, ["V"]) for i in range(50)]
    alarms = spark.createDataFrame(rows, "alarm_id string, alarm_type string, raised_us long, trail_ids array<string>")
    known = [(f"P{t}{k}", t, list(s), s[0], 0.9, w * SECOND, k % 2 == 0) for t in "TUV" for k, (s, w) in enumerate((("ABC", 30), ("BXA", 5), ("CA", 20)))]
    patterns = spark.createDataFrame(known, "pattern_id string, trail_id string, sequence array<string>, root_type string, confidence double, window_us long, by_gap boolean")
    wanted = []
    for pattern, trail, sequence, root, confidence, window, by_gap in known:
        state = Instance(sequence, root, confidence, window, by_gap)
        for alarm, kind, at, on in sorted((r for r in rows if trail in r[3] and r[1] in sequence), key=lambda r: (r[2], r[0])):
            end = state.deadline
            if gone := state.expire(at):
                wanted.append(("reverted", pattern, end, tuple(gone)))
            if got := state.admit(alarm, kind, at):
                wanted.append((got[0], pattern, at, tuple(got[2])))
        if state.members:
            wanted.append(("reverted", pattern, state.deadline, tuple(a for a, _ in state.members.values())))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = correlate.correlate(alarms, patterns)
        got = [(r.kind, r.pattern_id, r.at_us, tuple(r.alarm_ids)) for r in found.collect()]
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(got) == sorted(wanted)
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan  # no group is held as a whole


def test_session_window_example(spark):
    row = govern.session_windows(spark.createDataFrame([(3000.0, 1000.0, 2000.0, 500.0)], "timeframe_ms double, median_ms double, max_gap_ms double, stddev_ms double")).first()
    assert (row.window_ms, row.window_type) == (5000, "gap-based")


def test_density_forms_agree(spark):
    rows = [("T", 0, f"a{i}", t, "x") for i, t in enumerate([0, 1, 2, 3, 50, 51, 52, 54, 80, 100, 102, 103])]
    frame = spark.createDataFrame([(t, w, a, u * SECOND, k) for t, w, a, u, k in rows], "trail_id string, window_us long, alarm_id string, raised_us long, kind string")
    by_time = {r.alarm_id: r.cluster for r in cluster.clustered(frame, 2 * SECOND, 3).collect()}
    general = cluster.clustered_by_features(frame, {"kind": 1.0}, 2.0, 3, SECOND)
    assert by_time == {r.alarm_id: r.cluster for r in general.collect()}
    assert by_time["a8"] is None and len(set(by_time.values()) - {None}) == 3


def test_enrichment_steps(spark):
    schema = "alarm_id string, moid string, alarm_type string, severity string, state string, raised_us long, source string, trail_ids array<string>"
    rows = [("1", "N:1", "X", "warning", "raised", 0, "s", []), ("2", "N:1", "X", "warning", "cleared", SECOND, "s", []), ("3", "N:2", "Y", "minor", "raised", 0, "z", []), ("3", "N:2", "Y", "minor", "raised", 5, "z", []), ("4", "N:3", "C", "minor", "raised", 0, "z", [])]
    sets = spark.createDataFrame([("s", "vendor"), ("default", "plain")], "source string, ruleset string")
    mapping = spark.createDataFrame([("plain", "minor", "low")], "ruleset string, raw string, severity string")
    members = spark.createDataFrame([("T1", "N:2"), ("T0", "N:2")], "trail_id string, moid string")
    noisy = spark.createDataFrame([(None, "C")], "moid string, alarm_type string")
    got = enrich.enrich(spark.createDataFrame(rows, schema), sets, mapping, noisy, members).collect()
    assert [(r.alarm_id, r.severity, r.raw_severity, r.ruleset, r.trail_ids) for r in got] == [("3", "low", "minor", "plain", ["T0", "T1"])]


def test_frequent_sequences(spark):
    tokens = {0: "abc", 1: "abc", 2: "acb", 3: "b"}
    rows = spark.createDataFrame([("T", s, i, f"{s}{i}", t) for s, ts in tokens.items() for i, t in enumerate(ts)], "trail_id string, session int, raised_us int, alarm_id string, alarm_type string")
    got = {"".join(r.sequence): (r.freq, round(r.confidence, 6), round(r.lift, 6)) for r in mining.frequent_sequences(rows, 0.5, 4).collect()}
    assert got == {"a": (3, 0.75, 1.0), "b": (4, 1.0, 1.0), "c": (3, 0.75, 1.0), "ab": (3, 1.0, 1.0), "ac": (3, 1.0, 1.333333), "bc": (2, 0.5, 0.666667), "abc": (2, 0.666667, 0.888889)}


def plain_sequences(sessions, support, longest, most):
    """All sequences of a trail up to ``longest`` that enough sessions hold, then the first ``most``."""
    tokens, out, level = sorted({t for s in sessions for t in s}), {}, [()]
    for _ in range(longest):
        grown = {}
        for seq in (p + (t,) for p in level for t in tokens):
            held = 0
            for s in sessions:
                rest = iter(s)
                held += all(t in rest for t in seq)
            if held and held >= support * len(sessions):
                grown[seq] = held
        out |= grown
        level = list(grown)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))[:most]


@pytest.mark.parametrize("most", [3, 40, 100_000])
def test_frequent_sequences_where_the_cap_binds(spark, most):
    r = random.Random(most)
    sessions = {(t, s): [r.choice("abc") for _ in range(r.randint(1, 14))] for t in range(3) for s in range(9)}
    sessions |= {(3, s): list("abcab" * 3) for s in range(4)}  # all alike: every sequence has the same support
    rows = [(f"T{t}", s, i // 2, f"{s}-{i:03}", x) for (t, s), xs in sessions.items() for i, x in enumerate(xs)]
    found = mining.frequent_sequences(spark.createDataFrame(rows, "trail_id string, session int, raised_us int, alarm_id string, alarm_type string"), 0.4, 5, most).collect()
    for t in range(4):
        expected = plain_sequences([x for (u, _), x in sessions.items() if u == t], 0.4, 5, most)
        assert sorted((-x.freq, tuple(x.sequence)) for x in found if x.trail_id == f"T{t}") == sorted((-f, s) for s, f in expected)


def plain_clusters(rows, eps, fewest, scale, kinds, numbers):
    """Every pair of a group, components of its core points, border points to the first."""

    def apart(x, y):
        d = abs(x["raised_us"] - y["raised_us"]) / scale + sum(w for f, w in kinds.items() if x[f] != y[f])
        for f, w in numbers.items():
            d += w * abs(x[f] - y[f]) if None not in (x[f], y[f]) else (0 if x[f] is y[f] else 1e9)
        return d

    out = {}
    for group in {(r["trail_id"], r["window_us"]) for r in rows}:
        some = sorted((r for r in rows if (r["trail_id"], r["window_us"]) == group), key=lambda r: (r["raised_us"], r["alarm_id"]))
        near = [[j for j, y in enumerate(some) if apart(x, y) <= eps] for x in some]
        label, n = {}, 0
        for i in range(len(some)):
            if len(near[i]) >= fewest and i not in label:
                front = [i]
                label[i] = n
                while front:
                    front = [j for k in front for j in near[k] if len(near[j]) >= fewest and label.setdefault(j, None) is None and not label.update({j: n})]
                n += 1
        for i, x in enumerate(some):
            found = [label[j] for j in near[i] if j in label]
            out[(*group, x["alarm_id"])] = label[i] if i in label else min(found, default=None)
    return out


@pytest.mark.parametrize(("eps", "fewest", "numbers"), [(1.5, 3, {}), (2.0, 4, {"hops": 0.5}), (0.5, 2, {"hops": 0.25}), (3.5, 5, {"hops": 1.0})])
def test_clusters_over_mixed_features(spark, eps, fewest, numbers):
    r = random.Random(int(eps * 10))
    rows = []
    for i in range(420):
        at = r.randrange(0, 60, 2) * SECOND // 4 if i % 3 else r.randrange(60 * SECOND)
        rows.append({"trail_id": r.choice("AAB"), "window_us": r.choice([0, 60]), "alarm_id": f"{i:04}", "raised_us": at, "kind": r.choice(["x", "y", None]), "layer": r.choice(["l1", "l2"]), "hops": r.choice([0, 1, 2, 5, None])})
    kinds = {"kind": 1.0, "layer": 0.75}
    frame = spark.createDataFrame([tuple(x.values()) for x in rows], "trail_id string, window_us long, alarm_id string, raised_us long, kind string, layer string, hops int")
    found = cluster.clustered_by_features(frame, kinds, eps, fewest, SECOND, numbers).collect()
    assert {(x.trail_id, x.window_us, x.alarm_id): x.cluster for x in found} == plain_clusters(rows, eps, fewest, SECOND, kinds, numbers)
    assert len(found) == 420


def test_components_of_chains_and_stars(spark):
    chain = spark.range(1000).selectExpr("'c' s", "format_string('n%05d', id) a", "format_string('n%05d', id + 1) b")
    back = spark.range(300).selectExpr("'c' s", "format_string('m%05d', 999 - id) a", "format_string('m%05d', 998 - id) b")
    star = spark.range(100_000).selectExpr("'d' s", "'hub' a", "concat('leaf', id) b")
    same = spark.createDataFrame([("e", "n00001", "n00000"), ("e", "x", "x"), ("f", "a", "b"), ("f", "b", "a")], "s string, a string, b string")
    found = components(chain.union(back).union(star).union(same), ["s"])
    got = found.groupBy("s", "root").count().collect()
    assert {tuple(x) for x in got} == {("c", "n00000", 1001), ("c", "m00699", 301), ("d", "hub", 100_001), ("e", "n00000", 2), ("f", "a", 2)}
    assert components(same.limit(0), ["s"]).collect() == []


def test_tables(spark):
    rows = spark.createDataFrame([("d", "s1", 1, "t1"), ("d", "s2", 2, "t2"), ("d", "s3", 3, "t3")], "domain string, snapshot string, built_at int, trail_id string")
    assert {r.trail_id for r in rules.retained(rows, 2).collect()} == {"t2", "t3"}
    assert [r.trail_id for r in tables.page(rows, F.desc("built_at"), offset=1, limit=1).collect()] == ["t2"]
    with pytest.raises(ValueError):
        tables.page(rows, F.col("built_at"), limit=501)
    bounds = spark.createDataFrame([("support", 0.0, 1.0)], "name string, low double, high double")
    assert validate.out_of_bounds(spark.createDataFrame([("support", "1.5"), ("support", "x"), ("support", "0.3")], "name string, value string"), bounds).count() == 2
    assert [r.incidents for r in kpi.confidence_histogram(spark.createDataFrame([(1.0,), (0.5,)], "confidence double")).orderBy("bucket").collect()] == [0, 0, 1, 0, 1]


def test_generator_is_deterministic_and_its_roots_come_first(spark):
    vertices, edges = generate.topology(spark, **{k: v for k, v in generate.settings(nodes=12).items() if k != "alarms"})
    assert validate.dangling(edges, vertices).count() == 0
    kinds = spark.createDataFrame([("fiber", "FiberSpan", "FiberFault")], "scenario_type string, origin_type string, alarm_type string")
    effects = spark.createDataFrame([("RIDES_ON", "LinkDown", 800.0, 100.0)], "relation string, effect_alarm string, delay_ms double, spread_ms double")

    def corpus():
        return generate.cascade(generate.instances(vertices, kinds, 3, 3600 * SECOND, 7), edges, effects, 7)

    first = sorted(map(tuple, corpus().collect()))
    assert first == sorted(map(tuple, corpus().repartition(3).collect())) and len(first) == 6
    truth = generate.labels(corpus()).collect()
    assert all(r.root_alarm_type == "FiberFault" and len(r.children) == 1 for r in truth)
    with pytest.raises(ValueError):
        generate.settings(nodes=5)


def test_snapshots_count_from_their_commit_on(spark, tmp_path):
    class Fails(commit.SnapshotStore):
        def publish(self, kept, number):
            raise InterruptedError

    text = '{"schemaVersion":1,"snapshotId":"%s","domain":"d","nodes":[{"managedObjectId":"Node:%s","objectType":"Node"}],"edges":[]}'
    texts = lambda *names: spark.createDataFrame([(n, text % (n, n)) for n in names], "key string, value string")
    words = spark.createDataFrame([("d", "objectType", "Node")], "domain string, kind string, term string")
    at = F.substring("snapshotId", 2, 9).cast("long")
    store = commit.SnapshotStore(spark, str(tmp_path), 2)
    held = lambda: (sorted((r.snapshot, r.version, r.current) for r in store.manifest().collect()), [r.id for r in store.graph("vertices", "domain string, snapshot string, id string").collect()], sorted(r.snapshotId for r in store.events().collect()))
    assert held() == ([], [], [])
    assert [r.rule for r in store.commit(texts("S5").unionByName(spark.createDataFrame([("x", "{")], "key string, value string")), words, at).collect()] == ["json"]
    first = held()
    assert first == ([("S5", 0, True)], ["Node:S5"], ["S5"])
    with pytest.raises(InterruptedError):
        Fails(spark, str(tmp_path), 2).commit(texts("S9"), words, at)
    assert held() == first
    store.commit(texts("S5"), words, at)  # known already
    assert held() == first and store.newest() == 0
    store.commit(texts("S3"), words, at)  # built before the current one
    assert held() == ([("S3", 1, False), ("S5", 0, True)], ["Node:S5"], ["S3", "S5"])
    store.commit(texts("S9"), words, at)
    assert held() == ([("S5", 0, False), ("S9", 2, True)], ["Node:S9"], ["S3", "S5", "S9"])  # S3 is evicted, its event stays


def test_repeated_ingest_knows_its_evicted_snapshots(spark, tmp_path):
    text = '{"schemaVersion":1,"snapshotId":"%s","domain":"d","nodes":[{"managedObjectId":"Node:%s","objectType":"Node"}],"edges":[]}'
    texts = lambda *names: spark.createDataFrame([(n, text % (n, n)) for n in names], "key string, value string")
    words = spark.createDataFrame([("d", "objectType", "Node")], "domain string, kind string, term string")
    at = F.substring("snapshotId", 2, 9).cast("long")
    store = commit.SnapshotStore(spark, str(tmp_path), 2)
    held = lambda: (sorted((r.snapshot, r.built_at, r.version, r.current) for r in store.manifest().collect()), sorted(r.snapshotId for r in store.events().collect()))
    every = texts("S1", "S2", "S3", "S4", "S5")
    store.commit(every, words, at)
    first = held()
    assert first == ([("S4", 4, 0, False), ("S5", 5, 0, True)], ["S4", "S5"])
    store.commit(every, words, at)
    assert held() == first and store.newest() == 0 and sorted(x.name for x in (tmp_path / "vertices").iterdir()) == ["ingest=0"]
    store.commit(texts("S9"), words, at)
    store.commit(every.unionByName(texts("S9")), words, at)
    assert held()[0] == [("S5", 5, 0, False), ("S9", 9, 1, True)] and store.newest() == 1
    store.commit(every.unionByName(texts("S6")), words, at)  # only what is new
    assert held() == ([("S6", 6, 2, False), ("S9", 9, 1, True)], ["S4", "S5", "S6", "S9"])
    assert [r.id for r in store.read("vertices", "domain string, snapshot string, id string").where("ingest = 2").collect()] == ["Node:S6"]
    store.commit(texts("S9"), words, F.lit(1).cast("long"))  # built earlier than was said
    assert held()[0] == [("S6", 6, 2, True), ("S9", 1, 3, False)]
    store.commit(every, words, at)  # S5 would be kept now
    assert held()[0] == [("S5", 5, 4, False), ("S6", 6, 2, True)]
    store.commit(texts("S9"), words, F.lit(1).cast("long"))
    assert store.newest() == 4
    store.commit(texts("S9"), words, at)  # with its old time, which is not the last that it came with
    assert held()[0] == [("S6", 6, 2, False), ("S9", 9, 5, True)]


def test_committed_snapshots_ingests_each_half_whole(spark, tmp_path, monkeypatch):
    taken, whole = [], commit.SnapshotStore.commit
    monkeypatch.setattr(commit.SnapshotStore, "commit", lambda self, raw, *rest: (taken.append({r.key for r in raw.select("key").collect()}), whole(self, raw, *rest))[1])
    spark.range(10, 70).selectExpr("id as c_custkey", "id % 5 as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    rows = store_queries.committed_snapshots(spark, str(tmp_path)).collect()
    even, odd = ({f"f{k}" for k in range(first, 70, 2)} for first in (10, 11))
    assert taken == [even, odd, odd, even]
    assert {(r.snapshot, r.version) for r in rows} == {(f"S{k}", k % 2) for k in range(61, 70)}


def test_checked_corpus_names_its_first_bad_line(spark, tmp_path):
    payload = '{"alarmId":"a","managedObjectId":"Node:n1","eventType":"e","alarmType":"t","perceivedSeverity":"major","raisedAt":"x","state":"raised"}'
    good = [f'{{"seq":{i},"topic":"t","envelope":{{"payload":{payload}}}}}' for i in range(40)]
    read = lambda lines, name: (spark.createDataFrame([(x,) for x in lines], "value string").repartition(4).write.text(str(tmp_path / name)), files.read_corpus(spark, str(tmp_path / name), checked=True))[1]
    assert [r.seq for r in read(['{"corpusVersion":1,"count":40}', "", *good], "good").collect()] == list(range(40))
    lacking = [x.replace('"state":"raised"', '"other":1') if i in (33, 12, 27) else x for i, x in enumerate(good)]
    with pytest.raises(ValueError, match="corpus line 12: payload lacks state"):
        read(lacking, "lacking")
    with pytest.raises(ValueError, match="corpus line 5: missing envelope.payload"):
        read([*lacking[:5], '{"seq":5,"topic":"t","envelope":{}}', *lacking[6:]], "empty")
    with pytest.raises(ValueError, match="corpus line 0: bad JSON"):
        read([*lacking, '{"seq":3,'], "broken")


def test_compile_stops_at_foreign_alarm_types(spark):
    signatures = spark.createDataFrame([("s", i, f"t{i:02}", "o") for i in range(30)], "scenario_id string, position int, alarm_type string, moid string")
    every = signatures.select("alarm_type")
    assert codebook.complete(signatures, every).count() == 30
    with pytest.raises(ValueError, match="vocabulary: t03, t07$"):
        codebook.complete(signatures, every.where("alarm_type not in ('t03', 't07')"))
    with pytest.raises(ValueError, match=r"t00, .*t19, \.\.\.$"):
        codebook.complete(signatures, every.where("false"))


@pytest.mark.parametrize(("share", "different"), [(0.0, 20), (0.37, 20), (0.9, 20), (1.0, 20), (0.37, 100_000)])
def test_percentiles_by_ranges_are_exact(spark, share, different):
    draw = random.Random(5)
    values = {"hot": [draw.choice([draw.randrange(50), draw.randrange(2**20), draw.randrange(2**41)]) for _ in range(1500)]}
    values |= {"near": [2**40 + draw.randrange(40) for _ in range(300)], "few": [3, 3, 9], "one": [7], "none": [], "same": [5] * 90}
    rows = [(k, v) for k, some in values.items() for v in some] + [("none", None), ("hot", None), (None, 4), (None, 6)]
    frame = spark.createDataFrame(rows, "k string, v long").repartition(7)
    got = {r.k: r.p for r in exact_percentile(frame, ["k"], "v", share, "p", different).collect()}
    assert set(got) == set(values) | {None}
    for key, some in (values | {None: [4, 6]}).items():
        place, ordered = (len(some) - 1) * share, sorted(some)
        if not some:
            assert got[key] is None
            continue
        low, high = int(place), min(int(place) + 1, len(some) - 1)
        # the formula of the built-in function, so that results are equal to the last bit
        expected = float(ordered[low]) if place == low or ordered[low] == ordered[high] else (low + 1 - place) * ordered[low] + (place - low) * ordered[high]
        assert got[key] == expected
    assert exact_percentile(frame.limit(0), ["k"], "v", share, "p", different).isEmpty()


def test_numbers_across_ranges(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.randrange(200), i) for i in range(900)]
    frame = spark.createDataFrame(rows, "k string, t long, i long").repartition(5)
    got = [tuple(r) for r in numbered(frame, ["k"], ["t"], "n").collect()]
    assert sorted(g[2] for g in got) == list(range(900))
    for key in ("a", "b", None):
        mine = sorted((n, t) for k, t, _, n in got if k == key)
        assert [n for n, _ in mine] == list(range(len(mine))) and [t for _, t in mine] == sorted(t for _, t in mine)
    assert numbered(frame.limit(0), ["k"], ["t"], "n").isEmpty()


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_snapshot_texts_are_dealt_over_tasks_before_they_are_parsed(spark, monkeypatch):
    monkeypatch.setattr(store_queries, "TEXTS", 20)
    texts = store_queries.snapshot_texts(spark, "/root/testdata/sf0.001")
    sizes = [r["count"] for r in texts.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 150 and max(sizes) < 60
    vertices, edges = files.lift(ingest.parsed(texts).select("s.*"))
    for frame in (ingest.structure(texts), ingest.meaning(texts), ingest.words(texts, store_queries.snapshot_words(spark)), vertices, edges):
        dealt = None
        for line in plan_of(frame).splitlines():
            depth = len(line) - len(line.lstrip(" :+-"))
            dealt = None if dealt is not None and depth <= dealt else dealt
            assert dealt is None or "json" not in line  # what lies under the shuffle runs before it
            dealt = depth if "RepartitionByExpression" in line else dealt


def test_missing_edge_ends_are_looked_up_by_end(spark):
    vertices = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = [("a", "b", "R"), ("a", "x", "R"), ("a", "x", "R"), ("y", "x", "R"), (None, "b", "R")]
    out = validate.dangling(spark.createDataFrame(rows, "src string, dst string, relation string"), vertices)
    wanted = [("a", "x", "dst"), ("a", "x", "dst"), ("y", "x", "dst"), ("y", "x", "src"), (None, "b", "src")]
    assert sorted(map(str, ((r.src, r.dst, r.end) for r in out.collect()))) == sorted(map(str, wanted))
    assert "LeftAnti" not in plan_of(out)  # edges meet the missing ends, not all vertices


def test_time_clusters_read_no_frame_again_for_each_row(spark):
    rng = random.Random(5)
    points = [(t, rng.choice(["x", None]), rng.randrange(60)) for t in ("T1", "T2") for _ in range(40)]
    rows = spark.createDataFrame([(i, t, 0, k, at) for i, (t, k, at) in enumerate(points)], "alarm_id int, trail_id string, window_us long, kind string, raised_us long")
    out = cluster.clustered(rows, 2, 4)
    near = lambda p, q: p[0] == q[0] and abs(p[2] - q[2]) <= 2
    cores = sorted({(p[0], p[2]) for p in points if sum(near(p, q) for q in points) >= 4})
    chains, number = {}, {}
    for t, at in cores:
        number[t] = number.get(t, -1) + (not any((t, at - x) in chains for x in (1, 2)))
        chains[t, at] = number[t]
    wanted = {i: min((chains[t, x] for x in range(at - 2, at + 3) if (t, x) in chains), default=None) for i, (t, _, at) in enumerate(points)}
    assert {r.alarm_id: r.cluster for r in out.collect()} == wanted and len(set(wanted.values())) > 2
    assert "RangeFrame" not in plan_of(out)
    alike = cluster.clustered(rows, 2, 2, ("kind",))
    assert alike.count() == 80 and alike.where("kind is null and cluster is not null").count() > 0
