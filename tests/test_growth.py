"""What keeps large graphs within their limits: how often a step reads its input, and with which operators."""

import pytest
from pyspark.sql import functions as F

from rootweave.operators import codebook, components, graph, trails
from rootweave.plans import cluster
from rootweave.queries import conflict_winners


@pytest.fixture
def written(monkeypatch):
    """Names of what the operators settle, in order."""
    names = []
    for module in (codebook, components, graph, trails):
        real = module.settle
        monkeypatch.setattr(module, "settle", lambda frame, name="step", real=real: names.append(name) or real(frame, name))
    return names


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_leaves_take_no_part_in_rounds(spark, written):
    links = [("h", f"n{i:02}") for i in range(40)] + [("p", "q"), ("q", "p"), ("n03", "h")]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {"h": "h", "p": "p", "q": "p"} | {f"n{i:02}": "h" for i in range(40)}
    assert "pointers" not in written
    # two hubs on a circle, each with a leaf; the least node is a leaf
    links = [("b", "c"), ("c", "d"), ("d", "b"), ("d", "a"), ("c", "e")]
    assert {r.root for r in components.components(spark.createDataFrame(links, "a string, b string")).collect()} == {"a"}
    assert "pointers" in written


def test_traversal_reads_edges_once(spark, written):
    edges = spark.createDataFrame([("A", "B", "R"), ("A", "B", "R"), ("B", "C", "R")], "src string, dst string, relation string")
    vertices = spark.createDataFrame([(x,) for x in "ABC"], "id string")
    got = graph.traverse(vertices, edges, vertices.where("id = 'A'"), ["R"], 3).collect()
    assert sorted(tuple(r) for r in got) == [("A", "B", 1), ("A", "C", 2)] and written.count("walk") == 1


def test_propagation_stops_where_no_rule_goes_on(spark, written):
    templates = spark.createDataFrame([("R", "A", "x", "B", "y"), ("S", "B", "y", "C", "z")], "relation string, trigger_type string, trigger_alarm string, effect_type string, effect_alarm string")
    edges = spark.createDataFrame([("a1", "b1", "R"), ("a1", "b2", "R"), ("b1", "c1", "S"), ("b2", "c1", "S"), ("a1", "c1", "R"), ("c1", "a1", "R")], "src string, dst string, relation string")
    vertices = spark.createDataFrame([("a1", "A"), ("b1", "B"), ("b2", "B"), ("b2", "D"), ("c1", "C")], "id string, object_type string")  # b2 has two types
    start = spark.createDataFrame([("sc", "a1", "x")], "scenario_id string, origin string, alarm_type string")
    got = codebook.propagate(start, vertices, edges, templates).orderBy("position").collect()
    assert [(r.position, r.alarm_type, r.moid) for r in got] == [(0, "x", "a1"), (1, "y", "b1"), (2, "y", "b2"), (3, "z", "c1")]
    assert written.count("front") == 3 and "fires" not in written  # no level after the last rule


def test_lost_nodes_alone_need_no_whole_graph_and_free_ones_do(spark, written):
    vertices = spark.createDataFrame([("N:1", "0"), ("N:2", "0"), ("L:1", None), ("L:2", None), ("L:3", None), ("SRLG:g", None)], "id string, area string")
    edges = spark.createDataFrame([("N:1", "N:2", "R"), ("L:1", "L:2", "R"), ("L:2", "L:1", "R")], "src string, dst string, relation string")
    sets = lambda groups=None: {(tuple(r.members), r.area, r.risk_group) for r in trails.trails(vertices, edges, ["R"], "d", "s", groups).collect()}
    assert sets() == {(("N:1", "N:2"), "0", None), (("L:1", "L:2"), None, None), (("L:3",), None, None)}
    assert "linked" in written and "ties" not in written
    groups = spark.createDataFrame([("SRLG:g", "L:3"), ("SRLG:g", "N:1")], "group string, member string")
    assert sets(groups) == {(("L:3", "N:1", "N:2", "SRLG:g"), "0", "SRLG:g"), (("L:3", "N:1", "SRLG:g"), "0", "SRLG:g"), (("L:1", "L:2"), None, None)}


def test_reached_trails_are_rows(spark):
    signatures = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("t", 0, "b")], "scenario_id string, position int, moid string")
    found = spark.createDataFrame([("T1", ["b"]), ("T2", ["a", "b"])], "trail_id string, members array<string>")
    assert {tuple(r) for r in codebook.reached(signatures, found).collect()} == {("s", "T1", 1), ("s", "T2", 0), ("t", "T1", 0), ("t", "T2", 0)}
    assert {r.scenario_id: r.trail_ids for r in codebook.tagged(signatures, found).collect()} == {"s": ["T2", "T1"], "t": ["T1", "T2"]}


def test_counts_of_ends_triple_no_edge(spark):
    rows = [("a", "x", "R"), ("a", "x", "R"), ("b", None, "R"), (None, "y", None), ("a", "y", None)]
    counts = graph.hierarchy_counts(spark.createDataFrame(rows, "src string, dst string, relation string"))
    assert {tuple(r) for r in counts.collect()} == {("R", 3, 2, 1), (None, 2, 1, 1)}
    assert "Expand" not in plan(counts)


def test_conflict_candidates_are_dealt_once_before_the_winners(spark):
    found = plan(conflict_winners(spark, "/root/testdata/sf0.001"))
    assert found.count("Exchange hashpartitioning") == 2 and "HashAggregate" not in found


def test_points_among_their_own_kind_ask_no_other_cell(spark, monkeypatch):
    sizes = {}
    real = cluster.settle

    def counted(frame, name):
        sizes[name] = (done := real(frame, name)).count()
        return done

    monkeypatch.setattr(cluster, "settle", counted)
    shape = "trail_id string, window_us long, alarm_id string, raised_us long, kind string"
    mixed = lambda rows: {r.alarm_id: r.cluster for r in cluster.clustered_by_features(spark.createDataFrame([("T", 0, *x) for x in rows], shape), {"kind": 1.0}, 1.5, 3, 100).collect()}
    dense = [(f"{k}{i:03}", 10 * i, k) for k in "abcd" for i in range(100)]
    assert set(mixed([*dense, ("lone", 5000, "a")]).values()) == {0, None}
    assert sizes["probes"] == 4 and sizes["asked"] < 40 and sizes["pairs"] == 0  # once 1,604 probes
    # two chains overlap, are apart (by over 50) where the later one starts, and touch later on
    far = [(f"a{i}", 140 * i, "a") for i in range(8)] + [(f"A{i}", 140 * i + 1, "a") for i in range(8)]
    touch = [("b0", 210, "b"), ("b1", 212, "b"), ("b2", 214, "b"), ("b3", 330, "b"), ("b4", 380, "b")]
    assert set(mixed(far + touch).values()) == {0} and sizes["pairs"] == 1
    assert set(mixed(far + touch[:3]).values()) == {0, 1}
