"""Snapshot onboarding: structure, ids and references, vocabulary, then the graph's tables and the pointer to the newest.

A snapshot is one JSON text in a row (key, value). All violations of a step are returned; a snapshot with any goes no
further, so that later steps meet only sound ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.functions.ids import is_object_id, object_type
from rootweave.session import settle
from rootweave.sources.files import SNAPSHOT, lift, small_enough, unnested

# Fields of a snapshot file, of its nodes and its edges; those that must be there.
FIELDS = {"": ["schemaVersion", "snapshotId", "domain", "nodes", "edges"], "nodes": ["managedObjectId", "objectType", "name", "attributes"], "edges": ["from", "to", "relation", "attributes"]}
REQUIRED = {"": ["schemaVersion", "domain", "nodes", "edges"], "nodes": ["managedObjectId", "objectType"], "edges": ["from", "to", "relation"]}
LARGEST = 32 << 20
VIOLATION = "key string, place string, rule string"


def found(checks: list[tuple[Column, str, Column]]) -> Column:
    """(place, rule) of each check whose condition holds."""
    rows = [F.when(F.coalesce(bad, F.lit(False)), F.struct(place.alias("place"), F.lit(rule).alias("rule"))) for bad, rule, place in checks]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def keys_of(text: Column, part: str, place: Column) -> list[tuple[Column, str, Column]]:
    keys = F.json_object_keys(text)
    checks = [(keys.isNull(), "type", place)]
    checks += [(~F.array_contains(keys, f), "required", F.concat(place, F.lit(f".{f}"))) for f in REQUIRED[part]]
    return [*checks, (F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS[part])))) > 0, "additionalProperties", place)]


def empty(text: Column, field: str) -> Column:
    return F.length(F.get_json_object(text, f"$.{field}")) == 0


def structure(raw: DataFrame, most: int = LARGEST) -> DataFrame:
    """key, place and rule of what the file's shape violates: size, JSON, fields missing, unknown or of a wrong kind."""
    text, root = F.col("value"), F.lit("$")
    version = F.get_json_object(text, "$.schemaVersion")
    whole = [
        (~small_enough(text, most), "too large", root),
        (text.isNull() | F.json_object_keys(text).isNull(), "json", root),
        *keys_of(text, "", root)[1:],
        (version.isNotNull() & ~F.coalesce(version.try_cast("int") >= 1, F.lit(False)), "minimum", F.lit("$.schemaVersion")),
        *[(empty(text, f), "minLength", F.lit(f"$.{f}")) for f in ("domain", "snapshotId")],
        *[(F.get_json_object(text, f"$.{p}").isNotNull() & F.json_array_length(F.get_json_object(text, f"$.{p}")).isNull(), "type", F.lit(f"$.{p}")) for p in ("nodes", "edges")],
    ]
    out = unnested(raw, found(whole), "v", "key").select("key", "v.*")
    for part in ("nodes", "edges"):
        items = unnested(raw, F.from_json(F.get_json_object(text, f"$.{part}"), "array<string>"), "item", "key")
        item, place = F.col("item"), F.concat(F.lit(f"$.{part}["), F.col("i").cast("string"), F.lit("]"))
        checks = keys_of(item, part, place)
        if part == "nodes":
            moid = F.get_json_object(item, "$.managedObjectId")
            checks += [(moid.isNotNull() & ~is_object_id(moid), "pattern", F.concat(place, F.lit(".managedObjectId"))), (empty(item, "objectType"), "minLength", F.concat(place, F.lit(".objectType")))]
        out = out.unionByName(items.select("key", F.explode(found(checks)).alias("v")).select("key", "v.*"))
    return out


def parsed(raw: DataFrame) -> DataFrame:
    return raw.select("key", F.from_json("value", SNAPSHOT).alias("s"))


def meaning(raw: DataFrame) -> DataFrame:
    """key, place and rule of nodes whose type differs from their id, and of edge ends that are no node of the file."""
    s = parsed(raw)
    nodes = unnested(s, F.col("s.nodes"), "n", "key")
    wrong = nodes.where(object_type(F.col("n.managedObjectId")) != F.col("n.objectType"))
    out = [wrong.select("key", F.concat(F.lit("$.nodes["), F.col("i").cast("string"), F.lit("].objectType")).alias("place"), F.lit("objectType-prefix").alias("rule"))]
    ids = nodes.select("key", F.col("n.managedObjectId").alias("id")).distinct()
    edges = unnested(s, F.col("s.edges"), "e", "key")
    for end in ("from", "to"):
        gone = edges.withColumn("id", F.col(f"e.{end}")).join(ids, ["key", "id"], "left_anti")
        out.append(gone.select("key", F.concat(F.lit("$.edges["), F.col("i").cast("string"), F.lit(f"].{end}")).alias("place"), F.lit("dangling-reference").alias("rule")))
    return reduce(DataFrame.unionByName, out)


def words(raw: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """key, place (the word) and rule of types and relations that the domain's vocabulary (domain, kind, term) lacks."""
    s = parsed(raw).select("key", F.col("s.domain").alias("domain"), "s")
    types = unnested(s, F.col("s.nodes.objectType"), "term", "key", "domain", F.lit("objectType").alias("kind")).drop("i")
    relations = unnested(s, F.col("s.edges.relation"), "term", "key", "domain", F.lit("relation").alias("kind")).drop("i")
    missing = types.unionByName(relations).distinct().join(vocabulary, ["domain", "kind", "term"], "left_anti")
    return missing.select("key", F.col("term").alias("place"), F.concat(F.col("kind"), F.lit("-in-vocabulary")).alias("rule"))


def checked(raw: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshot texts (key, value) that no step refuses, and rejects: key, place and rule of the first step that fails.

    Each step's violations are written once, so that the next one doesn't find them anew; texts aren't written.
    """
    bad = settle(structure(raw), "structure")
    shaped = raw.join(bad.select("key").distinct(), "key", "left_anti")
    worse = settle(meaning(shaped), "meaning")
    sound = shaped.join(worse.select("key").distinct(), "key", "left_anti")
    foreign = settle(words(sound, vocabulary), "words")
    return sound.join(foreign.select("key").distinct(), "key", "left_anti"), bad.unionByName(worse).unionByName(foreign)


def lifted(taken: DataFrame, at: Column, change: str = "full", trace: str = "trace") -> dict[str, DataFrame]:
    """vertices, edges, snapshots, pointers and events of checked texts, as for ``ingest``."""
    snapshots = parsed(taken).select("key", "s.*").withColumn("snapshotId", F.coalesce("snapshotId", F.concat(F.lit("SNAP-"), F.substring(F.sha2("key", 256), 1, 12))))
    vertices, edges = lift(snapshots)
    pointers = snapshots.groupBy("domain").agg(F.max(F.struct(at.alias("built_at"), F.col("snapshotId").alias("snapshot"))).alias("p")).select("domain", "p.snapshot", "p.built_at")
    sizes = [F.size("nodes").alias("nodes"), F.size("edges").alias("edges")]
    events = snapshots.select(F.col("snapshotId").alias("snapshotId"), F.lit(change).alias("changeType"), *sizes, F.lit(trace).alias("traceId"))
    heads = snapshots.select("domain", F.col("snapshotId").alias("snapshot"), at.cast("long").alias("built_at"), *sizes)
    heads = heads.groupBy("domain", "snapshot").agg(F.max(F.struct("built_at", "nodes", "edges")).alias("h")).select("domain", "snapshot", "h.*")
    return {"vertices": vertices, "edges": edges, "snapshots": heads, "pointers": pointers, "events": events}


def ingest(raw: DataFrame, vocabulary: DataFrame, at: Column, change: str = "full", trace: str = "trace") -> dict[str, DataFrame]:
    """vertices, edges, snapshots, pointers, events and rejects of snapshot texts (key, value).

    A snapshot without an id of its own gets one from its key. pointers: domain, snapshot and built_at of what is current
    from now on; events: the topology.changed payloads; rejects: key, place and rule of the first step that fails.
    """
    taken, rejects = checked(raw, vocabulary)
    return {**lifted(taken, at, change, trace), "rejects": rejects}
