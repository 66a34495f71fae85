"""Checks that return violations as rows; an empty result means sound input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.functions.ids import is_object_id, object_type
from rootweave.session import settle


def violations(rows: DataFrame, key: Column, checks: dict[str, Column]) -> DataFrame:
    """key and violation, one row for each check that a row fails; a null check fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return rows.select(key.alias("key"), F.explode(failed).alias("violation"))


def prefix_violations(vertices: DataFrame) -> DataFrame:
    """Vertices whose id is malformed or names another type than object_type."""
    return violations(vertices, F.col("id"), {"bad id": is_object_id(F.col("id")), "type differs from id": object_type(F.col("id")) == F.col("object_type")})


def dangling(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each edge end that is no vertex: src, dst, relation and end ('src' or 'dst').

    Different ends are looked up, not edges; those that are missing, hardly any in a sound graph, then pick the edges.
    """
    named = reduce(DataFrame.unionByName, [edges.select(F.col(end).alias("id")).distinct() for end in ("src", "dst")])
    missing = settle(named.distinct().join(vertices.select("id").distinct(), "id", "left_anti"), "missing")
    ends = [edges.join(missing, edges[end].eqNullSafe(missing["id"]), "left_semi").select("src", "dst", "relation", F.lit(end).alias("end")) for end in ("src", "dst")]
    return reduce(DataFrame.unionByName, ends)


def outside_vocabulary(rows: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Rows whose value is in no row of the vocabulary's column of that name."""
    return rows.join(vocabulary.select(column).distinct(), column, "left_anti").select(rows.columns)


def unknown_references(records: DataFrame, references: Column, vocabulary: DataFrame) -> DataFrame:
    """record_id and reference for each listed reference that the vocabulary (term) lacks."""
    listed = records.select("record_id", F.explode(references).alias("term"))
    return listed.join(vocabulary.select("term").distinct(), "term", "left_anti").select("record_id", "term")


def out_of_bounds(parameters: DataFrame, bounds: DataFrame) -> DataFrame:
    """Parameters (name, value as text) that are no number or outside bounds (name, low, high)."""
    number = F.expr("try_cast(value as double)")
    joined = parameters.join(bounds, "name").withColumn("number", number)
    return joined.where(F.col("number").isNull() | (F.col("number") < F.col("low")) | (F.col("number") > F.col("high"))).select("name", "value")


def check_traversal(start: str, relations: list[str], depth: int, deepest: int = 32) -> None:
    if not start or not start.strip():
        raise ValueError("a traversal needs a start")
    if not relations:
        raise ValueError("a traversal needs a relation at least")
    if not 1 <= depth <= deepest:
        raise ValueError(f"depth must be from 1 to {deepest}")
