"""Versioned rule records and snapshots: the current, the pinned, the newest few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_version(versions: DataFrame) -> DataFrame:
    """domain, record_type, record_id and next_version ('v' and a number) of (..., version)."""
    number = F.substr("version", F.lit(2)).cast("int")
    return versions.groupBy("domain", "record_type", "record_id").agg(F.concat(F.lit("v"), F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_version"))


def ranked(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Adds rank within the keys, from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def current(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return ranked(rows, keys, *order).where("rank = 1").drop("rank")


def pinned(versions: DataFrame, version: str) -> DataFrame:
    return versions.where(F.col("version") == version)


def snapshots(trails: DataFrame) -> DataFrame:
    """domain, snapshot and newest built_at, with the word for the first two of a domain."""
    newest = trails.groupBy("domain", "snapshot").agg(F.max("built_at").alias("built_at"))
    return ranked(newest, ["domain"], F.desc("built_at"), F.desc("snapshot")).withColumn("role", F.when(F.col("rank") == 1, "current").when(F.col("rank") == 2, "previous"))


def retained(trails: DataFrame, keep: int) -> DataFrame:
    """Rows of the newest ``keep`` snapshots of each domain."""
    old = snapshots(trails).where(F.col("rank") > keep)
    return trails.join(old.select("domain", "snapshot"), ["domain", "snapshot"], "left_anti")


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those of equal keys replaced by changes (which have one row a key)."""
    return rows.join(changes, keys, "left_anti").select(rows.columns).unionByName(changes.select(rows.columns))


def exist(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with found: whether any row has its keys."""
    there = rows.select(*keys).distinct().withColumn("found", F.lit(True))
    return wanted.join(there, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_active(books: DataFrame, keys: list[str], at: str, key: str) -> DataFrame:
    """books with active: of each key the one that was compiled last supersedes all others."""
    return ranked(books, keys, F.desc(at), F.desc(key)).withColumn("active", F.col("rank") == 1).drop("rank")
