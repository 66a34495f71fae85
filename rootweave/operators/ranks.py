"""Exact percentiles and row numbers for keys whose rows don't fit into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.operators.components import hub_join
from rootweave.session import settle

#: A key with more different values than this is searched by ranges; in each round a range is parted in 2 ^ STEP.
DIFFERENT, STEP = 100_000, 16


def exact_percentile(rows: DataFrame, keys: list[str], value: str, share: float, to: str, different: int = DIFFERENT) -> DataFrame:
    """keys and ``to``: the percentile (0 to 1) of value, interpolated between neighbours; null where a key has no values.

    Values are whole numbers from 0 on. They are counted first. A key with at most ``different`` of them, and rows without
    key, are settled at once. For others the range that holds the rank is narrowed round by round, from the highest bits
    down: at most 2 ^ STEP rows of a key and range come together.
    """
    counts = settle(rows.groupBy(*keys, value).agg(F.count("*").alias("_n")), "counts")
    wide = settle(counts.groupBy(*keys).agg(F.count("*").alias("_d")).where(F.col("_d") > different).select(*keys, F.lit(True).alias("_wide")), "wide")
    at_once = F.percentile(value, F.lit(share), F.col("_n")).alias(to)
    if wide.isEmpty():
        return counts.groupBy(*keys).agg(at_once)
    marked = settle(hub_join(counts, wide, keys, "left"), "marked")
    searched = by_ranges(marked.where("_wide").where(F.col(value).isNotNull()).drop("_wide"), keys, value, share, to)
    return marked.where("_wide is null").groupBy(*keys).agg(at_once).unionByName(searched)


def by_ranges(counts: DataFrame, keys: list[str], value: str, share: float, to: str) -> DataFrame:
    """keys and ``to`` from counts (keys, value, _n)."""
    place = (F.col("_total") - 1) * F.lit(share)
    ranks = F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))
    wanted = counts.groupBy(*keys).agg(F.sum("_n").alias("_total")).withColumn("_place", place).select(*keys, "_place", F.explode(ranks).alias("_rank"))
    wanted = settle(wanted.withColumn("_head", F.lit(0).cast("long")).withColumn("_below", F.lit(0).cast("long")), "wanted")
    bits = max(int(counts.agg(F.max(value)).first()[0]).bit_length(), 1)
    left = counts.withColumn("_head", F.lit(0).cast("long"))
    for turn, shift in enumerate(range((bits - 1) // STEP * STEP, -1, -STEP)):
        if turn:
            heads = wanted.select(*keys, "_head").distinct()
            left = settle(hub_join(left.withColumn("_head", F.shiftright(value, shift + STEP)), heads, [*keys, "_head"]).select(counts.columns + ["_head"]), "narrowed")
        parts = left.groupBy(*keys, "_head", F.shiftright(value, shift).alias("_part")).agg(F.sum("_n").alias("_n"))
        before = Window.partitionBy(*keys, "_head").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        within = F.col("_rank") - F.col("_below") - F.col("_before")
        held = wanted.join(parts, [*keys, "_head"]).where((within >= 0) & (within < F.col("_n")))
        wanted = settle(held.select(*keys, "_place", "_rank", F.col("_part").alias("_head"), (F.col("_below") + F.col("_before")).alias("_below")), "wanted")
    ends = wanted.groupBy(*keys).agg(F.first("_place").alias("_place"), F.min(F.struct("_rank", "_head")).alias("_low"), F.max(F.struct("_rank", "_head")).alias("_high"))
    low, high = F.col("_low._head").cast("double"), F.col("_high._head").cast("double")
    between = (F.col("_high._rank") - F.col("_place")) * low + (F.col("_place") - F.col("_low._rank")) * high
    return ends.select(*keys, F.when(low == high, low).otherwise(between).alias(to))


def numbered(rows: DataFrame, keys: list[str], order: list[str], to: str) -> DataFrame:
    """rows with ``to``, their number from 0 within the keys (null is a key) in an order; ties are numbered in any order.

    Rows are sorted by ranges; a row's number is its place in its range and what earlier ranges hold of its key.
    """
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
    placed = settle(placed, "placed").withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.select("_first", "_before", *[F.col(c).alias(f"_of_{i}") for i, c in enumerate(["_part", *keys])])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(["_part", *keys])])
    return placed.join(starts, same).select(rows.columns + [(F.col("_before") + F.col("_id") - F.col("_first")).alias(to)])
