"""Plain table operators: pages, bag differences, changes between two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, LARGEST = 50, 500


def page(rows: DataFrame, *order: Column, offset: int = 0, limit: int = PAGE, most: int = LARGEST) -> DataFrame:
    """One page of the ordered rows; a limit is 1 to ``most``."""
    if offset < 0 or not 1 <= limit <= most:
        raise ValueError(f"offset must be 0 or more, limit from 1 to {most}")
    return rows.orderBy(*order).offset(offset).limit(limit)


def bag_difference(expected: DataFrame, observed: DataFrame, keys: list[str], token: str) -> DataFrame:
    """keys, missing (expected more often than observed) and spurious (the reverse), tokens counted as bags."""
    a = expected.groupBy(*keys, token).agg(F.count("*").alias("s"))
    b = observed.groupBy(*keys, token).agg(F.count("*").alias("o"))
    both = a.join(b, [*keys, token], "full_outer").na.fill(0, ["s", "o"])
    return both.groupBy(*keys).agg(F.sum(F.greatest(F.col("s") - F.col("o"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("o") - F.col("s"), F.lit(0))).alias("spurious"))


def changes(now: DataFrame, before: DataFrame, key: str, value: str, at_ms: int, shown_ms: int = 1500) -> DataFrame:
    """key, value, change ('new', 'changed' or 'same') and shine_until (null if the same) of each row that is there now."""
    joined = now.select(key, value).join(before.select(key, F.col(value).alias("was"), F.lit(True).alias("known")), key, "left")
    change = F.when(F.col("known").isNull(), "new").when(F.col(value).eqNullSafe(F.col("was")), "same").otherwise("changed")
    return joined.select(key, value, change.alias("change"), F.when(change != "same", F.lit(at_ms + shown_ms)).alias("shine_until"))


def listed(rows: DataFrame, *order: Column, offset: int = 0, limit: int = PAGE, most: int = LARGEST) -> DataFrame:
    """One row: items (a page, in order), total, limit and offset."""
    names = [c for c in rows.columns]
    numbered = page(rows, *order, offset=offset, limit=limit, most=most).withColumn("_at", F.monotonically_increasing_id())
    items = numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", *names))), lambda x: F.struct(*[x[c].alias(c) for c in names])).alias("items"))
    total = rows.agg(F.count("*").alias("total"))
    return items.join(total, F.lit(True)).select("items", "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))


def filtered(rows: DataFrame, trail: str | None = None, since_us: int | None = None, until_us: int | None = None, at: str = "created_us", match: str | None = None, **equal: str | None) -> DataFrame:
    """Rows of a list by trail, time (``since_us`` included, ``until_us`` not), match ('pattern' or 'codebook') and equal values."""
    if match not in (None, "pattern", "codebook"):
        raise ValueError("match must be pattern or codebook")
    if trail is not None:
        rows = rows.where(F.col("trail_id") == trail)
    if since_us is not None:
        rows = rows.where(F.col(at) >= since_us)
    if until_us is not None:
        rows = rows.where(F.col(at) < until_us)
    if match is not None:
        rows = rows.where(F.col("pattern_id").isNotNull() if match == "pattern" else F.col("pattern_id").isNull())
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows
