"""What the operators need of the session: a shared folder, written stages, and batches that fit in memory."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch of whole texts; ``arrays.slices`` cuts further by bytes.
TEXT_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). On one machine, as in tests, a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = context.getCheckpointDir().get()
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by rows; whole texts need few."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def documents(frame: DataFrame) -> DataFrame:
    """doc_id (long) and text (string), and no other columns, so that further ones can't clash.

    A column of the right type is taken as it is: two joins of one table then share its shuffle.
    """
    kinds = {"doc_id": "bigint", "text": "string"}
    return frame.select(*[frame[c] if dict(frame.dtypes).get(c) == kind else frame[c].cast(kind).alias(c) for c, kind in kinds.items()])


#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
PICKED = 500_000


def listed_ids(ids: DataFrame) -> DataFrame:
    """A written list of distinct doc_ids, to be broadcast only if its size is proven."""
    ids = stored(ids.select("doc_id").where("doc_id is not null").distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= PICKED else ids


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows but those whose doc_id is listed."""
    return docs.join(listed_ids(ids), "doc_id", "left_anti").select(docs.columns)


#: A key with this share of all rows is common; there can be but 1 / COMMON of them.
COMMON = 1 / 1000


#: Tables with fewer rows are joined as they are.
FEW_ROWS = 100_000


def spread_join(left: DataFrame, right: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """left (stored) and right (one small row for each key) by key: no key's rows meet in one task.

    The rows of ``right`` for common keys, a thousand at most, go to all tasks; only the rest is dealt by key. ``count``
    is a column of ``right`` with the key's rows in ``left``, if they are counted already.
    """
    total = left.count()
    if total < FEW_ROWS:
        return left.join(right, key)
    if count is None:
        counts = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= COMMON * total)
        common = F.broadcast(stored(counts.select(key), "common"))
        few, rest = right.join(common, key, "left_semi"), right
    else:
        few, rest = right.where(F.col(count) >= COMMON * total), right.where(F.col(count) < COMMON * total)
    few = stored(few, "few")
    if few.isEmpty():
        return left.join(right, key)
    few = F.broadcast(few)
    often = left.join(few, key)
    return often.unionByName(left.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key).select(often.columns))
