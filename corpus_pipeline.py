"""A training corpus from ``documents``: each stage works on all that the one before it kept.

Stages decide on rows. Rows without doc_id, and rows that share one, are different documents: within a stage they have
numbers of their own above all ids, so that each is judged by itself, and none of them has a label.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.llm.decontaminate import find_contamination
from rootweave.llm.near_dedup import near_duplicates
from rootweave.llm.prefix_encode import encode_texts
from rootweave.llm.quality import classify_quality
from rootweave.llm.session import listed_ids, stored, without
from rootweave.llm.surrogates import replace_entities


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def by_row(stage: Stage) -> Stage:
    """The stage over rows that all have an id of their own; columns are as they were."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        repeated = stored(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "repeated")
        if repeated.isEmpty():
            return stage(spark, docs, sf_dir)
        most = ids.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        again = listed_ids(repeated).withColumn("_again", F.lit(True))
        kind = dict(docs.dtypes)["doc_id"]
        rows = docs.join(again, docs["doc_id"].cast("long") == again["doc_id"], "left").select(*[docs[c] for c in docs.columns], "_again")
        own = F.col("_again").isNotNull() | F.col("doc_id").isNull()
        # written once, so that a row keeps its number
        rows = stored(rows.withColumn("_id", F.col("doc_id")).withColumn("doc_id", F.when(own, F.lit(most + 1) + F.monotonically_increasing_id()).otherwise(F.col("doc_id").cast("long"))).drop("_again"), "numbered")
        return stage(spark, rows, sf_dir).withColumn("doc_id", F.col("_id").cast(kind)).select(docs.columns)

    return run


@by_row
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scores = classify_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, scores.where("not kept"))


#: Words in a shingle and similarity (per cent) of the stage; near_duplicates' own defaults are the contract of op3 alone.
SHINGLE, SIMILAR = 5, 80


@by_row
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return without(docs, near_duplicates(docs, shingle=SHINGLE, threshold=SIMILAR).where("not kept"))


@by_row
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without(docs, find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    new = replace_entities(docs, carry=others)
    counted = new.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in others else new
    return counted.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, ready to train on, with the digests that prove their round trip."""
    coded = encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("SentencePiece encoding and decoding", tokens),
]
#: Training, sketches and tokenisation are not SQL; tests compare with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
