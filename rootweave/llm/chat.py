"""Chat formatting of logged conversations, each kept once at its longest.

A log that is written again after every turn holds all beginnings of a conversation. Rolling hashes over the turns give
every beginning a fingerprint; conversations whose whole fingerprint is a shorter beginning of another are dropped by an
anti-join, as are repeats of a whole conversation. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootweave.llm.session import stored

# The chat markup.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """Markup within a text must not read as markup."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(CLOSE), F.lit("\n"))), "")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_logged (conversations with these very turns) and chat.

    A conversation is the turns of one conv_id in the order of turn (null first; equal turn numbers by role, then text);
    a row repeated with equal turn, role and text counts once. Null roles and texts are empty. Of equal conversations the
    smallest conv_id stays; a proper beginning of another conversation goes. Rows without conv_id belong to none and are
    left out. Other columns are ignored.
    """
    turns = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # a beginning's fingerprint rolls on by one turn: two hashes of each turn at its place, combined
    marked = turns.distinct().withColumn("at", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolling = [F.bit_xor(F.xxhash64(F.lit(seed), "at", "role", "text")).over(so_far).alias(f"mark{seed}") for seed in (1, 2)]
    logged = stored(marked.select("conv_id", "role", "text", F.col("at").cast("long").alias("at"), "n", *rolling), "conversations")
    whole_ones = logged.where("at = n").groupBy("mark1", "mark2", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    # beginnings that go on; a very common one is one row a task
    begun = logged.where("at < n").select("mark1", "mark2", F.col("at").alias("n")).distinct()
    maximal = whole_ones.join(begun, ["mark1", "mark2", "n"], "left_anti").select("conv_id", F.col("n_logged").cast("long").alias("n_logged"))
    kept = logged.join(maximal, "conv_id").groupBy("conv_id", "n_logged").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    return kept.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_logged", rendered(F.col("turns")).alias("chat"))


SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, list(row(role, text) ORDER BY turn NULLS FIRST, role, text) AS turns FROM turns GROUP BY conv_id
), one AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_logged FROM whole GROUP BY turns
), begun AS (
  SELECT DISTINCT turns[1:k] AS turns FROM whole, generate_series(1, len(turns) - 1) AS s(k)
), kept AS (
  SELECT o.* FROM one o WHERE NOT EXISTS (SELECT 1 FROM begun b WHERE b.turns = o.turns)
)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, CAST(n_logged AS BIGINT) AS n_logged,
  array_to_string(list_transform(turns, lambda t: '<|im_start|>' || replace(replace(t[1], '<|', '<\\|'), '|>', '|\\>') || chr(10)
    || replace(replace(t[2], '<|', '<\\|'), '|>', '|\\>') || '<|im_end|>' || chr(10)), '') AS chat
FROM kept
"""
