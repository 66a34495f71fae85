"""Collocations of two and three words for each language, grown best first from counted prefixes.

A phrase can't stand more often than a prefix of it, so that a prefix bounds the score of all that grows from it: whatever
follows the pair (v, w), the cut after v gives at most f(v w) / f(v). Words and pairs are counted in whole. Pairs wait in
a frontier, in the order of that bound; a pair is expanded by counting the phrases of three words that begin with it, and,
as it is itself a candidate, those that end with it, which may cover it. A first batch from the top of the frontier gives
each language a ``TOP``-th best score of phrases that nothing can cover any more; the next expands all that can still
reach it, ties included, after which it is settled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootweave.llm.arrays import LOWER, U64, mix, prefix_hash, slices, span_hash, text_bytes, word_spans
from rootweave.llm.session import PICKED, small_batches, stored

LEAST, TOP, COVERED, MILLION = 10, 2000, 50, 1_000_000
#: Pairs of a language that the first batch expands; while that gives too few phrases, eight times as many.
BATCH = 4 * TOP

#: [.,;:!?\x0A-\x0D] end a piece; \x20 and \x09 separate its words.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
INSIDE = ~ENDS
INSIDE[[0x20, 0x09]] = False
#: Words whose phrases are counted together before they leave a task.
HELD = 1 << 20
#: Bits of the filters that go to all tasks (8 MB for words, 16 MB for pairs, however many there are).
WORD_BITS, PAIR_BITS = 26, 27


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text"))


def read(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple]:
    """For each slice: bytes in lower case, starts and ends of words, their hashes (with the language), row, and whether a word goes on the piece of the one before."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            low = LOWER[data]
            starts, ends, _ = word_spans(low, offsets, INSIDE[low])
            if not len(starts):
                continue
            langs = pc.dictionary_encode(part.column("lang"))
            salts = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=8).digest()) for x in langs.dictionary.to_pylist()], U64)
            row = np.searchsorted(offsets, starts, "right") - 1
            words = mix(span_hash(prefix_hash(low), starts, ends) ^ salts[langs.indices.to_numpy()[row]])
            broken = np.cumsum(ENDS[low])
            goes_on = np.zeros(len(starts), bool)
            goes_on[1:] = (broken[starts[1:]] == broken[ends[:-1] - 1]) & (row[1:] == row[:-1])
            yield low, starts, ends, words, row, goes_on, part


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """w (hash of language and word), lang, word and n; and whether a hash stands for two words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for low, starts, ends, words, row, _, part in read(batches, seed):
            found, first, n = np.unique(words, return_index=True, return_counts=True)
            lengths = ends[first] - starts[first]
            cuts = np.r_[0, np.cumsum(lengths)]
            letters = low[np.arange(cuts[-1]) + np.repeat(starts[first] - cuts[:-1], lengths)]
            spelt = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(letters)])
            yield pa.record_batch([found.view(np.int64), n, part.column("lang").take(pa.array(row[first])), spelt.cast(pa.binary())], names=["w", "n", "lang", "word"])

    rows = docs.mapInArrow(count, "w bigint, n bigint, lang string, word binary")
    one = F.struct("lang", "word")
    return rows.groupBy("w").agg(F.sum("n").alias("n"), F.min(one).alias("one"), (F.min(one) != F.max(one)).alias("clash")).select("w", "n", "one.lang", F.col("one.word").cast("string").alias("word"), "clash")


def cell_of(bits: int, *words: np.ndarray) -> np.ndarray:
    """Where a filter keeps a word, or a pair of words."""
    x = words[0]
    for w in words[1:]:
        x = x ^ (w << U64(17) | w >> U64(47))
    return (x & U64((1 << bits) - 1)).astype(np.int64)


def cell(bits: int, first: Column, second: Column | None = None) -> Column:
    """The same as a column, from 1."""
    x = first
    if second is not None:
        x = x.bitwiseXOR(F.shiftleft(second, 17).bitwiseOR(F.shiftrightunsigned(second, 47)))
    return x.bitwiseAND(F.lit((1 << bits) - 1)) + 1


def bit_filter(rows: DataFrame, bits: int, *columns: str):
    """A bitmap of the rows' cells for all tasks: its size is fixed. It may hold what isn't there, never the other way."""
    cells = rows.select(cell(bits, *map(F.col, columns)).alias("x"))
    parts = cells.groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m"))
    whole = bytearray(1 << bits - 3)
    for b, m in parts.toLocalIterator():
        whole[(b - 1) * len(m) : b * len(m)] = m
    return rows.sparkSession.sparkContext.broadcast(bytes(whole))


def holds(bitmap: bytes, cells: np.ndarray) -> np.ndarray:
    return np.frombuffer(bitmap, np.uint8)[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 == 1


def phrase_counts(docs: DataFrame, seed: int, size: int, chosen) -> DataFrame:
    """Counts of the phrases of ``size`` words that ``chosen`` picks, a mask over the places where one starts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def summed() -> pa.RecordBatch:
            known, ids = np.unique(np.concatenate(held), return_inverse=True)  # numbers of 21 bits for the words of a block
            ids = ids.reshape(-1, size)
            key = ids[:, 0].astype(np.int64)
            for k in range(1, size):
                key = key << 21 | ids[:, k]
            keys, n = np.unique(key, return_counts=True)
            words = [known[keys >> 21 * (size - 1 - k) & (1 << 21) - 1].view(np.int64) for k in range(size)]
            return pa.record_batch([*words, n], names=[*[f"w{k + 1}" for k in range(size)], "n"])

        for *_, words, _, goes_on, _ in read(batches, seed):
            last = len(words) - size + 1
            if last <= 0:
                continue
            mask = np.logical_and.reduce([goes_on[k : last + k] for k in range(1, size)])
            mask = np.flatnonzero(mask)
            mask = mask[chosen([words[mask + k] for k in range(size)])]
            for begin in range(0, len(mask), HELD // size):
                some = mask[begin : begin + HELD // size]
                held.append(np.stack([words[some + k] for k in range(size)], axis=1).reshape(-1))
                total += len(held[-1])
                if total >= HELD // 2:
                    yield summed()
                    held, total = [], 0
        if held:
            yield summed()

    keys = [f"w{k + 1}" for k in range(size)]
    rows = docs.mapInArrow(count, f"{', '.join(f'{k} bigint' for k in keys)}, n bigint")
    return rows.groupBy(keys).agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST)


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact up to counts of 10**15."""
    whole = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"({whole(MILLION)} * {whole(a)} * {whole(a)}) div ({whole(left)} * {whole(right)})")


def best(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    """The first ``top`` rows of each language by ``order``, with rank: those of 64 parts of it first, so that no task sorts a language."""
    part = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "lang"]), F.lit(64))
    some = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    return some.drop("_part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def small(rows: DataFrame, name: str) -> DataFrame:
    """Written, and broadcast if it is proven to be small."""
    rows = stored(rows, name)
    return F.broadcast(rows) if rows.count() <= PICKED else rows


def settled(docs: DataFrame, seed: int, words: DataFrame, pairs: DataFrame, known: tuple, right: DataFrame, left: DataFrame) -> DataFrame:
    """lang, w1, w2, w3 (null: a pair), a, l, r, score of the phrases of three words that begin with a pair of ``right`` or
    end with one of ``left``, and of the pairs of ``left`` that none of them covers. Pairs of ``left`` are in ``right`` too."""
    all_pairs = known[1]
    begins, ends = bit_filter(right, WORD_BITS, "w1", "w2"), bit_filter(left, WORD_BITS, "w1", "w2")

    def chosen(w: list[np.ndarray]) -> np.ndarray:
        asked = holds(begins.value, cell_of(WORD_BITS, w[0], w[1])) | holds(ends.value, cell_of(WORD_BITS, w[1], w[2]))
        at = np.flatnonzero(asked)
        return at[holds(all_pairs.value, cell_of(PAIR_BITS, w[0][at], w[1][at])) & holds(all_pairs.value, cell_of(PAIR_BITS, w[1][at], w[2][at]))]

    triples = stored(phrase_counts(docs, seed, 3, chosen), "triples")
    head = pairs.select("lang", "w1", "w2", F.col("a").alias("f12"), F.col("f1"))
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
    cuts = triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).withColumn("s1", score("a", "f1", "f23")).withColumn("s2", score("a", "f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    longer = cuts.select("lang", "w1", "w2", "w3", "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    inside = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    covers = inside.groupBy("w1", "w2").agg(F.max("a").alias("most"))
    free = left.join(covers, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("most") < COVERED * F.col("a"), F.lit(True)))
    return stored(longer.unionByName(free.select("lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")), "settled")


def collocations(docs: DataFrame, top: int = TOP, batch: int = BATCH) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's ``top`` phrases by score, then a (both falling), then phrase.

    A null language is ``und``; a null text is empty. Every row counts, repeated or not. n is the language's number of
    words; a, l and r are the counts of the phrase and of the parts on both sides of its lowest-scoring cut. Phrases with a
    below ``LEAST`` are none; pairs that a phrase of three words covers by half are dropped. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs, seed = texts_of(docs), 0
    while True:  # a hash that stands for two words is found by their spellings: count again with another
        counted = stored(word_counts(docs, seed), "words")
        if counted.where("clash").isEmpty():
            break
        seed += 1
    sizes = small(counted.groupBy("lang").agg(F.sum("n").alias("total")), "sizes")
    words = stored(counted.where(F.col("n") >= LEAST).select("w", "lang", F.col("n").alias("f"), "word"), "frequent")
    often = bit_filter(words, WORD_BITS, "w")
    counts = phrase_counts(docs, seed, 2, lambda w: np.flatnonzero(holds(often.value, cell_of(WORD_BITS, w[0])) & holds(often.value, cell_of(WORD_BITS, w[1]))))
    firsts = words.select(F.col("w").alias("w1"), "lang", F.col("f").alias("f1"))
    seconds = words.select(F.col("w").alias("w2"), F.col("f").alias("f2"))
    pairs = stored(counts, "counts").join(firsts, "w1").join(seconds, "w2")
    # what can grow from a pair scores no more than its bound; nor does the pair itself
    pairs = stored(pairs.withColumn("score", score("a", "f1", "f2")).withColumn("bound", F.expr(f"{MILLION} * a div f1")), "pairs")
    known = often, bit_filter(pairs, PAIR_BITS, "w1", "w2")
    waiting = small(pairs.groupBy("lang").agg(F.count("*").alias("waiting")), "waiting")
    while True:
        some = stored(best(pairs, batch, F.desc("bound"), F.desc("score"), F.col("w1"), F.col("w2")), "batch").select(pairs.columns)
        found = settled(docs, seed, words, pairs, known, some, some)
        ranked = best(found.select("lang", "score", "w1", "w2", "w3"), top, F.desc("score"), F.col("w1"), F.col("w2"))
        reached = stored(ranked.groupBy("lang").agg(F.count("*").alias("found"), F.min("score").alias("least")), "reached")
        bars = waiting.join(reached, "lang", "left").withColumn("full", F.coalesce(F.col("found") >= top, F.lit(False)))
        bars = small(bars.select("lang", "full", F.when(F.col("full"), F.col("least")).otherwise(F.lit(0)).alias("bar"), (F.col("waiting") <= batch).alias("all")), "bars")
        if bars.where("not full and not all").isEmpty():
            break
        batch *= 8
    able = pairs.join(bars.select("lang", "bar"), "lang")
    right = stored(able.where("bound >= bar"), "able").select(pairs.columns)
    final = settled(docs, seed, words, pairs, known, right, able.where("score >= bar").select(pairs.columns))
    final = final.join(bars.select("lang", "bar"), "lang").where("score >= bar").drop("bar")
    for k in (1, 2, 3):
        final = final.join(words.select(F.col("w").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    phrases = final.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "l", "r", "score")
    ranked = best(phrases, top, F.desc("score"), F.desc("a"), F.col("phrase"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


SQL = f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts
), lists AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces
), one AS (SELECT lang, w, CAST(count(*) AS HUGEINT) AS f FROM (SELECT lang, unnest(ws) AS w FROM lists) GROUP BY ALL
), two AS (SELECT lang, g[1] AS w1, g[2] AS w2, CAST(count(*) AS HUGEINT) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) AS g FROM lists) GROUP BY ALL
), three AS (SELECT lang, g[1] AS w1, g[2] AS w2, g[3] AS w3, CAST(count(*) AS HUGEINT) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) AS g FROM lists) GROUP BY ALL HAVING count(*) >= {LEAST}
), pairs AS (SELECT p.lang, w1, w2, p.f AS a, x.f AS l, y.f AS r, ({MILLION} * p.f * p.f) // (x.f * y.f) AS score FROM two p JOIN one x ON x.lang = p.lang AND x.w = w1 JOIN one y ON y.lang = p.lang AND y.w = w2 WHERE p.f >= {LEAST}
), cuts AS (SELECT t.*, x.f AS f1, q.f AS f23, p.f AS f12, z.f AS f3, ({MILLION} * t.f * t.f) // (x.f * q.f) AS s1, ({MILLION} * t.f * t.f) // (p.f * z.f) AS s2 FROM three t
  JOIN one x ON x.lang = t.lang AND x.w = t.w1 JOIN two q ON q.lang = t.lang AND q.w1 = t.w2 AND q.w2 = t.w3 JOIN two p ON p.lang = t.lang AND p.w1 = t.w1 AND p.w2 = t.w2 JOIN one z ON z.lang = t.lang AND z.w = t.w3
), phrases AS (
  SELECT lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, f AS a, CASE WHEN s1 <= s2 THEN f1 ELSE f12 END AS l, CASE WHEN s1 <= s2 THEN f23 ELSE f3 END AS r, least(s1, s2) AS score FROM cuts
  UNION ALL SELECT lang, w1 || ' ' || w2, a, l, r, score FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM three t WHERE t.lang = p.lang AND t.w1 = p.w1 AND t.w2 = p.w2 AND 100 * t.f >= {COVERED} * p.a)
    AND NOT EXISTS (SELECT 1 FROM three t WHERE t.lang = p.lang AND t.w2 = p.w1 AND t.w3 = p.w2 AND 100 * t.f >= {COVERED} * p.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM phrases)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST((SELECT sum(f) FROM one o WHERE o.lang = k.lang) AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked k WHERE rank <= {TOP}
"""
