"""Near duplicates by MinHash bands, odd sketches and exact confirmation.

Equal shingle sets are one class from the start. Each class has 128 MinHash samples: 25 bands of five deal classes into
buckets, and all samples are folded into a parity bitmap (an odd sketch), whose XOR with another's estimates a high
similarity from its population count. Links are confirmed on full sets.

Groups of copies are never expanded into all pairs. Each member is first held against its bucket's smallest one, its hub;
the confirmed links join most of a group. Then only members of different components need comparing: those outside the
bucket's largest component are compared with the bucket, and give only links that join components. What is compared is
dealt in cells of bounded size, a hub's members in as many as they need, so that no popular document's near copies and no
common band meet in one task. Where many texts share a band without being near duplicates, their sketches are compared
with each other, cell by cell (eight long numbers a pair); full sets are compared only for the pairs that sketches leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.llm import arrays as A
from rootweave.llm.components import components
from rootweave.llm.session import documents, listed_ids, small_batches, spread_join, stored

SHINGLE = 3
THRESHOLD = 85  # per cent
BANDS, ROWS, SAMPLES = 25, 5, 128
LONGS = 8
BITS = 64 * LONGS
#: An estimate this much below the threshold still goes to confirmation: over five standard deviations.
SLACK = 0.2
#: Members and probes of a cell, and shingles of either that it has on average at most.
MEMBERS, PROBES, SHINGLES = 512, 2048, 1 << 20
#: Members of a cell that has one probe, a hub.
STAR = 128

FACTORS = A.mix(np.arange(1, SAMPLES + 1, dtype=A.U64)) | A.U64(1)
SKETCH = "doc_id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>"
SKETCHES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes: ``size`` lower-cased words, or all words if fewer."""
    data, bounds = A.text_bytes(texts)
    data = A.LOWER[data]
    starts, ends, first = A.word_spans(data, bounds, ~A.SPACE[data])
    sums = A.prefix_hash(A.span_hash(A.prefix_hash(data), starts, ends))
    counts = np.diff(first)
    grams = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = A.concat_ranges(first[:-1], grams)
    end = begin + np.repeat(np.minimum(counts, size), grams)
    hashes = A.span_hash(sums, begin, end)
    cuts = np.concatenate([[0], np.cumsum(grams)])
    return [np.unique(hashes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1).view(np.int64)))


def sketched(size: int):
    """For mapInArrow over (doc_id, text): set size, set key, bands and sketch; empty sets have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in A.lean_slices(batch, "text"):
                sets = shingle_sets(piece.column(1), size)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                flat = np.concatenate([*sets, np.zeros(0, A.U64)])
                cuts = np.cumsum(n[full]) - n[full]
                least = np.zeros((len(full), SAMPLES), A.U64)
                k1, k2 = np.zeros(len(n), A.U64), np.zeros(len(n), A.U64)
                if len(full):
                    for i in range(SAMPLES):
                        least[:, i] = np.minimum.reduceat(flat * FACTORS[i], cuts)
                    k1[full] = np.add.reduceat(A.mix(flat), cuts)
                    k2[full] = np.add.reduceat(A.mix(flat ^ A.U64(0x5DEECE66D)), cuts)
                number = np.arange(BANDS, dtype=A.U64)
                bands = A.mix(reduce(lambda x, i: A.mix(x) + least[:, i : BANDS * ROWS : ROWS], range(ROWS), np.broadcast_to(number, (len(full), BANDS))))
                bit = (A.mix(least + np.arange(SAMPLES, dtype=A.U64)) % A.U64(BITS)).astype(np.int64)
                odd = np.zeros((len(full), BITS), np.uint8)
                for i in range(SAMPLES):
                    odd[np.arange(len(full)), bit[:, i]] ^= 1
                sketch = np.packbits(odd, axis=1).view(A.U64)
                bands_of, sketch_of = np.zeros((len(n), BANDS), A.U64), np.zeros((len(n), LONGS), A.U64)
                bands_of[full], sketch_of[full] = bands, sketch
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists(bands_of), lists(sketch_of)], schema=SKETCHES)

    return run


def listed(size: int):
    """For mapInArrow over (doc_id, text): the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in A.lean_slices(batch, "text"):
                sets = shingle_sets(piece.column(1), size)
                cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, A.U64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], schema=SETS)

    return run


def most_odd(threshold: int) -> int:
    """Bits in which the sketches of two sets may differ for their estimated similarity to stay near the threshold."""
    least = threshold / 100 - SLACK
    return int(np.ceil(BITS / 2 * (1 - np.exp(-4 * SAMPLES / BITS * (1 - least)))))


def close(sketch: Column, other: Column, n: Column, m: Column, threshold: int) -> Column:
    """Whether sizes and odd sketches let two sets be as similar as asked."""
    odd = reduce(lambda x, i: x + F.bit_count(sketch[i].bitwiseXOR(other[i])), range(LONGS), F.lit(0))
    return (100 * F.least(n, m) >= threshold * F.greatest(n, m)) & (odd <= most_odd(threshold))


def across(threshold: int):
    """For mapInArrow over cells (cell, probe, rep, comp, n, sketch, shingles): confirmed links of probes with members.

    What the cell has linked so far is one component, and nothing within a component is compared again, so that a cell
    gives fewer links than it has rows.
    """
    most = most_odd(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in A.groups(batches, "cell"):
            probe = cell["probe"].to_numpy().astype(bool)
            rep, n = cell["rep"].to_numpy(), cell["n"].to_numpy()
            comp = cell["comp"].to_numpy().copy()
            bits = cell["sketch"].combine_chunks().flatten().to_numpy().view(A.U64).reshape(-1, LONGS)
            lists = cell["shingles"].combine_chunks()
            flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            first = np.cumsum(size) - size
            members, links = np.flatnonzero(~probe), []
            for x in np.flatnonzero(probe):
                y = members[(comp[members] != comp[x]) & (100 * np.minimum(n[members], n[x]) >= threshold * np.maximum(n[members], n[x]))]
                y = y[np.bitwise_count(bits[y] ^ bits[x]).sum(1) <= most]
                if not len(y):
                    continue
                mine = np.sort(flat[first[x] : first[x] + size[x]])
                theirs = flat[A.concat_ranges(first[y], size[y])]
                held = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                shared = np.add.reduceat(held.astype(np.int64), np.cumsum(size[y]) - size[y])
                for z in y[100 * shared >= threshold * (size[y] + size[x] - shared)].tolist():
                    if comp[z] != comp[x]:
                        links.append((rep[z], rep[x]))
                        comp[comp == comp[z]] = comp[x]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*links, strict=True)], schema=PAIRS)

    return run


def sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """doc_id and shingles of the listed documents."""
    return stored(docs.join(listed_ids(ids), "doc_id", "left_semi").mapInArrow(listed(size), "doc_id long, shingles array<long>"), "sets")


def parts(rows: str, shingles: str, most: int) -> Column:
    """Into how many parts so many rows with so many shingles are dealt."""
    return F.greatest(F.lit(1), F.ceil(F.expr(rows) / most), F.ceil(F.expr(shingles) / SHINGLES)).cast("int")


def confirmed(stars: DataFrame, sketch: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """Those pairs of a hub and another class (hub, rep, n) whose full sets are as similar as asked: a and b."""
    stars = stored(stars, "stars")
    sizes = stored(stars.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("all_n")).withColumn("wide", parts("m", "all_n", STAR)), "hubs")
    member = spread_join(stars, sizes.select("hub", "m", "wide"), "hub", "m").select(F.xxhash64("hub", F.pmod(F.xxhash64("rep"), "wide")).alias("cell"), F.lit(0).alias("probe"), "rep")
    probe = sizes.select(F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("i"), "hub").select(F.xxhash64("hub", F.col("i").cast("long")).alias("cell"), F.lit(1).alias("probe"), F.col("hub").alias("rep"))
    return compared(member.unionByName(probe).withColumn("comp", F.col("rep")), sketch, docs, size, threshold)


def compared(dealt: DataFrame, sketch: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links that ``across`` finds in cells (cell, probe, rep, comp)."""
    dealt = stored(dealt, "cells")
    sets = sets_of(dealt.select(F.col("rep").alias("doc_id")), docs, size)
    sets = sets.groupBy(F.col("doc_id").alias("rep")).agg(F.first("shingles").alias("shingles"))
    rows = dealt.join(sketch.join(sets, "rep"), "rep").select("cell", "probe", "rep", "comp", "n", "sketch", "shingles")
    return stored(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(across(threshold), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of ``threshold`` per cent or more of their shingle sets.

    Returns one row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept
    (doc_id = component_id). Words are runs of characters other than \\x20 and \\x09-\\x0D, A-Z lower-cased. Null, empty
    and blank texts have no shingles and no links. Rows without doc_id get no component and are kept. Rows that repeat a
    doc_id count as one node, linked by what either holds. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    plain = documents(docs)
    sketches = stored(plain.mapInArrow(sketched(shingle), SKETCH), "sketches")
    named = sketches.where("doc_id is not null and n > 0")
    plain = plain.where("doc_id is not null")
    classes = stored(named.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "classes")
    buckets = classes.select(F.explode("bands").alias("key"), "rep", "n")
    hubs = stored(buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1"), "bands")
    buckets = stored(spread_join(buckets, hubs, "key", "m"), "buckets")
    sketch = classes.select("rep", "n", "sketch")
    of_hub = sketch.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
    stars = buckets.where("rep <> hub").select("hub", "rep").distinct()
    stars = spread_join(stored(stars.join(sketch, "rep"), "met"), of_hub, "hub")
    stars = stars.where(close(F.col("sketch"), F.col("hub_sketch"), F.col("n"), F.col("hub_n"), threshold)).select("hub", "rep", "n")
    links = confirmed(stars, sketch, plain, shingle, threshold)
    joined = components(links).select(F.col("node").alias("rep"), F.col("component").alias("comp"))

    # members of different components of one bucket
    placed = stored(buckets.select("key", "rep", "n").join(joined, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "placed")
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("part_n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("m", "comp", "part_n")).alias("top"), F.sum("m").alias("all"), F.sum("part_n").alias("all_n"), F.count("*").alias("parts")).where("parts > 1")
    wide, deep = parts("all", "all_n", MEMBERS), parts("all - top.m", "all_n - top.part_n", PROBES)
    largest = stored(largest.select("key", "all", F.col("top.comp").alias("main"), wide.alias("wide"), deep.alias("deep")), "largest")
    open_ = stored(spread_join(placed, largest, "key", "all"), "open")
    member = open_.select("*", F.lit(0).alias("probe"), F.pmod(F.xxhash64("rep"), "wide").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("deep") - 1)).alias("j"))
    probe = open_.where("comp <> main").select("*", F.lit(1).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("i"), F.pmod(F.xxhash64("rep"), "deep").cast("int").alias("j"))
    dealt = member.unionByName(probe).select(F.xxhash64("key", "i", "j").alias("cell"), "probe", "rep", "comp")
    more = compared(dealt, sketch, plain, shingle, threshold)
    joined = components(links.unionByName(more)).select(F.col("node").alias("rep"), F.col("component").alias("comp"))

    of_class = F.struct("k1", "k2", "n").alias("class")
    found = classes.join(joined, "rep", "left").select(of_class, "copies", F.coalesce("comp", "rep").alias("component_id"))
    result = spread_join(named.select("doc_id", "n", of_class), found, "class", "copies")
    rest = sketches.where("doc_id is null or n = 0").withColumn("component_id", F.col("doc_id"))
    every = result.select("doc_id", "n", "component_id").unionByName(rest.select("doc_id", "n", "component_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
