"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item of n words is compared with all windows of n words (a shorter text is one window). A window's SimHash
is looked up in a multi-index over the SimHashes of the items of n words: eight blocks of eight bits, each with the items
by block value; as one block at least differs in two bits at most wherever all differ in RADIUS at most, no fingerprint
within the radius is missed. Candidates so found are verified by the exact weighted similarity of five-word shingles.
Windows that hold too few shingles of items of their length for the similarity asked are left out before hashing.

A shingle's weight is its inverse document frequency over the whole benchmark, counted by cells of a table of bounded
size, so that it doesn't depend on the blocks in which a large benchmark goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.llm import arrays as A
from rootweave.llm.session import documents, small_batches, stored

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 23, 8
#: Bytes of benchmark text that one pass over the documents takes; a larger benchmark takes more passes.
PASS_BYTES = 16 << 20
#: Pairs of windows and items that the multi-index lists at once, at most 4096 windows, whose starts lie within SPAN words.
PAIRS, WINDOWS, SPAN = 1 << 20, 4096, 1 << 14
#: Bits of a shingle's cell in the table of document frequencies.
CELL_BITS = 22

MATCH = "doc_id long, item_id long, similarity double, first_word long, n_words long, distance int"
MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32())])
#: By value of a block: the values that differ from it in as many bits as a block may.
NEAR = [[v for v in range(256) if (v ^ x).bit_count() <= RADIUS // BLOCKS] for x in range(256)]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words (digits, letters and all non-ASCII characters) and the first word of each text."""
    data, bounds = A.text_bytes(texts)
    data = A.LOWER[data]
    starts, ends, first = A.word_spans(data, bounds, A.ALNUM[data])
    return A.span_hash(A.prefix_hash(data), starts, ends), first


def shingles(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words by first word."""
    at = np.arange(max(0, len(sums) - size))
    return A.span_hash(sums, at, at + size)


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> A.U64(64 - CELL_BITS)).astype(np.int64)


def votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of 64 signed weights for each hash."""
    bits = np.unpackbits(A.mix(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
    return (2 * bits - 1) * weights[:, None].astype(np.float32)


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


@dataclass
class Weights:
    """Document frequencies of shingles over the whole benchmark, by cell."""

    items: int
    counts: np.ndarray

    @property
    def rare(self) -> float:
        return 1 + float(np.log(1 + self.items))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return 1 + np.log((1 + self.items) / np.maximum(1, self.counts[cells(hashes)]))


class Length:
    """The items of one number of words, with the multi-index over their fingerprints."""

    def __init__(self, n: int, size: int, ids: list[int | None], hashes: list[np.ndarray], weights: Weights) -> None:
        self.n, self.size, self.ids = n, size, ids
        self.bags = [np.unique(h, return_counts=True) for h in hashes]
        self.weigh = [weights.of(h) for h, _ in self.bags]
        self.whole = [float((w * c).sum()) for w, (_, c) in zip(self.weigh, self.bags, strict=True)]
        self.prints = np.concatenate([fingerprint(votes(h, w * c).sum(0, keepdims=True)) for w, (h, c) in zip(self.weigh, self.bags, strict=True)])
        self.first, self.listed = [], []
        for b in range(BLOCKS):
            holders: list[list[int]] = [[] for _ in range(256)]
            for i, value in enumerate(self.prints[:, b].tolist()):
                for near in NEAR[value]:
                    holders[near].append(i)
            self.first.append(np.cumsum([0, *map(len, holders)]))
            self.listed.append(np.array([i for x in holders for i in x], np.int64))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all fingerprints within the radius."""
        pairs = []
        for b in range(BLOCKS):
            value = prints[:, b].astype(np.int64)
            start, count = self.first[b][value], self.first[b][value + 1] - self.first[b][value]
            pairs.append(np.repeat(np.arange(len(prints)), count) * len(self.ids) + self.listed[b][A.concat_ranges(start, count)])
        found = np.unique(np.concatenate(pairs))
        window, item = found // len(self.ids), found % len(self.ids)
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1)
        within = distance <= RADIUS
        return window[within], item[within], distance[within]

    def similarity(self, window: np.ndarray, weight: float, item: int) -> float:
        """Weighted Jaccard similarity of an item's bag of shingles and a window's, which weighs ``weight`` in all."""
        hashes, counts = self.bags[item]
        place = np.minimum(np.searchsorted(hashes, window), len(hashes) - 1)
        held = np.bincount(place[hashes[place] == window], minlength=len(hashes))
        both = float((np.minimum(held, counts) * self.weigh[item]).sum())
        return both / (weight + self.whole[item] - both)


class Items:
    """A block of the benchmark: its items by length, and the lengths of the items that hold a shingle."""

    def __init__(self, ids: list[int | None], texts: list[str], shingle: int, weights: Weights) -> None:
        words, first = word_hashes(pa.array(texts, pa.string()))
        by_length: dict[int, list[int]] = {}
        for i, n in enumerate(np.diff(first).tolist()):
            if n:
                by_length.setdefault(n, []).append(i)
        self.lengths, of = [], []
        for n, rows in sorted(by_length.items()):
            size = min(shingle, n)
            hashes = [shingles(A.prefix_hash(words[first[i] : first[i + 1]]), size) for i in rows]
            self.lengths.append(Length(n, size, [ids[i] for i in rows], hashes, weights))
            of.append(np.unique(np.concatenate(hashes)))
        number = np.repeat(np.arange(len(of)), [len(x) for x in of])
        every = np.concatenate([*of, np.zeros(0, A.U64)])
        order = np.argsort(every, kind="stable")
        self.known, start = np.unique(every[order], return_index=True)
        self.start, self.holders = np.append(start, len(every)), number[order]
        self.sizes = sorted({x.size for x in self.lengths})
        self.weights = weights

    def matches(self, hashes: dict[int, np.ndarray], similarity: float, n_words: int) -> Iterator[tuple[int | None, float, int, int, int]]:
        """(item, similarity, first word, words, distance) of the best window of one text for each item that matches.

        ``hashes``: the text's shingles by size.
        """
        for size, grams in hashes.items():
            at = np.flatnonzero(self.weights.counts[cells(grams)] > 0)
            place = np.minimum(np.searchsorted(self.known, grams[at]), max(0, len(self.known) - 1))
            sure = self.known[place] == grams[at]
            at, place = at[sure], place[sure]
            if not len(at):
                continue
            count = self.start[place + 1] - self.start[place]
            spots, length = np.repeat(at, count), self.holders[A.concat_ranges(self.start[place], count)]
            weight = self.weights.of(grams)
            for k in np.unique(length).tolist():
                if self.lengths[k].size == size:
                    yield from self.of_length(self.lengths[k], grams, weight, spots[length == k], similarity, n_words)

    def of_length(self, items: Length, grams: np.ndarray, weight: np.ndarray, spots: np.ndarray, similarity: float, n_words: int) -> Iterator[tuple[int | None, float, int, int, int]]:
        n = min(items.n, n_words)  # a shorter text is one window
        width = n - items.size + 1
        near = np.zeros(len(grams) + 1, np.int64)  # windows that hold a spot
        np.add.at(near, np.maximum(spots - width + 1, 0), 1)
        np.add.at(near, spots + 1, -1)
        starts = np.flatnonzero(np.cumsum(near)[: len(grams) - width + 1])
        held = np.searchsorted(spots, starts + width) - np.searchsorted(spots, starts)
        starts = starts[held >= width * least_share(similarity, self.weights.rare)]
        best: dict[int, tuple[float, int, int]] = {}
        step = max(1, min(WINDOWS, PAIRS // len(items.ids)))
        block = 0
        while block < len(starts):
            # sums of votes take 512 bytes a word from the first window of a block to its last
            end = min(block + step, int(np.searchsorted(starts, starts[block] + SPAN)))
            some, block = starts[block:end], end
            low, high = int(some[0]), int(some[-1]) + width
            ahead = np.zeros((high - low + 1, 64))
            np.cumsum(votes(grams[low:high], weight[low:high]), axis=0, out=ahead[1:])
            # weights that cancel out leave rounding errors of sums
            prints = fingerprint(ahead[some + width - low] - ahead[some - low] - 1e-6)
            for window, item, distance in zip(*(x.tolist() for x in items.near(prints)), strict=True):
                begin = int(some[window])
                alike = items.similarity(grams[begin : begin + width], float(weight[begin : begin + width].sum()), item)
                if alike >= similarity and (item not in best or (alike, -begin) > (best[item][0], -best[item][1])):
                    best[item] = alike, begin, distance
        for item, (alike, begin, distance) in best.items():
            yield items.ids[item], alike, begin, n, distance


def least_share(similarity: float, rare: float) -> float:
    """A lower bound of the share of a window's shingles that a similar item holds, whatever their weights.

    For bags of equal size m with weights from 1 to ``rare``: common weight >= s / (1 + s) * (sum of both) needs common
    shingles c with c * rare >= s * (c * rare + 2 * (m - c)), hence the share below. A text shorter than an item has a
    smaller bag, which needs a larger share.
    """
    s = similarity
    return 2 * s / (rare * (1 - s) + 2 * s) if s < 1 else 1.0


def by_size(words: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    sums = A.prefix_hash(words)
    return {s: shingles(sums, s) for s in sizes if len(words) >= s}


def weights_of(items: DataFrame, shingle: int) -> Weights:
    """Counts, for each cell, the items that hold one of its shingles: at most a row for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in A.lean_slices(batch, "text"):
                words, first = word_hashes(piece.column("text"))
                held = [np.zeros(0, np.int64)]
                for a, b in zip(first, first[1:], strict=False):
                    if a < b:
                        held.append(np.unique(cells(shingles(A.prefix_hash(words[a:b]), min(shingle, b - a)))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).astype(np.int32))], ["cell"])

    found = items.mapInArrow(run, "cell int").groupBy("cell").agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(1 << CELL_BITS, np.int32)
    counts[found["cell"].to_numpy()] = np.minimum(found["n"].to_numpy(), 1 << 30)
    return Weights(items.count(), counts)


def sieved(weights, sizes: list[int]):
    """For mapInArrow over (doc_id, text): the rows that may hold a shingle of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in A.lean_slices(batch, "text"):
                words, first = word_hashes(piece.column(1))
                sums = A.prefix_hash(words)
                keep = np.zeros(piece.num_rows, bool)
                for size in sizes:
                    grams = shingles(sums, size)
                    keep[np.searchsorted(first, np.flatnonzero(weights.value.counts[cells(grams)] > 0), side="right") - 1] = True
                yield piece.filter(pa.array(keep))

    return run


def searched(items, similarity: float):
    """For mapInArrow over (doc_id, text): matches with a block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        for batch in batches:
            for piece in A.lean_slices(batch, "text"):
                words, first = word_hashes(piece.column(1))
                sums = A.prefix_hash(words)
                ids, rows = piece.column(0).to_pylist(), []
                maybe = np.zeros(piece.num_rows, bool)
                for size in block.sizes:
                    grams = shingles(sums, size)
                    at = np.flatnonzero(block.weights.counts[cells(grams)] > 0)
                    at = at[np.isin(grams[at], block.known)]
                    maybe[np.searchsorted(first, at, side="right") - 1] = True
                for row in np.flatnonzero(maybe).tolist():
                    mine = words[first[row] : first[row + 1]]
                    rows += [(ids[row], *match) for match in block.matches(by_size(mine, block.sizes), similarity, len(mine))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), MATCHES, strict=True)], schema=MATCHES)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, pass_bytes: int | None = None) -> DataFrame:
    """Texts that hold a passage as long as a benchmark item and similar to it: one row for each such pair.

    Returns doc_id, item_id, similarity (of the best window, the leftmost of equals), first_word, n_words and distance
    (of the SimHashes). Items of fewer than ``shingle`` words are one shingle; items without words match nothing, nor do
    null and empty texts. A text shorter than an item is one window. Rows without doc_id or item_id take part like all
    others and carry the null; repeated rows give repeated pairs. Other columns are ignored, empty tables give no rows.

    The benchmark goes to the tasks in blocks of ``pass_bytes`` of text (PASS_BYTES), one after the other, so that what
    is broadcast is bounded and the driver holds one block; where there are several, one pass first keeps the texts that
    may hold any shingle of the benchmark, and each block is then compared with those. The result is the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = documents(docs)
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null")
    size = int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    passes = max(1, -(-size // (pass_bytes or PASS_BYTES)))
    weights = weights_of(items, shingle)
    if passes > 1:
        shared = spark.sparkContext.broadcast(weights)
        plain = stored(plain.mapInArrow(sieved(shared, list(range(1, shingle + 1))), "doc_id long, text string"), "sieved")
        shared.destroy()
    found = None
    for part in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == part).collect()
        block = spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows], shingle, weights))
        some = plain.mapInArrow(searched(block, similarity), MATCH)
        if passes > 1:
            some = stored(some, "matches")
            block.destroy()
        found = some if found is None else found.unionByName(some)
    return found
