"""Suffix-array dedup by column-wise construction over many texts.

Contexts (runs of 100-byte windows, at most 168 bytes) that share an anchor but differ are strings of a collection.
A task takes blocks of whole anchor groups and builds each block's Burrows-Wheeler transform by columns: every round
puts the next symbol, from the right, of every string in front of its suffix, and the transform's own stable order by
symbol gives all places of the next round. Neighbours of the final order that agree on 100 bytes are equal windows.

Where external files would hold the transform, Spark's shuffle does: a block is bounded (``repeats.BLOCK_BYTES``), so its columns
stay in memory and a lost executor's blocks are made again from the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.llm import arrays as A
from rootweave.llm import repeats as R
from rootweave.llm.session import documents, small_batches, stored

WIDTH, GRAM = 100, 32
#: Windows before an anchor that are told apart by their common bytes first.
PART = 12

RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def column_order(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Start in ``body`` of every non-empty suffix of every string, in sorted order (shorter first, then by string).

    The list holds all suffixes inserted so far, ``before`` the symbol in front of each: the transform. A stable sort by
    that symbol is the place of each longer suffix after the empty ones, so one round inserts one symbol a string.
    """
    ends = starts + lengths
    ahead = np.full(len(body) + 1, 256, np.uint16)  # symbol before each place; 256: none, a string starts there
    ahead[1:] = body
    at = ends.copy()
    last = np.zeros(len(body) + 1, bool)
    last[starts] = True
    # an end coincides with the next string's start: places of empty suffixes are kept apart
    empty = np.where(lengths > 0, ahead[ends], 256).astype(np.uint16)
    n, longer = len(starts), np.zeros(0, np.int64)
    before = empty
    for _ in range(int(lengths.max(initial=0))):
        order = np.argsort(before, kind="stable")
        order = order[: np.count_nonzero(before < 256)]
        places = np.concatenate([at, longer])[order] - 1
        longer = places
        front = ahead[places]
        front[last[places]] = 256
        before = np.concatenate([empty, front])
    return longer if n else np.zeros(0, np.int64)


def equal_neighbours(body: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Whether each place of ``order`` and the one before it start the same ``width`` bytes (all in range)."""
    eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(body, 8)).view(np.uint64).ravel()
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in [*range(0, width - 7, 8), width - 8]:
        x = eights[order + k]
        same[1:] &= x[1:] == x[:-1]
    return same


def shared_parts(body: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rel: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of the strings in which some window may equal another string's: (string, first window, windows).

    Windows that start in one cell of PART places before the anchor all hold the cell's common bytes, so a cell whose
    common bytes no other string of the group has holds no equal windows.
    """
    windows = lengths - width + 1
    sums = A.prefix_hash(body)
    # distance of a window to its anchor: rel - k; cells are aligned to it
    low, high = rel - windows + 1, rel
    cells = high // PART - low // PART + 1
    string = np.repeat(np.arange(len(starts)), cells)
    cell = A.concat_ranges(low // PART, cells)
    far, near = np.minimum(cell * PART + PART - 1, high[string]), np.maximum(cell * PART, low[string])
    anchor = starts[string] + rel[string]
    begin, end = anchor - cell * PART, anchor - cell * PART - (PART - 1) + width
    # where a string lacks some of a cell's windows, the bytes common to the whole cell still lie in it
    key = A.mix(A.span_hash(sums, begin, end) + A.mix(group[string].view(A.U64)) + cell.astype(A.U64))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    use = count[back] > 1
    string, far, near = string[use], far[use], near[use]
    order = np.lexsort((-far, string))
    string, far, near = string[order], far[order], near[order]
    joined = np.zeros(len(string), bool)
    joined[1:] = (string[1:] == string[:-1]) & (near[:-1] == far[1:] + 1)
    head = np.flatnonzero(~joined)
    tail = np.append(head[1:], len(string)) - 1
    if not len(string):
        head = tail = np.zeros(0, np.int64)
    return string[head], rel[string[head]] - far[head], far[head] - near[tail] + 1


def later_windows(block: pa.Table, width: int) -> pa.RecordBatch:
    """Of whole anchor groups: runs of windows that an earlier text, or an earlier place of the same text, holds."""
    body, offsets = A.text_bytes(block["body"])
    starts, lengths = offsets[:-1], np.diff(offsets)
    doc, lo, rel = (block[c].to_numpy().astype(np.int64) for c in ("doc_id", "lo", "rel"))
    string, skip, count = shared_parts(body, starts, lengths, rel, block["h"].to_numpy(), width)
    if not len(string):
        return pa.RecordBatch.from_pylist([], schema=R.FOUND)
    size = count + width - 1
    packed = body[A.concat_ranges(starts[string] + skip, size)]
    begins = np.cumsum(size) - size
    order = column_order(packed, begins, size)
    owner = np.repeat(np.arange(len(string)), size)
    place = order - begins[owner[order]]
    whole = place < count[owner[order]]  # the first bytes of shorter suffixes are no window
    order, place = order[whole], place[whole]
    who = owner[order]
    equal = equal_neighbours(packed, order, width)
    ids, at = doc[string[who]], lo[string[who]] + skip[who] + place
    klass = np.cumsum(~equal)
    ranked = np.lexsort((at, ids, klass))
    klass, ids, at = klass[ranked], ids[ranked], at[ranked]
    first = np.ones(len(klass), bool)
    first[1:] = klass[1:] != klass[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(klass)), 0))
    later = ~first & ((ids != ids[head]) | (at != at[head]))
    return R.as_runs(ids[later], at[later])


def remove(width: int):
    """For mapInArrow over (doc_id, text, runs): each text without the bytes of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in A.slices(batch, "text"):
                data, offsets = A.text_bytes(piece.column("text"))
                bounds, lows, counts = R.interval_arrays(piece.column("runs"))
                rows = []
                for i in range(piece.num_rows):
                    text = data[offsets[i] : offsets[i + 1]]
                    if bounds[i] == bounds[i + 1]:
                        kept, spans = text, 0
                    else:
                        gone = R.covered(len(text), width, lows[bounds[i] : bounds[i + 1]], counts[bounds[i] : bounds[i + 1]])
                        kept, spans = text[~gone], int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    kept = kept.tobytes()
                    rows.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), list(RESULT)[1:], strict=True))], schema=RESULT)

    return run


def dedupe_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = R.HOT) -> DataFrame:
    """Each text without the bytes of every ``width``-byte string that starts earlier in the corpus.

    Earlier: in a text of smaller doc_id, or earlier in the same text. Texts are UTF-8 bytes; strings do not cross
    texts. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary: a cut may split a character).
    Null and short texts come back whole (null as empty). Rows without doc_id have no place in the order: they come
    back whole and make nothing else a copy. Repeats of one row count once and get the same result; if different
    texts share a doc_id, each is cut by what was found for either. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    named = documents(docs)
    nameless = named.where("doc_id is null").withColumn("runs", F.array().cast("array<struct<lo:int,n:int>>"))
    named = named.where("doc_id is not null")
    anchors = named.mapInArrow(R.scan(R.byte_symbols, width, gram, True), R.ANCHORS).repartition("h")
    found = stored(R.judged(anchors, True), "contexts")
    wanted = found.where("seen = 0").groupBy("doc_id").agg(F.collect_list(F.struct("h", "lo", "n", "rel", "rivals")).alias("items"))
    pieces = stored(named.join(wanted, "doc_id").mapInArrow(R.cut(R.byte_symbols, R.take_bytes, width, hot), R.PIECE), "pieces")
    partial = pieces.where("body is not null").repartition("h").sortWithinPartitions("h").mapInArrow(R.blocks(later_windows, width), R.INTERVAL)
    runs = R.per_document(found.where("seen = 1").select("doc_id", "lo", "n").unionByName(partial)).unionByName(R.repeated_places(pieces))
    runs = runs.groupBy("doc_id").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return named.join(runs, "doc_id", "left").unionByName(nameless).mapInArrow(remove(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
