"""Repeated fixed-length windows across a corpus: the steps that the substring operators share.

A window is ``width`` consecutive symbols (bytes, or words) of one text. Its anchor is the leftmost of its
``gram``-symbol pieces with the smallest hash, so equal windows have equal anchors in equal places. All windows
of one text with one anchor form a context: a run of windows. Contexts need only be compared with contexts of an
equal anchor, and the anchor's hash deals them out: a couple of rows for every hundred bytes rather than one for each.
Where an anchor has very many different contexts, as at the edges of a passage that a large part of all texts have in
common, its windows are settled one by one, by 128 bits of hash: sums by window combine before they are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.llm import arrays as A

#: Anchors that a task sorts at once.
HELD = 1 << 20
#: Bytes of contexts that a task compares at once, whole anchor groups at least (HOT contexts at most).
BLOCK_BYTES = 1 << 20
#: Contexts of one anchor above which its windows are settled one by one.
HOT = 500
#: A context with its symbols, or, where ``body`` is null, one window with two hashes of it (h and c).
PIECE = "h long, c long, doc_id long, lo int, rel int, body binary"
PIECES = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("rel", pa.int32()), ("body", pa.binary())])
INTERVAL = "doc_id long, lo int, n int"
FOUND = pa.schema([("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())])
ANCHORS = "h long, c long, doc_id long, lo int, n int, rel int, seen int"
#: ``seen``: 0: it isn't known whether the context is a copy; 1: it is; 2: it is what the same text's context at ``c`` is.
KIND = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("rel", pa.int32()), ("seen", pa.int32())])


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = A.word_spans(data, offsets, ~A.SPACE[data])
    return A.span_hash(A.prefix_hash(data), starts, ends), first


def contexts(symbols: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Per context: anchor hash, content hash, row, first window, number of windows, place of the anchor in it."""
    sums = A.prefix_hash(symbols)
    hashes = A.gram_hash(sums, gram) if len(symbols) > gram else np.zeros(0, A.U64)
    if len(symbols) == width:  # gram_hash leaves out the last place, which no further symbol follows
        hashes = A.span_hash(sums, np.arange(width - gram + 1), np.arange(width - gram + 1) + gram)
    elif len(symbols) > width:
        hashes = np.append(hashes, A.mix((sums[-1:] - sums[-1 - gram : -gram]) * A.POWERS(len(sums))[1][len(sums) - 1 - gram : len(sums) - gram]))
    best = A.leftmost_minimum(hashes, width - gram + 1)
    at = np.arange(len(best))
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + width <= offsets[row + 1]
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
    lo = np.flatnonzero(new & inside)
    run_end = np.append(np.flatnonzero(new), len(best))
    hi = np.minimum(run_end[np.searchsorted(run_end, lo, side="right")], offsets[row[lo] + 1] - width + 1)
    rows = row[lo]
    return hashes[best[lo]], A.span_hash(sums, lo, hi + width - 1), rows, lo - offsets[rows], hi - lo, best[lo] - lo


def scan(symbols: Callable, width: int, gram: int, same_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc_id, text): the contexts of each task, equal ones combined.

    Of equal contexts the first goes on; later ones are known copies at once. With ``same_text`` a repeat within one
    text counts as a copy; without it, it is noted as equal to the text's first such context.
    """

    def combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, c, doc, lo, n, rel = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((lo, doc, c, h))
        h, c, doc, lo, n, rel = (x[order] for x in (h, c, doc, lo, n, rel))
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        again = same & (doc == doc[head])
        if same_text:
            twice = np.zeros(len(h), bool)  # a repeated row of the table
            twice[1:] = same[1:] & (doc[1:] == doc[:-1]) & (lo[1:] == lo[:-1])
            seen, keep = same & ((doc != doc[head]) | (lo != lo[head])), ~twice
        else:
            twice = again & (lo == lo[head])
            seen, keep = np.where(again, 2, same), ~twice
            c = np.where(again, lo[head].astype(A.U64), c)
        # known copies need no partner any more: spread them evenly
        h = np.where(seen > 0, A.mix(doc.astype(A.U64) * A.U64(31) + lo.astype(A.U64)), h)
        arrays = [h.view(np.int64), c.view(np.int64), doc, lo.astype(np.int32), n.astype(np.int32), rel.astype(np.int32), seen.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in arrays], schema=KIND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in A.slices(batch, "text"):
                ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                h, c, rows, lo, n, rel = contexts(*symbols(*A.text_bytes(piece.column(1))), width, gram)
                if len(h):
                    held.append((h, c, ids[rows], lo, n, rel))
                    size += len(h)
                if size >= HELD:
                    yield combined(held)
                    held, size = [], 0
        if held:
            yield combined(held)

    return run


def judged(anchors: DataFrame, same_text: bool) -> DataFrame:
    """Contexts with ``seen`` settled as far as equal contexts go, and ``rivals``, how many different contexts share the anchor.

    Rows that are no copies and have no rival are dropped: no other text holds any of their windows.
    """
    by_anchor, by_context = Window.partitionBy("h"), Window.partitionBy("h", "c")
    first = F.min(F.struct("doc_id", "lo") if same_text else F.struct("doc_id")).over(by_context)
    later = (F.struct("doc_id", "lo") if same_text else F.struct("doc_id")) > F.col("first")
    return (
        anchors.withColumn("first", first)
        .withColumn("rivals", F.when(F.min("c").over(by_anchor) != F.max("c").over(by_anchor), F.count("c").over(by_anchor)).otherwise(0))
        .withColumn("seen", F.when((F.col("seen") == 1) | later, 1).otherwise(0))
        .where((F.col("seen") == 1) | (F.col("rivals") > 0))
        .select("h", "doc_id", "lo", "n", "rel", "seen", "rivals")
    )


def per_document(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))


def covered(length: int, width: int, lows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which of ``length`` symbols lie in one of the windows that start in the given runs."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, np.minimum(lows, length), 1)
    np.add.at(change, np.minimum(lows + counts - 1 + width, length), -1)
    return np.cumsum(change[:-1]) > 0


def interval_arrays(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets by row, and lo and n of all runs of a list<struct<lo, n>> column (null: none)."""
    if isinstance(runs, pa.ChunkedArray):
        runs = runs.combine_chunks()
    lengths = np.array([0 if x is None else x for x in runs.value_lengths().to_pylist()], np.int64)
    flat = runs.flatten()
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return offsets, flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)


def as_runs(ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Window starts as runs of consecutive ones."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(ids)) - 1 if len(ids) else head
    return pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(at[head].astype(np.int32)), pa.array((at[tail] - at[head] + 1).astype(np.int32))], schema=FOUND)


def as_binary(joined: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(joined))]).cast(pa.binary())


def take_bytes(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    return as_binary(data[A.concat_ranges(begin, size)], size)


def take_words(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Words joined by one space."""
    starts, ends, _ = A.word_spans(data, offsets, ~A.SPACE[data])
    words = A.concat_ranges(begin, size)
    lengths = ends[words] - starts[words] + 1
    joined = np.append(data, np.uint8(0x20))[np.minimum(A.concat_ranges(starts[words], lengths), len(data))]
    stops = np.cumsum(lengths)
    joined[stops - 1] = 0x20
    last = np.cumsum(size) - 1
    totals = np.diff(np.concatenate([[0], stops[last]])) if len(size) else size
    return as_binary(joined, totals)


def cut(symbols: Callable, take: Callable, width: int, hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc_id, text, items): the symbols of each listed context, or its windows if the anchor has over ``hot`` contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in A.slices(batch, "text"):
                data, bounds = A.text_bytes(piece.column("text"))
                symbol, offsets = symbols(data, bounds)
                items = piece.column("items")
                counts = items.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = items.flatten()
                h, lo, n, rel, rivals = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
                row = np.repeat(np.arange(len(counts)), counts)
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                # the text may be another than the one the context is of, where texts share a doc_id
                fits = lo + n + width - 1 <= np.diff(offsets)[row]
                some = fits & (rivals <= hot)
                k, at, size, place, where = h[some], lo[some], n[some] + width - 1, rel[some], row[some]
                bodies = take(data, bounds, offsets[where] + at, size)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(len(k), pa.int64()), pa.array(ids[where]), pa.array(at.astype(np.int32)), pa.array(place.astype(np.int32)), bodies], schema=PIECES)
                many = fits & (rivals > hot)
                if many.any():
                    at, where = A.concat_ranges(lo[many], n[many]), np.repeat(row[many], n[many])
                    begin = offsets[where] + at
                    first = A.span_hash(A.prefix_hash(symbol), begin, begin + width)
                    other = A.span_hash(A.prefix_hash(A.mix(symbol)), begin, begin + width)
                    for k in range(0, len(at), HELD):
                        part = slice(k, k + HELD)
                        none = pa.nulls(len(at[part]), pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(first[part].view(np.int64)), pa.array(other[part].view(np.int64)), pa.array(ids[where[part]]), pa.array(at[part].astype(np.int32)), none, pa.nulls(len(none), pa.binary())], schema=PIECES)

    return run


def repeated_windows(pieces: DataFrame, same_text: bool) -> DataFrame:
    """Of pieces (stored) that are single windows: those that an earlier text, or place of the same text, holds.

    These are all but the first of each window. The anti-join is dealt by window and place, which no two texts share.
    """
    windows = pieces.where("body is null").select("h", "c", "doc_id", "lo")
    place = ["doc_id", "lo"] if same_text else ["doc_id"]
    firsts = windows.groupBy("h", "c").agg(F.min(F.struct(*place)).alias("first")).select("h", "c", "first.*")
    return windows.join(firsts, ["h", "c", *place], "left_anti").select("doc_id", "lo", F.lit(1).alias("n"))


def repeated_places(pieces: DataFrame) -> DataFrame:
    """doc_id and runs: as ``repeated_windows`` with ``same_text``, gathered by text.

    The first place of each window belongs to one text. A text's windows and the places that it owns meet as two lists, one
    row for each text, however many texts share its windows.
    """
    windows = pieces.where("body is null")
    owned = windows.groupBy("h", "c").agg(F.min(F.struct("doc_id", "lo")).alias("first")).groupBy("first.doc_id").agg(F.collect_list("first.lo").alias("own"))
    every = windows.groupBy("doc_id").agg(F.collect_set("lo").alias("all"))
    later = F.array_except("all", F.coalesce("own", F.array().cast("array<int>")))
    return every.join(owned, "doc_id", "left").select("doc_id", F.transform(later, lambda x: F.struct(x.alias("lo"), F.lit(1).alias("n"))).alias("runs"))


def blocks(compare: Callable[[pa.Table, int], pa.RecordBatch], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over pieces with symbols sorted by h: blocks of whole groups through ``compare``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("body").nbytes
            if size < BLOCK_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            h = table["h"].to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if whole:
                yield compare(table.slice(0, whole), width)
                held = table.slice(whole).combine_chunks().to_batches()
                size = sum(x.column("body").nbytes for x in held)
        if held:
            yield compare(pa.Table.from_batches(held).combine_chunks(), width)

    return run
