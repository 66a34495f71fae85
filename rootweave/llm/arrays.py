"""Vectorised helpers for tasks: bytes, words and rolling hashes of an Arrow batch of texts.

Everything here works on one slice of a batch (``slices`` bounds its bytes), never on a whole partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
#: One less than a power of two: ``Powers`` keeps a power for each place of a slice, in sizes of powers of two.
SLICE_BYTES = (1 << 20) - 1

#: \x20\x09-\x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Digits, letters and all non-ASCII bytes make up words.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the public splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as long as a slice needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                factors = np.full(size, base, U64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offset of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns freed memory to the system. Python workers serve one task after the other, of all stages of a session, and
    would keep the most that any of them has held. Without glibc only Arrow's own memory is returned."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have ``size`` bytes at most (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def lean_slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The same for stages that follow one another in a session: after a batch, freed memory is given back."""
    yield from slices(batch, text)
    give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes, and for each text the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Sums of symbol times power, from which ``span_hash`` takes any span's hash."""
    up, _ = POWERS(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, U64)
    np.cumsum((symbols.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same 64 bits for the same symbols, wherever they stand."""
    _, down = POWERS(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def gram_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of ``size`` symbols, by start."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, U64)
    _, down = POWERS(len(sums))
    return mix((sums[size:] - sums[:n]) * down[:n])


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the index of its smallest one, the leftmost among equals.

    Doubling: a block of 2n values is the better of two blocks of n; the last step overlaps.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, where, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        right = best[step:] < best[: len(best) - step]
        where = np.where(right, where[step:], where[: len(where) - step])
        best = np.minimum(best[step:], best[: len(best) - step])
        size += step
    return where[:n]


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the given ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with one key, of batches sorted by it. The caller bounds the runs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
