import hashlib

import numpy as np
import pytest

from rootweave.llm import repeats
from rootweave.llm.fingerprint_index import dedupe_windows
from rootweave.llm.suffix_dedup import column_order, dedupe_substrings

from . import corpus


def digest(data):
    return hashlib.sha256(data).hexdigest()


def windows_by_hand(rows, width):
    words = {d: corpus.split(t) for d, t in rows}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - width + 1):
            first[tuple(w[i : i + width])] = min(first.get(tuple(w[i : i + width]), d), d)
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield d, (len(w), sum(gone), digest(kept.encode()))


def bytes_by_hand(rows, width):
    first = {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if first.setdefault(b[i : i + width], (d, i)) != (d, i):
                gone[i : i + width] = [True] * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield d, (len(b), len(b) - len(kept), spans, digest(kept))


@pytest.mark.parametrize(("width", "gram", "batches", "hot"), [(50, 8, 3, 500), (20, 6, 1, 2), (50, 8, 5, 1)])
def test_windows(spark, width, gram, batches, hot):
    rows = corpus.rows()
    got = dedupe_windows(corpus.frame(spark, rows), width, gram, batches, hot).drop("kept").collect()
    assert len(got) == len(rows) + 2
    expected = dict(windows_by_hand(rows, width))
    assert {tuple(r) for r in got if r.doc_id is not None} == {(d, *x) for d, x in expected.items()}
    assert [r.n_removed for r in got if r.doc_id is None] == [0]


@pytest.mark.parametrize(("width", "gram", "hot"), [(100, 32, 500), (40, 16, 2), (100, 32, 1)])
def test_bytes(spark, width, gram, hot):
    rows = corpus.rows(2)
    got = dedupe_substrings(corpus.frame(spark, rows), width, gram, hot).drop("kept").collect()
    assert len(got) == len(rows) + 2
    expected = dict(bytes_by_hand(rows, width))
    assert {tuple(r) for r in got if r.doc_id is not None} == {(d, *x) for d, x in expected.items()}
    assert [r.n_removed for r in got if r.doc_id is None] == [0]


def test_empty_tables(spark):
    assert dedupe_windows(corpus.empty(spark)).count() == 0
    assert dedupe_substrings(corpus.empty(spark)).count() == 0


def test_column_order_sorts_all_suffixes():
    rng = np.random.default_rng(0)
    strings = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (7, 1, 20, 20, 3)]
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes) - sizes
    order = column_order(np.frombuffer(b"".join(strings), np.uint8), starts, sizes)
    suffixes = [(s[i:], k, starts[k] + i) for k, s in enumerate(strings) for i in range(len(s))]
    assert order.tolist() == [x[2] for x in sorted(suffixes)]


def test_contexts_cover_each_window_once_and_anchor_equal_windows_equally():
    rng = np.random.default_rng(0)
    for n in (0, 5, 19, 20, 21, 300):
        data, offsets = rng.integers(97, 99, n).astype(np.uint8), np.array([0, n // 3, n], np.int64)
        h, _, row, lo, count, rel = repeats.contexts(data, offsets, 20, 6)
        seen, anchor = set(), {}
        for i in range(len(h)):
            for k in range(count[i]):
                start = offsets[row[i]] + lo[i] + k
                seen.add((int(row[i]), int(lo[i] + k)))
                window = data[start : start + 20].tobytes()
                assert anchor.setdefault(window, (int(h[i]), int(rel[i] - k))) == (int(h[i]), int(rel[i] - k))
        assert seen == {(k, i) for k in range(2) for i in range(max(0, offsets[k + 1] - offsets[k] - 19))}
        assert int(count.sum()) == len(seen)


def common_passage(n=1500):
    """One passage in ever different surroundings: all contexts at its edges have one anchor."""
    passage = " ".join(f"p{i}" for i in range(70))
    return [(d, f"{' '.join(f'a{d}x{i}' for i in range(d % 9))} {passage} {' '.join(f'b{d}x{i}' for i in range(d % 7))}") for d in range(n)]


def test_a_passage_in_many_surroundings(spark):
    rows = common_passage()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (200, 10_000):
        got = dedupe_windows(frame, hot=hot).drop("kept").collect()
        assert {tuple(r) for r in got} == {(d, *x) for d, x in windows_by_hand(rows, 50)}
        got = dedupe_substrings(frame, hot=hot).drop("kept").collect()
        assert {tuple(r) for r in got} == {(d, *x) for d, x in bytes_by_hand(rows, 100)}


def test_an_index_that_outlives_the_call(spark, tmp_path):
    rows = corpus.rows(5) + [(1000 + d, t) for d, t in common_passage(40)] + [(2000 + d, t) for d, t in corpus.rows(5, 60)]
    folder, got = f"file://{tmp_path}/index", set()
    for part in (rows[:50], rows[50:140], rows[140:], []):
        frame = spark.createDataFrame(part, "doc_id long, text string")
        got |= {tuple(r) for r in dedupe_windows(frame, batches=2, folder=folder).drop("kept").collect()}
    assert got == {(d, *x) for d, x in windows_by_hand(rows, 50)}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("run_")]
