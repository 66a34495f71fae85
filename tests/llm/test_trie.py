"""The trie of beginnings against a dictionary of all of them."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from rootweave.llm.prefix_trie import prefix_trie, rebuilt, turn_sequences

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KIND = "conv_id long, turn long, role string, text string, n long, ids string, chars int, key string, low long, depth long, turns string"


def sequences(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: tuple((r, t) for _, _, r, t in sorted(x, key=lambda y: (y[0], y[1], y[2].encode(), y[3].encode()))) for c, x in own.items()}


def with_heads(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, ())[:h] + turns[h:]
    return out


def by_hand(convs):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    out = Counter()
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p))))
        out[min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def logs(seed, n=400):
    """Common first turns, a third of all conversations alike, very long ones that differ late, odd texts and turns."""
    r = random.Random(seed)
    said = [("user", "hi"), ("user", "hé 😀"), ("assistant", ""), ("", "hi"), ("u", "serhi"), ("user", "a" * 3000)]
    rows = []
    for c in range(n):
        k = r.random()
        if k < 0.33:
            turns = said[:4]
        elif k < 0.4:
            turns = [said[i % 3] for i in range(r.randint(60, 75))] + [r.choice(said)]
        else:
            turns = [said[0]] * (r.random() < 0.7) + [r.choice(said) for _ in range(r.randint(1, 7))]
        turn = list(range(len(turns)))
        if k > 0.95:
            turn = [r.choice([None, 0, 1]) for _ in turns]
        rows += [(c, i, x or None, t or None) for i, (x, t) in zip(turn, turns, strict=True)]
    rows += [(None, 0, "user", "no conversation"), *rows[:3], (10_250, 0, "user", "head is absent")]
    r.shuffle(rows)
    return [(*x, 1, "x", 2, "y", 3, 4, "z") for x in rows]


@pytest.mark.parametrize(("seed", "cells"), [(1, 1 << 19), (2, 200), (3, 40)])
def test_against_a_dictionary(spark, seed, cells):
    rows = logs(seed)
    turns = turn_sequences(spark.createDataFrame(rows, KIND).repartition(5))
    assert Counter(map(tuple, prefix_trie(turns, cells).select(COLUMNS).collect())) == by_hand(sequences(rows))


def test_rebuilt(spark):
    rows = logs(4, 250)
    found = prefix_trie(rebuilt(turn_sequences(spark.createDataFrame(rows, KIND))), 100)
    assert found.columns == COLUMNS
    assert Counter(map(tuple, found.collect())) == by_hand(with_heads(sequences(rows)))


def test_turnless_conversations_and_none(spark):
    kind = "conv_id long, turns array<struct<id:string,chars:bigint>>"
    empty = hashlib.sha256(b"3,7,12").hexdigest()
    only = prefix_trie(spark.createDataFrame([(12, []), (3, []), (7, [])], kind)).collect()
    assert [tuple(x) for x in only] == [(3, 0, None, 3, 0, 1, 0, empty)]
    assert prefix_trie(spark.createDataFrame([], kind)).collect() == []
    assert prefix_trie(turn_sequences(spark.createDataFrame([], KIND))).collect() == []
