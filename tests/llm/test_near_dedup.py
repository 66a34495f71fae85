from collections import Counter

import corpus_pipeline
from rootweave.llm.components import components
from rootweave.llm.near_dedup import near_duplicates

from . import corpus


def by_hand(rows, size=3, threshold=85):
    sets = {}
    for d, t in rows:
        w = corpus.split(corpus.ascii_lower(t))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for d, s in sets.items():
        shared = Counter(e for x in s for e in holders.get(x, ()))
        for e, k in shared.items():
            if 100 * k >= threshold * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
        for x in s:
            holders.setdefault(x, []).append(d)
    return {(d, len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_components_of_near_copies(spark):
    rows = corpus.rows(3, 300, words=[f"w{i}" for i in range(40)], longest=120)
    got = near_duplicates(corpus.frame(spark, rows)).collect()
    assert len(got) == len(rows) + 2
    assert {tuple(r) for r in got if r.doc_id is not None} == by_hand(rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_a_large_group_of_near_copies_is_one(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 60], f"x{i}", *base[i % 60 + 1 :]])) for i in range(1500)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == by_hand(rows)


def test_empty(spark):
    assert near_duplicates(corpus.empty(spark)).count() == 0


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (501, 500), (700, 700)], "a long, b long")
    got = {(r.node, r.component) for r in components(links).collect()}
    assert got == {(i, 0) for i in range(301)} | {(500, 500), (501, 500)}


def test_the_stage_takes_five_words_and_80_per_cent(spark):
    base = [[f"b{k}w{i}" for i in range(300)] for k in range(3)]
    edited = [f"e{i}" if i % 38 == 17 else w for i, w in enumerate(base[2])]  # 0.851 with three words, 0.762 with five
    rows = list(enumerate(" ".join(w) for w in (base[0], base[0][:246], base[1], base[1][:200], base[2], edited)))
    kept = {d for d, _, _, k in by_hand(rows, 5, 80) if k}
    assert kept == {0, 2, 3, 4, 5}
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept)
    odd = corpus.rows(11, 200, words=[f"w{i}" for i in range(40)], longest=120)
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(odd, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == {d for d, _, _, k in by_hand(odd, 5, 80) if k}
