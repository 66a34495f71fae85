import numpy as np
import pytest

import corpus_pipeline
from rootweave.llm.neighbours import nearest_neighbours
from rootweave.llm.quality import classify_quality

from . import corpus

SF = "/root/testdata/sf0.001"


def vectors(n=400, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    x = (centres[rng.integers(8, size=n)] + 0.5 * rng.normal(size=(n, dims))).astype(np.float32)
    x[50:120] = x[50]  # a very common vector
    return x


def test_neighbours(spark):
    x = vectors()
    rows = [(i, v.tolist(), 1, "a") for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [float("inf")] + [1.0] * 15), (1080, [1.0] * 3), (None, [1.0] * 16), (1100, [None] + [1.0] * 15)]
    rows += [(i, v, 1, "a") for i, v in odd] + [rows[3]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int, ids string")
    got = {}
    for r in nearest_neighbours(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 400, 20))
    found = whole = 0
    d = x.astype(np.float64)
    for q, rs in got.items():
        rs.sort()
        assert [r[0] for r in rs] == list(range(1, 21))
        s = d @ d[q]
        others = np.array([i for i in range(len(d)) if i != q])
        best = others[np.lexsort((others, -np.round(s[others], 9)))[:20]]
        found, whole = found + len(set(best) & {r[1] for r in rs}), whole + 20
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in rs)
        assert [(-round(r[2], 12), r[1]) for r in rs] == sorted((-round(r[2], 12), r[1]) for r in rs)
    assert found / whole >= 0.9
    assert nearest_neighbours(frame.limit(0)).count() == 0
    few = nearest_neighbours(spark.createDataFrame(rows[:3], frame.schema)).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]


def test_neighbours_among_jittered_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x[5400:] = 2 * x[5400] + 1e-4 * rng.normal(size=(600, 64)).astype(np.float32)  # closer than codes can tell
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest_neighbours(frame, "vec_id >= 5400 and vec_id % 20 = 0", lists=4).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    d = x.astype(np.float64)
    found = 0
    for q in range(5400, 6000, 20):
        s = d @ d[q]
        s[q] = -np.inf
        found += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert found >= 0.95 * 20 * 30


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = classify_quality(docs, labels.where("doc_id % 4 <> 0"), rounds=1)
    assert scored.count() == docs.count()
    held = scored.join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in held) / len(held)
    assert right >= 0.95
    clean = [r for r in held if r.quality == 1 and r.toxic == 0]
    assert sum(r.kept for r in clean) / len(clean) >= 0.95


def test_quality_without_classes(spark):
    docs = corpus.frame(spark, corpus.rows(7, 20))
    none = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = classify_quality(docs, none).collect()
    assert len(got) == docs.count() and all(r.kept and r.score is None for r in got)
    assert classify_quality(corpus.empty(spark), none).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, SF).cache()
        seen.append((docs, new))
        docs = new
    return seen


def test_pipeline_stages(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(new.columns == columns for _, new in stages[:-1])
    ids = [{r.doc_id for r in new.select("doc_id").collect()} for _, new in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[-1]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = stages[2]
    leaks = {r.doc_id for r in before.collect() if any(i in r.text for i in items)}
    assert leaks and not leaks & {r.doc_id for r in after.collect()}
    copies = stages[1][1].collect()
    assert len({r.text for r in copies}) == len(copies)
    assert not any("@mail" in r.text for r in stages[3][1].collect())
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [d for d, r in labels.items() if r.quality == 1 and not r.toxic]
    assert sum(d in ids[0] for d in clean) >= 0.9 * len(clean)


def test_pipeline_runs_as_one(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == stages[-1][1].count()


def marked(spark, quality, toxic):
    """40 documents, half of them junk, some with an insult; labels for as many as are given."""
    rows = [(i, ("%%% !!! ### " * 20 if i % 2 else "a quiet day by the sea and the hills ") + ("idiot" if i % 5 == 0 else "")) for i in range(40)]
    rows += [(None, "a quiet day"), (41, None), (42, ""), (43, "word " * 20_000), rows[0], (2, "%%% another text of one id")]
    labels = [(i, q, t) for i, (q, t) in enumerate(zip(quality, toxic, strict=True))]
    docs = spark.createDataFrame([(*x, *corpus.CLASH) for x in rows], corpus.KIND)
    return docs, spark.createDataFrame([*labels, *labels[:1], (None, 1, 1), (77, 0, 1), (5, 9, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10])
def test_quality_on_few_labels(spark, n):
    docs, labels = marked(spark, [1 - i % 2 for i in range(n)], [0] * n)
    got = classify_quality(docs, labels, rounds=1).collect()
    assert len(got) == docs.count()
    assert all((r.score is None) == (n < 2) and r.toxic_score is None for r in got)
    if n < 2:
        assert all(r.kept for r in got)


def test_quality_with_one_class_only(spark):
    docs, labels = marked(spark, [1] * 30, [int(i % 5 == 0) for i in range(30)])
    got = classify_quality(docs, labels, rounds=1).collect()
    assert all(r.score is None and 0 <= r.toxic_score <= 1 for r in got)
    docs, labels = marked(spark, [1 - i % 2 for i in range(30)], [None] * 30)
    got = classify_quality(docs, labels).collect()
    assert all(r.toxic_score is None and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept == (i % 2 == 0) for i in range(30, 40))
