"""Every stage with the rows that tables shouldn't have."""

import random

import pytest

import corpus_pipeline

from . import corpus

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h string, words string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def documents(spark):
    r = random.Random(2)
    prose = lambda n: " ".join(f"w{r.randint(0, 300)}" for _ in range(n))
    leak = "so: one two three four five six seven eight nine ten " + prose(30)
    rows = [(i, prose(60)) for i in range(1, 30)] + [(None, leak), (None, prose(50)), (7, leak), (7, prose(40)), (40, None), (41, ""), (None, None)]
    rows += [(50, prose(60)), (51, prose(20_000)), (52, leak)]
    rows += [(53, rows[-3][1]), (None, rows[-3][1]), rows[0]]
    return leak, spark.createDataFrame([(i, t, None, "s", None, "h", "w") for i, t in rows], COLUMNS), rows


def test_leaks_go_whatever_their_id(spark, folder):
    leak, docs, rows = documents(spark)
    got = STAGES["benchmark decontamination"](spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((i or 0, t or "") for i, t in rows if t != leak)


def test_copies_go_whatever_their_id(spark, folder):
    leak, docs, rows = documents(spark)
    got = [(r.doc_id, r.text) for r in STAGES["MinHash near-dedup"](spark, docs, folder).collect()]
    texts = [t for _, t in got if t]
    assert len(texts) == len(set(texts)) and set(texts) == {t for _, t in rows if t}
    assert (52, leak) in got and (50, rows[-6][1]) in got
    assert sum(t is None for _, t in got) == 2 and (41, "") in got


def test_quality_and_the_rest(spark, folder):
    _, docs, rows = documents(spark)
    kept = STAGES["quality classifier"](spark, docs, folder)
    assert kept.columns == docs.columns and 0 < kept.count() <= len(rows)
    clean = STAGES["PII"](spark, docs, folder)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert STAGES["SentencePiece encoding and decoding"](spark, docs, folder).count() == len(rows)


def test_empty_tables(spark, folder):
    _, docs, _ = documents(spark)
    for stage in STAGES.values():
        assert stage(spark, docs.limit(0), folder).count() == 0
