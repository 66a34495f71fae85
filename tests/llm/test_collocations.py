"""Collocations against counts of all phrases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rootweave.llm.collocations import COVERED, LEAST, best, collocations, score

from . import corpus

KIND = "doc_id long, lang string, text string, n long, a int, w string, w1 string, word string, score string, rank long, total long"
CLASH = (1, 2, "x", "y", "z", "s", 3, 4)


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", corpus.ascii_lower(text))]


def by_hand(rows, top):
    counts, total, out = Counter(), Counter(), []
    for _, lang, text in rows:
        for words in pieces(text):
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i : i + k])] += 1
    wanted = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= LEAST}
    for lang in total:
        found = []
        for (one, phrase), a in wanted.items():
            if one != lang:
                continue
            cuts = [(10**6 * a * a // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
            s, k = min(cuts)
            longer = [b for (o, p), b in wanted.items() if o == lang and len(p) > len(phrase) and phrase in (p[:2], p[1:])]
            if not any(100 * b >= COVERED * a for b in longer):
                found.append((lang, " ".join(phrase), a, counts[lang, phrase[:k]], counts[lang, phrase[k:]], total[lang], s))
        found.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i + 1, *x[1:]) for i, x in enumerate(found[:top])]
    return sorted(out)


def rows(seed, n=150):
    r = random.Random(seed)
    words = ["The", "of", "é", "New", "YORK", "ß", "city", "x", "😀", *[f"w{i}" for i in range(25)]]
    weights = [30, 25, 9, 8, 8, 5, 5, 4, 3, *[1 + i % 4 for i in range(25)]]
    out = [(0, "en", None), (1, None, ""), (2, "xx", " .,\t"), (3, "fr", "a"), (4, "und", "x y " * 12)]
    for i in range(5, n):
        parts = []
        for _ in range(r.randint(0, 120)):
            parts += r.choices(words, weights) if r.random() < 0.8 else r.choice([["New", "york", "city"], ["x", "x", "x", "x"], ["w1", "w2"], ["é", "of", "The"]])
        text = "".join(p + r.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b", ":"]) for p in parts)
        out.append((i, r.choice(["en", "en", "en", "de", None]), text))
    out.append((n, "en", " ".join(r.choices(words, weights, k=30_000))))
    return [*out, out[7]]


@pytest.mark.parametrize(("seed", "top", "batch"), [(1, 2000, 8000), (2, 15, 4), (3, 40, 60)])
def test_against_counts_of_all_phrases(spark, seed, top, batch):
    texts = rows(seed)
    docs = spark.createDataFrame([(*x, *CLASH) for x in texts], KIND).repartition(3)
    found = collocations(docs, top, batch)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == by_hand(texts, top)


def test_ties_at_the_last_place(spark):
    texts = [(i, "en", ". ".join(f"p{k} q{k}" for k in range(60))) for i in range(12)]
    docs = spark.createDataFrame([(*x, *CLASH) for x in texts], KIND)
    assert sorted(map(tuple, collocations(docs, 7, 5).collect())) == by_hand(texts, 7)


def test_empty_tables_and_no_phrases(spark):
    assert collocations(spark.createDataFrame([], KIND)).collect() == []
    assert collocations(spark.createDataFrame([(1, "en", "a b c", *CLASH)], KIND)).collect() == []


def test_scores_of_large_counts_are_exact(spark):
    cases = [(10**12 - 1, 10**12, 10**12), (10**14 + 7, 10**14 + 9, 10**14 + 8), (999_999_999_999_989, 999_999_999_999_999, 999_999_999_999_997), (10, 10, 10)]
    found = spark.createDataFrame(cases, "a long, l long, r long").select(score("a", "l", "r").alias("s")).collect()
    assert [x.s for x in found] == [10**6 * a * a // (x * y) for a, x, y in cases]


def test_best_keeps_the_order(spark):
    some = [("en" if i % 3 else "de", i * 37 % 101) for i in range(500)]
    found = best(spark.createDataFrame(some, "lang string, s long"), 9, F.desc("s")).collect()
    for lang in ("en", "de"):
        assert [x.s for x in sorted(found, key=lambda x: x["rank"]) if x.lang == lang] == sorted((s for o, s in some if o == lang), reverse=True)[:9]
