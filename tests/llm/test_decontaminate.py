import math
import random
import re
from collections import Counter

from rootweave.llm.decontaminate import RADIUS, find_contamination

from . import corpus


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", corpus.ascii_lower(text))


def bag(w, size):
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def by_hand(texts, bench, similarity=0.8, shingle=5):
    """(doc, item) -> (similarity, first word, words) over all windows of all texts, without fingerprints."""
    items = [(i, words(t or "")) for i, t in bench if t is not None]
    frequency, total = Counter(), len(items)
    for _, w in items:
        if w:
            frequency.update(set(bag(w, min(shingle, len(w)))))
    weight = lambda g: 1 + math.log((1 + total) / max(1, frequency[g]))
    out = {}
    for d, t in texts:
        w = words(t or "")
        held = {size: set(bag(w, size)) for size in range(1, shingle + 1)}
        for i, item in items:
            size = min(shingle, len(item))
            if item and not held[size] & set(bag(item, size)):
                continue  # no window is similar at all
            n = min(len(item), len(w))
            if not item or n < size:
                continue
            mine = bag(item, size)
            whole = sum(c * weight(g) for g, c in mine.items())
            best = (-1.0, 0)
            for a in range(len(w) - n + 1):
                window = bag(w[a : a + n], size)
                both = sum(min(c, mine[g]) * weight(g) for g, c in window.items())
                s = both / (sum(c * weight(g) for g, c in window.items()) + whole - both)
                best = max(best, (round(s, 12), -a))
            if best[0] >= similarity:
                out.setdefault((d, i), []).append((round(best[0], 9), -best[1], n))
    return {k: sorted(v) for k, v in out.items()}


def ours(found):
    out = {}
    for r in found.collect():
        assert r.distance <= RADIUS
        out.setdefault((r.doc_id, r.item_id), []).append((round(r.similarity, 9), r.first_word, r.n_words))
    return {k: sorted(v) for k, v in out.items()}


def tables(seed=3):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("aeiou") + r.choice("klmnp") + r.choice("aeiou")
    opening = [word() for _ in range(12)]  # many items begin with it
    items = [[word() for _ in range(r.choice([1, 3, 4, 5, 6, 9, 20, 20, 40, 40, 70]))] for _ in range(40)]
    items += [opening + [word() for _ in range(r.choice([8, 28]))] for _ in range(20)]
    items += [items[20], ["so", "so"] * 10, [*items[21][:-1], "tied"]]
    texts = []
    for d in range(260):
        body = []
        for _ in range(r.randint(0, 3)):
            body += [word() for _ in range(r.randint(0, 40))]
            piece = list(r.choice(items))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                piece[r.randrange(len(piece))] = word()
            if r.random() < 0.2:
                piece = piece[: max(1, int(len(piece) * 0.9))]
            body += piece
        if r.random() < 0.2:
            body += opening
        texts.append((d, r.choice([" ", ", ", "\n"]).join(body)))
    texts += [(1000, None), (1001, ""), (1002, " .,"), (None, " ".join(items[25])), (1003, "so " * 500)]
    texts += [(1004, " ".join(word() for _ in range(12_000)) + " " + " ".join(items[30]) + " ".join(word() for _ in range(12_000)))]
    texts += [texts[0], texts[0], (1005, " ".join(items[26])), (1005, " ".join(items[27]))]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(500, None), (501, ""), (502, " .,"), (None, " ".join(items[28]))]
    return texts, bench


def test_against_all_windows(spark):
    texts, bench = tables()
    expected = by_hand(texts, bench)
    docs = spark.createDataFrame([(*x, *corpus.CLASH) for x in texts], corpus.KIND)
    benchmark = spark.createDataFrame([(*x, "t", 1) for x in bench], "item_id long, text string, doc_id string, n int")
    got = ours(find_contamination(docs, benchmark))
    assert set(got) <= set(expected) and len(expected) > 100
    # a fingerprint may lie beyond the radius of an item whose shingles are few
    assert sum(got.get(k) == v for k, v in expected.items()) >= 0.99 * len(expected)
    assert ours(find_contamination(docs, benchmark, pass_bytes=800)) == got
    assert find_contamination(docs.limit(0), benchmark).count() == 0
    assert find_contamination(docs, benchmark.limit(0)).count() == 0


def test_an_opening_that_all_items_share(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    opening = [word() for _ in range(25)]
    items = [opening + [word() for _ in range(15 + i % 7)] for i in range(200)]
    texts = [(d, " ".join(opening + [word() for _ in range(60)])) for d in range(800)] + [(1000 + i, " ".join(x)) for i, x in enumerate(items)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = find_contamination(docs, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    found = {(x.doc_id, x.item_id) for x in got.collect()}
    assert {(1000 + i, i) for i in range(200)} <= found and not any(d < 1000 for d, _ in found)
