"""The licence scan against a plain aligner over all words of all texts."""

import math
import random
import re
from collections import Counter

from rootweave.llm.licenses import ALIGNED, PHRASES, RAREST, TEMPLATES, looked_up, scan_licenses, vocabulary

from . import corpus


def split(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", corpus.ascii_lower(text))


def by_hand(texts):
    known = set(vocabulary())
    words = [split(t or "") for t in texts]
    frequency = Counter(w for ws in words for w in set(ws) & known)
    idf = {w: math.log((1 + len(texts)) / n) for w, n in frequency.items()}
    out = []
    for ws in words:
        places, line = {}, f" {' '.join(ws)} "
        for i, w in enumerate(ws):
            if w in known:
                places.setdefault(w, []).append(i)
        starts = {p: [i for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()] for p in PHRASES}
        base = {PHRASES[p] for p, s in starts.items() if s}
        every, labels, score = [i for s in starts.values() for i in s], set(base), 0.0
        for template in TEMPLATES:
            label, key, _ = template
            if sum(map(len, places.values())) < 2 or f" {key} " not in line:
                continue
            mine = looked_up(template)
            weight = sum(sorted((idf.get(w, 0.0) for w, _ in mine), reverse=True)[: 2 * RAREST])
            rare = sorted({(-idf[w], w) for w, _ in mine if w in places})[:RAREST]
            times = Counter(w for w, _ in mine)
            possible = sum(-o * times[w] for o, w in rare)
            votes = Counter()
            for _, w in rare:
                for x, at in mine:
                    if x == w:
                        for i in places[w]:
                            votes[i - at] += idf[w]
            for vote in votes.values():
                share = min(1.0, vote / max(possible, weight * 0.5))
                score = max(score, share)
                if share >= ALIGNED - 1e-12:
                    labels.add(label)
        out.append((len(ws), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)))
    return out


def test_against_a_plain_aligner(spark):
    r = random.Random(12)
    words = vocabulary()
    prose = lambda n, share: [r.choice(words) if r.random() < share else f"w{r.randint(0, 400)}" for _ in range(n)]
    texts = []
    for _ in range(260):
        body = prose(r.randint(0, 60), r.choice([0.02, 0.2]))
        for _ in range(r.randint(0, 4)):
            piece = r.choice(TEMPLATES)[2].split()
            cut = r.random()
            piece = piece[: len(piece) // 2] if cut < 0.2 else piece[len(piece) // 3 :] if cut < 0.3 else piece
            piece = [w.upper() if r.random() < 0.1 else "other" if r.random() < 0.03 else w for w in piece]
            body += piece + prose(r.randint(0, 30), 0.05)
        texts.append(r.choice([" ", "\n", ", "]).join(body))
    texts += [None, "", " ,", texts[3], texts[3], "mit license mit license", "license"]
    texts += [" ".join(prose(15_000, 0.1) + TEMPLATES[-1][2].split() + prose(15_000, 0.1))]
    ids = [None if i % 50 == 7 else i // 2 for i in range(len(texts))]
    frame = spark.createDataFrame([(d, t, *corpus.CLASH) for d, t in zip(ids, texts, strict=True)], corpus.KIND)
    got = [(x.doc_id, *tuple(x)[1:-1], round(x.score, 9)) for x in scan_licenses(frame).collect()]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(got, key=key) == sorted(((d, *x) for d, x in zip(ids, by_hand(texts), strict=True)), key=key)
    assert sum("," in x[6] for x in got) > 30


def test_whole_licences(spark):
    r = random.Random(1)
    texts = [" ".join([*(f"w{r.randint(0, 400)}" for _ in range(200)), t, *(f"w{r.randint(0, 400)}" for _ in range(200))]) for _, _, t in TEMPLATES]
    texts += [" ".join(f"w{r.randint(0, 400)}" for _ in range(100)) for _ in range(600)]
    got = {x.doc_id: x for x in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score > 0.99
    assert not any(got[i].labels for i in range(len(TEMPLATES), len(texts)))
