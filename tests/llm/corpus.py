"""Small corpora with every odd case, and what each operator should make of them, by brute force."""

import random
import re

SPACES = r"[^\x20\x09-\x0D]+"
KIND = "doc_id long, text string, h string, c int, lo int, n long, hash string, rep long, key string, words string, runs string, row long"
CLASH = ("x", 1, 2, 3, "y", 4, "z", "w", "r", 5)


def rows(seed=1, n=120, words=("ab", "cd", "é x", "the", "of", "\x00", "q.", "Ünd"), longest=200):
    """Texts that share passages, near copies, periodic texts, nulls, blanks, and one very long text."""
    r = random.Random(seed)
    base = [[r.choice(words) for _ in range(r.randint(0, longest))] for _ in range(8)]
    out = []
    for i in range(n):
        k = r.random()
        if k < 0.08:
            text = None
        elif k < 0.14:
            text = r.choice(["", " ", "\n\t", "a", "a b"])
        elif k < 0.5:
            w = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = "X"
            text = r.choice([" ", "\n", "\x0b "]).join(w)
        elif k < 0.65:
            text = " ".join(r.choice(base) + r.choice(base)) + " "
        elif k < 0.75:
            text = "ab cd " * r.randint(0, 150)
        else:
            text = " ".join([r.choice(words[:2]) for _ in range(r.randint(0, 100))] + r.choice(base)[20:150])
        out.append((i, text))
    out.append((n, " ".join(r.choice(words) for _ in range(20_000))))
    return out


def frame(spark, found):
    """The rows with clashing further columns, one row twice, and a row without id."""
    found = [*found, found[-2], (None, "the of ab cd " * 40)]
    return spark.createDataFrame([(*x, *CLASH) for x in found], KIND)


def empty(spark):
    return spark.createDataFrame([], KIND)


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return re.findall(SPACES, text or "")
