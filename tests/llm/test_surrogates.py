"""Surrogates held against the entities that were planted: distinct, alike wherever repeated, and of the same format."""

import random
import re

from pyspark.sql import functions as F

from rootweave.llm.surrogates import ALPHABETS, entity_pattern, replace_entities

from . import corpus


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def planted(r):
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    octet = lambda: str(r.choice([r.randint(0, 9), r.randint(10, 99), r.randint(100, 255)]))
    front = digits(15)
    valid = front + next(d for d in "0123456789" if luhn(front + d))
    return {
        "phone": [f"555-{digits(3)}-{digits(4)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"],
        "card": [valid, digits(16)],
        "ssn": [f"{digits(3)}-{digits(2)}-{digits(4)}"],
        "email": [f"{word(3)}.{word(4)}@{word(5)}.example.com"],
        "ip": [".".join([str(r.randint(1, 9)), octet(), octet(), octet()])],
        "iban": [f"DE{digits(20)}"],
        "secret": [f"token: {word(6)}{digits(9)}"],
    }


def test_distinct_alike_and_of_the_same_format(spark):
    r = random.Random(21)
    found = {}
    for _ in range(150):
        for kind, values in planted(r).items():
            found.setdefault(kind, []).extend(values)
    every = [(kind, v) for kind, values in found.items() for v in dict.fromkeys(values)]
    rows = [(i, f"x {v} | y {v} z", *corpus.CLASH) for i, (_, v) in enumerate(every)] + [(10_000 + i, f"again {v}", *corpus.CLASH) for i, (_, v) in enumerate(every)]
    rows += [(None, f"again {every[0][1]}", *corpus.CLASH), (20_000, " , ".join(v for _, v in every) * 20, *corpus.CLASH)]
    got = {x.doc_id: x for x in replace_entities(spark.createDataFrame(rows, corpus.KIND)).collect()}
    new = {}
    for i, (kind, v) in enumerate(every):
        a, b = re.fullmatch(r"x (.*) \| y (.*) z", got[i].text).groups()
        assert a == b == got[10_000 + i].text.removeprefix("again ") and a != v
        assert re.sub("[a-z]", "a", re.sub("[0-9]", "0", a.split(": ")[-1].lower())) == re.sub("[a-z]", "a", re.sub("[0-9]", "0", v.split(": ")[-1].lower()))
        if kind == "card":
            assert luhn(a) == luhn(v)
        if kind == "ip":
            assert all(0 <= int(o) <= 255 and str(int(o)) == o for o in a.split("."))
        new.setdefault(kind, []).append(a)
    for kind, values in new.items():
        assert len(set(values)) == len(values), kind
        assert not set(values) & {v for k, v in every if k == kind}
    assert got[None].text == got[10_000].text
    assert got[20_000].n_entities == 20 * len(every) - 19 * (every[0][0] != every[-1][0]) or got[20_000].n_entities > 19 * len(every)


def test_an_exhausted_format_keeps_entities_apart(spark):
    ips = [f"{a}.{b}.{c}.{d}" for a in range(10) for b in range(10) for c in range(10) for d in range(9)]  # 9,000 of 10,000
    got = replace_entities(spark.createDataFrame([(i, f"at {x}") for i, x in enumerate(ips)], "doc_id long, text string"))
    new = [r.text for r in got.collect()]
    assert len(set(new)) == len(ips) and all(re.fullmatch(r"at [0-9]\.[0-9]\.[0-9]\.[0-9]", t) for t in new)


def test_names_beyond_lists_and_by_parts(spark):
    texts = [
        "Dr. Ngozi Okafor came. Then Ngozi Okafor left, and Okafor wrote.",
        "my name is Priya Raman and I stay",
        "Priya Raman said no.",
        "Anna Schmidt and Ms. Schmidt and ANNA SCHMIDT and Klaus Schmidt",
        "Господин Иванов, Мария Иванова и Госпожа Иванова",
        "Prof Lu and Sam Taylor; Dear Quentin Zed",
        "No Names Here, but The End Of It.",
        "Mr Schmidt",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    got = {}
    for x in replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert got.setdefault(x.doc_id, x.text) == x.text
    a = re.fullmatch(r"Dr\. (\S+) (\S+) came\. Then (\S+) (\S+) left, and (\S+) wrote\.", got[0]).groups()
    assert a[0] == a[2] and a[1] == a[3] == a[4] and "Okafor" not in got[0] and "Ngozi" not in got[0]
    b = re.fullmatch(r"my name is (\S+ \S+) and I stay", got[1])[1]
    assert got[2] == f"{b} said no." and "Raman" not in b
    c = re.fullmatch(r"(\S+) (\S+) and Ms\. (\S+) and (\S+) (\S+) and (\S+) (\S+)", got[3]).groups()
    assert c[1] == c[2] == c[6] and c[3] == c[0].upper() and c[4] == c[1].upper() and c[0] != c[5]
    assert got[7] == f"Mr {c[1]}"
    d = re.fullmatch(r"Господин (\S+), (\S+) (\S+) и Госпожа (\S+)", got[4]).groups()
    assert d[2] == d[3] != d[0] and d[0].endswith("ов") and d[2].endswith("ова")
    assert "Quentin Zed" not in got[5] and "Sam Taylor" not in got[5] and got[6] == texts[6]


def test_very_long_texts_and_prose(spark):
    r = random.Random(3)
    prose = " ".join(r.choice(["lorem", "ipsum", "Dolor", "sit,", "amet.", "12", "3.14"]) for _ in range(200_000))
    rows = [(0, prose), (1, prose + " jo@mail.example.com " + prose), (2, "@" * 5000 + "a" * 100_000 + "@"), (3, "1" * 50_000 + " Aa" * 20_000)]
    got = {x.doc_id: x for x in replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == prose and got[0].n_entities == 0
    assert got[1].n_entities == 1 and got[1].text.startswith(prose) and "jo@mail" not in got[1].text
    assert got[2].text == rows[2][1] and got[3].text == rows[3][1]
    assert spark.range(1).select(F.lit("Ann met him").rlike(entity_pattern())).first()[0] is False


def test_names_of_many_parts_other_alphabets_and_addresses(spark):
    texts = [
        "Mary Jane Watson left. Mrs Watson wrote; Mary-Jane Watson too.",
        "Dr Ludwig van der Berg and Mr Berg",
        "my name is Juan de la Cruz Ortega and",
        "Sam O'Brien, then O'Brien again",
        "New York said no, Red Cross wrote and United Nations replied",
        "mail josé.müller@web.example.com or иван@пример.example.com",
        "call 555 123 4567 or 2001:db8:0:0:8:800:200c:417a or fe80::1:2ab at 12:30:45, 1 234 567 8901",
    ]
    got = {x.doc_id: x.text for x in replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    a = re.fullmatch(r"(\S+) (\S+) (\S+) left\. Mrs (\S+) wrote; (\S+) (\S+) too\.", got[0]).groups()
    assert a[2] == a[3] == a[5] and "Watson" not in got[0] and "Jane" not in got[0] and "Mary" not in got[0]
    b = re.fullmatch(r"Dr (\S+) van der (\S+) and Mr (\S+)", got[1]).groups()
    assert b[1] == b[2] != "Berg" and b[0] != "Ludwig"
    c = re.fullmatch(r"my name is (\S+) de la (\S+) (\S+) and", got[2]).groups()
    assert not {"Juan", "Cruz", "Ortega"} & set(c)
    assert "Brien" not in got[3] and got[4] == texts[4]
    d = re.fullmatch(r"mail (\S+)@\S+ or \S+", got[5])[1]
    assert re.sub("[a-z]", "a", re.sub("[à-ÿ]", "é", d)) == "aaaé.aéaaaa" and d != "josé.müller"
    e = re.fullmatch(r"call (\d{3} \d{3} \d{4}) or ([0-9a-f:]+) or ([0-9a-f:]+) at 12:30:45, 1 234 567 8901", got[6]).groups()
    assert e[0] != "555 123 4567" and [len(x) for x in e[1].split(":")] == [4, 3, 1, 1, 1, 3, 4, 4] and "::" in e[2] and e[1:] != ("2001:db8:0:0:8:800:200c:417a", "fe80::1:2ab")


def test_the_key_is_a_setting(spark):
    docs = spark.createDataFrame([(1, "at 10.20.30.40")], "doc_id long, text string")
    usual = replace_entities(docs).first().text
    spark.conf.set("spark.rootweave.surrogates.key", "another")
    try:
        assert replace_entities(docs).first().text not in (usual, "at 10.20.30.40")
    finally:
        spark.conf.unset("spark.rootweave.surrogates.key")
    assert replace_entities(docs).first().text == usual


def test_shifts_within_alphabets_are_one_to_one(spark):
    """Every letter of an alphabet, each as an address of its own: as many different surrogates."""
    letters = [c for a in ALPHABETS for c in a]
    docs = spark.createDataFrame([(i, f"to {c}x@mail.example.com") for i, c in enumerate(letters)], "doc_id long, text string")
    got = [x.text for x in replace_entities(docs).collect()]
    assert len(set(got)) == len(letters)
