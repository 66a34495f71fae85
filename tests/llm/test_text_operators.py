import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece

from rootweave.llm import chat
from rootweave.llm.decontaminate import find_contamination
from rootweave.llm.licenses import TEMPLATES, scan_licenses, vocabulary
from rootweave.llm.prefix_encode import PrefixEncoder, encode_texts
from rootweave.llm.surrogates import drawn, entity_pattern, replace_entities

from . import corpus

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_encoding_equals_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        ours = PrefixEncoder(f.read())
    r = random.Random(0)
    parts = ["a", "b", "e", "t", "h", "n", " ", "  ", "\n", "▁", "é", "日", "𝒳", "\x00", ".", "<s>", "<0x0A>", "%%%", " " * 17, "\t", "ing", "tion", "The"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(r.choice(list(ours.ids)) for _ in range(r.randint(1, 6))) for _ in range(3000)]
    texts += [t for n in range(70) for t in (" " * n, " " * n + "x", "x" + " " * n, " " * n + "\n")] + ["x" * 3000]
    for text in texts:
        ids = library.encode(text, add_bos=True, add_eos=True)
        packed, plain = ours.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert plain == library.decode(ids), text


def test_encoding_of_tables(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = corpus.rows(4, 60)
    got = encode_texts(corpus.frame(spark, rows), MODEL).collect()
    assert len(got) == len(rows) + 2
    texts = dict(rows)
    for r in got:
        if r.doc_id is not None:
            ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
            assert (r.ids, r.n_tokens) == (ids, len(ids))
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert encode_texts(corpus.empty(spark), MODEL).count() == 0


def test_contamination(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (3, 5, 12, 40, 60)]
    prose = lambda n: [word() for _ in range(n)]
    bent = list(items[3])
    bent[0] = "other"  # one shingle of 36
    broken = [w if i % 4 else "other" for i, w in enumerate(items[4])]
    texts = [
        (0, " ".join(prose(100))),
        (1, " ".join(prose(50) + items[3] + prose(30))),
        (2, "\n".join(x.upper() for x in bent + prose(5))),
        (3, ", ".join(prose(20) + items[0] + prose(2) + items[2])),
        (4, " ".join(broken + prose(9))),
        (5, " ".join(items[4][:30])),
        (6, None),
        (7, ""),
        (8, " ".join(items[4][2:58])),  # 52 of 56 shingles, in a text shorter than the item
    ]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(8, None), (9, " .,")]
    docs, benchmark = corpus.frame(spark, texts), spark.createDataFrame([(*x, "t", 1) for x in bench], "item_id long, text string, doc_id string, n int")
    got = {(r.doc_id, r.item_id, r.first_word) for r in find_contamination(docs, benchmark).collect()}
    assert got == {(1, 3, 50), (2, 3, 0), (3, 0, 20), (3, 2, 25), (8, 4, 0)}
    assert find_contamination(corpus.empty(spark), benchmark).count() == 0
    assert find_contamination(docs, benchmark.limit(0)).count() == 0


PII = "Write to Anna Schmidt or anna.s@mail.example.com, ANNA.S@MAIL.EXAMPLE.COM, +1 (017) 555-7713, 97.51.17.173, 4845168114407329 or 4845 1681 1440 7329; token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\". Mr Müller, Мария Иванова."


def test_surrogates(spark):
    rows = [(0, PII), (1, "Nothing here: 3.14, 2024, version 10.2."), (2, None), (3, ""), (4, PII + " ﷐﷑ 97.51.17.174"), (5, PII), (None, "see 97.51.17.173"), (0, PII)]
    got = replace_entities(spark.createDataFrame([(*x, *corpus.CLASH) for x in rows], corpus.KIND)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for text in re.findall(r"[\w.]+@[\w.]+|97[\d.]+|4845[\d ]+\d|04db\w+|555-7713|Schmidt|Müller|Иванова", PII):
        assert text not in by[0].text
    assert (by[1].text, by[2].text, by[3].text, by[1].n_entities) == (rows[1][1], None, "", 0)
    assert by[0].text == by[5].text and by[4].text.startswith(by[0].text + " ﷐﷑ ")
    ip = re.findall(r"\d+\.\d+\.\d+\.\d+", by[4].text)
    assert ip[0] != ip[1] and by[None].text == f"see {ip[0]}"
    plain, upper = re.findall(r"[\w.]+@[\w.]+", by[0].text, re.I)[:2]
    assert upper == plain.upper() and plain.endswith(".com") and [len(x) for x in plain.split(".")] == [len(x) for x in "anna.s@mail.example.com".split(".")]
    a, b = re.search(r"(\d{16}) or (\d{4} \d{4} \d{4} \d{4})", by[0].text).groups()
    assert a == b.replace(" ", "")
    assert re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", by[0].text) and re.search(r"Mr [A-ZÄÖÜ]", by[0].text) and re.search(r"[А-Я][а-яё]+ [А-Я][а-яё-]+\.$", by[0].text)
    assert replace_entities(corpus.empty(spark)).count() == 0


def test_secrets_of_any_length(spark):
    r = random.Random(9)
    drawn_value = lambda n: "".join(r.choice("abcXYZ0123456789_-") for _ in range(n - 1)) + "k"
    jwt = ".".join(map(drawn_value, (36, 160, 43)))
    values = [*map(drawn_value, (12, 128, 129, 300, 1000, 100_000)), jwt, drawn_value(40) + "==", "sk.live." + drawn_value(6), "ab." * 30_000 + "c"]
    rows = [(i, f'token = "{v}" and secret: {v}. Next') for i, v in enumerate(values)]
    rows += [(100, "password: anna.schmidt@mail.example.com"), (101, "see anna.schmidt@mail.example.com"), (102, "token: 197.151.117.173"), (103, "see 197.151.117.173"), (104, "token: short.")]
    got = {x.doc_id: x for x in replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, v in enumerate(values):
        found = re.fullmatch(r'token = "(.*)" and secret: (.*)\. Next', got[i].text)
        new = found[1]
        assert new == found[2] and len(new) == len(v) and got[i].n_entities == 2
        assert [c for c in new if c in ".=_-"] == [c for c in v if c in ".=_-"]
        assert all(part not in new for part in re.findall("[A-Za-z0-9]{8,}", v))
        assert new != v
    assert got[100].text.split()[-1] == got[101].text.split()[-1] and got[102].text.split()[-1] == got[103].text.split()[-1]
    assert got[104].text == "token: short."


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"Anna {chr(65 + i % 26)}{chr(97 + i // 26)}mann came") for i in range(600)]
    got = replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.text for r in got}) == 600 and all(r.n_entities == 1 for r in got)


def test_entity_pattern_leaves_prose_alone():
    assert callable(drawn)
    prose = "And there were 12 of them. In 1999, at 10:30, part 3.2 of 7 was 12345 long; The The Of Of."
    assert re.search(r"\d", prose) and "(?" in entity_pattern()


def test_chat(spark):
    r = random.Random(6)
    rows = []
    for c in range(60):
        turns = [(t, ["user", "assistant"][t % 2], f"m{r.randint(0, 2)}<|im_end|>" if t else "hello") for t in range(r.randint(1, 5))]
        rows += [(c, *t, "x", 1) for t in turns]
        if c % 3 == 0:
            rows += [(100 + c, *t, "x", 1) for t in turns[: r.randint(1, len(turns))]]
    long = [(t, "user", f"m{t % 97} " * (1 + 2000 * (t == 7))) for t in range(4000)]
    rows += [(700, *t, "x", 1) for t in long] + [(701, *t, "x", 1) for t in long[:3999]] + [(702, *t, "x", 1) for t in long]
    rows += [rows[0], (None, 0, "user", "lost", "x", 1), (900, None, None, None, "x", 1), (900, 1, "user", "", "x", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mark string, n int")
    con = duckdb.connect()
    table = frame.select("conv_id", "turn", "role", "text").toArrow()
    con.register("conversations", table)
    assert sorted(map(tuple, chat.format_chats(frame).collect())) == sorted(con.sql(chat.SQL).fetchall())
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_licences(spark):
    rows = [
        (0, "Released under the MIT License."),
        (1, "x MIT license, Apache\nLicense mit-license; the GNU general public license"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "license mit apache public general"),
        (4, None),
        (5, ""),
        (6, "Redistribution and use in source and binary forms, with or without modification, are permitted"),
        (7, "Ünder the Mitt License of the publics"),
    ]
    got = {r.doc_id: tuple(r)[1:] for r in scan_licenses(spark.createDataFrame([(*x, *corpus.CLASH) for x in rows], corpus.KIND)).collect()}
    assert got[0][:6] == (5, 1, 3, 3, "mit", "mit") and got[0][6] > 0.99
    assert got[1][:5] == (12, 4, 1, 9, "apache,gpl,mit")
    assert got[2][:6] == (7, 0, None, None, "", "cc-by-nc")
    assert got[3][1:6] == (0, None, None, "", "")
    assert got[4][:2] == got[5][:2] == (0, 0) and got[4][6] == 0
    assert got[6][4:6] == ("", "bsd") and got[7][1] == 0
    assert all(0 <= x[6] <= 1 for x in got.values())
    assert scan_licenses(corpus.empty(spark)).count() == 0


def test_licences_of_many_notices_and_of_very_long_prose(spark):
    r = random.Random(8)
    wording = {}
    for label, _, text in TEMPLATES:
        wording.setdefault(label, text)
    words = vocabulary()
    # licence words stand alone in prose, so that they make no phrase
    prose = lambda n, share=0.2: " ".join(r.choice(words) if i % 2 and r.random() < share else f"w{r.randint(0, 999)}" for i in range(n))
    sets = [["mpl", "epl", "isc"], ["bsd", "isc", "mpl"], ["bsd", "mpl", "epl", "cc0", "unlicense"], sorted(wording)]
    sets += [sorted(r.sample(sorted(wording), r.randint(1, 6))) for _ in range(20)]
    rows = [(i, " ".join(x for label in s for x in (prose(20, 0), wording[label]))) for i, s in enumerate(sets)]
    for label in sorted(wording):
        rows.append((len(rows), f"{prose(10_000)} {wording[label]} {prose(10_000)}"))
        sets.append([label])
    rows += [(1000 + i, prose(40, 0.02)) for i in range(600)]
    got = {x.doc_id: x for x in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    implied = {"lgpl": "gpl", "agpl": "gpl"}  # their wordings hold the base phrase of the other
    for i, s in enumerate(sets):
        found = set(got[i].labels.split(","))
        assert found == {*s, *(implied[x] for x in s if x in implied)}, (s, found)
        assert got[i].score > 0.99
    assert all(got[d].score < 0.6 for d, _ in rows[len(sets) :])
