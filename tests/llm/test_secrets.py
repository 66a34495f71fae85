"""The secret scan against all rules read over all texts, and the queries against what matches hold."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rootweave.llm.arrays import LOWER
from rootweave.llm.secret_scan import MORE, RULES, TRUE, Rule, digests, scan_secrets, trigram_query

from . import corpus

# the base rules as the contract spells them
PLAIN = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]
MATCHES = [
    "password: hunter22", "PassWd='abc.def=='", "api_key = \"K9-xyz/77\"", "APIKEY:short", "token=tok_12", "secret  :  s3cr3t-value", "toKen=ab",
    "AKIA" + "Q7" * 8, "AKIA12", "AKIAAKIA" + "Z" * 20, "0123456789abcdef01234567", "deadbeef", "f" * 4000,
    "ghp_" + "a1" * 18, "xoxb-" + "12-ab" * 5, "AIza" + "x_-9" * 9, "sk_live_" + "0" * 24, "eyJ" + "abc.DEF-_" * 6, "-----BEGIN RSA PRIVATE KEY-----",
    "token=" + "ſ" * 9, "toKen=abcdefgh", "é token=ünter token = 'zzzzzz'",
]


def by_hand(text):
    found = []
    for i, (kind, pattern, group, least) in enumerate([*PLAIN, *[(r.kind, r.pattern, r.group, r.least) for r in MORE]]):
        found += [(m.start(), i, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    found.sort()
    line = lambda rows: ",".join(f"{k}:{b}:{e}" for b, _, k, e in rows)
    counts = Counter(k for _, _, k, _ in found)
    base = [x for x in found if x[1] < 3]
    return (counts["assign"], counts["access"], counts["hex"], hashlib.sha256(line(base).encode()).hexdigest(), line(found))


def test_against_all_rules_over_all_texts(spark):
    r = random.Random(5)
    words = ["the", "ein", "é", "password", "token", "secret", "AKIA", "api", "key", "=", ":", "\n", "abc0", "0x"]
    texts = [None, "", " ", "to", "tok", *MATCHES]
    for _ in range(300):
        parts = [r.choice(words) for _ in range(r.randint(0, 60))] + [r.choice(MATCHES) for _ in range(r.randint(0, 3))]
        r.shuffle(parts)
        texts.append(r.choice([" ", "", ", "]).join(parts))
    texts.append(" ".join([r.choice(words) for _ in range(60_000)] + MATCHES))
    found = corpus.frame(spark, list(enumerate(texts)))
    expected = Counter((row.doc_id, *by_hand(row.text)) for row in found.collect())
    assert Counter(map(tuple, digests(scan_secrets(found)).collect())) == expected


def test_empty_table(spark):
    assert digests(scan_secrets(corpus.empty(spark))).collect() == []


def test_rules_of_ones_own(spark):
    docs = corpus.frame(spark, [(1, "say Straße42 or hi"), (2, "nothing"), (3, None)])
    own = (Rule("street", "Straße[0-9]+"), Rule("any", "h.", 0, 2))
    rows = {x.doc_id: [(s.kind, s.begin, s.end) for s in x.spans] for x in scan_secrets(docs, own).collect()}
    assert rows[1] == [("street", 4, 12), ("any", 16, 18)] and rows[2] == [("any", 3, 5)] and rows[3] == []
    with pytest.raises(ValueError):
        trigram_query("(?i)token")
    with pytest.raises(ValueError):
        scan_secrets(docs, (Rule("a", "b"), Rule("a", "c")))


def answered(query, text):
    low = bytes(LOWER[list(text.encode())]).decode("latin-1") if text else ""
    if isinstance(query, str):
        return query in low
    return (all if query[0] == "and" else any)(answered(q, text) for q in query[1])


EXPRESSIONS = [r.pattern for r in RULES] + ["ab(c|de)+f?gh", "(foo|ba[rz])[0-9]{2,}qux", "x*abc|defg", "(?ai)TOK(?=en)en", "a{3}b{2,4}c", "(?>abc)++d", "[^a]bcd", "é{2}x", "()", "a|"]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_a_query_holds_wherever_its_rule_matches(data):
    pattern = data.draw(st.sampled_from(EXPRESSIONS))
    text = data.draw(st.from_regex(pattern))
    assert re.search(pattern, text) is None or answered(trigram_query(pattern), text)


def test_queries_that_are_expected():
    assert trigram_query("[0-9a-f]{24,}") == TRUE
    assert trigram_query("abcd") == ("and", frozenset({"abc", "bcd"}))
    assert trigram_query("(abc|def)x*") == ("or", frozenset({"abc", "def"}))
    assert not any(trigram_query(r.pattern) == TRUE for r in RULES if r.kind != "hex")
