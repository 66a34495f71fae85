"""Secrets in texts, by a trigram inverted index over the documents and Boolean trigram queries derived from the rules.

Every rule is a regular expression. From its parsed form follows which trigrams any match must hold, as a Boolean query.
The index has, for each segment of some thousand documents, a posting list for each trigram that a query names; queries
are intersections and unions of a segment's lists. Only documents that answer a rule's query are read with that rule. A
rule whose query is empty (any run of hexadecimal digits, say) is read over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.llm.arrays import LOWER, slices, text_bytes
from rootweave.llm.session import PICKED, documents, small_batches, stored


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that don't overlap; those whose ``group`` is shorter than ``least`` code points are dropped.

    Patterns that ignore case must say so for ASCII letters only: (?ai).
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The contract's three kinds, then public formats of keys. All are linear in a text.
BASE = (
    Rule("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abeprs]-[A-Za-z0-9-]+", 0, 24),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_.-]+", 0, 40),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: Documents in a segment; a posting list has no more.
SEGMENT = 4096
#: Spellings that are followed one by one; characters beyond are any character.
SPELLINGS = 64

# a query is a trigram, or ("and" | "or", queries); an empty "and" holds for every text
Query = str | tuple
TRUE: Query = ("and", frozenset())


def all_of(*queries: Query) -> Query:
    parts = {p for q in queries for p in (q[1] if q[0] == "and" else [q])}
    return parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def any_of(*queries: Query) -> Query:
    parts = {p for q in queries for p in (q[1] if q[0] == "or" else [q])}
    if TRUE in parts:
        return TRUE
    # of two alternatives the one that asks for more is covered by the other
    asks = {p: p[1] if p[0] == "and" else {p} for p in parts}
    parts = {p for p in parts if not any(asks[q] < asks[p] for q in parts)}
    return parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


@dataclass(frozen=True)
class Shape:
    """What is known of all matches of an expression: their spellings if few, else how they begin and end, and what they hold."""

    spelt: frozenset[str] | None
    begin: frozenset[str]
    end: frozenset[str]
    need: Query = TRUE

    @property
    def query(self) -> Query:
        return all_of(self.need, held(self.begin), held(self.end))


def held(spellings: Iterable[str]) -> Query:
    """The trigrams that all the spellings hold, whichever it is."""
    return any_of(*(all_of(*(s[i : i + 3] for i in range(len(s) - 2))) for s in spellings))


def exactly(spellings: Iterable[str]) -> Shape:
    found = frozenset(spellings)
    return Shape(found, found, found)


ANYTHING = Shape(None, frozenset([""]), frozenset([""]))


def cut(spellings: set[str], at: slice) -> frozenset[str]:
    """Few or short ones stay; of too many only the two characters at their edge, which a neighbour may complete."""
    if len(spellings) > SPELLINGS:
        spellings = {s[at] for s in spellings}
    return frozenset(spellings if len(spellings) <= SPELLINGS else [""])


def followed(a: Shape, b: Shape) -> Shape:
    if a.spelt is not None and b.spelt is not None and len(a.spelt) * len(b.spelt) <= SPELLINGS:
        return exactly(x + y for x in a.spelt for y in b.spelt)
    across = {x + y for x in a.end for y in b.begin} if len(a.end) * len(b.begin) <= SPELLINGS**2 else {""}
    begin = {x + y for x in a.spelt for y in b.begin} if a.spelt is not None else set(a.begin)
    end = {x + y for x in a.end for y in b.spelt} if b.spelt is not None else set(b.end)
    return Shape(None, cut(begin, slice(0, 2)), cut(end, slice(-2, None)), all_of(a.query, b.query, held(across), held(begin), held(end)))


def either(shapes: list[Shape]) -> Shape:
    if all(s.spelt is not None for s in shapes) and sum(len(s.spelt) for s in shapes) <= SPELLINGS:
        return exactly(x for s in shapes for x in s.spelt)
    begin, end = ({x for s in shapes for x in getattr(s, side)} for side in ("begin", "end"))
    return Shape(None, cut(begin, slice(0, 2)), cut(end, slice(-2, None)), any_of(*(s.query for s in shapes)))


def spelled(code: int) -> str:
    """A character as its UTF-8 bytes, one character a byte, in the lower case that the index is in."""
    return bytes(LOWER[np.frombuffer(chr(code).encode(), np.uint8)]).decode("latin-1")


def of_class(members: list) -> Shape:
    found: set[str] = set()
    for kind, value in members:
        if kind is op.LITERAL:
            found.add(spelled(value))
        elif kind is op.RANGE and value[1] - value[0] < SPELLINGS:
            found |= {spelled(c) for c in range(value[0], value[1] + 1)}
        else:
            return ANYTHING
    # many single characters tell little and multiply what follows them
    return exactly(found) if len(found) <= 8 else ANYTHING


def shape_of(tree: Iterable) -> Shape:
    out = exactly([""])
    for kind, value in tree:
        if kind is op.LITERAL:
            one = exactly([spelled(value)])
        elif kind is op.IN:
            one = of_class(value)
        elif kind is op.BRANCH:
            one = either([shape_of(b) for b in value[1]])
        elif kind is op.SUBPATTERN:
            one = shape_of(value[3])
        elif kind is op.ATOMIC_GROUP:
            one = shape_of(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            one = repeated(value[0], value[1], shape_of(value[2]))
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            one = exactly([""])
        else:
            one = ANYTHING
        out = followed(out, one)
    return out


def repeated(least: int, most: int, item: Shape) -> Shape:
    if not least:
        return exactly([*item.spelt, ""]) if most == 1 and item.spelt is not None else ANYTHING
    times = min(least, 3)
    some = reduce(followed, [item] * times)
    return some if most == times else Shape(None, some.begin, some.end, some.query)


def trigram_query(pattern: str) -> Query:
    """What any match of the pattern must hold: trigrams of its lower-cased UTF-8 bytes, written as characters up to 255."""
    flags = re.compile(pattern).flags
    if flags & re.IGNORECASE and not flags & re.ASCII:
        raise ValueError(f"{pattern}: ignore the case of ASCII letters only, (?ai)")
    return shape_of(_parser.parse(pattern)).query


def named(query: Query) -> set[str]:
    """The trigrams of a query."""
    return {query} if isinstance(query, str) else {t for q in query[1] for t in named(q)}


INDEX = "segment string, trigram binary, doc_ids array<bigint>"


def trigram_index(docs: DataFrame, trigrams: Iterable[str]) -> DataFrame:
    """segment, trigram (three lower-cased bytes) and doc_ids, the documents of the segment that hold it.

    Only the trigrams asked for have lists, as no query reads another.
    """
    asked = sorted(trigrams)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        place = np.full(1 << 24, -1, np.int16)
        for i, t in enumerate(asked):
            a, b, c = t.encode("latin-1")
            place[a << 16 | b << 8 | c] = i
        ids, hits, count = [], [], 0

        def segment() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays(ids)
            pairs = np.unique(np.concatenate(hits))
            kind, at = pairs // SEGMENT, pairs % SEGMENT
            cuts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(pairs) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.r_[cuts, len(pairs)].astype(np.int32), doc_ids.take(pa.array(at)))
            grams = [asked[k].encode("latin-1") for k in kind[cuts]]
            return pa.record_batch([pa.array([f"{task}-{number}"] * len(grams)), pa.array(grams, pa.binary()), lists], names=["segment", "trigram", "doc_ids"])

        for batch in batches:
            for part in slices(batch, "text"):
                for begin in range(0, part.num_rows, SEGMENT):
                    rows = part.slice(begin, SEGMENT)
                    if count + rows.num_rows > SEGMENT:
                        yield segment()
                        ids, hits, count, number = [], [], 0, number + 1
                    data, offsets = text_bytes(rows.column("text"))
                    low = LOWER[data].astype(np.int32)
                    found = place[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
                    at = np.flatnonzero(found >= 0)
                    row = np.searchsorted(offsets, at, "right") - 1
                    inside = at + 3 <= offsets[row + 1]  # of one text
                    hits.append(np.unique(found[at[inside]].astype(np.int64) * SEGMENT + count + row[inside]))
                    ids.append(rows.column("doc_id"))
                    count += rows.num_rows
        if count:
            yield segment()

    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(index, INDEX)


def answers(lists: Column, query: Query) -> Column:
    """The documents of a segment that a query holds for."""
    if isinstance(query, str):
        return F.coalesce(F.element_at(lists, F.lit(query.encode("latin-1"))), F.array().cast("array<bigint>"))
    combine = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(combine, [answers(lists, q) for q in sorted(query[1], key=repr)])


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """doc_id and rules, a bit for each rule whose query holds in a document of that id."""
    segments = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "doc_ids"))).alias("lists"))
    found = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("rule"), answers(F.col("lists"), q).alias("doc_ids")) for i, q in queries.items()])
    rows = segments.select(F.explode(found).alias("f")).select("f.rule", F.explode("f.doc_ids").alias("doc_id"))
    return rows.groupBy("doc_id").agg(F.bit_or("rule").alias("rules"))


SPANS = "doc_id bigint, spans array<struct<kind:string,begin:bigint,end:bigint>>"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs: doc_id and spans (kind, begin, end in code points), by begin, then in the rules' order.

    A null text is empty. Rows that share a doc_id, or have none, are read each by itself. Spans of different kinds may
    overlap. Other columns are ignored.
    """
    if len({r.kind for r in rules}) < len(rules) or len(rules) > 63:
        raise ValueError("up to 63 rules with names of their own")
    texts = documents(docs)
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    always = sum(1 << i for i, q in queries.items() if q == TRUE)
    queries = {i: q for i, q in queries.items() if q != TRUE}
    if queries:
        index = stored(trigram_index(texts, set().union(*map(named, queries.values()))), "trigrams")
        found = stored(candidates(index, queries), "candidates").withColumnRenamed("doc_id", "_doc")
        found = F.broadcast(found) if found.count() <= PICKED else found
        texts = texts.join(found, texts["doc_id"].eqNullSafe(found["_doc"]), "left")
    else:
        texts = texts.withColumn("rules", F.lit(None).cast("long"))
    compiled = [(r, re.compile(r.pattern)) for r in rules]

    def spans_of(text: str, chosen: int) -> list[tuple[int, int, int]]:
        found = []
        for i, (rule, pattern) in enumerate(compiled):
            if chosen >> i & 1:
                for m in pattern.finditer(text):
                    begin, end = m.span(rule.group)
                    if end - begin >= rule.least:
                        found.append((m.start(), i, m.end()))
        return sorted(found)

    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, chosen = part.column("text").to_pylist(), part.column("rules").to_pylist()
                found = [spans_of(t or "", (c or 0) | always) for t, c in zip(texts, chosen, strict=True)]
                rows = [[{"kind": rules[i].kind, "begin": b, "end": e} for b, i, e in spans] for spans in found]
                yield pa.record_batch([part.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    small_batches(docs.sparkSession)
    return texts.select("doc_id", "text", "rules").mapInArrow(read, SPANS)


def digests(spans: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts by kind of the base rules, the digest of their spans, and all spans as text."""
    line = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in base]
    return spans.select("doc_id", *counts, F.sha2(line(of([r.kind for r in base])), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


# The same by regular expressions alone: matches and what stands between them give the places.
SQL_RULES = [("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "(AKIA[A-Z0-9]+)", 0, 20), ("hex", "([0-9a-f]+)", 0, 24)]
SQL_RULES += [(r.kind, r.pattern, r.group, r.least) for r in MORE]


def sql() -> str:
    kinds = "\n  UNION ALL ".join(
        f"""SELECT row_no, {i} AS o, '{kind}' AS kind, unnest(list_transform(range(1, len(e) + 1), lambda i: {{
    'b': coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(e[1:i - 1], lambda x: length(x))), 0), 'n': length(e[i]), 'm': length(g[i])}})) AS f, {least} AS least
  FROM (SELECT row_no, regexp_extract_all(text, '{p}', 0) AS e, regexp_extract_all(text, '{p}', {group}) AS g, string_split_regex(text, '{p}') AS s FROM texts)"""
        for i, (kind, p, group, least) in enumerate(SQL_RULES)
    )
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents
), matches AS ({kinds}
), spans AS (SELECT row_no, o, kind, CAST(f.b AS BIGINT) AS b, CAST(f.b + f.n AS BIGINT) AS e FROM matches WHERE f.m >= least
), lines AS (SELECT row_no, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) FILTER (o < 3) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) AS spans FROM spans GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN lines USING (row_no)
"""


SQL = sql()
