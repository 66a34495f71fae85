"""The trie of all beginnings of conversations, by sorted matrices of turn ids.

Conversations are dealt to shards by range of their turn ids, so that those with one beginning stand together. In a shard
they are put in order by a lexsort of a matrix padded with zeros; where a column differs from the row before, or a column
left of it did (the masks are accumulated by OR), a node of that depth starts; reduceat sums up each depth, the deepest
first. A node that holds a shard's first or last row may go on in the next shard. Such nodes lie on two paths; the paths
of all shards, with what is known of their nodes, are rows of a next round of the same, until one shard holds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.llm.session import spread_join, stored

#: Turns in a shard; more than that only where conversations are long.
CELLS = 1 << 19
#: Columns of a padded matrix that are held at a time.
BAND = 32
NOTHING = hashlib.sha256(b"").hexdigest()

#: What a path tells of the nodes on it: members, smallest member, and children, leaves and tokens of what is closed below.
PARTS = ("n", "low", "kids", "leaves", "saved")
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
FIELDS = [
    ("kind", pa.string()),
    *[(c, pa.int64()) for c in NODE],
    ("ends_sha256", pa.string()),
    ("key", pa.binary()),
    ("parent_key", pa.binary()),
    ("ids", pa.binary()),
    ("chars", pa.list_(pa.int64())),
    *[(c, pa.list_(pa.int64())) for c in PARTS],
    ("members", pa.string()),
]
SCHEMA = pa.schema(FIELDS)
DDL = f"kind string, {', '.join(f'{c} bigint' for c in NODE)}, ends_sha256 string, key binary, parent_key binary, ids binary, chars array<bigint>, {', '.join(f'{c} array<bigint>' for c in PARTS)}, members string"


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (id: 16 bytes of (role, text) as hexadecimal; chars: code points of the text), in order.

    Turns are in the order of turn, null first; equal turn numbers by role, then text. A repeated row is a turn again. Null
    roles and texts are empty. Rows without conv_id belong to no conversation and are left out; so are other columns.
    """
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        *[F.coalesce(conversations[c].cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    ).where("conv_id is not null")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    turn = F.struct(at.alias("at"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("id"), F.length("text").cast("long").alias("chars"))
    turns = rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


class Shard:
    """Rows in order, and for each depth the rows that reach it and where its nodes start among them."""

    def __init__(self, table: pa.Table, whole: bool) -> None:
        tie = table.column("conv_id").to_numpy()
        ids = table.column("ids").to_pylist()
        length = np.array([len(x) // 16 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), ">u8").astype(np.uint64).reshape(-1, 2)
        chars = table.column("chars").combine_chunks().flatten().to_numpy()
        begins = np.cumsum(length) - length
        order = self.in_order(length, begins, flat, tie)
        self.tie, self.length, self.begins, self.flat, self.chars = tie[order], length[order], begins[order], flat, chars
        self.of_first = np.cumsum(length + 1)[order] - length[order] - 1  # a path has a part for each depth, the root's first
        self.parts = {c: table.column(c).combine_chunks().flatten().to_numpy() for c in PARTS} if "n" in table.column_names else None
        self.whole = whole
        self.rows, self.starts = [np.arange(len(tie))], [np.zeros(1, np.int64)]
        self.mark_nodes()

    @staticmethod
    def band(rows: np.ndarray, begin: int, length: np.ndarray, begins: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Columns begin to begin + BAND of the padded matrix: rows x columns x 2."""
        width = min(BAND, int(length[rows].max()) - begin)
        at = begin + np.arange(width)
        inside = at < length[rows][:, None]
        return np.where(inside[..., None], flat[np.where(inside, begins[rows][:, None] + at, 0)], np.uint64(0))

    @classmethod
    def in_order(cls, length: np.ndarray, begins: np.ndarray, flat: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """By turn ids, then conv_id; bands of columns from the last to the first, each a stable lexsort."""
        order = np.argsort(tie, kind="stable")
        for begin in reversed(range(0, int(length.max(initial=0)), BAND)):
            reach = length[order] > begin
            here = order[reach]
            matrix = cls.band(here, begin, length, begins, flat)
            keys = matrix[:, ::-1, ::-1].reshape(len(here), -1).T
            order = np.concatenate([order[~reach], here[np.lexsort(keys)]])  # those that end before are padded, so first
        return order

    def mark_nodes(self) -> None:
        differs = np.zeros(len(self.tie), bool)  # from the row before, in a column up to here
        differs[:1] = True
        for begin in range(0, int(self.length.max(initial=0)), BAND):
            here = np.flatnonzero(self.length > begin)
            matrix = self.band(here, begin, self.length, self.begins, self.flat)
            mask = np.ones(matrix.shape[:2], bool)
            mask[1:] = (matrix[1:] != matrix[:-1]).any(axis=2)
            mask[1:, 0] |= np.diff(np.cumsum(differs)[here]) > 0
            mask = np.logical_or.accumulate(mask, axis=1)
            for j in range(mask.shape[1]):
                reach = self.length[here] > begin + j
                self.rows.append(here[reach])
                self.starts.append(np.flatnonzero(mask[reach, j]))
            differs[here] = mask[:, -1]

    def part(self, name: str, depth: int) -> np.ndarray:
        rows = self.rows[depth]
        if self.parts is None:
            return self.tie[rows] if name == "low" else np.full(len(rows), name == "n", np.int64)
        return self.parts[name][self.of_first[rows] + depth]

    def is_open(self, depth: int) -> np.ndarray:
        """Whether a node may have members in another shard."""
        found = np.zeros(len(self.starts[depth]), bool)
        if not self.whole and len(found):
            found[0] |= self.rows[depth][0] == 0
            found[-1] |= self.rows[depth][-1] == len(self.tie) - 1
        return found

    def keys(self, row: int) -> list[bytes]:
        """The key of each beginning of a row, the empty one first."""
        turns = self.flat[self.begins[row] : self.begins[row] + self.length[row]]
        roll, out = hashlib.blake2b(digest_size=16), []
        for depth in range(len(turns) + 1):
            if depth:
                roll.update(turns[depth - 1].tobytes())
            out.append(roll.copy().digest())
        return out

    def batches(self) -> Iterator[pa.RecordBatch]:
        last, deepest = len(self.tie) - 1, len(self.rows) - 1
        lows = [np.minimum.reduceat(self.part("low", d), self.starts[d]) for d in range(deepest + 1)]
        first_keys, last_keys = self.keys(0), self.keys(last)
        paths = [{c: [0] * (int(self.length[row]) + 1) for c in PARTS} for row in (0, last)]
        nodes: dict[str, list] = {c: [] for c in (*NODE, "ends_sha256", "key", "parent_key")}
        ends: list[tuple[bytes, int, str]] = []
        below: tuple | None = None
        for depth in range(deepest, -1, -1):
            rows, starts, opened = self.rows[depth], self.starts[depth], self.is_open(depth)
            more = {c: np.zeros(len(rows), np.int64) for c in ("kids", "leaves", "saved")}
            if below:
                at = np.searchsorted(rows, below[0])
                more["kids"][at], more["leaves"][at], more["saved"][at] = 1, below[1], below[2]
            n = np.add.reduceat(self.part("n", depth), starts)
            kids, leaves, saved = (np.add.reduceat(self.part(c, depth) + more[c], starts) for c in more)
            chars = self.chars[self.begins[rows[starts]] + depth - 1] if depth else np.zeros(1, np.int64)
            total_leaves, total_saved = np.where(kids == 0, 1, leaves), saved + (n - 1) * chars
            closed = np.flatnonzero(~opened)
            below = rows[starts[closed]], total_leaves[closed], total_saved[closed]
            # what is open goes on along the first row's and the last row's path; a node on both counts on the first
            on_first = bool(opened.any() and rows[0] == 0)
            if on_first:
                self.carry(paths[0], depth, (n[0], lows[depth][0], kids[0], leaves[0], saved[0]))
            if opened.any() and rows[-1] == last:
                both = on_first and len(starts) == 1
                self.carry(paths[1], depth, (0, np.iinfo(np.int64).max, 0, 0, 0) if both else (n[-1], lows[depth][-1], kids[-1], leaves[-1], saved[-1]))
            if self.parts is None:
                ended = np.add.reduceat((self.length[rows] == depth).astype(np.int64), starts)
                members = lambda i: ",".join(map(str, self.tie[rows[starts[i] : starts[i] + ended[i]]].tolist()))  # noqa: B023, E731
                ends += [((first_keys if i == 0 and on_first else last_keys)[depth], int(self.tie[rows[starts[i]]]), members(i)) for i in np.flatnonzero(opened & (ended > 0))]
                nodes["ends_sha256"] += [hashlib.sha256(members(i).encode()).hexdigest() if ended[i] else NOTHING for i in closed]
                nodes["key"] += [None] * len(closed)
            else:
                nodes["ends_sha256"] += [None] * len(closed)
                nodes["key"] += self.keys_at(rows[starts[closed]], depth)
            parents, parent_keys = self.parents(closed, depth, lows, first_keys, last_keys)
            nodes["parent_key"] += parent_keys
            for name, values in zip(NODE, (lows[depth], np.full(len(n), depth), parents, n, kids, total_leaves, total_saved), strict=True):
                nodes[name] += values if isinstance(values, list) else values[closed].tolist()
        yield from self.as_batches("node", nodes)
        if not self.whole:
            same = all(len(s) == 1 for s in self.starts) and self.length[0] == self.length[last]
            for row, path in [(0, paths[0])] if same else [(0, paths[0]), (last, paths[1])]:
                begin, end = self.begins[row], self.begins[row] + self.length[row]
                yield from self.as_batches("path", {"conv_id": [int(self.tie[row])], "ids": [self.flat[begin:end].astype(">u8").tobytes()], "chars": [self.chars[begin:end]], **{c: [v] for c, v in path.items()}})
        if ends:
            yield from self.as_batches("ends", {"key": [e[0] for e in ends], "conv_id": [e[1] for e in ends], "members": [e[2] for e in ends]})

    @staticmethod
    def carry(path: dict[str, list[int]], depth: int, values: tuple) -> None:
        for name, value in zip(PARTS, values, strict=True):
            path[name][depth] = int(value)

    def keys_at(self, rows: np.ndarray, depth: int) -> list[bytes]:
        return [hashlib.blake2b(self.flat[self.begins[r] : self.begins[r] + depth].tobytes(), digest_size=16).digest() for r in rows]

    def parents(self, closed: np.ndarray, depth: int, lows: list, first_keys: list, last_keys: list) -> tuple[list, list]:
        """The smallest member of each closed node's parent, or, where that is open, the parent's key."""
        if not depth:
            return [None] * len(closed), [None] * len(closed)
        up_rows, up_starts, opened = self.rows[depth - 1], self.starts[depth - 1], self.is_open(depth - 1)
        at = np.searchsorted(up_starts, np.searchsorted(up_rows, self.rows[depth][self.starts[depth][closed]]), "right") - 1
        on_first = len(up_rows) and up_rows[0] == 0
        key = lambda i: (first_keys if i == 0 and on_first else last_keys)[depth - 1]
        return [None if opened[i] else int(lows[depth - 1][i]) for i in at], [key(i) if opened[i] else None for i in at]

    @staticmethod
    def as_batches(kind: str, columns: dict[str, list]) -> Iterator[pa.RecordBatch]:
        n = len(next(iter(columns.values())))
        for begin in range(0, n, 1 << 14):
            size = min(1 << 14, n - begin)
            given = columns | {"kind": [kind] * n}
            arrays = [pa.array(given[c][begin : begin + size], t) if c in given else pa.nulls(size, t) for c, t in FIELDS]
            yield pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)


def shard_nodes(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield from Shard(pa.Table.from_batches(held), whole).batches()


def end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's members, read piece by piece in order."""
    key, digest, done = None, hashlib.sha256(), []
    for batch in batches:
        for one, members in zip(batch.column("key").to_pylist(), batch.column("members").to_pylist(), strict=True):
            if one == key:
                digest.update(b",")
            else:
                done += [(key, digest.hexdigest())] if key is not None else []
                key, digest = one, hashlib.sha256()
            digest.update(members.encode())
        if done:
            yield pa.record_batch([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done])], names=["key", "ends_sha256"])
            done = []
    if key is not None:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def prefix_trie(sequences: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256 (of the members that end there, by number, joined by commas).

    sequences: conv_id and turns, as ``turn_sequences`` gives them; one row for each conversation, which may have no turns.
    A node is a distinct sequence of first turns, the root that of none. Without conversations there is no root either.
    A task holds one shard: about ``cells`` turns, and each conversation whole.
    """
    spark = sequences.sparkSession
    ids, chars = F.unhex(F.array_join(F.col("turns.id"), "")).alias("ids"), F.col("turns.chars").alias("chars")
    rows = stored(sequences.select("conv_id", ids, chars), "sequences")
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("chars") + 1), F.lit(0))).first()
    shards = max(size // cells + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = []
    while True:
        shards = min(shards, max(1, count // 8))
        whole = shards <= 1
        dealt = rows.repartition(1) if whole else rows.repartitionByRange(shards, "ids", "conv_id")
        found = stored(dealt.mapInArrow(lambda batches, whole=whole: shard_nodes(batches, whole), DDL), "trie")
        out.append(found)
        if whole:
            break
        rows = found.where("kind = 'path'").select("conv_id", "ids", "chars", *PARTS)
        count, size = rows.agg(F.count("*"), F.sum(F.size("chars") + 1)).first()
        shards = size // cells + 1 if size > cells else 1
    nodes, late = out[0].where("kind = 'node'"), None
    if len(out) > 1:
        for found in out[1:]:
            late = found.where("kind = 'node'") if late is None else late.unionByName(found.where("kind = 'node'"))
        pieces = out[0].where("kind = 'ends'").select("key", "conv_id", "members")
        ended = pieces.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(end_digests, "key binary, ends_sha256 string")
        late = stored(late.drop("ends_sha256").join(ended, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "late")
        every = nodes.unionByName(late.select(nodes.columns)).select(*NODE, "ends_sha256", "parent_key")
        asking = stored(every.where("parent_key is not null").drop("parent_conv_id"), "asking")
        known = late.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
        nodes = every.where("parent_key is null").drop("parent_key").unionByName(spread_join(asking, known, "parent_key").drop("parent_key"))
    return nodes.select(*NODE, "ends_sha256")


def rebuilt(sequences: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Sequences that share beginnings: the first h turns of conversation c - c % every, then the own turns after the first h.

    h is the checksum (CRC-32) of the decimal c modulo ``most``. Where that conversation is absent, its part is empty.
    """
    own = stored(sequences, "own")
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = own.withColumn("_h", h).withColumn("_of", F.col("conv_id") - F.col("conv_id") % every)
    joined = rows.join(heads, rows["_of"] == heads["_base"], "left")
    none = F.array().cast(own.schema["turns"].dataType)
    turns = F.concat(F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h")), F.slice("turns", F.col("_h") + 1, F.size("turns")))
    return joined.select("conv_id", turns.alias("turns"))


SQL = """
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM rows_ GROUP BY conv_id
), sums AS (SELECT *, conv_id - conv_id % 100 AS base, CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))) % 6 AS INTEGER) AS h FROM own
), rebuilt AS (SELECT s.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[1:s.h] END, s.turns[s.h + 1:]) AS turns FROM sums s LEFT JOIN own b ON b.conv_id = s.base
), beginnings AS (SELECT conv_id, len(turns) AS n, CAST(unnest(range(0, len(turns) + 1)) AS BIGINT) AS depth, turns FROM rebuilt
), nodes AS (SELECT depth, turns[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = depth) AS ends FROM beginnings GROUP BY ALL
), kids AS (SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.p = n.p
), above AS (SELECT *, unnest(range(0, depth + 1)) AS a FROM known
), subtrees AS (SELECT a AS depth, p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(p[depth].t) END) AS saved_tokens FROM above GROUP BY ALL)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM known k JOIN subtrees s ON s.depth = k.depth AND s.p = k.p LEFT JOIN known u ON u.depth = k.depth - 1 AND u.p = k.p[1:k.depth - 1]
"""
