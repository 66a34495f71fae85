"""Byte-pair pieces by a table of prefixes.

For every prefix of a word the table keeps the one piece that ends its encoding. The candidates are the pieces that an
automaton finds to end there; the right one is that which may follow the last piece of the prefix before it. The ids of
the whole word are then read backwards. Texts fall into words where no piece crosses, so the words of a task are
remembered, and rows are dealt by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from rootweave.llm.arrays import give_back
from rootweave.llm.session import documents, small_batches

SPACE = "▁"
#: Words (twice as many, by generations), stretches and pairs that a worker remembers before it starts anew.
WORDS, STRETCHES, PAIRS = 300_000, 500_000, 300_000
LONGEST = 64
NEVER = float("-inf")
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded", pa.string()), ("decoded_sha256", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: A word: spaces, then what is not one.
WORD = regex.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PrefixEncoder:
    """Encodes and decodes with the vocabulary of a sentencepiece BPE model with byte fallback (read with its library)."""

    def __init__(self, model: bytes) -> None:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = processor.get_piece_size()
        self.pieces = [processor.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if processor.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in self.byte_of}
        self.score = {p: processor.get_score(i) for p, i in self.ids.items()}
        self.bos, self.eos = processor.bos_id(), processor.eos_id()
        self.special = special
        self.full = max((len(p) for p in self.ids if not p.strip(SPACE)), default=1)
        self.automaton = ahocorasick.Automaton()
        self.joined: set[str] = set()
        for p in self.ids:
            self.automaton.add_word(p, p)
            self.joined.update(p[k : k + 2] for k in range(len(p) - 1))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.ends: dict[str, tuple[list[tuple[str, float]], list[tuple[str, float]]]] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.parts: dict[str, list[str]] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding by definition: the best-scored neighbours merge first, the leftmost of equals. For short texts."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def growth(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
        """What stands at the left and at the right end of a piece while it merges, each with the score at which it came.

        A merge may have to wait for one of its sides, so that its score is that side's, if worse.
        """
        if (known := self.ends.get(piece)) is None:
            parts = [(c, 0.0) for c in piece]
            left, right = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                score, k = max((self.score.get(a[0] + b[0], NEVER), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if score == NEVER:
                    break
                k = -k
                both = parts[k][0] + parts[k + 1][0], min(score, parts[k][1], parts[k + 1][1])
                if k == 0:
                    left.append(both)
                if k + 2 == len(parts):
                    right.append(both)
                parts[k : k + 2] = [both]
            known = self.ends[piece] = ([], []) if len(parts) > 1 else (left, right)
        return known

    def follows(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left``: no merge across their border comes before their own merges."""
        if left[-1] + right[0] not in self.joined:
            return True
        if (known := self.compatible.get((left, right))) is None:
            if len(self.compatible) > PAIRS:
                self.compatible.clear()
            known = self.compatible[left, right] = self.undisturbed(self.growth(left)[1], self.growth(right)[0])
        return known

    def undisturbed(self, left: list[tuple[str, float]], right: list[tuple[str, float]]) -> bool:
        a = b = 0
        while left and right:
            across = self.score.get(left[a][0] + right[b][0], NEVER)
            grow_left = left[a + 1][1] if a + 1 < len(left) else NEVER
            grow_right = right[b + 1][1] if b + 1 < len(right) else NEVER
            if across > grow_left and across >= grow_right and across > NEVER:
                return False
            if grow_left == grow_right == NEVER:
                return True
            if grow_left >= grow_right:
                a += 1
            else:
                b += 1
        return False

    def table(self, text: str) -> list[str]:
        """Pieces (or single characters without a piece) of a stretch, from the last piece of each of its prefixes."""
        last, done, compatible = list(text), -1, self.compatible
        for end, piece in self.automaton.iter(text):  # at each end the longest first
            if end != done:
                start = end - len(piece)
                if start < 0 or (compatible.get((last[start], piece)) or self.follows(last[start], piece)):
                    last[end], done = piece, end
        out, end = [], len(text) - 1
        while end >= 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def stretch(self, text: str) -> list[str]:
        """Like ``table``, after a cut between any two characters that no piece has side by side."""
        out, start = [], 0
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1 : k + 1] not in self.joined:
                part = text[start:k]
                if (pieces := self.parts.get(part)) is None:
                    pieces = self.table(part) if len(part) > 1 else [part]
                    if len(part) <= LONGEST:
                        if len(self.parts) > STRETCHES:
                            self.parts.clear()
                        self.parts[part] = pieces
                out += pieces
                start = k
        return out

    def word(self, text: str) -> list[int]:
        """Ids of one word. Runs of spaces have the worst score: they merge after all else, so they are merged apart."""
        spaces = len(text) - len(text.lstrip(SPACE))
        pieces: list[str] = []
        if spaces < len(text):
            pieces = self.stretch(text[max(0, spaces - 1) :])
            if spaces and pieces[0] != SPACE:
                spaces -= 1
            elif spaces:
                pieces = pieces[1:]
        ids = [self.ids[p] for p in self.space_run(spaces)]
        for p in pieces:
            if (i := self.ids.get(p)) is None:
                ids += [self.bytes[b] for b in p.encode()]
            else:
                ids.append(i)
        return ids

    def space_run(self, n: int) -> list[str]:
        """``n`` spaces merged from the left; long runs repeat the longest piece that all others grow into."""
        if n < 2:
            return [SPACE] * n
        head = max(0, n // self.full - 1)
        return [SPACE * self.full] * head + self.merged(SPACE * (n - head * self.full))

    def decode(self, ids: list[int]) -> str:
        """Text of ids as the library gives it: bytes of neighbours together, one leading space less."""
        if self.byte_of.keys().isdisjoint(ids) and self.special.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i not in self.special:
                out += self.pieces[i].encode()
        return out.decode("utf-8", "replace").replace(SPACE, " ")

    def known(self, text: str) -> tuple[bytes, str]:
        """A word's ids, packed, and what they decode to; words of the generation before last are forgotten."""
        if (found := self.older.get(text)) is None:
            ids = self.word(text)
            found = pack(f"<{len(ids)}I", *ids), self.decode(ids)
        if len(text) <= LONGEST:
            if len(self.words) > WORDS:
                self.older, self.words = self.words, {}
            self.words[text] = found
        return found

    def forget(self) -> None:
        """Drops the words and stretches of a task; the tables of the model stay."""
        for held in (self.words, self.older, self.parts):
            held.clear()

    def encode(self, text: str) -> tuple[bytes, str]:
        """All ids with begin and end, as little-endian 32-bit numbers, and the decoded text."""
        ids, decoded = [np.array([self.bos], "<u4").tobytes()], []
        if text:
            get, known = self.words.get, self.known
            for w in WORD.findall(SPACE + text.replace(" ", SPACE)):
                packed, plain = get(w) or known(w)
                ids.append(packed)
                decoded.append(plain)
        ids.append(np.array([self.eos], "<u4").tobytes())
        plain = "".join(decoded)
        return b"".join(ids), plain[1:] if plain.startswith(" ") else plain


ENCODERS: dict[int, PrefixEncoder] = {}


def encoder(model: bytes) -> PrefixEncoder:
    """One encoder a worker process, so that its tables are built once."""
    if (key := hash(model)) not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = PrefixEncoder(model)
    return ENCODERS[key]


def encode_texts(docs: DataFrame, model_path: str, ids: bool = True) -> DataFrame:
    """Ids of whole texts, begin and end included, and the text that they decode to.

    Returns doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256, with
    ``ids`` also the ids and the decoded text themselves. A null text is encoded as an empty one: begin and end. doc_id
    may be null or repeat; every row gives one row. Other columns are ignored. The model file (a few hundred kB) is read
    once by the driver and goes to the tasks as a broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model.value)
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 32):
                    piece = batch.slice(start, 32)
                    rows = []
                    for text in piece.column(1).to_pylist():
                        packed, plain = coder.encode(text or "")
                        row = len(packed) // 4, hashlib.sha256(packed).hexdigest()
                        again = plain, hashlib.sha256(plain.encode()).hexdigest()
                        rows.append((np.frombuffer(packed, "<u4").astype(np.int32), *row, *again) if ids else (*row, again[1]))
                    schema = ENCODED if ids else DIGEST
                    yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)
        finally:  # the worker goes on to other stages
            coder.forget()
            give_back()

    kind = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string" if ids else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents(docs).mapInArrow(run, kind)
