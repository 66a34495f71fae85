"""Quality by co-training: one classifier reads the text, the other what is known about the page without reading it.

Each view counts in how many documents of either class a feature stands (words and marks of the text; language, source
and stated length of the page), which makes naive Bayes weights; a logistic line over a view's weights calibrates it. A
bounded sample of labelled rows starts both. In each round both views score every unlabelled document, and every one
that a view is sure of is counted by the other view; only sums by feature leave the tasks. Calibrated log-odds are
added. A third classifier, sparse, learns from the labelled rows which texts are toxic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rootweave.llm import arrays as A
from rootweave.llm.session import small_batches, stored

#: The most labelled documents that are trained on, taken in the order of a hash of doc_id. Unlabelled ones have no limit.
LABELLED = 8000
ROUNDS = 2
#: How sure a view must be for the other to learn from it, and what such a document counts (a power of two: sums are exact).
SURE, TRUST = 0.98, 0.25
HELD_OUT = 0.2
#: Bits of a hashed word, of a hashed word of the toxicity classifier, and of a hashed fact about the page.
WORD_BITS, TOXIC_BITS, FACT_BITS = 16, 18, 12
#: In how many sampled documents a word must stand to have a weight for toxicity.
FEWEST = 4
#: What is added to every count.
SMOOTH = 0.5

ROW = "doc_id long, text string, facts array<int>, stated double"
SUMS = "view int, feature int, bad double, good double"
SCORES = "doc_id long, text_score double, page_score double, score double, toxic_score double"


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what the page's view sees: hashed facts and the logarithm of the stated length."""
    had = {c.lower() for c in docs.columns}
    known = {c: F.coalesce(docs[c].cast("string"), F.lit("none")) if c in had else F.lit("none") for c in ("lang", "source")}
    chars = F.coalesce(docs["n_chars"].try_cast("double"), F.lit(0.0)) if "n_chars" in had else F.lit(0.0)
    stated = F.log1p(F.least(F.abs(F.nanvl(chars, F.lit(0.0))), F.lit(1e15)))
    step = F.floor(2 * stated).cast("string")
    facts = {"lang": known["lang"], "source": known["source"], "both": F.concat_ws("|", known["lang"], known["source"]), "step": step}
    hashed = F.array(*[F.pmod(F.xxhash64(F.lit(k), c), F.lit(1 << FACT_BITS)).cast("int") for k, c in facts.items()])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), hashed.alias("facts"), stated.alias("stated"))


@dataclass
class Texts:
    """One slice of texts: the distinct words (and runs of marks) of each, hashed, and numbers about the whole of it."""

    row: np.ndarray
    word: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        data, bounds = A.text_bytes(column)
        low = A.LOWER[data]
        sums = A.prefix_hash(low)
        rows, words, tokens = [], [], np.zeros(len(bounds) - 1, np.int64)
        marks = ~A.ALNUM[data] & ~A.SPACE[data]
        for inside in (A.ALNUM[data], marks):
            starts, ends, first = A.word_spans(low, bounds, inside)
            words.append(A.span_hash(sums, starts, ends) >> A.U64(64 - TOXIC_BITS))
            rows.append(np.repeat(np.arange(len(bounds) - 1), np.diff(first)))
            tokens += np.diff(first)
        both = np.unique(np.concatenate(rows) << TOXIC_BITS | np.concatenate(words).astype(np.int64))
        row, word = both >> TOXIC_BITS, both & ((1 << TOXIC_BITS) - 1)
        size = np.diff(bounds)

        def share(of: np.ndarray) -> np.ndarray:
            ahead = np.concatenate([[0], np.cumsum(of)])
            return (ahead[bounds[1:]] - ahead[bounds[:-1]]) / (1 + size)

        distinct = np.bincount(row, minlength=len(size)) / (1 + tokens)
        shares = [share((data >= lo) & (data < hi)) for lo, hi in ((0x41, 0x5B), (0x30, 0x3A), (0x0A, 0x0B))]
        return cls(row, word, np.stack([np.log1p(size), *shares, share(marks), distinct, size / (1 + tokens)], 1))


@dataclass
class View:
    """Counts by class and feature (0: bad, 1: good), documents by class, and the line that calibrates what they give."""

    bits: int
    counts: np.ndarray = field(init=False)
    documents: np.ndarray = field(default_factory=lambda: np.zeros(2))
    slope: np.ndarray | None = None
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.counts = np.zeros((2, 1 << self.bits))

    def evidence(self, row: np.ndarray, feature: np.ndarray, n: int, own: np.ndarray | None = None) -> np.ndarray:
        """For each of ``n`` documents its features' mean weight, sum by square root, largest and smallest weight.

        ``own`` is the class of documents that the counts hold themselves (-1: none); each is then judged without itself.
        """
        own = np.full(n, -1) if own is None else own
        odds = []
        for c in (1, 0):
            mine = (own == c).astype(float)
            odds.append(np.log((self.counts[c][feature] - mine[row] + SMOOTH) / (self.documents[c] - mine + 2 * SMOOTH)[row]))
        weight = odds[0] - odds[1]
        size = np.maximum(np.bincount(row, minlength=n), 1)
        total = np.bincount(row, weight, minlength=n)
        most, least = np.zeros(n), np.zeros(n)
        np.maximum.at(most, row, weight)
        np.minimum.at(least, row, weight)
        return np.stack([total / size, total / np.sqrt(size), most, least], 1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.slope + self.shift, -40, 40)


@dataclass
class QualityModel:
    """``words`` and ``page`` are None where the labels have no two classes of quality; so is ``toxic`` with toxicity."""

    words: View | None = None
    page: View | None = None
    prior: float = 0.0
    toxic: tuple[np.ndarray, float] | None = None

    def inputs(self, piece: pa.RecordBatch, own: np.ndarray | None = None) -> tuple[Texts, np.ndarray, np.ndarray]:
        """The texts of a slice, and what the two views see of each row."""
        texts, n = Texts.of(piece.column("text")), piece.num_rows
        if self.words is None:
            return texts, np.zeros((n, 0)), np.zeros((n, 0))
        row, word = distinct_prefixes(texts)
        read = np.concatenate([self.words.evidence(row, word, n, own), texts.numbers], 1)
        facts = facts_of(piece)
        known = self.page.evidence(np.repeat(np.arange(n), facts.shape[1]), facts.ravel(), n, own)
        return texts, read, np.concatenate([known, piece.column("stated").to_numpy()[:, None]], 1)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, text_score, page_score, score and toxic_score of every row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in A.lean_slices(batch, "text"):
                    texts, read, known = self.inputs(piece)
                    none = pa.nulls(piece.num_rows, pa.float64())
                    scores = [none] * 3
                    if self.words is not None:
                        a, b = self.words.odds(read), self.page.odds(known)
                        scores = [pa.array(chance(x)) for x in (a, b, a + b - self.prior)]
                    toxic = none
                    if self.toxic:
                        sums = np.bincount(texts.row, self.toxic[0][texts.word], minlength=piece.num_rows)
                        toxic = pa.array(chance(sums + self.toxic[1]))
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *scores, toxic], ["doc_id", "text_score", "page_score", "score", "toxic_score"])

        return rows_of(docs).mapInArrow(run, SCORES)


def chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def distinct_prefixes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Row and word with the fewer bits of the quality view, each pair once."""
    row, word = texts.row, texts.word >> (TOXIC_BITS - WORD_BITS)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
    return row[new], word[new]


def facts_of(piece: pa.RecordBatch) -> np.ndarray:
    return piece.column("facts").flatten().to_numpy().astype(np.int64).reshape(piece.num_rows, -1)


def counted(view: int, feature: np.ndarray, row: np.ndarray, label: np.ndarray, weight: float, bits: int, held: np.ndarray) -> None:
    """Adds documents of class ``label`` (-1: none) to the sums of one view; the last place counts documents."""
    for c in (0, 1):
        mine = label == c
        held[view][c][: 1 << bits] += weight * np.bincount(feature[mine[row]], minlength=1 << bits)
        held[view][c][-1] += weight * mine.sum()


def sums(rows: DataFrame, judge) -> DataFrame:
    """view, feature (-1: documents), bad and good over all rows; ``judge`` gives a slice's class for either view, and their weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, (1 << bits) + 1)) for bits in (WORD_BITS, FACT_BITS)]
        for batch in batches:
            for piece in A.lean_slices(batch, "text"):
                texts, words, page, weight = judge(piece)
                if (words >= 0).any():
                    row, word = distinct_prefixes(texts)
                    counted(0, word, row, words, weight, WORD_BITS, held)
                if (page >= 0).any():
                    facts = facts_of(piece)
                    counted(1, facts.ravel(), np.repeat(np.arange(len(facts)), facts.shape[1]), page, weight, FACT_BITS, held)
        for view, bits in enumerate((WORD_BITS, FACT_BITS)):
            at = np.flatnonzero(held[view].any(0))
            feature = np.where(at == 1 << bits, -1, at).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), view, np.int32)), pa.array(feature), *(pa.array(held[view][c][at]) for c in (0, 1))], ["view", "feature", "bad", "good"])

    found = rows.mapInArrow(run, SUMS)
    return found.groupBy("view", "feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def added(model: QualityModel, found: DataFrame) -> QualityModel:
    """A model whose counts have the sums in them: at most a row for each feature, whatever the corpus."""
    new = QualityModel(View(WORD_BITS), View(FACT_BITS), model.prior, model.toxic)
    for old, view in ((model.words, new.words), (model.page, new.page)):
        view.counts, view.documents = old.counts.copy(), old.documents.copy()
    table = found.toArrow()
    which, feature, bad, good = (table[c].to_numpy() for c in ("view", "feature", "bad", "good"))
    for k, view in enumerate((new.words, new.page)):
        for c, values in ((0, bad), (1, good)):
            mine = (which == k) & (feature >= 0)
            view.counts[c][feature[mine]] += values[mine]
            view.documents[c] += values[(which == k) & (feature < 0)].sum()
    return new


def line(rows: DataFrame, label: str, penalty: float, sparse: float = 0.0, scaled: bool = True):
    return LogisticRegression(featuresCol="x", labelCol=label, regParam=penalty, elasticNetParam=sparse, maxIter=40, standardization=scaled).fit(rows)


def calibrate(model: QualityModel, sample: DataFrame) -> None:
    """Fits both views' lines on the labelled sample; each of its documents is judged without itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in A.lean_slices(batch, "text"):
                own = piece.column("quality").to_numpy().astype(np.int64)
                _, read, known = model.inputs(piece, own)
                yield pa.RecordBatch.from_arrays([pa.array(list(read)), pa.array(list(known)), piece.column("quality")], ["read", "known", "quality"])

    seen = stored(sample.where("quality is not null").mapInArrow(run, "read array<double>, known array<double>, quality double"), "calibration")
    for view, column in ((model.words, "read"), (model.page, "known")):
        fitted = line(seen.select(array_to_vector(column).alias("x"), "quality"), "quality", 1e-3)
        view.slope, view.shift = fitted.coefficients.toArray(), float(fitted.intercept)


def has_two(rows: DataFrame, label: str) -> bool:
    return rows.where(F.col(label).isNotNull()).select(label).distinct().count() == 2


def train_toxic(sample: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights by hashed word, and a constant; None if the sample has no two classes of toxicity."""
    known = sample.where("toxic is not null")
    if not has_two(known, "toxic"):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in A.lean_slices(batch, "text"):
                texts = Texts.of(piece.column("text"))
                cuts = np.concatenate([[0], np.cumsum(np.bincount(texts.row, minlength=piece.num_rows))]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(cuts), pa.array(texts.word.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([words, piece.column("toxic"), piece.column("held")], ["words", "toxic", "held"])

    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1000)) < 1000 * HELD_OUT
    read = stored(known.withColumn("held", held).mapInArrow(run, "words array<int>, toxic double, held boolean"), "toxic")
    # only words that stand in a few documents of the sample have a weight: its number of words bounds the model
    fewest = min(FEWEST, 1 + read.count() // 10)
    often = read.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)
    vocabulary = np.sort(often.select("word").toArrow()["word"].to_numpy())
    if not len(vocabulary):
        return None

    def vector(words: list[int]) -> SparseVector:
        at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        at = at[vocabulary[at] == words]
        return SparseVector(len(vocabulary), at, np.ones(len(at)))

    rows = read.select(F.udf(vector, VectorUDT())("words").alias("x"), "toxic", "held")
    train, rest = rows.where("not held"), read.where("held")
    split = has_two(read.where("not held"), "toxic")
    model = line(train if split else rows, "toxic", 0.002, 1.0, False)
    weights, shift = np.zeros(1 << TOXIC_BITS), float(model.intercept)
    weights[vocabulary] = model.coefficients.toArray()
    if split and has_two(rest, "toxic"):
        score = F.udf(lambda words: float(weights[np.array(words, np.int64)].sum() + shift) if words else shift, DoubleType())
        again = line(rest.select(array_to_vector(F.array(score("words"))).alias("x"), "toxic"), "toxic", 1e-3)
        slope = float(again.coefficients[0])
        if slope > 0:
            weights, shift = weights * slope, shift * slope + float(again.intercept)
    return weights, shift


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, facts, stated, quality and toxic (null where unknown) of at most ``most`` labelled documents."""
    sound = lambda c: F.when(labels[c].cast("double").isin(0.0, 1.0), labels[c].cast("double")).alias(c)
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), sound("quality"), sound("toxic"))
    marks = marks.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chosen = marks.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = stored(chosen, "labelled")  # at most ``most`` rows, so that they may be broadcast
    rows = rows_of(docs).join(F.broadcast(chosen), "doc_id")
    # rows that share an id are one labelled document, that of the smallest text
    first = rows.groupBy("doc_id").agg(F.min(F.struct("text", "facts", "stated", "quality", "toxic")).alias("r"))
    return stored(first.select("doc_id", "r.*"), "sample")


def train_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> QualityModel:
    """Trains on at most ``labelled`` labelled documents and on all others of ``docs``."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, labelled)
    model = QualityModel(toxic=train_toxic(sample))
    if not has_two(sample, "quality"):
        return model

    def by_label(piece: pa.RecordBatch):
        own = piece.column("quality").to_numpy().astype(np.int64)
        return Texts.of(piece.column("text")), own, own, 1.0

    empty = QualityModel(View(WORD_BITS), View(FACT_BITS), toxic=model.toxic)
    start = added(empty, sums(sample.where("quality is not null"), by_label))
    good = float(start.words.documents[1] / start.words.documents.sum())
    start.prior = math.log(good / (1 - good))
    ids = np.sort(np.array([r["doc_id"] for r in sample.select("doc_id").collect()], np.int64))  # bounded by ``labelled``
    model = start
    for turn in range(rounds + 1):
        calibrate(model, sample)
        if turn < rounds:
            model = added(start, sums(rows_of(docs), sure_of(model, ids)))
    return model


def sure_of(model: QualityModel, ids: np.ndarray):
    """For ``sums``: what each view learns from the other about the documents that are not in the sample."""

    def judge(piece: pa.RecordBatch):
        texts, read, known = model.inputs(piece)
        doc = piece.column("doc_id")
        free = doc.is_valid().to_numpy(zero_copy_only=False) & ~np.isin(doc.fill_null(0).to_numpy(), ids)
        learnt = []
        for p in (chance(model.page.odds(known)), chance(model.words.odds(read))):
            learnt.append(np.where(free & (p >= SURE), 1, np.where(free & (p <= 1 - SURE), 0, -1)))
        return texts, *learnt, TRUST

    return judge


def classify_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, threshold: float = 0.5) -> DataFrame:
    """Scores every document by both views and decides which are kept.

    Returns one row for each row of ``docs``: doc_id, text_score, page_score, score (both together), toxic_score and kept
    (score >= ``threshold`` and toxic_score < 0.5; a null score rejects nothing). Null and empty texts are scored as texts
    without words; a null doc_id is scored like any other but never trained on, nor is a label without doc_id. Labels
    other than 0 and 1 are unknown, each for itself; of repeated labels the lower quality and the higher toxicity hold.
    Without labels of both classes the scores of quality are null, and likewise that of toxicity. Rows that share an id
    are scored one by one. lang, source and n_chars are used where there; other columns are ignored. An empty table has
    no rows.
    """
    scores = train_quality(docs, labels, labelled, rounds).score(docs)
    kept: Column = F.coalesce(F.col("score") >= threshold, F.lit(True)) & F.coalesce(F.col("toxic_score") < 0.5, F.lit(True))
    return scores.withColumn("kept", kept)
