"""Substring dedup against a log-structured index of window fingerprints.

Texts come in batches of ascending doc_id. The index is a list of immutable runs, each a Parquet table sorted by
fingerprint with the first text of each. A batch is merge-joined with every run, then becomes a run itself; runs of one
level are compacted into one of the next. An index in a folder of its own takes in further batches later. A fingerprint stands for a context: all 50-word windows with one anchor
(see ``repeats``), so that the index holds about one row for every twenty windows. Windows of contexts that share an
anchor without being equal are compared word for word at the end.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.llm import arrays as A
from rootweave.llm import repeats as R
from rootweave.llm.session import documents, shared_dir, small_batches, stored

WIDTH, GRAM = 50, 8
BATCHES = 3
#: Runs of one level that are compacted into one of the next.
FAN = 2

RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


class FingerprintIndex:
    """Runs of (h, c) with the first text that has it; the driver holds their names, never their rows.

    All runs have as many buckets by h, sorted within, so that a merge join of two reads them as they lie. An index with a
    folder of its own outlives the session: ``save`` writes which runs it has, and opening the folder again finds them,
    and the texts that they are of, from which later batches are verified.
    """

    COLUMNS = "h BIGINT, c BIGINT, doc_id BIGINT, at BIGINT"

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/") if folder else f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.paths: dict[int, str] = {}
        self.texts: list[str] = []
        self.version = 0
        if folder and self.exists(f"{self.folder}/versions"):
            listed = spark.read.parquet(f"{self.folder}/versions")
            rows = listed.where(F.col("version") == listed.agg(F.max("version")).first()[0]).orderBy("level", "place").collect()
            self.version, self.buckets = rows[0]["version"], rows[0]["buckets"]
            self.texts = [r["path"] for r in rows if r["level"] < 0]
            for r in rows:
                if r["level"] >= 0:
                    self.levels += [[] for _ in range(r["level"] + 1 - len(self.levels))]
                    self.levels[r["level"]].append(self.opened(r["path"]))

    def exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def save(self, texts: DataFrame) -> None:
        """Keeps the texts of this session's batches, and a new version of the list of runs."""
        path = f"{self.folder}/texts-{uuid.uuid4().hex}"
        texts.write.parquet(path)
        self.texts.append(path)
        rows = [(self.version + 1, self.buckets, -1, i, p) for i, p in enumerate(self.texts)]
        rows += [(self.version + 1, self.buckets, k, i, self.paths[id(run)]) for k, level in enumerate(self.levels) for i, run in enumerate(level)]
        self.spark.createDataFrame(rows, "version int, buckets int, level int, place int, path string").write.mode("append").parquet(f"{self.folder}/versions")
        self.version += 1

    def history(self) -> DataFrame | None:
        """doc_id and text of all batches that were saved."""
        return self.spark.read.schema("doc_id long, text string").parquet(*self.texts) if self.texts else None

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def opened(self, path: str) -> DataFrame:
        """A bucketed run; its name in the catalogue goes at once, its files stay."""
        name = f"run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self.COLUMNS}) USING parquet CLUSTERED BY (h) SORTED BY (h, c) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.known(name, path)

    def known(self, name: str, path: str) -> DataFrame:
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        self.paths[id(run)] = path
        return run

    def sorted_table(self, rows: DataFrame) -> DataFrame:
        name = f"run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        rows.select("h", "c", "doc_id", "at").write.bucketBy(self.buckets, "h").sortBy("h", "c").option("path", path).saveAsTable(name)
        return self.known(name, path)

    @staticmethod
    def firsts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h", "c").agg(F.min(F.struct("doc_id", "at")).alias("first")).select("h", "c", "first.*")

    def add(self, rows: DataFrame) -> DataFrame:
        """Takes in a batch and returns its contexts that a smaller doc_id in the index has."""
        batch = self.sorted_table(rows.repartition(self.buckets, "h"))
        run = self.sorted_table(self.firsts(batch))
        copies = batch
        for k, other in enumerate([run, *self.runs]):
            copies = copies.join(other.select("h", "c", F.col("doc_id").alias(f"first{k}")).hint("merge"), ["h", "c"], "left")
        earliest = [F.col(f"first{k}") for k in range(1 + len(self.runs))]
        copies = stored(copies.where((F.least(*earliest) if len(earliest) > 1 else earliest[0]) < F.col("doc_id")).select("doc_id", "at"), "copies")
        old = [batch]
        for level in range(64):
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FAN:
                break
            merged, self.levels[level] = self.levels[level], []
            run = self.sorted_table(self.firsts(reduce(DataFrame.unionByName, merged)))
            old += merged
        for table in old:
            self.drop(table)
        return copies

    def drop(self, table: DataFrame) -> None:
        """Removes a table that a compaction or the end of a batch has left without readers."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def rivals(self, new: DataFrame | None = None) -> DataFrame:
        """Contexts that share their anchor with different ones, one of them at least of a text in ``new`` (doc_id)."""
        every = reduce(DataFrame.unionByName, self.runs)
        if len(self.runs) > 1:
            every = self.firsts(every)
        several = every.groupBy("h").agg(F.count("*").alias("rivals")).where("rivals > 1")
        if new is not None:
            several = several.join(every.join(new, "doc_id", "left_semi").select("h").distinct(), "h", "left_semi")
        return every.join(several, "h").select("h", "doc_id", *located(), "rivals")


#: A context's first window, windows and place of the anchor, in one number (windows of up to 4,095 words).
PACKED = "shiftleft(cast(lo as long), 24) + shiftleft(cast(n as long), 12) + rel"


def located() -> list[Column]:
    return [F.shiftright("at", 24).cast("int").alias("lo"), F.shiftright("at", 12).bitwiseAND(4095).cast("int").alias("n"), F.col("at").bitwiseAND(4095).cast("int").alias("rel")]


def later_windows(block: pa.Table, width: int) -> pa.RecordBatch:
    """Of whole anchor groups: runs of windows that a text of smaller doc_id holds, compared word for word."""
    data, bounds = A.text_bytes(block["body"])
    starts, ends, first = A.word_spans(data, bounds, ~A.SPACE[data])
    symbols = A.span_hash(A.prefix_hash(data), starts, ends)
    counts = np.diff(first) - width + 1
    row = np.repeat(np.arange(len(counts)), counts)
    place = A.concat_ranges(np.zeros(len(counts), np.int64), counts)
    begin = first[row] + place
    key = A.span_hash(A.prefix_hash(symbols), begin, begin + width)
    doc, lo = (block[c].to_numpy().astype(np.int64) for c in ("doc_id", "lo"))
    order = np.lexsort((doc[row], key))
    key, row, place, begin = key[order], row[order], place[order], begin[order]
    left, size = starts[begin], ends[begin + width - 1] - starts[begin]
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (size[1:] == size[:-1])
    pairs = np.flatnonzero(same)
    for some in np.array_split(pairs, max(1, len(pairs) * 400 // (8 << 20))):
        if len(some):
            unequal = data[A.concat_ranges(left[some], size[some])] != data[A.concat_ranges(left[some - 1], size[some])]
            same[some] = ~np.logical_or.reduceat(unequal, np.cumsum(size[some]) - size[some])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    later = doc[row] > doc[row[head]]
    return R.as_runs(doc[row[later]], (lo[row] + place)[later])


def remove(width: int):
    """For mapInArrow over (doc_id, text, runs): each text without the words of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in A.slices(batch, "text"):
                data, bounds = A.text_bytes(piece.column("text"))
                offsets, lows, counts = R.interval_arrays(piece.column("runs"))
                like = piece.column("runs").flatten().field(2).to_numpy(zero_copy_only=False).astype(np.int64)
                rows = []
                for i in range(piece.num_rows):
                    words = data[bounds[i] : bounds[i + 1]].tobytes().split()
                    gone = 0
                    if offsets[i] < offsets[i + 1]:
                        lo, n, of = (x[offsets[i] : offsets[i + 1]] for x in (lows, counts, like))
                        fits = np.maximum(lo, of) + n + width - 1 <= len(words)
                        lo, n, of = lo[fits], n[fits], of[fits]
                        start = np.zeros(max(0, len(words) - width + 1), bool)
                        start[A.concat_ranges(lo[of < 0], n[of < 0])] = True
                        start[A.concat_ranges(lo[of >= 0], n[of >= 0])] |= start[A.concat_ranges(of[of >= 0], n[of >= 0])]
                        at = np.flatnonzero(start)
                        mask = R.covered(len(words), width, at, np.ones(len(at), np.int64))
                        gone = int(mask.sum())
                        kept = b" ".join([w for w, g in zip(words, mask.tolist(), strict=True) if not g])
                    else:
                        kept = b" ".join(words)
                    rows.append((len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), list(RESULT)[1:], strict=True))], schema=RESULT)

    return run


def dedupe_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, hot: int = R.HOT, folder: str | None = None) -> DataFrame:
    """Each text without the words of every ``width``-word window that a text of smaller doc_id also holds.

    Words are runs of characters other than \\x20 and \\x09-\\x0D; windows do not cross texts. Returns doc_id, n_words,
    n_removed, kept_sha256 and kept (the remaining words joined by one space). Null, empty and short texts lose nothing.
    Rows without doc_id have no place in the order: they lose nothing and take nothing from others. Repeats of a row do
    not count as earlier ones; if different texts share a doc_id, each is cut by what was found for either. Other
    columns are ignored. An empty table has no rows.

    With a ``folder`` (shared by all executors) the index stays there: a later call with larger doc_ids goes on from it,
    and its texts lose what any earlier call's texts hold. Texts once returned are not looked at again.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    named = documents(docs)
    nameless = named.where("doc_id is null").withColumn("runs", F.array().cast("array<struct<lo:int,n:int,like:long>>"))
    named = named.where("doc_id is not null")
    at = [k / batches for k in range(1, batches)]
    cuts = named.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), F.lit(1000))).first()[0] if at else None
    edges = sorted({int(x) for x in cuts or []})  # none for an empty table
    index, known = FingerprintIndex(spark, folder), []
    history = index.history()
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        batch = named
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        contexts = stored(batch.mapInArrow(R.scan(R.word_symbols, width, gram, False), R.ANCHORS), "fingerprints")
        known.append(contexts.where("seen > 0").select("doc_id", "lo", "n", F.when(F.col("seen") == 2, F.col("c")).otherwise(-1).alias("like")))
        copies = index.add(contexts.where("seen = 0").select("h", "c", "doc_id", F.expr(PACKED).alias("at")))
        known.append(copies.select("doc_id", *located()[:2], F.lit(-1).cast("long").alias("like")))
    rivals = index.rivals(named.select("doc_id") if history is not None else None)
    wanted = rivals.groupBy("doc_id").agg(F.collect_list(F.struct("h", "lo", "n", "rel", "rivals")).alias("items"))
    texts = named if history is None else named.unionByName(history)
    pieces = stored(texts.join(wanted, "doc_id").mapInArrow(R.cut(R.word_symbols, R.take_words, width, hot), R.PIECE), "pieces")
    partial = pieces.where("body is not null").repartition("h").sortWithinPartitions("h").mapInArrow(R.blocks(later_windows, width), R.INTERVAL)
    every = partial.unionByName(R.repeated_windows(pieces, False)).withColumn("like", F.lit(-1).cast("long"))
    for some in known:
        every = every.unionByName(some)
    runs = every.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n", "like")).alias("runs"))
    if folder:
        index.save(named)
    return named.join(runs, "doc_id", "left").unionByName(nameless).mapInArrow(remove(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
