"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is then put into its centroid's list with
the codes of its residual. A query visits the lists of its nearest centroids, ranks their members by distance tables
over the codes, and all members that may be among the best by their estimate and its error are scored again on the
original vectors in double precision. How many lists must be visited is measured on the sample: few where vectors have
clusters, most of them where they have none.

Equal vectors are one member that carries its smallest ids, as many as a result may need. Lists and the queries that
visit them are cut into cells of bounded size, so that neither a common vector nor a popular list meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.llm import arrays as A
from rootweave.llm.session import stored

NEAREST = 20
#: Vectors that centroids and codebooks are fitted on, in the order of a hash of vec_id.
SAMPLE = 16_384
#: Share of a sampled query's nearest sampled vectors that the visited lists must hold; queries that measure it; lists that
#: are visited at least.
COVERAGE, MEASURED, LEAST = 0.95, 512, 8
#: Members of each cell that are scored again at least, besides as many as a result has.
AGAIN = 12
PARTS, CODES = 16, 256
#: Members and queries of a cell.
MEMBERS, QUERIES = 2048, 512


def k_means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of a bounded sample; an empty one takes a random row."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(rounds):
        near = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], rows[rng.integers(len(rows), size=k)]).astype(np.float32)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres**2).sum(1)
    return np.concatenate([(size - 2 * (part @ centres.T)).argmin(1) for part in np.array_split(rows, max(1, len(rows) // 2048))])


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS) -> None:
        self.coarse = k_means(sample, lists)
        residuals = sample - self.coarse[nearest(sample, self.coarse)]
        bounds = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        self.spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        self.books = [k_means(residuals[:, a:b], CODES, 8, 1 + i) for i, (a, b) in enumerate(self.spans)]

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each vector."""
        lists = nearest(rows, self.coarse)
        residuals = rows - self.coarse[lists]
        return lists, np.stack([nearest(residuals[:, a:b], book) for (a, b), book in zip(self.spans, self.books, strict=True)], 1).astype(np.uint8)

    def visits(self, rows: np.ndarray, probes: int) -> np.ndarray:
        """The lists whose centroids have the largest products with each query."""
        products = rows @ self.coarse.T
        probes = min(probes, products.shape[1])
        return np.argpartition(-products, probes - 1, axis=1)[:, :probes]

    def probes(self, sample: np.ndarray, k: int, coverage: float) -> int:
        """How many lists queries must visit to find this share of their nearest, measured within the sample."""
        queries = sample[:: max(1, len(sample) // MEASURED)][:MEASURED]
        place = nearest(sample, self.coarse)
        products = queries @ sample.T
        products[np.arange(len(queries)), np.arange(0, len(sample), max(1, len(sample) // MEASURED))[: len(queries)]] = -np.inf
        near = np.argsort(-products, axis=1)[:, : min(k, len(sample) - 1)]
        rank = np.argsort(np.argsort(-(queries @ self.coarse.T), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(rank, place[near], 1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(coverage * len(needed))))]) + 1 if len(needed) else 1

    def errors(self, rows: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Lengths of what the codes of one list's members leave of their vectors."""
        left = rows - self.coarse[of]
        for i, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            left[:, a:b] -= book[codes[:, i]]
        return np.sqrt((left.astype(np.float64) ** 2).sum(1))

    def products(self, queries: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Estimated products of queries with members of one list: tables of query parts by codewords, looked up by code."""
        sums = np.repeat((queries @ self.coarse[of])[:, None], len(codes), 1)
        for i, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            sums += (queries[:, a:b] @ book.T)[:, codes[:, i]]
        return sums


def matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def kind_of(vectors: DataFrame) -> str:
    """Vectors keep the precision that they have."""
    return "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of those that take part, one for each vec_id."""
    x = F.col("vector")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast(kind_of(vectors)).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & usable)
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest_neighbours(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = NEAREST, coverage: float = COVERAGE, lists: int | None = None) -> DataFrame:
    """The ``k`` nearest rows found for each query row: query_id, rank (from 1), vec_id and score.

    Nearness is the inner product in double precision on the original vectors; ties go to the smaller vec_id; a query is
    no neighbour of itself. ``queries`` is a condition on vec_id. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do those of another length than most, or without vec_id; of rows that share a vec_id the
    smallest vector stays. Fewer candidates give fewer rows, an empty table none. Other columns are ignored. With a
    ``coverage`` of 1 or more all lists are visited, which makes the search exact.
    """
    spark, kind = vectors.sparkSession, kind_of(vectors)
    rows = clean(vectors)
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stored(rows.where(F.size("vector") == lengths["length"]), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()["vector"]
    sample = np.stack(sample.to_numpy()).astype(np.float32)
    lists = min(lists or int(2 * lengths["n"] ** 0.5), max(1, len(sample) // 16))
    fitted = Quantiser(sample, lists)
    probes = lists if coverage >= 1 else max(LEAST, fitted.probes(sample, k, coverage))
    quantiser = spark.sparkContext.broadcast(fitted)

    same = Window.partitionBy("vector").orderBy("vec_id")
    classes = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                where, codes = quantiser.value.place(matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("vector"), pa.array(where.astype(np.int32)), pa.array([c.tobytes() for c in codes])], ["ids", "vector", "list", "codes"])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                where = quantiser.value.visits(matrix(batch.column("vector")), probes)
                of = pa.array(np.repeat(np.arange(len(where)), where.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(of), batch.column("vector").take(of), pa.array(where.ravel().astype(np.int32))], ["id", "vector", "list"])

    members = stored(classes.mapInArrow(placed, f"ids array<long>, vector {kind}, list int, codes binary"), "lists")
    visits = rows.where(queries).mapInArrow(visiting, f"id long, vector {kind}, list int")
    # one row for each list, as many as there are centroids
    wide = members.groupBy("list").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("wide"))
    deep = visits.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("deep"))
    shape = stored(wide.join(deep, "list"), "cells")
    cell = F.xxhash64("list", "i", "j").alias("cell")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = members.join(F.broadcast(shape), "list").withColumn("i", F.pmod(F.xxhash64(F.col("ids")[0]), "wide").cast("int")).withColumn("j", each("deep"))
    held = held.select(cell, F.lit(0).alias("kind"), F.col("ids")[0].alias("id"), "ids", "vector", "codes", "list")
    asked = visits.join(F.broadcast(shape), "list").withColumn("j", F.pmod(F.xxhash64("id"), "deep").cast("int")).withColumn("i", each("wide"))
    asked = asked.select(cell, F.lit(1).alias("kind"), "id", F.array().cast("array<long>").alias("ids"), "vector", F.lit(b"").alias("codes"), "list")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in A.groups(batches, "cell"):
            asks = group["kind"].to_numpy()
            mine, theirs = group.filter(pa.array(asks == 0)), group.filter(pa.array(asks == 1))
            if not mine.num_rows or not theirs.num_rows:
                continue
            codes = np.frombuffer(b"".join(mine["codes"].to_pylist()), np.uint8).reshape(mine.num_rows, -1)
            vectors, copies = matrix(mine["vector"], np.float64), mine["ids"].combine_chunks()
            sizes, ids = copies.value_lengths().to_numpy(), copies.flatten().to_numpy()
            first = np.cumsum(sizes) - sizes
            asking, queries = theirs["id"].to_numpy(), matrix(theirs["vector"], np.float64)
            guess = quantiser.value.products(queries.astype(np.float32), mine["list"][0].as_py(), codes)
            # a product differs from its estimate by the query's norm times the member's error at most, and by rounding
            norm = np.sqrt((queries**2).sum(1))[:, None]
            reach = norm * (quantiser.value.errors(matrix(mine["vector"]), mine["list"][0].as_py(), codes) + 1e-5 * np.sqrt((vectors**2).sum(1).max()))
            many = min(k + 1, len(codes))
            cut = -np.partition(reach - guess, many - 1, axis=1)[:, many - 1 : many]
            may = guess + reach >= cut
            most = min(k + AGAIN, len(codes))
            np.put_along_axis(may, np.argpartition(-guess, most - 1, axis=1)[:, :most], True, axis=1)
            needed = np.flatnonzero(may.any(0))
            exact = np.where(may[:, needed], queries @ vectors[needed].T, -np.inf)
            last = -np.partition(-exact, many - 1, axis=1)[:, many - 1]
            last -= 1e-12 * (1 + np.abs(last))  # sums in another order
            out: list[tuple[np.ndarray, ...]] = []
            for query_id, query, scores, least in zip(asking.tolist(), queries, exact, last, strict=True):
                again = needed[scores >= least]
                score = (vectors[again] * query).sum(1)
                found, score = ids[A.concat_ranges(first[again], sizes[again])], np.repeat(score, sizes[again])
                best = np.lexsort((found, -score))[: k + 1]
                best = best[found[best] != query_id][:k]
                out.append((np.full(len(best), query_id), found[best], score[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    dealt = held.unionByName(asked).repartition("cell").sortWithinPartitions("cell")
    pairs = dealt.mapInArrow(searched, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
