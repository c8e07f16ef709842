"""A vector index: inverted lists around k-means centres, with product-quantised codes and exact re-ranking."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import check_top_k

#: Rows that the centres and codebooks are fitted on, at most; every row is indexed.
FIT_ROWS = 20_000
#: Queries by which the number of probed lists is chosen, and the share of their neighbours that must lie in these.
TRIALS, WITHIN = 64, 0.97
#: Codes of a list that one task holds; longer lists are dealt to several.
CHUNK = 50_000
CODEWORDS = 256


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def closest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The places of the ``n`` nearest centres of each row, nearest first; a bounded number of distances is held."""
    step = max(1, (8 << 20) // max(1, len(centres)))
    parts = (squared(x[k : k + step], centres) for k in range(0, max(1, len(x)), step))
    pick = (lambda d: d.argmin(1)[:, None]) if n == 1 else (lambda d: np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate([pick(d) for d in parts])


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of ``x`` by k-means; those that lose all their rows stay where they are."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = closest(x, centres)[:, 0]
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class VectorIndex:
    """An index in a folder that driver and executors share.

    ``centres`` (k-means on a sample) split the vectors into lists; of each vector its difference from the centre is kept as one byte
    for each of ``parts`` sections, the nearest word of the section's codebook.  ``lists`` holds, in a folder for each list, ids, codes
    and vectors; a search reads the codes of the lists that it probes, and the vectors of the candidates.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.centres = self.books = None
        self.probes = 1

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def fit(self, rows: DataFrame, *, key: str = "chunk_id", vector: str = "vector", lists: int | None = None, section: int = 4, k: int = 10) -> VectorIndex:
        """Fit centres and codebooks on at most ``FIT_ROWS`` rows, and choose how many lists to probe for ``WITHIN`` of the ``k`` nearest.

        ``section`` is the number of dimensions of a codebook.  Rows with null or non-finite vectors take no part.  The sample is
        drawn by hash of the key, so a repeated fit gives the same index.
        """
        good = self._sound(rows, key, vector)
        n = good.count()
        if not n:
            raise ValueError("an index needs a vector")
        sample = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, FIT_ROWS / n))).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
        told = sample.toPandas()
        x = np.stack(told["vector"].to_numpy()).astype(float)
        self.centres = lloyd(x, lists or max(1, min(2048, round(math.sqrt(n)))))
        near = closest(x, self.centres)[:, 0]
        rest = x - self.centres[near]
        bounds = [(a, min(a + section, self.dim)) for a in range(0, self.dim, section)]

        def book(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p in b.column("id").to_pylist():
                    words = lloyd(rest[:, bounds[p][0] : bounds[p][1]], CODEWORDS)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(words)), pa.array(list(words), pa.list_(pa.float64()))], ["part", "piece"])

        # One task fits each section's codebook, from the sample that goes with it.
        fitted = self.spark.range(0, len(bounds), 1, len(bounds)).mapInArrow(book, "part long, piece array<double>").toPandas()
        self.books = [np.stack(fitted[fitted["part"] == p]["piece"].to_numpy()) for p in range(len(bounds))]
        self.probes = self._needed_probes(good, x[:TRIALS], k)
        return self

    def _sound(self, rows: DataFrame, key: str, vector: str) -> DataFrame:
        v = F.col(vector)
        return rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))).select(F.col(key).cast("long").alias("id"), v.cast("array<float>").alias("vector"))

    def _needed_probes(self, rows: DataFrame, trials: np.ndarray, k: int) -> int:
        """How many lists, in order of their centres' distance, hold ``WITHIN`` of the trials' true neighbours: one scan of all rows."""
        centres = self.centres

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((len(trials), 0)), np.zeros((len(trials), 0), np.int64)
            for b in batches:
                x = _matrix(b.column("vector"))
                d, at = np.hstack((held[0], squared(trials, x))), np.hstack((held[1], np.tile(closest(x, centres)[:, 0], (len(trials), 1))))
                top = np.argsort(d, axis=1, kind="stable")[:, :k]
                held = np.take_along_axis(d, top, 1), np.take_along_axis(at, top, 1)
            width = held[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(trials)), width)), pa.array(held[0].ravel()), pa.array(held[1].ravel())], ["trial", "d", "list"])

        best = rows.select("vector").mapInArrow(nearest, "trial long, d double, list long")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("trial").orderBy("d"))).where(F.col("rank") <= k).toPandas()
        order = np.argsort(np.argsort(squared(trials, centres), axis=1), axis=1)
        depth = np.sort(order[best["trial"], best["list"]])
        return int(depth[max(0, math.ceil(WITHIN * len(depth)) - 1)]) + 1

    def add(self, rows: DataFrame, *, key: str = "chunk_id", vector: str = "vector") -> None:
        """Index a batch of rows with new ids; what is there isn't read or written.  Vectors of another length are an error of the job."""
        centres, books, dim = self.centres, self.books, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                if set(b.column("vector").value_lengths().to_numpy()) != {dim}:
                    raise ValueError(f"vectors of this index have {dim} entries")
                x = _matrix(b.column("vector"))
                near = closest(x, centres)[:, 0]
                rest, at, codes = x - centres[near], 0, []
                for words in books:
                    codes.append(closest(rest[:, at : at + words.shape[1]], words)[:, 0].astype(np.uint8))
                    at += words.shape[1]
                packed = np.stack(codes, 1).tobytes()
                code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(books)), b.num_rows, [None, pa.py_buffer(packed)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), code, b.column("vector"), pa.array(near.astype(np.int32))], ["id", "code", "vector", "list"])

        coded = self._sound(rows, key, vector).mapInArrow(run, "id long, code binary, vector array<float>, list int")
        at = f"{self.path}/lists/segment={uuid.uuid4().hex}"
        # Rows of a list go together; a list with very many goes to several tasks.
        coded.hint("rebalance", "list").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(at)

    def rows(self) -> DataFrame:
        """``id, code, vector, segment, list``; a filter on ``list`` prunes folders."""
        return self.spark.read.schema("id long, code binary, vector array<float>, segment string, list int").parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int, *, key: str = "query_id", vector: str = "vector", probes: int | None = None, refine: int = 10) -> DataFrame:
        """``query_id, rank, id, distance``: for each query the ``k`` nearest by exact squared distance among the ``refine * k`` nearest by code.

        Queries meet the codes of the ``probes`` lists whose centres are nearest; distances to codes are sums from one table for each query and
        list.  Ties go to the smaller id.  Queries with null or non-finite vectors give no rows.
        """
        check_top_k(k)
        centres, books, wanted = self.centres, self.books, min(probes or self.probes, len(self.centres))
        asked = self._sound(queries, key, vector)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = closest(_matrix(b.column("vector")), centres, wanted)
                    at = pa.array(np.repeat(np.arange(b.num_rows), wanted))
                    yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("vector").take(at), pa.array(near.ravel().astype(np.int32))], ["query_id", "query", "list"])

        probed = asked.mapInArrow(spread, "query_id long, query array<float>, list int")
        lists = [r[0] for r in probed.select("list").distinct().collect()]
        rows = self.rows().where(F.col("list").isin(lists))
        sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        dealt = rows.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", "code")
        probed = probed.join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "query_id", "query")
        many = refine * k

        def near_codes(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(held):
                return pd.DataFrame({"query_id": [], "id": [], "rough": [], "list": []})
            codes = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1)
            ids, at, numbers = held["id"].to_numpy(), int(held["list"].iloc[0]), asked["query_id"].to_numpy()
            rest, n = np.stack(asked["query"].to_numpy()).astype(float) - centres[at], min(many, len(held))
            out, step = [], max(1, (4 << 20) // len(held))
            for k in range(0, len(rest), step):
                some, place = rest[k : k + step], 0
                d = np.zeros((len(some), len(held)))
                for p, words in enumerate(books):
                    d += squared(some[:, place : place + words.shape[1]], words)[:, codes[:, p]]
                    place += words.shape[1]
                top = np.argpartition(d, n - 1, axis=1)[:, :n]
                out.append(pd.DataFrame({"query_id": np.repeat(numbers[k : k + step], n), "id": ids[top].ravel(), "rough": np.take_along_axis(d, top, 1).ravel(), "list": at}))
            return pd.concat(out)

        rough = probed.groupBy("list", "chunk").cogroup(dealt.groupBy("list", "chunk")).applyInPandas(near_codes, "query_id long, id long, rough double, list int")
        best = rough.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rough", "id"))).where(F.col("_n") <= many).select("query_id", "id", "list")
        exact = best.join(rows.select("list", "id", "vector"), ["list", "id"]).join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), "query_id")
        distance = F.aggregate(F.zip_with(F.col("vector").cast("array<double>"), F.col("query").cast("array<double>"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        ranked = exact.select("query_id", "id", distance.alias("distance")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
