"""Retrieval: exact vector top-k, BM25, substring fallback, fusion, reranking, context rendering."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import dense_score, min_max, sparse_score
from .graphs import cut_lineage

K1, B = 1.2, 0.75


def check_top_k(k: int) -> int:
    if not 1 <= k <= 1000:
        raise ValueError("top_k must be 1..1000")
    return k


def check_query_vector(vector: Sequence[float]) -> list[float]:
    """A non-empty list of finite numbers."""
    if not isinstance(vector, list | tuple) or not vector:
        raise ValueError("a query vector is a non-empty list")
    if any(isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v) for v in vector):
        raise ValueError("a query vector holds finite numbers")
    return [float(v) for v in vector]


def squared_l2(vector: Column, query: Sequence[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector.cast("array<double>"), q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def vector_top_k(df: DataFrame, query: Sequence[float], k: int, *, key: Sequence[str], vector: str = "vector", where: Column | None = None) -> DataFrame:
    """The k nearest rows after the filter: ``key``, ``distance`` (squared) and ``score``; ties by key.

    A projection and TakeOrderedAndProject: no shuffle, k rows from each task.
    """
    q = check_query_vector(query)
    rows = df if where is None else df.where(where)
    rows = rows.withColumn("distance", squared_l2(F.col(vector), q)).withColumn("score", dense_score(F.col("distance"))).drop(vector)
    return rows.orderBy("distance", *key).limit(check_top_k(k))


def term_count(lowered: Column, term: str) -> Column:
    """Occurrences of a term as a whole word between white space."""
    return F.regexp_count(lowered, F.lit(rf"{re.escape(term)}(?![^ \t\n\r])(?<![^ \t\n\r]{re.escape(term)})"))


def bm25(df: DataFrame, terms: Sequence[str], *, text: str = "text", where: Column | None = None) -> DataFrame:
    """Rows and their ``raw`` BM25 score; zero where no term occurs.

    Counts only the query's terms, so no tokens are exploded and nothing is shuffled: one pass
    for lengths and document frequencies (one row), one to score.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    rows = df if where is None else df.where(where)
    tf = [F.col(f"_tf{k}") for k in range(len(terms))]
    counts = {f"_tf{k}": term_count(F.lower(text), t) for k, t in enumerate(terms)}
    rows = rows.withColumns(counts | {"_len": F.regexp_count(text, F.lit(r"[^ \t\n\r]+"))})
    stats = rows.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *(F.count_if(c > 0).alias(f"df{k}") for k, c in enumerate(tf))).first()
    total = F.lit(0.0)
    for k, c in enumerate(tf):
        idf = math.log(1 + (stats["n"] - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5))
        total = total + F.lit(idf) * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("_len") / F.lit(stats["avg"] or 1.0)))
    return rows.withColumn("raw", total).drop("_len", *counts)


def text_top_k(df: DataFrame, terms: Sequence[str], k: int, *, key: Sequence[str], text: str = "text", where: Column | None = None) -> DataFrame:
    scored = bm25(df, terms, text=text, where=where).withColumn("score", sparse_score(F.col("raw")))
    # Rows without a term come last, so they can go after the cut; before it, the counts would be computed twice.
    return scored.orderBy(F.round("raw", 9).desc(), *key).limit(check_top_k(k)).where("raw > 0")


def substring_top_k(df: DataFrame, needle: str, k: int, *, key: Sequence[str], text: str = "text", where: Column | None = None) -> DataFrame:
    """Rows that hold the text literally, in order of key, each with score 1."""
    rows = df if where is None else df.where(where)
    return rows.where(F.col(text).contains(needle)).withColumn("score", F.lit(1.0)).orderBy(*key).limit(check_top_k(k))


def search_text(df: DataFrame, query: str, k: int, *, key: Sequence[str], text: str = "text", where: Column | None = None) -> DataFrame:
    """BM25, or the substring search where that finds nothing."""
    found = text_top_k(df, query.split(), k, key=key, text=text, where=where).drop("raw")
    return found if not found.isEmpty() else substring_top_k(df, query, k, key=key, text=text, where=where)


def ranked(df: DataFrame, *, score: str = "score", key: Sequence[str]) -> DataFrame:
    """``rank`` from 1 over a list of at most k rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.round(score, 12).desc(), *key)))


def rrf(lists: Sequence[DataFrame], *, key: Sequence[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: ``key`` and ``score``."""
    parts = [d.select(*key, (1.0 / (F.lit(float(k)) + F.col("rank"))).alias("_s")) for d in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*key).agg(F.sum("_s").alias("score"))


def linear(dense: DataFrame, sparse: DataFrame, *, key: Sequence[str], weights: tuple[float, float] = (0.5, 0.5), normalize: bool = True) -> DataFrame:
    """Weighted sum of both lists' scores, each scaled to 0..1 first, and the sums scaled again."""
    whole = Window.partitionBy()
    scaled = lambda d, w: d.select(*key, (F.lit(w) * (min_max(F.col("score"), whole) if normalize else F.col("score"))).alias("_s"))
    both = scaled(dense, weights[0]).unionByName(scaled(sparse, weights[1])).groupBy(*key).agg(F.sum("_s").alias("score"))
    flat = F.when(F.col("score") > 0, 1.0).otherwise(0.0)
    return both.withColumn("score", min_max(F.col("score"), whole, flat))


def hybrid(df: DataFrame, texts: DataFrame, query_vector: Sequence[float], terms: Sequence[str], k: int, *, key: Sequence[str], method: str = "rrf", where: Column | None = None, where_texts: Column | None = None) -> DataFrame:
    """Both searches at twice k, fused and cut at k, with each list's own score and rank.

    ``where`` filters the vectors and ``where_texts`` the texts (a tenant, a collection) before they are ranked.  Each
    search runs once: its few rows are a checkpoint, which fusion and the lists' own scores read.
    """
    texts = texts if where_texts is None else texts.where(where_texts)
    dense = cut_lineage(ranked(vector_top_k(df, query_vector, min(1000, 2 * k), key=key, where=where).select(*key, "score"), key=key))
    sparse = cut_lineage(ranked(text_top_k(texts, terms, min(1000, 2 * k), key=key).select(*key, "score"), key=key))
    fused = rrf([dense, sparse], key=key) if method == "rrf" else linear(dense, sparse, key=key)
    own = lambda d, n: d.select(*key, F.col("score").alias(f"{n}_score"), F.col("rank").alias(f"{n}_rank"))
    out = fused.join(own(dense, "vector"), list(key), "left").join(own(sparse, "text"), list(key), "left")
    return out.orderBy(F.round("score", 9).desc(), *key).limit(check_top_k(k))


def rerank_by_rrf(results: DataFrame, *, key: Sequence[str], k: int | None = None) -> DataFrame:
    """Fuse the two score columns of results again, with ranks among these results."""
    both = [ranked(results.where(F.col(c).isNotNull()).select(*key, F.col(c).alias("score")), key=key) for c in ("vector_score", "text_score")]
    out = rrf(both, key=key).orderBy(F.round("score", 9).desc(), *key)
    return out.limit(k) if k else out


def map_reranked(texts: DataFrame, results: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Results in the order of a reranker's texts: equal texts are taken in their order, unnamed results follow."""
    t = texts.withColumn("_n", F.row_number().over(Window.partitionBy("text").orderBy("position")))
    r = results.withColumn("_n", F.row_number().over(Window.partitionBy("text").orderBy(*key)))
    return r.join(t.select("text", "_n", "position"), ["text", "_n"], "left").orderBy(F.col("position").asc_nulls_last(), *key).drop("_n")


def top_k_per_group(df: DataFrame, query: Sequence[float], k: int, *, group: str, key: Sequence[str], vector: str = "vector") -> DataFrame:
    """The k nearest of each collection in one job; tasks keep k rows a group before the shuffle."""
    rows = df.withColumn("distance", squared_l2(F.col(vector), check_query_vector(query))).drop(vector)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("distance", *key))).where(F.col("rank") <= k)


def within_distance(df: DataFrame, query: Sequence[float], k: int, threshold: float, *, key: Sequence[str], vector: str = "vector") -> DataFrame:
    """Note search: the k nearest, of which those at most ``threshold`` away."""
    return vector_top_k(df, query, k, key=key, vector=vector).where(F.col("distance") <= threshold)


def render_context(results: DataFrame, *, with_metadata: bool = False) -> DataFrame:
    """One row: results by rank as ``[i]`` and text, a line of dashes between."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"))
    if with_metadata:
        head = F.concat(head, F.format_string(" (score %.4f)", F.col("score")))
    item = F.concat(head, F.lit("\n"), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("rank").alias("r"), item.alias("t"))))
    return results.agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n---\n").alias("context"))


def index_choice(rows: Column) -> Column:
    """Scan below 50,000 rows, a graph index below ten million, else inverted lists."""
    return F.when(rows < 50_000, "none").when(rows < 10_000_000, "hnsw").otherwise("ivf_pq")


def needs_reindex(rows: Column, unindexed: Column, upserted: Column, immediate: bool = False) -> Column:
    return F.lit(immediate) | (upserted >= 1000) | (unindexed > 10_000) | (unindexed / F.greatest(rows, F.lit(1)) > 0.05)


def approximate_top_k(df: DataFrame, query: Sequence[float], k: int, *, key: str, vector: str = "vector", length: float = 0.5, tables: int = 8) -> DataFrame:
    """Nearest neighbours by random projections, for tables too large to scan; recall depends on ``length`` and ``tables``."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=length, numHashTables=tables, seed=7).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense(check_query_vector(query)), k, distCol="l2")
    return near.select(key, (F.col("l2") * F.col("l2")).alias("distance"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embedding_of(payload: pd.Series) -> pd.Series:
    """The first vector in a JSON payload: a list, a list of lists, or objects with an embedding or data; null where there is none."""
    import json

    def find(x):  # noqa: ANN001, ANN202
        if isinstance(x, dict):
            return next((v for k in ("embedding", "vector", "data", "embeddings") if k in x and (v := find(x[k])) is not None), None)
        if isinstance(x, list) and x:
            numbers = all(isinstance(v, int | float) and not isinstance(v, bool) for v in x)
            return [float(v) for v in x] if numbers else find(x[0])
        return None

    def one(s):  # noqa: ANN001, ANN202
        try:
            return find(json.loads(s))
        except (TypeError, ValueError):
            return None

    return payload.map(one)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in for an embedding model: 16 signed counts of hashed words, scaled to length 1."""
    import zlib

    import numpy as np

    def one(t):  # noqa: ANN001, ANN202
        v = np.zeros(16, np.float32)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h & 15] += 1 if h >> 4 & 1 else -1
        return v / (np.linalg.norm(v) or 1)

    return texts.map(one)
