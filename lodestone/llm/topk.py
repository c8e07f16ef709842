"""Exact top-k by aggregating sorted lists without random access (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialize, prepare

#: Depths, as parts of each list, at which bounds are compared.
DEPTHS = (0.5, 0.8, 0.95)
#: Queries whose bounds are held together.
CHUNK = 128
#: Rows whose sorted lists are read together; the next rows start from the scores found before.
LIST_ROWS = 8192


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


class SortedLists:
    """Rows of a block as one sorted list for each component, read from both ends.

    Reading down to a depth moves every list's two cursors: values at or beyond a cursor are known, those
    between the cursors lie between them.
    """

    def __init__(self, rows: np.ndarray):
        self.rows, self.sorted = rows, np.sort(rows, axis=0)

    def cursors(self, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """The last values read from the top and from the bottom."""
        n = len(self.sorted)
        read = min(n, max(1, int(np.ceil(depth * n))))
        return self.sorted[n - read], self.sorted[read - 1]

    def upper(self, at: np.ndarray, depth: float, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """Upper bounds of rows' scores: what isn't read is at most (for negative weights at least) at the cursor."""
        top, bottom = self.cursors(depth)
        return np.maximum(self.rows[at], top) @ up + np.minimum(self.rows[at], bottom) @ down

    def lower(self, at: np.ndarray, depth: float, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """Lower bounds: what isn't read is at the list's far end."""
        top, bottom = self.cursors(depth)
        rows = self.rows[at]
        return np.where(rows >= top, rows, self.sorted[0]) @ up + np.where(rows <= bottom, rows, self.sorted[-1]) @ down


def no_random_access(queries: np.ndarray, query_rows: np.ndarray, candidates: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and of candidates, scores, and the mean depth read for each query: the k best inner products among candidates other than the query's own row.

    The candidates' sorted lists (:class:`SortedLists`) are read in runs of ``LIST_ROWS`` rows.  At each depth, rows
    whose upper bound is under a query's threshold are out: the threshold is the k-th best score that
    earlier runs have resolved, or else the k-th best lower bound.  Rows that no query needs any more
    aren't looked at again, and reading stops when no query has more than 4k rows left; their scores are then resolved.
    Ties go to the smaller id, then to the smaller row.
    """
    d = candidates.shape[1]
    limit = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(d, 1)
    kind = np.float32 if limit < 1 << 24 else np.float64 if limit < 1 << 53 else None
    weights, exact = (queries, candidates) if kind is None else (queries.astype(kind), candidates.astype(kind))
    m = len(queries)
    best_at, best_score, depths = [np.empty(0, np.int64)] * m, [np.empty(0, np.int64)] * m, np.zeros(m)
    for start in range(0, len(candidates), LIST_ROWS):
        block = exact[start : start + LIST_ROWS]
        own_rows, n = rows[start : start + LIST_ROWS], len(block)
        lists = SortedLists(block) if kind is not None and n > 4 * k else None
        for a in range(0, m, CHUNK):
            w, own = weights[a : a + CHUNK], query_rows[a : a + CHUNK]
            at, alive, depth = np.arange(n), own_rows[:, None] != own[None, :], 0.0
            threshold = np.array([s.min() if len(s) == k else -np.inf for s in best_score[a : a + CHUNK]])
            if lists is not None:
                up, down = np.maximum(w, 0).T, np.minimum(w, 0).T
                for depth in DEPTHS:
                    if not np.isfinite(threshold).all():
                        low = lists.lower(at, depth, up, down)
                        low[~alive] = -np.inf
                        threshold = np.maximum(threshold, np.partition(low, len(low) - k, axis=0)[len(low) - k]) if len(low) >= k else threshold
                    alive &= lists.upper(at, depth, up, down) >= threshold
                    needed = alive.any(axis=1)
                    at, alive = at[needed], alive[needed]
                    if not len(at) or alive.sum(axis=0).max() <= 4 * k:
                        break
            depths[a : a + len(w)] += (depth if lists is not None else 1.0) * n
            for q in range(len(w)):
                left = at[alive[:, q]]
                score = (block[left] @ w[q]).astype(np.int64)
                left, score = np.concatenate([best_at[a + q], left + start]), np.concatenate([best_score[a + q], score])
                if len(left) > k:
                    kept = score >= np.partition(score, len(score) - k)[len(score) - k]
                    left, score = left[kept], score[kept]
                order = np.lexsort((rows[left], ids[left], -score))[:k]
                best_at[a + q], best_score[a + q] = left[order], score[order]
    counts = np.fromiter(map(len, best_at), np.int64, m)
    return np.repeat(np.arange(m), counts), np.concatenate([*best_at, np.empty(0, np.int64)]), np.concatenate([*best_score, np.empty(0, np.int64)]), depths / max(1, len(candidates))


def top_k(vectors: DataFrame, is_query: F.Column, *, k: int = 20, scale: float = 64.0, block_rows: int = 65_536, query_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", with_depth: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row, the k best inner products over all other rows.

    Components become floor(``scale`` * x).  The queries are a stated set: blocks of them meet blocks
    of all rows, each pair of blocks is one bounded piece of work in which the lists of one run of rows after another are
    read, and the k best of each block are merged.  Vectors that are null or empty, or hold null or non-finite components, and rows without
    an id, take no part.  Rows that repeat an id are candidates and queries of their own, each query row with
    its own ranks.  Only vectors of a query's own length are its candidates.  Ties go to the smaller id, then to the row
    written first; fewer than k candidates give all; other columns aren't read; an empty table gives no rows.
    ``with_depth`` adds ``depth``, the part of the lists read for the query in the row's block, on average.
    """
    spark = vectors.sparkSession
    prepare(spark)
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) > 0)
    rows = vectors.where(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialize(rows.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, m = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, query_blocks = -(-n // block_rows) or 1, -(-m // query_rows) or 1
    of = lambda many: F.pmod(F.xxhash64("row"), F.lit(many))
    all_of = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<long>"))
    left = rows.where("q").select("dim", of(query_blocks).alias("qb"), all_of(blocks).alias("cb"), "row", "vec_id", "v")
    # The sides have columns of their own: Spark prunes shared ones from one side.
    right = rows.select(F.col("dim").alias("dim2"), all_of(query_blocks).alias("qb2"), of(blocks).alias("cb2"), F.col("row").alias("row2"), F.col("vec_id").alias("vec_id2"), F.col("v").alias("v2"))

    def work(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names = ["_query", "query_id", "_row", "vec_id", "score", "depth"]
        if not queries.num_rows or not candidates.num_rows:
            return pa.table([pa.array([], t) for t in [pa.int64()] * 5 + [pa.float64()]], names=names)
        qr, qi, cr, ci = (t.column(c).to_numpy() for t, c in ((queries, "row"), (queries, "vec_id"), (candidates, "row2"), (candidates, "vec_id2")))
        q, c, score, depth = no_random_access(_matrix(queries, "v"), qr, _matrix(candidates, "v2"), ci, cr, k)
        return pa.table([pa.array(x) for x in (qr[q], qi[q], cr[c], ci[c], score, depth[q])], names=names)

    near = left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim2", "qb2", "cb2")).applyInArrow(work, "_query long, query_id long, _row long, vec_id long, score long, depth double")
    best = Window.partitionBy("_query").orderBy(F.col("score").desc(), "vec_id", "_row")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", *(["depth"] if with_depth else []))
