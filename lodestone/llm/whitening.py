"""Whitening of vectors by a singular value decomposition of their centred, distributed rows (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialize, prepare

#: Directions with less than this share of the largest variance are rounding noise and no components.
NOISE = 1e-13
_LONG = float(1 << 62)


def on_grid(vector: Column, scale: int) -> Column:
    """``floor(scale * c)`` of each entry as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def sound(vector: Column) -> Column:
    """Neither null nor with null, NaN or infinite entries."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[list[int | None], np.ndarray]:
    """Sums of ``(n * x - S)**2`` by row: exact (null beyond a long), and as double."""
    wide = n * x.astype(float) - np.array(sums, float)
    rough = (wide * wide).sum(axis=1)
    if (np.abs(x).max(initial=0) * float(n) < _LONG) and max(map(abs, sums), default=0) < _LONG and rough.max(initial=0) < _LONG:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist(), rough
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact], np.array(exact, float)


class Whitening:
    """A fitted space: ``n`` distinct vectors, their sums, unit components and variances, and the total variance."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, variances: np.ndarray):
        self.n, self.sums, self.components, self.variances = n, sums, components, variances

    def apply(self, rows: DataFrame, vector: str = "_x") -> DataFrame:
        """``rows`` (without the vector) with ``deviation``, ``_deviation`` (double) and ``whitened`` (an array)."""
        prepare(rows.sparkSession)
        n, sums, axes, scale = self.n, self.sums, self.components, np.sqrt(self.variances)
        kept = [c for c in rows.columns if c != vector]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean = np.array([float(Decimal(s) / n) for s in sums])
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                exact, rough = _deviations(x, n, sums)
                whitened = (x.astype(float) - mean) @ axes / scale
                yield pa.RecordBatch.from_pydict({c: b.column(c) for c in kept} | {"deviation": pa.array(exact, pa.int64()), "_deviation": pa.array(rough), "whitened": pa.array(list(whitened), pa.list_(pa.float64()))})

        schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), "deviation long", "_deviation double", "whitened array<double>"]
        return rows.mapInArrow(run, ", ".join(schema))


def fit(distinct: DataFrame, n: int, dim: int, k: int) -> Whitening:
    """The space of ``n`` distinct integer vectors ``_x`` of one length.

    Sums are exact.  MLlib decomposes the centred rows, which stay distributed; singular values s give variances s * s / n.  The
    driver holds the ``dim`` sums and a matrix of ``dim`` x ``dim``, whatever the number of rows.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    totals = distinct.select(F.posexplode("_x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in sorted(totals.collect(), key=lambda r: r["at"])]
    mean = F.array(*(F.lit(float(Decimal(s) / n)) for s in sums))
    centred = F.zip_with(F.col("_x").cast("array<double>"), mean, lambda a, b: a - b)
    rows = MLUtils.convertVectorColumnsFromML(distinct.select(array_to_vector(centred).alias("v")), "v")
    # All singular values are asked for, so that the small matrix is decomposed directly, to double precision.
    svd = RowMatrix(rows, n, dim).computeSVD(dim, computeU=False, rCond=0.0)
    variances = svd.s.toArray() ** 2 / n
    number = min(k, int((variances > NOISE * variances[0]).sum()))
    return Whitening(n, sums, svd.V.toArray()[:, :number], variances[:number])


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, k: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each sound row and its first ``k`` components.

    Entries are put on a grid of ``1 / scale``.  The fit takes each distinct grid vector once, so copies don't weigh; rows with equal
    vectors get equal results, and repeated and null ids are carried as they are.  ``explained`` is a component's share of the total
    variance, which comes from the exact deviations and not from the decomposition.  ``identity_error`` measures the whitened fit
    rows' covariance.  Vectors that are null or hold null, NaN or infinite entries are dropped.  Vectors of different
    lengths are spaces of their own, fitted one after the other.  A space has no more components than directions in which its rows vary (of variances that are
    equal any order may come): a single vector, or empty ones, give no rows, nor does an empty table.  A deviation beyond a long is null.  Other columns, whatever their
    names, aren't read.  The fit is a table in the shared folder, read by each pass.
    """
    rows = vectors.where(sound(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), on_grid(F.col(vector_col), scale).alias("_x"))
    distinct = materialize(rows.select("_x").distinct(), "grid-vectors")
    spaces = distinct.groupBy(F.size("_x").alias("dim")).count().where("dim > 0 and count > 1").orderBy("dim").collect()
    parts = [_whitened(rows.where(F.size("_x") == s["dim"]), distinct.where(F.size("_x") == s["dim"]), s["count"], s["dim"], k) for s in spaces]
    if not parts:
        numbers = (F.lit(None).cast(t).alias(c) for c, t in [("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")])
        return rows.where("false").select("vec_id", *numbers)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _whitened(rows: DataFrame, distinct: DataFrame, n: int, dim: int, k: int) -> DataFrame:
    space = fit(distinct, n, dim, k)
    number = len(space.variances)
    own = space.apply(distinct)
    w = [F.get("whitened", F.lit(i)) for i in range(number)]
    pairs = [(i, j) for i in range(number) for j in range(i, number)]
    exact = F.when(F.count("deviation") == F.count("*"), F.sum(F.col("deviation").cast("decimal(38,0)")).cast("double"))
    told = own.agg(F.coalesce(exact, F.sum("_deviation")).alias("total"), *(F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    trace = told["total"] / n / n / n
    error = max(abs(told[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    each = space.apply(rows).select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    explained = F.element_at(F.array(*(F.lit(float(v / trace)) for v in space.variances)), F.col("_k") + 1)
    return each.select("vec_id", (F.col("_k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
