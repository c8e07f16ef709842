"""Distinct counts and quantiles by day from stored sketches that merge."""

from __future__ import annotations

import contextlib
import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a distinct-count sketch, as a power of two: a relative standard error of 0.8 %, and exact below some 3,000 values.
DISTINCT_POWER = 14
#: Size of a quantile sketch: a rank is off by 0.7 % at most with 99 % confidence.
QUANTILE_SIZE = 400


class SketchStore:
    """A folder with one row of sketches for each day and key, in a folder for each day.

    Days are added once and never read again to extend or merge; a day that is added anew replaces what is there, so a load that is
    repeated counts once.  A range reads its days' folders and merges their sketches, whose size doesn't grow with the rows.

    With ``exact``, each day's different items are kept in a folder beside the sketches, and ranges count them instead of estimating.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], *, exact: bool = False):
        self.spark, self.path, self.keys, self.exact = spark, path.rstrip("/"), list(keys), exact

    def add(self, rows: DataFrame, *, day: str = "day", item: str = "item", value: str = "value") -> None:
        """Sketch the rows of whole days: distinct ``item``, quantiles of ``value`` (double), and exact counts, least and greatest values.

        Null items and values aren't counted in their sketches; rows with a null day or key form groups of their own, as in any grouping.
        """
        n = rows.groupBy(F.col(day).alias("day"), *self.keys).agg(
            F.count("*").alias("n"), F.count(value).alias("values"), F.min(value).alias("least"), F.max(value).alias("greatest"),
            F.hll_sketch_agg(item, DISTINCT_POWER).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_SIZE).alias("levels"),
        )
        with _dynamic(self.spark):
            n.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(self.path)
            if self.exact:
                # Null items stay, so that each day that comes anew has a folder that replaces its former one.
                each = rows.select(F.col(day).alias("day"), *self.keys, F.col(item).alias("item")).distinct()
                each.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}-items")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def between(self, low, high, *, by: Sequence[str] | None = None, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:  # noqa: ANN001
        """``by`` (the store's keys, or some of them), ``n, least, greatest, items`` (distinct, estimated unless the store is exact) and ``q<percent>`` for the days from low to high, both included."""
        by = self.keys if by is None else list(by)
        within = F.col("day").between(F.lit(low), F.lit(high))
        days = self.rows().where(within)
        merged = days.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("values").alias("_values"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.hll_sketch_estimate(F.hll_union_agg("items")).alias("items"), F.kll_merge_agg_double("levels").alias("_levels"))
        if self.exact:
            each = self.spark.read.parquet(f"{self.path}-items").where(within)
            counted = each.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count_distinct("item").alias("items"))
            same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.lit(True))
            merged = merged.drop("items").join(counted, same)
        told = [F.when(F.col("_values") > 0, F.kll_sketch_get_quantile_double("_levels", F.lit(float(q)))).alias(f"q{round(100 * q)}") for q in quantiles]
        return merged.select(*by, "n", "least", "greatest", "items", *told)


@contextlib.contextmanager
def _dynamic(spark: SparkSession):  # noqa: ANN202
    """Writes replace the folders that they write to, and no others."""
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)
