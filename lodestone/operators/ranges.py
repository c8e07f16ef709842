"""As-of and interval joins from built-in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, *, by: list[str], on: str, tie: str) -> DataFrame:
    """Each left row with the last right row of its key at or before it: ``right_<column>``, null where there is none.

    One union and one window: one shuffle by key, and no pairs are made.
    """
    values = [c for c in right.columns if c not in by]
    a = left.withColumn("_right", F.lit(None).cast(_struct(right, values))).withColumn("_side", F.lit(1))
    b = right.select(*by, on, F.col(tie), F.struct(*values).alias("_right")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    upto = Window.partitionBy(*by).orderBy(on, tie, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_right", F.last("_right", ignorenulls=True).over(upto)).where("_side = 1")
    return out.select(*left.columns, *(F.col(f"_right.{c}").alias(f"right_{c}") for c in values))


def _struct(df: DataFrame, columns: list[str]):
    from pyspark.sql import types as T

    return T.StructType([df.schema[c] for c in columns])


def interval_join(intervals: DataFrame, points: DataFrame, *, width: float, low: str = "low", high: str = "high", x: str = "x") -> DataFrame:
    """Intervals with the points in them: both go to buckets of ``width``, an equi-join does the rest.

    An interval is in each bucket that it touches, a point in one, so no pair comes twice.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    left = intervals.withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high))))
    right = points.withColumn("_b", bucket(x))
    return left.join(right, "_b").where((F.col(x) >= F.col(low)) & (F.col(x) <= F.col(high))).drop("_b")
