"""Functions that SQL text can call: scalar, vectorised and table-valued."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars

CATEGORIES: dict[str, list[str]] = {}


@F.pandas_udf(T.LongType())
def twice(values: pd.Series) -> pd.Series:
    return values * 2


class SplitParts:
    """One row for each part of a text."""

    def eval(self, text: str, separator: str):  # noqa: ANN201
        for part in text.split(separator):
            yield (part,)


def register_functions(spark: SparkSession) -> None:
    """Register all functions; names by category are in ``CATEGORIES``."""
    spark.udf.register("twice", twice)
    spark.udf.register("canonical_json", scalars.canonical_json)
    spark.udf.register("json_depth", scalars.json_depth)
    spark.udtf.register("split_parts", F.udtf(SplitParts, returnType="part string"))
    CATEGORIES.update(scalar=["twice", "canonical_json", "json_depth"], table=["split_parts"])
