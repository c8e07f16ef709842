"""Latest rows, pages and limits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order; tasks keep one row a key before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def clamp(n: int, most: int) -> int:
    return max(1, min(n, most))


def page_info(total: int, page: int, size: int) -> dict:
    """Page numbers from 1, at least one page; a page past the end is the last."""
    pages = max(1, math.ceil(total / size))
    page = max(1, min(page, pages))
    return {"total": total, "page": page, "total_pages": pages, "has_next": page < pages, "has_previous": page > 1}


def page(df: DataFrame, order: list, *, page: int, size: int) -> tuple[DataFrame, dict]:
    """One page in a total order, and where it is."""
    size = clamp(size, 200)
    info = page_info(df.count(), page, size)
    return df.orderBy(*order).offset((info["page"] - 1) * size).limit(size), info
