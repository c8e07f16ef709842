"""Trace analytics: pairing of step starts with their ends, durations, running plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seconds_between


def pair_steps(events: DataFrame, *, keys: list[str], order: list[str]) -> DataFrame:
    """A row for each start that its key's next event doesn't replace: completed with its end, or running.

    A start followed by another start of the same key is lost; ends without a start give nothing.
    """
    at = Window.partitionBy(*keys).orderBy(*order)
    steps = events.where(F.col("phase").isin("start", "end"))
    steps = steps.withColumn("_next", F.lead(F.struct("phase", "id", "ts")).over(at))
    steps = steps.where((F.col("phase") == "start") & (F.col("_next").isNull() | (F.col("_next.phase") == "end")))
    status = F.when(F.col("_next").isNull(), "running").otherwise("completed")
    return steps.select(*keys, F.col("id").alias("start_id"), "ts", F.col("_next.id").alias("end_id"), status.alias("status"), seconds_between(F.col("ts"), F.col("_next.ts")).alias("seconds"))


def durations(events: DataFrame, *, keys: list[str], longest: float = 3600.0) -> DataFrame:
    """Starts joined with their key's last end; durations over 0 and up to ``longest`` seconds count."""
    ends = events.where("phase = 'end'").groupBy(*keys).agg(F.max(F.struct("ts", "id"))["ts"].alias("end_ts"))
    both = events.where("phase = 'start'").join(ends, keys).withColumn("seconds", seconds_between(F.col("ts"), F.col("end_ts")))
    return both.where((F.col("seconds") > 0) & (F.col("seconds") <= longest))


def plan_numbers(events: DataFrame, *, key: str, order: list[str]) -> DataFrame:
    """``plan``: how many starts the key has had up to each event."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("plan", F.sum((F.col("phase") == "start").cast("int")).over(upto))


def token_total(events: DataFrame) -> DataFrame:
    """Sum of each event's total, else its usage's total, else prompt and completion; null if none has any."""
    field = lambda p: F.get_json_object("data", f"$.{p}").try_cast("long")
    parts = F.coalesce(field("prompt_tokens"), F.lit(0)) + F.coalesce(field("completion_tokens"), F.lit(0))
    any_part = field("prompt_tokens").isNotNull() | field("completion_tokens").isNotNull()
    return events.agg(F.sum(F.coalesce(field("total_tokens"), field("usage.total_tokens"), F.when(any_part, parts))).alias("tokens"))
