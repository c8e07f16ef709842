"""Structured Streaming operators over an event stream with ``ts`` and a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 64) -> DataFrame:
    """A stream of a table's files; ``ts`` becomes an instant."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # A file source lists a folder: a single file is found by its name there.
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(folder).isFile()
    rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def tumbling(events: DataFrame, width: str, late: str, *, by: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window (sliding where ``slide`` is given)."""
    keys = [F.window("ts", width, slide) if slide else F.window("ts", width)] + ([F.col(by)] if by else [])
    out = events.withWatermark("ts", late).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.unix_seconds("window.start").alias("start"), *([by] if by else []), "n", "total")


def sessions(events: DataFrame, gap: str, late: str, *, by: str) -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return out.select(by, F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Rows with keys not seen within the watermark: replays are dropped by id, not by time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def after_mark(events: DataFrame, mark) -> DataFrame:
    """Rows after a high-water mark."""
    return events.where(F.col("ts") > F.lit(mark))


def running_totals(events: DataFrame, *, by: str, value: str) -> DataFrame:
    """Totals, last id and count of each key, for update or complete mode."""
    return events.groupBy(by).agg(F.sum(value).alias("total"), F.max("event_id").alias("token"), F.count("*").alias("n"))


_STATE = T.StructType([T.StructField("start_id", T.LongType()), T.StructField("start_us", T.LongType())])
_PAIRS = "task_id long, start_id long, end_id long, status string, seconds double"


def pair_steps(events: DataFrame, *, timeout_ms: int | None = None) -> DataFrame:
    """Start/end pairs of a stream with ``task_id, id, phase, ts``: completed at the end, running when a batch leaves a start open.

    A later start replaces an open one; an end without a start gives nothing.  With a timeout, a start open for
    so long is emitted as ``expired`` and forgotten; such a query runs until it is stopped, since
    there may always be another timeout to come.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        start = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if start:
                yield pd.DataFrame([(key[0], start[0], None, "expired", None)], columns=["task_id", "start_id", "end_id", "status", "seconds"])
            return
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples():
            us = row.ts.value // 1000
            if row.phase == "start":
                start = (row.id, us)
            elif row.phase == "end" and start:
                out.append((key[0], start[0], row.id, "completed", (us - start[1]) / 1e6))
                start = None
        if start:
            state.update(start)
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
            out.append((key[0], start[0], None, "running", None))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["task_id", "start_id", "end_id", "status", "seconds"]).astype({"end_id": "Int64"})

    return events.groupBy("task_id").applyInPandasWithState(step, _PAIRS, _STATE, "update", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")


def broadcast_updates(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    """Start a query that hands each micro-batch to ``send``."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(send).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, *, mode: str = "complete") -> DataFrame:
    """Run what is there to the end, and read the result from the sink's folder.

    In complete and update mode each batch is written to a folder of its own.  Complete mode's
    last folder is the result; update mode's folders together are the changes.
    """
    spark = stream.sparkSession
    checkpoint = f"{path}/checkpoint"
    if mode == "append":
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    batches: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        batches.append(batch)

    broadcast_updates(stream, write, checkpoint, mode).awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    chosen = batches[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(stream.schema).parquet(*(f"{path}/rows/batch={b}" for b in chosen))
