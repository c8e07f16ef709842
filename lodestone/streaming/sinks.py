"""A sink that takes each micro-batch once, whatever dies in between."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class OnceSink:
    """Rows of a stream under ``rows/batch=N``, with a marker in ``pending`` while batch N is written and one in ``done`` when it counts.

    Spark repeats a batch that it hasn't logged as finished under the same number and with the same rows.  A batch that is done is left
    as it is; one that was pending is written anew over whatever the dead attempt has left.  Readers see batches that are done.  With
    ``clock``, a done marker also holds the highest time so far, and rows up to that time are left out of later batches: a source that
    delivers old messages again after a restart adds nothing.  ``fail`` is called between a batch's write and its marker (for tests).
    """

    def __init__(self, spark: SparkSession, path: str, *, clock: str | None = None, fail: Callable[[int], None] | None = None):
        self.spark, self.path, self.clock, self.fail = spark, path.rstrip("/"), clock, fail

    def _fs(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self, folder: str) -> list[int]:
        fs, Path = self._fs()  # noqa: N806
        at = Path(f"{self.path}/{folder}")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []

    def done(self) -> list[int]:
        return self._numbers("done")

    def pending(self) -> list[int]:
        """Batches whose write has begun and that don't count yet."""
        return sorted(set(self._numbers("pending")) - set(self.done()))

    def _mark(self, folder: str, batch: int, told: dict, replace: bool) -> None:
        fs, Path = self._fs()  # noqa: N806
        out = fs.create(Path(f"{self.path}/{folder}/{batch}"), replace)
        out.writeBytes(json.dumps(told))
        out.close()

    def high_water(self, before: int | None = None) -> str | None:
        """The highest time of the batches that are done (those before a number), as ISO text in UTC; null if none has one."""
        earlier = [b for b in self.done() if before is None or b < before]
        if not earlier:
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/done/{earlier[-1]}").collect()))["mark"]

    def write(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        if batch in self.done():
            return
        self._mark("pending", batch, {}, True)
        mark = self.high_water(batch)
        if self.clock and mark:
            rows = rows.where(F.col(self.clock) > F.lit(mark).cast("timestamp"))
        at = f"{self.path}/rows/batch={batch}"
        rows.write.mode("overwrite").parquet(at)
        if self.clock:
            newest = self.spark.read.schema(rows.schema).parquet(at).agg(F.date_format(F.max(self.clock), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).first()[0]
            mark = newest or mark
        if self.fail:
            self.fail(batch)
        self._mark("done", batch, {"mark": mark}, False)

    def read(self, schema) -> DataFrame:  # noqa: ANN001
        """The rows of the batches that are done."""
        batches = self.done()
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/rows/batch={b}" for b in batches)) if batches else self.spark.createDataFrame([], schema)


def drain(stream: DataFrame, sink: OnceSink, checkpoint: str) -> None:
    """Run what is there through the sink, from where the last run with this checkpoint stopped."""
    stream.writeStream.foreachBatch(sink.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
