"""Arrow batches on their way to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a batch, unless the session sets another bound, and rows of which a worker holds the results at a time.
BATCH_BYTES, PIECE_ROWS = 4 << 20, 64
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of batches: by rows alone, what a worker holds follows the length of texts and the size of tasks."""
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
