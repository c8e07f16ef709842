"""Shared scratch tables and worker set-up used by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch on its way to a Python worker, unless the session sets another bound.
BATCH_BYTES = 4 << 20
_MADE: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and bound the bytes of their batches."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; the setting is made here only where it is unset, and only for a local master.

    Written tables are immutable and stay until :func:`sweep` or the owner of that folder removes them, so that a
    result can be read again after executors are lost.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    _MADE.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def mark() -> int:
    """How many paths have been handed out: what :func:`sweep` takes."""
    return len(_MADE)


def latest() -> str:
    """The path handed out last."""
    return _MADE[-1]


def sweep(spark: SparkSession, since: int, keep: str | None = None) -> None:
    """Remove the tables written after the mark, but for ``keep``: call it when no result that reads them is needed."""
    discard(spark, [x for x in _MADE[since:] if x != keep])


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _MADE.remove(path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The column that :func:`numbered` adds.
ROW = "__row"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of each row's own (``ROW``), so that a decision about a row can be joined whatever its id is.

    Rows of a file scan are numbered by their file and their place in it, which need no copy; other rows are written once.
    """
    try:
        files = df.select(F.col("_metadata.file_path").alias("__file")).distinct()
        placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return materialize(df.withColumn(ROW, F.monotonically_increasing_id()), name)
    # The names of the files, which the driver has listed, meet in one task and get running numbers there.
    files = ids_side(materialize(files.coalesce(1).select("__file", F.monotonically_increasing_id().alias("__no")), name), 100_000)
    return placed.join(files, "__file").select(*df.columns, (F.shiftleft("__no", 36) + F.col("__at")).alias(ROW))


#: Ids up to this number (some 32 MB as a hash table of longs) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def ids_side(ids: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """A written table of one long column (or of few, with fewer ``rows``) as a join side: broadcast where its rows, counted here, are few enough."""
    return F.broadcast(ids) if ids.count() <= rows else ids


#: Rows with one key that go to one task of :func:`spread_join`.
KEY_ROWS = 50_000


def spread_join(rows: DataFrame, side: DataFrame, key: str, heavy: int = KEY_ROWS) -> DataFrame:
    """``rows`` (a written table) left-joined with ``side``: one row for each key, with ``_rows``, the number of rows that have it.

    Keys with more than ``heavy`` rows, such as the key of a text with very many copies, are dealt over several tasks, and their one row
    of ``side`` is repeated for each; rows with a null key, which match none, are spread too.
    """
    hot = materialize(side.where(F.col("_rows") > heavy).select(key, F.ceil(F.col("_rows") / heavy).cast("long").alias("_salts")), "heavy-keys")
    hot = ids_side(hot)
    number, none = F.monotonically_increasing_id(), F.lit(0).cast("long")
    salt = F.when(F.col(key).isNull(), number).otherwise(F.coalesce(F.pmod(number, F.col("_salts")), none))
    dealt = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_salts")
    parts = F.explode(F.sequence(none, F.coalesce("_salts", F.lit(1).cast("long")) - 1))
    side = side.drop("_rows").join(hot, key, "left").withColumn("_salt", parts).drop("_salts")
    return dealt.join(side, [key, "_salt"], "left").drop("_salt")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the writes within; names with __ for the dots."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
