"""A table of immutable files with an index of their keys: changes rewrite only the files that hold changed keys."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import merge as merged

#: Bits for each key of a file's Bloom filter, and how many of them a key sets: some 0.3 % of absent keys pass.
BITS, HASHES = 12, 6
#: Rows that a file is written with.
FILE_ROWS = 250_000
#: A version that is a multiple of this lists all files again, so that no more versions are read than this.
FULL_EVERY = 16
_ENTRY = "file string, low long, high long, rows long, bloom binary, live boolean"


def place(key: Column, kind: str) -> Column:
    """A long in the order of the key: the number itself, or the first seven bytes of a text; null comes first."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        value = key.cast("long")
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        value = F.unix_micros(key.cast("timestamp"))
    else:
        value = F.conv(F.rpad(F.hex(F.substring(key.cast("string").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.coalesce(value, F.lit(-(1 << 63)))


def bits_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The positions that keys, given by 64-bit hashes, set in a filter of ``size`` bits: an array with a row for each key."""
    h = hashes.view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :]) % np.uint64(size)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    flags = np.zeros(max(64, len(hashes) * BITS), bool)
    flags[bits_of(hashes, len(flags)).ravel()] = True
    return np.packbits(flags).tobytes() + len(flags).to_bytes(8, "little")


def passes(filter_bytes: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    size = int.from_bytes(filter_bytes[-8:], "little")
    at = bits_of(hashes, size)
    packed = np.frombuffer(filter_bytes, np.uint8)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


class FileTable:
    """Rows in Parquet files under ``data``; under ``log`` one folder for each version with the files that it adds and removes.

    A file's entry has the range of its rows' places (see :func:`place`, of the first key) and a Bloom filter of its keys.  A version counts from when
    its marker is made, which fails if another writer has made it first; files of a write that died are in no version.
    Keys compare null-safely and may repeat; the first key should follow the order in which rows come (a time, a running id),
    so that changes fall into few ranges.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], file_rows: int = FILE_ROWS):
        self.spark, self.path, self.keys, self.file_rows = spark, path.rstrip("/"), list(keys), file_rows

    # ---- versions

    def _fs(self):  # noqa: ANN202
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _markers(self) -> list[int]:
        fs, Path = self._fs()  # noqa: N806
        at = Path(f"{self.path}/versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        return max(self._markers(), default=0)

    def _told(self, version: int) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{version}").collect()))

    def files(self, version: int | None = None) -> DataFrame:
        """Entries of the version's files: the last full list and what versions since have added and removed."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _ENTRY).drop("live")
        full = (version // FULL_EVERY) * FULL_EVERY or 1
        logs = [self._told(v)["log"] for v in range(full, version + 1)]
        rows = self.spark.read.schema(_ENTRY).parquet(*logs)
        gone = rows.where("not live").select("file")
        return rows.where("live").join(gone, "file", "left_anti").drop("live")

    def _commit(self, version: int, entries: DataFrame, schema: str) -> None:
        log = f"{self.path}/log/{version}-{uuid.uuid4().hex}"
        if version % FULL_EVERY == 0:
            gone = entries.where("not live").select("file")
            entries = self.files(version - 1).join(gone, "file", "left_anti").withColumn("live", F.lit(True)).unionByName(entries.where("live"))
        entries.write.parquet(log)
        fs, Path = self._fs()  # noqa: N806
        out = fs.create(Path(f"{self.path}/versions/{version}"), False)  # fails where another writer was first
        out.writeBytes(json.dumps({"log": log, "schema": schema}))
        out.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The table's rows; their files' names are listed on the driver, as for any scan."""
        version = self.version() if version is None else version
        schema = self._told(version)["schema"]
        names = [r["file"] for r in self.files(version).select("file").toLocalIterator()]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    # ---- writes

    def _key(self, rows: DataFrame) -> tuple[Column, Column]:
        first = self.keys[0]
        return place(F.col(first), dict(rows.dtypes)[first]).alias("_place"), F.xxhash64(*(F.struct(F.col(k)) for k in self.keys)).alias("_hash")

    def _write(self, rows: DataFrame) -> DataFrame:
        """Write rows in order of their places, and give the entries of the new files."""
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        order = self._key(rows)[0]
        rows.withColumn("_place", order).repartitionByRange("_place").sortWithinPartitions("_place").drop("_place").write.option("maxRecordsPerFile", self.file_rows).parquet(at)
        written = self.spark.read.schema(rows.schema).parquet(at)
        spot, key_hash = self._key(written)
        keyed = written.select(F.col("_metadata.file_path").alias("file"), spot, key_hash)

        def entry(part: pd.DataFrame) -> pd.DataFrame:
            spots = part["_place"]
            return pd.DataFrame({"file": [part["file"].iloc[0]], "low": [spots.min()], "high": [spots.max()], "rows": [len(part)], "bloom": [bloom(part["_hash"].to_numpy())], "live": [True]})

        return keyed.groupBy("file").applyInPandas(entry, _ENTRY)

    def create(self, rows: DataFrame) -> None:
        """The first version."""
        self._commit(self.version() + 1, self._write(rows), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))

    def holding(self, changes: DataFrame) -> DataFrame:
        """``file``: those that may hold a key of ``changes``.

        Ranges of all files, two longs each, go to the tasks, where each key finds the files over its place; of these pairs, which
        are few where files hardly overlap, each meets its file's filter.  The rows of the table aren't read.
        """
        told = [(r["file"], r["low"], r["high"]) for r in self.files().select("file", "low", "high").orderBy("low", "file").toLocalIterator()]
        names, low, high = [t[0] for t in told], np.array([t[1] for t in told], np.int64), np.array([t[2] for t in told], np.int64)
        reach = np.maximum.accumulate(high) if len(high) else high

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                spot, hashes = b.column("_place").to_numpy(), b.column("_hash").to_numpy()
                first, last = np.searchsorted(reach, spot, side="left"), np.searchsorted(low, spot, side="right")
                n = np.maximum(last - first, 0)
                key = np.repeat(np.arange(len(spot)), n)
                file = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                over = high[file] >= spot[key] if len(file) else np.zeros(0, bool)
                key, file = key[over], file[over]
                yield pa.RecordBatch.from_arrays([pa.array([names[f] for f in file], pa.string()), pa.array(hashes[key])], ["file", "_hash"])

        pairs = changes.select(*self._key(changes)).distinct().mapInArrow(meet, "file string, _hash long")

        def test(asked: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
            hit = len(asked) and len(entry) and passes(entry["bloom"].iloc[0], asked["_hash"].to_numpy()).any()
            return pd.DataFrame({"file": pd.Series([asked["file"].iloc[0]] if hit else [], dtype=object)})

        return pairs.groupBy("file").cogroup(self.files().select("file", "bloom").groupBy("file")).applyInPandas(test, "file string")

    def _replace(self, changes: DataFrame, next_rows) -> int:  # noqa: ANN001
        version = self.version()
        schema = self._told(version)["schema"]
        touched = [r["file"] for r in self.holding(changes).toLocalIterator()]
        base = self.spark.read.schema(schema).parquet(*touched) if touched else self.spark.createDataFrame([], schema)
        entries = self._write(next_rows(base))
        gone = self.files(version).join(F.broadcast(self.spark.createDataFrame([(f,) for f in touched], "file string")), "file", "left_semi").withColumn("live", F.lit(False))
        self._commit(version + 1, entries.unionByName(gone), schema)
        return len(touched)

    def merge(self, changes: DataFrame, *, keep: Sequence[str] = (), ordinal: str | None = None) -> int:
        """Update all, insert all, as :func:`lodestone.operators.versions.merge`; gives the number of files that were rewritten.

        Files without a changed key stay as they are, under their names; rows with new keys go to files of their own range.
        """
        return self._replace(changes, lambda base: merged(base, changes, self.keys, keep=keep, ordinal=ordinal))

    def delete(self, keys: DataFrame) -> int:
        """Drop the rows whose keys ``keys`` has; gives the number of files that were rewritten."""
        asked = keys.select(*(F.col(k).alias(f"_k_{k}") for k in self.keys)).distinct()
        return self._replace(keys, lambda base: base.join(asked, [base[k].eqNullSafe(asked[f"_k_{k}"]) for k in self.keys], "left_anti"))
