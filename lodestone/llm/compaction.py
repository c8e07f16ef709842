"""A table of immutable shards with size-tiered compaction and versioned manifests (operator 6): DataFrame functions only.

Layout under the table's folder: ``data/<run>/...parquet`` shards, never changed once written, and
``manifest/v<number>`` with one row for each live shard.  A version is written beside and renamed into
place by a rename that fails if that version exists, so of two writers one wins and the other tries
again.  This needs a file system whose rename is atomic.
Readers take a version, the highest unless they name one, and the shards it lists, whatever else lies in ``data``.  Shards
that a merge replaces stay for the versions that list them; :meth:`ShardTable.expire` is the one thing that deletes.
A manifest has one row for each live shard, so one for each target size of data; like any scan of files, a read lists their names on the driver.
"""

from __future__ import annotations

import functools
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "file string, rows long, bytes long"


class ShardTable:
    """Shards at ``path``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)

    def version(self) -> int:
        """The highest committed version; 0 before the first."""
        at = self._path(f"{self.path}/manifest")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max([int(n[1:]) for n in names if n[0] == "v"], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{version:09d}")

    def _commit(self, base: int, live: DataFrame) -> bool:
        """Make ``live`` the version after ``base``; false if another writer was first."""
        beside = f"{self.path}/manifest/_{uuid.uuid4().hex}"
        live.coalesce(1).write.parquet(beside)
        gateway = self.spark.sparkContext._gateway
        plain = gateway.new_array(getattr(gateway.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._files.rename(self._path(beside), self._path(f"{self.path}/manifest/v{base + 1:09d}"), plain)
        except Py4JJavaError as error:
            self._fs.delete(self._path(beside), True)
            if "FileAlreadyExistsException" not in error.java_exception.toString():
                raise
            return False
        return True

    def _written(self, run: str) -> DataFrame:
        """Manifest rows of the shards that a run wrote; reads their footers and one column's sizes alone."""
        shards = self.spark.read.schema(self._schema(run)).parquet(f"{self.path}/data/{run}")
        return shards.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))

    def _schema(self, run: str):
        return self.spark.read.parquet(f"{self.path}/data/{run}").schema

    def append(self, df: DataFrame, *, rows_per_shard: int = 4000) -> int:
        """Write arrivals as small shards, without a shuffle, and commit them; gives the new version."""
        run = uuid.uuid4().hex
        df.write.options(maxRecordsPerFile=rows_per_shard, compression="zstd").parquet(f"{self.path}/data/{run}")
        new = self._written(run)
        while True:
            base = self.version()
            if self._commit(base, self.manifest(base).unionByName(new)):
                return base + 1

    def read(self, version: int | None = None, columns: list[str] | None = None, shard_col: str = "shard") -> DataFrame:
        """The live rows of a version, with ``shard_col``, the file that each is in.

        Columns are joined by name: one that a shard lacks is null there.  Shards whose types for a column can't be joined raise an error.
        """
        files = [r.file for r in self.manifest(version).select("file").toLocalIterator()]
        every = self.spark.read.option("recursiveFileLookup", True).option("mergeSchema", True)
        df = every.parquet(*files) if files else every.parquet(f"{self.path}/data").limit(0)
        return df.select(*(columns or [c for c in df.columns if c != shard_col]), F.col("_metadata.file_path").alias(shard_col))

    def plan(self, *, target_bytes: int, fan_in: int, growth: int = 4, version: int | None = None) -> DataFrame:
        """``file, bytes, tier, merge``: live shards below the target and the merge that each is due for (null: none yet).

        A shard's tier is the number of times that ``growth`` goes into its size, so a merge joins runs of
        similar size.  Within a tier shards queue by size and name and are cut at each full target;
        a cut with under ``fan_in`` shards that isn't full waits for more arrivals.  A tier's shards, a row each, queue in one task.
        """
        small = self.manifest(version).where(F.col("bytes") < target_bytes / 2)
        small = small.withColumn("tier", F.floor(F.log(F.greatest("bytes", F.lit(1)).cast("double")) / F.log(F.lit(float(growth)))).cast("int"))
        queue = Window.partitionBy("tier").orderBy("bytes", "file")
        small = small.withColumn("_cut", F.floor((F.sum("bytes").over(queue) - F.col("bytes")) / target_bytes))
        cut = Window.partitionBy("tier", "_cut")
        due = (F.count("*").over(cut) >= fan_in) | ((F.sum("bytes").over(cut) >= target_bytes / 2) & (F.count("*").over(cut) > 1))
        return small.select("file", "rows", "bytes", "tier", F.when(due, F.concat_ws("-", "tier", "_cut")).alias("merge"))

    def compact(self, *, target_bytes: int = 128 << 20, fan_in: int = 4, merges_per_job: int = 256) -> int:
        """Merge until no tier is due, in as many jobs as that takes; gives the last version.

        A job does up to ``merges_per_job`` merges, each one task that reads its shards and writes one
        file, so nothing is shuffled and no task handles much more than the target.  Columns are joined by name, so shards of arrivals with
        more columns keep them.  Each job commits on its own: a job that
        fails leaves the last version as it was, and what it wrote is listed by none.  Each merge lowers the number of
        shards, so it ends.  The driver plans over one row for each small shard of a job.
        """
        while True:
            base = self.version()
            due = self.plan(target_bytes=target_bytes, fan_in=fan_in, version=base).where("merge is not null")
            some = due.select("merge").distinct().orderBy("merge").limit(merges_per_job)
            chosen = due.join(F.broadcast(some), "merge").groupBy("merge").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("merge").collect()
            if not chosen:
                return base
            run = uuid.uuid4().hex
            merged = [self.spark.read.option("mergeSchema", True).parquet(*r.files).coalesce(1) for r in chosen]
            functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), merged).write.options(compression="zstd").parquet(f"{self.path}/data/{run}")
            old = self.spark.createDataFrame([(f,) for r in chosen for f in r.files], "file string")
            live = self.manifest(base).join(old, "file", "left_anti").unionByName(self._written(run))
            if not self._commit(base, live):
                self._fs.delete(self._path(f"{self.path}/data/{run}"), True)

    def expire(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` versions and the shards that none of these lists; gives the number of shards deleted.

        A reader of an expired version fails, so keep as many versions as commits may happen during a read.  Shards of runs
        that aren't committed yet are in no version and stay.
        """
        last = self.version()
        at = self._path(f"{self.path}/manifest")
        known = sorted(int(x.getPath().getName()[1:]) for x in self._fs.listStatus(at) if x.getPath().getName()[0] == "v") if last else []
        gone, kept = [v for v in known if v <= last - keep], [v for v in known if v > last - keep]
        if not gone:
            return 0
        files = lambda versions: functools.reduce(DataFrame.unionByName, [self.manifest(v).select("file") for v in versions]).distinct()
        dead = [r.file for r in files(gone).join(files(kept), "file", "left_anti").toLocalIterator()]
        for v in gone:
            self._fs.delete(self._path(f"{self.path}/manifest/v{v:09d}"), True)
        for f in dead:
            self._fs.delete(self._path(f), False)
        return len(dead)


def compacted(docs: DataFrame, path: str, *, rows_per_shard: int = 4000, target_bytes: int = 32 << 20, fan_in: int = 4, id_col: str = "doc_id") -> DataFrame:
    """Append ``docs`` to a table at ``path``, compact it, and tell where each row is: ``doc_id, shard, shard_rows, shard_bytes, version``.

    All columns are stored as they are, nulls and repeated rows included; extra columns may have any
    names, since a table's own data lie in the manifest.  ``shard`` is the file's place among the live files in
    order of name.  An empty table commits a version whose shards hold no rows and gives no rows.
    """
    table = ShardTable(docs.sparkSession, path)
    table.append(docs, rows_per_shard=rows_per_shard)
    version = table.compact(target_bytes=target_bytes, fan_in=fan_in)
    by_name = Window.orderBy("file")
    live = table.manifest(version).withColumn("shard", F.row_number().over(by_name).cast("long"))
    rows = table.read(version, [id_col], "_file").withColumnRenamed(id_col, "doc_id")
    live = live.select(F.col("file").alias("_file"), "shard", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    return rows.join(live, "_file").select("doc_id", "shard", "shard_rows", "shard_bytes", F.lit(version).cast("long").alias("version"))
