"""Tables laid out by key, so that joins on the key move no rows and a tag's rows are a folder of their own."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """Rows in ``buckets`` by the hash of ``key``, within a folder for each value of the column ``tag`` where given.

    Two such tables with as many buckets, and keys of the same type, join on their keys without an exchange.  The files
    are under ``path``; ``name`` is theirs in the session's catalog, and another session finds them by ``attach``.
    Batches are appended; each adds at most one file for each bucket and tag, and rows of a bucket are sorted within a file.
    Rows without a key are in one bucket.  Rows without a tag are kept, but no tag finds them.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, *, key: str, buckets: int, tag: str | None = None):
        self.spark, self.name, self.path, self.key, self.buckets, self.tag = spark, name, path, key, buckets, tag

    def append(self, df: DataFrame) -> None:
        # The shuffle puts a bucket's rows into one task, as the writer's hash does: one file for each bucket and tag.
        writer = df.repartition(self.buckets, self.key).write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, self.key).sortBy(self.key)
        (writer.partitionBy(self.tag) if self.tag else writer).saveAsTable(self.name)

    def attach(self, schema: str) -> None:
        """Enter the files under ``path`` into this session's catalog; ``schema`` names their columns, the tag's included."""
        tag = f"PARTITIONED BY ({self.tag})" if self.tag else ""
        self.spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet {tag} CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        if self.tag:
            self.spark.catalog.recoverPartitions(self.name)

    def read(self, *tags: str) -> DataFrame:
        """All rows, or those of some tags; folders of others aren't listed."""
        df = self.spark.table(self.name)
        return df.where(F.col(self.tag).isin(*tags)) if tags else df

    def tags(self) -> list[str]:
        """The tags that have rows, from the catalog alone."""
        found = (unquote(r[0].partition("=")[2]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())
        return sorted(t for t in found if t != "__HIVE_DEFAULT_PARTITION__")

    def read_first(self, *tags: str) -> DataFrame:
        """The rows of the first of these tags that has any: a tag's present name before its former ones."""
        have = set(self.tags())
        first = next((t for t in tags if t in have), None)
        return self.read(first) if first is not None else self.read().where("false")

    def missing(self, rows: KeyedTable, tag: str) -> DataFrame:
        """The rows of another table whose key this one hasn't under a tag; those without a key are left out."""
        have = self.read(tag).select(F.col(self.key).alias(rows.key))
        return rows.read().where(F.col(rows.key).isNotNull()).join(have, rows.key, "left_anti")
