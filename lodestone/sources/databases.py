"""External databases: whole tables in ranges of like size and catalogs for SQL text over JDBC, and tables over many SQLite databases.

Ranges are planned by the database: it counts keys by bucket, crowded buckets are counted again by finer ones, and
neighbours are joined up to the wanted size.  Only counts by bucket reach the driver.
"""

from __future__ import annotations

import itertools
import os
import sqlite3
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import bound_batches

#: Buckets of one count of keys, and intervals that one statement counts again.
PIECES, INTERVALS = 65_536, 200


def database_url(name: str, prefix: str = "LODESTONE_DB_") -> str:
    """The JDBC address that the environment gives for a name, whatever its case."""
    found = {k.upper(): v for k, v in os.environ.items()}.get((prefix + name).upper())
    if not found:
        raise KeyError(f"no {prefix}{name.upper()} in the environment")
    return found


@dataclass(frozen=True)
class Bucket:
    """``n`` rows with keys from ``low`` to ``high``, both of which occur."""

    low: int
    high: int
    n: int


class Ranged:
    """Ranges of a table by counts that its database makes; a kind of database says how it quotes a name and runs a statement."""

    def quoted(self, name: str) -> str:
        raise NotImplementedError

    def fetch(self, sql: str) -> Iterable[Sequence]:
        """The few rows of a statement."""
        raise NotImplementedError

    def _counted(self, table: str, key: str, where: str, first: int, width: int, within: Sequence[Bucket]) -> list[Bucket]:
        """Counts by buckets of ``width`` keys from ``first``, of the keys within some buckets."""
        told = []
        for some in itertools.batched(within, INTERVALS):
            spans = " OR ".join(f"({key} >= {b.low} AND {key} <= {b.high})" for b in some)
            offsets = f"SELECT CAST({key} AS BIGINT) AS k, CAST({key} AS BIGINT) - ({first}) AS o FROM {table} WHERE ({where}) AND ({spans})"
            buckets = f"SELECT k, o - MOD(o, {width}) AS b FROM ({offsets}) x"
            rows = self.fetch(f"SELECT MIN(k) AS low, MAX(k) AS high, COUNT(*) AS n FROM ({buckets}) y GROUP BY b")
            told += [Bucket(*map(int, r)) for r in rows]
        return told

    def histogram(self, table: str, column: str, most: int, where: str = "1 = 1") -> tuple[list[Bucket], int]:
        """Buckets in order, each of at most ``most`` rows or of a single key, and the number of null keys."""
        key = self.quoted(column)
        ((low, high, n, rows),) = self.fetch(f"SELECT MIN({key}) AS low, MAX({key}) AS high, COUNT({key}) AS n, COUNT(*) AS r FROM {table} WHERE {where}")
        done: list[Bucket] = []
        if not n:
            return done, rows
        # Differences of keys of both signs may not fit a long, those of one sign do.
        for first, last in ((int(low), min(int(high), -1)), (max(int(low), 0), int(high))):
            left, span = [Bucket(first, last, n)] if first <= last else [], last - first + 1
            while left:
                # Widths are powers of two, so that finer buckets lie in coarser ones.
                pieces = min(PIECES, 16 * -(-sum(b.n for b in left) // most) + 240)
                width = 1 << max(0, -(-span // pieces) - 1).bit_length()
                told = self._counted(table, key, where, first, width, left)
                done += [b for b in told if b.n <= most or b.low == b.high]
                left, span = [b for b in told if b.n > most and b.low < b.high], width
        return sorted(done, key=lambda b: b.low), rows - n

    def ranges(self, table: str, column: str, most: int, *, tie: str | None = None, where: str = "1 = 1") -> list[str]:
        """Conditions that each row meets exactly one of, for at most ``most`` rows each as counted now.

        The first range is open below, the last above and nulls have their own, so rows that come later are read
        too.  A key with more rows is a range of its own, cut by the column ``tie`` where given.  Both columns are integers.
        """
        key = self.quoted(column)
        buckets, nulls = self.histogram(table, column, most, where)
        runs: list[list[Bucket]] = []
        for b in buckets:
            if runs and sum(x.n for x in runs[-1]) + b.n <= most:
                runs[-1].append(b)
            else:
                runs.append([b])
        told = []
        cuts = [None, *(run[0].low for run in runs[1:]), None]
        for run, (first, after) in zip(runs, itertools.pairwise(cuts), strict=False):
            ends = [f"{key} >= {first}" if first is not None else "", f"{key} < {after}" if after is not None else ""]
            within = " AND ".join(e for e in ends if e) or f"{key} IS NOT NULL"
            hot = run[0]
            if tie and hot.n > most:
                same = f"{key} = {hot.low}"
                told += [f"{same} AND ({c})" for c in self.ranges(table, tie, most, where=f"({where}) AND {same}")]
                within = f"{within} AND {key} <> {hot.low}"
            told.append(within)
        if not runs:
            told.append(f"{key} IS NOT NULL")
        none = f"{key} IS NULL"
        if tie and nulls > most:
            return told + [f"{none} AND ({c})" for c in self.ranges(table, tie, most, where=f"({where}) AND {none}")]
        return [*told, none]


class Database(Ranged):
    """A database behind a JDBC address.

    Writes go by batches in one transaction a task; a task that is lost after its commit and runs again repeats its
    rows, so a table that must not have them needs a primary key.
    """

    def __init__(self, spark: SparkSession, url: str, options: Mapping[str, str] | None = None):
        self.spark, self.url, self.options = spark, url, dict(options or {})

    def quoted(self, name: str) -> str:
        """The name as this database's dialect quotes it."""
        return self.spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(name)

    def write(self, df: DataFrame, table: str, *, types: str | None = None, mode: str = "overwrite", connections: int = 8) -> None:
        """The rows as a table, over at most ``connections`` connections; ``types`` are column types in the database's words."""
        writer = df.write.mode(mode).options(**self.options, batchsize="10000", numPartitions=str(connections))
        (writer.option("createTableColumnTypes", types) if types else writer).jdbc(self.url, table)

    def query(self, sql: str) -> DataFrame:
        """The rows of a statement that the database runs."""
        return self.spark.read.options(**self.options).jdbc(self.url, f"({sql}) q")

    def fetch(self, sql: str) -> Iterable[Sequence]:
        return self.query(sql).toLocalIterator()

    def read(self, table: str, column: str, most: int, *, tie: str | None = None, where: str = "1 = 1") -> DataFrame:
        """A table, one task for each range of ``column``; filters and columns chosen later reach the database."""
        kept = [f"({where}) AND ({c})" for c in self.ranges(table, column, most, tie=tie, where=where)]
        return self.spark.read.jdbc(self.url, table, predicates=kept, properties={**self.options, "fetchsize": "10000"})

    def attach(self, name: str) -> None:
        """The database as a catalog: ``SELECT ... FROM name.SCHEMA.TABLE``; sums, sorts and limits are pushed down as its dialect can.

        A session keeps the first database of a name.
        """
        prefix = f"spark.sql.catalog.{name}"
        self.spark.conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
        for k, v in {"url": self.url, "pushDownAggregate": "true", "pushDownLimit": "true", **self.options}.items():
            self.spark.conf.set(f"{prefix}.{k}", v)


class _Sqlite(Ranged):
    """One SQLite database within a task."""

    def __init__(self, content: bytes | None = None):
        self.connection = sqlite3.connect(":memory:")
        if content is not None:
            self.connection.deserialize(content)
        self.connection.create_function("MOD", 2, lambda a, b: a % b, deterministic=True)  # its own is of floats

    def quoted(self, name: str) -> str:
        return _sqlite_name(name)

    def fetch(self, sql: str) -> list[tuple]:
        return self.connection.execute(sql).fetchall()


def _sqlite_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


#: Rows that a task has as Python values at a time.
_ROWS = 5000
#: Columns that SQLite holds as they are; others go as strings and are cast back.
_SQLITE = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "double": "REAL", "string": "TEXT"}


class SqliteDatabases:
    """Tables over many SQLite databases of up to ``rows`` rows, each the content of one row of a written table.

    For clusters without a database server: tasks fill and ask the databases where the rows are, ``keep(df, name)`` writes them to
    a folder that all share, and no row passes the driver.  Written by Spark's own commit, so a task that runs again
    repeats no rows.
    """

    def __init__(self, keep: Callable[[DataFrame, str], DataFrame], rows: int = 20_000):
        self.keep, self.rows, self.tables = keep, rows, {}

    def write(self, df: DataFrame, table: str, *, by: Sequence[str]) -> None:
        """The rows as a table; databases hold ranges of the columns ``by``."""
        bound_batches(df.sparkSession)
        kinds, most, name = dict(df.dtypes), self.rows, _sqlite_name(table)
        columns = ", ".join(f"{_sqlite_name(c)} {_SQLITE.get(k, 'TEXT')}" for c, k in kinds.items())
        insert = f"INSERT INTO {name} VALUES ({', '.join('?' * len(kinds))})"

        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, n = None, 0
            for piece in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
                if made is None:
                    made, n = _Sqlite().connection, 0
                    made.execute(f"CREATE TABLE {name} ({columns})")
                # SQLite takes NaN for null, and a word as it is: over all numbers, as in Spark.
                values = ([("NaN" if v != v else v) for v in c.to_pylist()] if pa.types.is_floating(c.type) else c.to_pylist() for c in piece.columns)
                made.executemany(insert, zip(*values, strict=True))
                n += piece.num_rows
                if n >= most:
                    yield _content(made)
                    made = None
            if made is not None:
                yield _content(made)

        plain = df.select(*(F.col(c) if k in _SQLITE else F.col(c).cast("string").alias(c) for c, k in kinds.items()))
        self.tables[table] = self.keep(plain.repartitionByRange(*by).mapInArrow(filled, "content binary"), f"sqlite-{table}"), kinds

    def _asked(self, table: str, ask: Callable[[_Sqlite], Iterable[str]], kinds: Mapping[str, str]) -> DataFrame:
        """The rows of the statements that ``ask`` has for each database."""
        schema = ", ".join(f"`{c}` {k if k in _SQLITE else 'string'}" for c, k in kinds.items())
        types = [_ARROW.get(k, pa.string()) for k in kinds.values()]

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for content in (x for b in batches for x in b.column("content")):
                database = _Sqlite(content.as_py())
                for sql in ask(database):
                    cursor = database.connection.execute(sql)
                    while rows := cursor.fetchmany(_ROWS):
                        values = ([float(v) if v == "NaN" else v for v in c] if t == pa.float64() else c for c, t in zip(zip(*rows, strict=True), types, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=list(kinds))

        rows = self.tables[table][0].mapInArrow(told, schema)
        return rows.select(*(F.col(c) if k in _SQLITE else F.col(c).cast(k).alias(c) for c, k in kinds.items()))

    def query(self, table: str, sql: str, kinds: Mapping[str, str]) -> DataFrame:
        """The rows that a statement over ``table`` has in each of its databases; ``kinds`` are their names and types."""
        return self._asked(table, lambda database: [sql], kinds)

    def read(self, table: str, column: str, most: int, *, tie: str | None = None) -> DataFrame:
        """A table, by the ranges of each of its databases."""
        kinds, name = self.tables[table][1], _sqlite_name(table)
        chosen = ", ".join(map(_sqlite_name, kinds))
        return self._asked(table, lambda database: [f"SELECT {chosen} FROM {name} WHERE {c}" for c in database.ranges(name, column, most, tie=tie)], kinds)


_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _content(connection: sqlite3.Connection) -> pa.RecordBatch:
    connection.commit()
    return pa.RecordBatch.from_arrays([pa.array([connection.serialize()], pa.binary())], names=["content"])
