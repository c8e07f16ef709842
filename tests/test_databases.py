"""Databases over JDBC, against the embedded one that comes with Spark."""

import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.plans import external
from lodestone.sources.databases import Database, SqliteDatabases, database_url


@pytest.fixture
def database(spark):
    return Database(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true")


def sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def plan(df):
    return df._jdf.queryExecution().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


KEYS = {
    "even": [(k, k) for k in range(5000)],
    "crowded": [(k, k) for k in range(2000)] + [(10**17 + k, k) for k in range(2000)] + [(-(10**17), 0)],
    "extremes": [(k, k) for k in range(-300, 300)] + [(-(1 << 63), 1), ((1 << 63) - 1, 2)],
    "hot": [(7, k) for k in range(3000)] + [(7, None)] * 5 + [(k, k) for k in range(1000)],
    "nulls": [(None, k) for k in range(2000)] + [(1, 1)],
    "one": [(5, 5)],
    "empty": [],
}


@pytest.mark.parametrize("case", sorted(KEYS))
def test_ranges_hold_each_row_once(spark, database, case):
    df = spark.createDataFrame(KEYS[case], "k long, t long")
    database.write(df, "t")
    back = database.read("t", "k", 400, tie="t")
    assert rows_of(back) == rows_of(df)
    assert max(sizes(back), default=0) <= 400
    # Neighbours are joined: two in a row hold more than the wanted size, but for the cuts at hot keys and nulls.
    assert back.rdd.getNumPartitions() <= 2 * len(KEYS[case]) / 400 + 6


def test_hot_key_without_tie_is_one_range(spark, database):
    df = spark.createDataFrame(KEYS["hot"], "k long, t long")
    database.write(df, "t")
    back = database.read("t", "k", 400)
    assert rows_of(back) == rows_of(df) and max(sizes(back)) == 3006


def test_later_rows_are_read(spark, database):
    database.write(spark.createDataFrame([(k,) for k in range(1000)], "k long"), "t")
    back = database.read("t", "k", 100)
    database.write(spark.createDataFrame([(-5,), (99_999,), (None,)], "k long"), "t", mode="append")
    assert back.count() == 1003


def test_filters_and_columns_are_pushed(spark, database):
    database.write(spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("v"), F.lit("x").alias("s")), "t", types="s VARCHAR(9)")
    some = database.read("t", "k", 100, where='"k" < 900').where("v = 3 AND s = 'x'").select("k")
    assert some.count() == 180
    assert "PushedFilters: [*IsNotNull(v), *IsNotNull(s), *EqualTo(v,3), *EqualTo(s,x)], ReadSchema: struct<k:bigint>" in plan(some)


def test_catalog_pushes_sums(spark, database):
    database.write(spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("v")), "t")
    database.attach("outer_db")
    told = spark.sql('SELECT `v`, sum(`k`) AS total, count(*) AS n FROM outer_db.APP.T WHERE k >= 500 GROUP BY v')
    assert rows_of(told) == [(v, sum(k for k in range(500, 1000) if k % 5 == v), 100) for v in range(5)]
    assert "PushedAggregates: [SUM" in plan(told) and "PushedGroupByExpressions: [v]" in plan(told)


def test_addresses_by_name(monkeypatch):
    monkeypatch.setenv("LODESTONE_DB_Sales", "jdbc:derby:memory:sales")
    assert database_url("sALES") == "jdbc:derby:memory:sales"
    with pytest.raises(KeyError):
        database_url("other")


@pytest.mark.parametrize("case", sorted(KEYS))
def test_sqlite_databases_hold_each_row_once(spark, case):
    asked = []
    databases = SqliteDatabases(lambda df, name: asked.append(name) or df.localCheckpoint(), rows=700)
    df = spark.createDataFrame(KEYS[case], "k long, t long")
    databases.write(df, "t", by=["k", "t"])
    back = databases.read("t", "k", 400, tie="t")
    assert rows_of(back) == rows_of(df) and asked == ["sqlite-t"]
    counted = databases.query("t", "SELECT count(*) AS n FROM t", {"n": "bigint"})
    assert sum(r.n for r in counted.collect()) == df.count() and max((r.n for r in counted.collect()), default=0) <= 5000


def test_sqlite_databases_keep_values(spark):
    databases = SqliteDatabases(lambda df, name: df.localCheckpoint())
    values = "SELECT * FROM VALUES (1L, double('NaN'), 'a\"b', timestamp'2020-01-02 03:04:05.678901', 1.50BD, true, float(0.1)), (2L, double('-Infinity'), NULL, NULL, NULL, NULL, NULL), (-9223372036854775808L, 0.1D, '', timestamp'1960-01-01', 0.01BD, false, float(3)) AS v(`k`, `d \"q`, s, ts, m, b, f)"
    df = spark.sql(values)
    databases.write(df, "odd", by=["k"])
    back = databases.read("odd", "k", 1)
    assert back.dtypes == df.dtypes and repr(rows_of(back)) == repr(rows_of(df))


def test_queries_need_no_server_on_a_cluster(spark, sf_dir, monkeypatch):
    found = [external.jdbc_orders_in_ranges, external.jdbc_catalog_totals]
    local = [rows_of(q(spark, sf_dir)) for q in found]
    monkeypatch.setattr(external, "_LOCAL", external.re.compile("no such master"))
    assert [rows_of(q(spark, sf_dir)) for q in found] == local
