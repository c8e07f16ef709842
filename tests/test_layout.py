"""Tables laid out by key: plans without exchanges, tags pruned at the scan."""

import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.sources.layout import KeyedTable


@pytest.fixture
def tables(spark, tmp_path):
    docs = KeyedTable(spark, f"docs_{uuid.uuid4().hex}", f"file://{tmp_path}/docs", key="doc", buckets=4)
    vectors = KeyedTable(spark, f"vectors_{uuid.uuid4().hex}", f"file://{tmp_path}/vectors", key="doc", buckets=4, tag="model")
    rows = spark.range(1000).select(F.col("id").alias("doc"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs.append(rows.where("doc < 600"))
    docs.append(rows.where("doc >= 600").unionByName(spark.createDataFrame([(None, "no key")], "doc long, text string")))
    for model, part in (("a/b c", "doc % 3 = 0"), ("old", "doc % 2 = 0")):
        vectors.append(rows.where(part).select("doc", F.lit(1.5).alias("v"), F.lit(model).alias("model")))
    vectors.append(spark.createDataFrame([(1, 2.5, None)], "doc long, v double, model string"))
    yield docs, vectors
    for t in (docs, vectors):
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")


def ran(df):
    """The final physical plan, after the run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_missing_rows_move_nothing(spark, tables):
    docs, vectors = tables
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = vectors.missing(docs, "a/b c")
        plan = ran(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.doc for r in df.collect()) == [k for k in range(1000) if k % 3]
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    assert "PartitionFilters: [isnotnull(model" in plan and "ReadSchema: struct<doc:bigint>" in plan


def test_tags(spark, tables):
    _, vectors = tables
    assert vectors.tags() == ["a/b c", "old"]
    assert vectors.read_first("new", "old").count() == 500 and vectors.read_first("a/b c", "old").count() == 334
    assert vectors.read_first("new").count() == 0 and vectors.read().count() == 835


def test_tags_are_pruned_while_running(spark, tables):
    _, vectors = tables
    models = spark.createDataFrame([("old", 1), ("a/b c", 9)], "model string, cost int").where("cost > 5")
    df = vectors.read().join(models, "model")
    assert "dynamicpruning" in ran(df)
    assert df.count() == 334


def test_another_session(spark, tables):
    _, vectors = tables
    again = KeyedTable(spark, f"{vectors.name}_again", vectors.path, key="doc", buckets=4, tag="model")
    again.attach("doc long, v double, model string")
    assert again.tags() == vectors.tags()
    assert sorted(map(tuple, again.read("old").collect())) == sorted(map(tuple, vectors.read("old").collect()))
    spark.sql(f"DROP TABLE {again.name}")
