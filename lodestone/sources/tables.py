"""Tables and the roles that they play in the knowledge-base model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Views for ad-hoc SQL; a view is a name for a scan and reads nothing."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def owner(doc_id: Column) -> Column:
    """Tenant of a document: none for every eleventh."""
    return F.when(doc_id % 11 != 0, doc_id % 5)


def kb_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``collection, doc_id, text, lang, n_chars, user_id``."""
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("collection"), "doc_id", "text", "lang", "n_chars", owner(F.col("doc_id")).alias("user_id"))


def kb_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, chunk_id, model_tag, collection, vector``: a vector is the only chunk of the document with its number."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("chunk_id"), F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model_tag"), F.col("label").cast("string").alias("collection"), F.col("embedding").alias("vector"))


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, task_id, phase, ts, value, props``: views start a step and purchases end it; the property k names model and tool."""
    e = load(spark, sf_dir, "events")
    phase = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "end").otherwise(F.col("event_type"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), phase.alias("phase"), "ts", "value", "props")


#: The same roles as DuckDB common table expressions.
SQL_DOCS = "docs AS (SELECT source AS collection, doc_id, text, lang, n_chars, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 5 END AS user_id FROM documents)"
SQL_EMB = "emb AS (SELECT vec_id AS doc_id, vec_id AS chunk_id, 'm' || (label % 3)::VARCHAR AS model_tag, label::VARCHAR AS collection, embedding AS vector FROM embeddings)"
SQL_TRACE = "trace AS (SELECT event_id AS id, user_id AS task_id, CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'end' ELSE event_type END AS phase, ts, value, props FROM events)"
