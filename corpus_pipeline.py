"""The corpus pipeline: documents in, packed training windows out.

Each stage calls one operator of ``lodestone.llm``; its rows are written as Parquet and read again as
the next stage's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing, pii, quality, simhash
from lodestone.llm.queries import table, tokenizer_path
from lodestone.llm.workspace import ROW, ids_side, latest, mark, materialize, numbered, sweep


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go.

    Each row has its own verdict, from its whole text and its site: rows with a null id and rows that repeat one are judged like
    others, equal rows of a site alike.  A null text is judged as an empty one, a null source or language as a site of
    its own.  Other columns are carried, whatever their names; an empty table gives no rows.
    """
    rows = numbered(docs, "quality-rows")
    verdicts = quality.classify_quality(rows, table(spark, sf_dir, "labels"), carry=(ROW,))
    rejected = materialize(verdicts.where("not kept").select(ROW), "rejected")
    return rows.join(ids_side(rejected), ROW, "left_anti").select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class (five-word shingles, similarity 0.8 or more) stays: that with the smallest id.

    Classes are of rows, so repeated rows and rows that repeat an id for another text are told apart; a null id comes
    after all others, and of equal ids the row written first stays.  Null and empty texts are one class.  Texts of fewer
    than five words are their whole sequence of words.  Other columns are carried, whatever their names; an empty table gives no rows.
    """
    rows = numbered(docs, "near-dup-rows")
    classes = simhash.similar_documents(rows, id_col=ROW).withColumnRenamed("doc_id", ROW)
    named = classes.join(rows.select(ROW, "doc_id"), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))
    kept = materialize(named.groupBy("component_id").agg(first.alias("first")).select(f"first.{ROW}"), "kept")
    return rows.join(ids_side(kept), ROW, "left_semi").select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; lengths follow.

    All rows stay: null and empty texts as they are (the length of a null text is null), very long ones masked
    whole, rows with null ids and repeated rows like others, equal texts alike.  Other columns are carried, whatever their names; an
    empty table gives no rows.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row comes as often as the mix takes it, up to three times.

    The null source is a source of its own; a null or empty text has no words, so what its source's ratio gives it for
    certain or by its rank costs nothing.  Rows with equal id and source rank alike and are taken or left together.
    Other columns are carried, whatever their names; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return mixing.mix_sources(rows).select("_row", copies.alias("_copy")).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows with their pieces' ids.

    A null or empty text gives the end id alone; very long texts are cut over windows; a null id is carried; repeated rows
    are packed as often as they come; other columns aren't read; an empty table gives no rows.
    """
    return packing.pack_documents(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_dup_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier's fit, the hashes, the discovery of spans or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; what a stage has written for itself is removed when its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = mark()
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, since, keep=latest())
    return docs
