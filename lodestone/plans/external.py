"""Queries over databases and laid-out tables that are filled from the given tables and read back."""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..sources.batches import PIECE_ROWS
from ..sources.databases import Database, SqliteDatabases, database_url
from ..sources.files import parsed_pages
from ..sources.layout import KeyedTable
from ..sources.tables import SQL_DOCS, SQL_EMB, kb_documents, kb_embeddings, load
from .registry import query
from .streams import _folder

_TYPES = "o_orderstatus VARCHAR(1), o_orderpriority VARCHAR(20)"


_LOCAL = re.compile(r"local(\[|$)")


def _database(spark) -> Database | SqliteDatabases:
    """The database that LODESTONE_DB_QUERIES names; without it the embedded one, or, as that lives in one process, SQLite's for a cluster."""
    try:
        return Database(spark, database_url("queries"))
    except KeyError:
        if _LOCAL.match(spark.sparkContext.master):
            return Database(spark, f"jdbc:derby:{_folder(spark).removeprefix('file://')};create=true")
        return SqliteDatabases(lambda df, name: _kept(df, f"{_folder(spark)}/{name}"))


def _kept(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("jdbc_orders_in_ranges", "S6", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 1000")
def jdbc_orders_in_ranges(spark, sf_dir):
    """All orders go to a database and come back by ranges of their customers, crowded customers by ranges of orders."""
    database = _database(spark)
    how = {"by": ["o_custkey", "o_orderkey"]} if isinstance(database, SqliteDatabases) else {"types": _TYPES}
    database.write(load(spark, sf_dir, "orders"), "orders_in", **how)
    back = database.read("orders_in", "o_custkey", 5000, tie="o_orderkey")
    return back.where("o_totalprice > 1000").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("jdbc_catalog_totals", "S6 2.16 federated", "SELECT n_name, o_orderstatus, sum(n)::BIGINT AS n FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def jdbc_catalog_totals(spark, sf_dir):
    """Counts that the database makes of its orders, joined with tables of files."""
    database = _database(spark)
    counted = "SELECT o_custkey, o_orderstatus, count(*) AS n FROM {} GROUP BY o_custkey, o_orderstatus"
    if isinstance(database, SqliteDatabases):
        database.write(load(spark, sf_dir, "orders"), "ORDERS_OUT", by=["o_custkey", "o_orderkey"])
        counts = database.query("ORDERS_OUT", counted.format("ORDERS_OUT"), {"o_custkey": "bigint", "o_orderstatus": "string", "n": "bigint"})
    else:
        database.write(load(spark, sf_dir, "orders"), "ORDERS_OUT", types=_TYPES)
        catalog = f"db_{uuid.uuid4().hex}"
        database.attach(catalog)
        counts = spark.sql(counted.format(f"{catalog}.APP.ORDERS_OUT"))
    customers, nations = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    joined = counts.join(customers, F.col("c_custkey") == F.col("o_custkey")).join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy("n_name", "o_orderstatus").agg(F.sum("n").alias("n"))


def _laid_out(spark, sf_dir) -> tuple[KeyedTable, KeyedTable]:
    """All documents by their number, and all vectors by model and number of their document."""
    folder, name = _folder(spark), uuid.uuid4().hex
    docs = KeyedTable(spark, f"docs_{name}", f"{folder}/docs", key="doc_id", buckets=16)
    docs.append(kb_documents(spark, sf_dir).select("doc_id", "collection", "lang"))
    vectors = KeyedTable(spark, f"vectors_{name}", f"{folder}/vectors", key="doc_id", buckets=16, tag="model_tag")
    vectors.append(kb_embeddings(spark, sf_dir).select("doc_id", "vector", "model_tag"))
    return docs, vectors


@query("layout_pending", "J1 S5", f"WITH {SQL_DOCS}, {SQL_EMB} SELECT doc_id, collection, lang FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM emb WHERE model_tag = 'm1')")
def layout_pending(spark, sf_dir):
    """Documents without a vector of one model, bucket by bucket."""
    docs, vectors = _laid_out(spark, sf_dir)
    return vectors.missing(docs, "m1")


@query("layout_tags", "S4 S5", f"WITH {SQL_EMB} SELECT model_tag, doc_id, len(vector)::INTEGER AS dim, (SELECT count(DISTINCT model_tag) FROM emb)::INTEGER AS models FROM emb WHERE model_tag = 'm2'")
def layout_tags(spark, sf_dir):
    """The vectors of a model that is still under its former name, with the number of models that the catalog lists."""
    _, vectors = _laid_out(spark, sf_dir)
    return vectors.read_first("m2-large", "m2").select("model_tag", "doc_id", F.size("vector").alias("dim"), F.lit(len(vectors.tags())).alias("models"))


_PAGE_WORDS = 300


def _pdf(text: str) -> bytes:
    """A file with a page for every 300 words, its characters mapped to Unicode by the font."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    pages = [" ".join(words[k : k + _PAGE_WORDS]).encode("utf-16-be") for k in range(0, len(words), _PAGE_WORDS)]
    units = [f"{u:04x}" for u in np.unique(np.frombuffer(b"".join(pages), ">u2")).tolist()]
    blocks = ("\n".join(f"<{u}> <{u}>" for u in units[k : k + 100]) for k in range(0, len(units), 100))
    streams = {6: "".join(f"beginbfchar\n{b}\nendbfchar\n" for b in blocks)} | {9 + 2 * k: f"BT /F1 9 Tf <{p.hex()}> Tj ET" for k, p in enumerate(pages)}
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{' '.join(f'{8 + 2 * k} 0 R' for k in range(len(pages)))}] /Resources << /Font << /F1 5 0 R >> >> >>", 5: "<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"}
    objects |= {8 + 2 * k: f"<< /Type /Page /Parent 2 0 R /Contents {9 + 2 * k} 0 R >>" for k in range(len(pages))}
    parts = [b"%PDF-1.5"] + [f"{n} 0 obj\n{o}\nendobj".encode() for n, o in objects.items()]
    for n, s in streams.items():
        body = zlib.compress(s.encode("latin-1"), 1)
        parts.append(f"{n} 0 obj\n<< /Filter /FlateDecode /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream\nendobj")
    return b"\n".join([*parts, b"%%EOF"])


@query(
    "pdf_page_texts",
    "S16",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), p AS (SELECT doc_id, unnest(range(0, len(w), {_PAGE_WORDS})) AS k, w FROM w),
    t AS (SELECT doc_id, k // {_PAGE_WORDS} + 1 AS page, array_to_string(w[k + 1 : k + {_PAGE_WORDS}], ' ') AS text FROM p) SELECT doc_id, page, length(text)::INTEGER AS chars, sha256(text) AS text_sha256 FROM t""",
)
def pdf_page_texts(spark, sf_dir):
    """Every document becomes a PDF file, whose pages are read back."""

    def files(batches):
        for piece in (b.slice(at, PIECE_ROWS) for b in batches for at in range(0, b.num_rows, PIECE_ROWS)):
            made = [(f"{d}.pdf", _pdf(t)) for d, t in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True) if t is not None]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["path", "content"])

    contents = load(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(files, "path string, content binary")
    doc_id = F.substring_index("path", ".", 1).cast("long")
    return parsed_pages(contents).select(doc_id.alias("doc_id"), "page", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha256"))
