"""Ingestion and search from end to end, and files written and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import flows, retrieval
from ..sources import files
from ..sources.tables import SQL_DOCS, SQL_EMB, kb_documents, kb_embeddings, load, owner
from .registry import query
from .retrieval import _DENSE, TERMS, _bm25, query_vector
from .streams import _folder
from .text import _WINDOWS

_PARSE = "sha256('{\"params\":{},\"parse_method\":\"text\"}')"
_CONFIG = "sha256('{\"chunk_params\":{\"chunk_overlap\":100,\"chunk_size\":500},\"text\":\"\"}')"


def _incoming(spark, sf_dir):
    return kb_documents(spark, sf_dir).select("collection", "doc_id", "text", "user_id")


@query("ingest_chunk_records", "J1 C12 M2", f"WITH {_WINDOWS}, {SQL_DOCS} SELECT doc_id, w.index::INTEGER AS index, sha256(concat_ws('|', collection, doc_id, {_PARSE}, {_CONFIG}, w.index)) AS chunk_id, sha256({_CONFIG} || '|' || chunk) AS chunk_hash, {_PARSE} AS parse_hash, {_CONFIG} AS config_hash, 'g1' AS generation_id, NULL::INTEGER AS page_number, user_id FROM w JOIN docs USING (doc_id)")
def ingest_chunk_records(spark, sf_dir):
    return flows.chunk_records(_incoming(spark, sf_dir), parser="text", size=500, overlap=100, generation="g1").select("doc_id", "index", "chunk_id", "chunk_hash", "parse_hash", "config_hash", "generation_id", "page_number", "user_id")


@query(
    "ingest_flow",
    "J1 J2 M1 M2 M3 A30 U4",
    f"""WITH {_WINDOWS} SELECT doc_id, count(w.index) AS chunks, count(w.index) AS embedded, CASE WHEN count(w.index) = 0 THEN 'pending' ELSE 'success' END AS status,
    count(w.index) FILTER (lang <> 'fr') AS cut_first, CASE WHEN any_value(lang) <> 'fr' THEN count(w.index) FILTER (w.index % 5 = 4) ELSE count(w.index) END AS embedded_late FROM documents LEFT JOIN w USING (doc_id) GROUP BY doc_id""",
)
def ingest_flow(spark, sf_dir):
    """Two runs: all but one language first, of which every fifth vector is lost, then all documents."""
    key = "collection string, doc_id long"
    empty = {"documents": f"{key}, text string, user_id long, content_hash string", "chunks": f"{key}, {flows.CHUNK}", "embeddings": f"{key}, chunk_id string, model string, vector array<float>, generation_id string"}
    state = {name: spark.createDataFrame([], schema) for name, schema in empty.items()}
    run = {"model": "hash16", "embed": retrieval.hash_embedding("text"), "size": 500, "overlap": 100}
    docs = _incoming(spark, sf_dir)
    first = flows.ingest(state, kb_documents(spark, sf_dir).where("lang <> 'fr'").select(*docs.columns), generation="g1", **run)
    lost = first["chunks"].where("index % 5 = 4").select("chunk_id")
    state = first | {"embeddings": first["embeddings"].join(lost, "chunk_id", "left_anti").select(*state["embeddings"].columns)}
    last = flows.ingest(state, docs, generation="g2", **run)
    early = last["chunks"].groupBy("doc_id").agg(F.count_if(F.col("generation_id") == "g1").alias("a"))
    late = last["embeddings"].groupBy("doc_id").agg(F.count_if(F.col("generation_id") == "g2").alias("b"))
    none = lambda c: F.coalesce(c, F.lit(0))
    return last["status"].join(early, "doc_id", "left").join(late, "doc_id", "left").select("doc_id", "chunks", "embedded", "status", none("a").alias("cut_first"), none("b").alias("embedded_late"))


@query(
    "search_flow",
    "R7 R9 R10 R11 P10",
    f"""WITH {SQL_DOCS}, {SQL_EMB}, mine AS (SELECT * FROM docs WHERE user_id = 3), {_DENSE}, {_bm25(TERMS, "mine")},
    d AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS rank FROM (SELECT doc_id, 1 / (1 + distance) AS score FROM near WHERE doc_id % 11 <> 0 AND doc_id % 5 = 3 ORDER BY distance, doc_id LIMIT 20)),
    s AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS rank FROM (SELECT doc_id, raw / (1 + raw) AS score FROM bm WHERE raw > 0 ORDER BY round(raw, 9) DESC, doc_id LIMIT 20)),
    f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT doc_id, rank FROM d UNION ALL SELECT doc_id, rank FROM s) GROUP BY 1),
    top AS (SELECT f.doc_id, d.score AS v, s.score AS t FROM f LEFT JOIN d USING (doc_id) LEFT JOIN s USING (doc_id) ORDER BY round(f.score, 9) DESC, f.doc_id LIMIT 10),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY round(v, 12) DESC, doc_id) AS rank FROM top WHERE v IS NOT NULL UNION ALL SELECT doc_id, row_number() OVER (ORDER BY round(t, 12) DESC, doc_id) FROM top WHERE t IS NOT NULL),
    z AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM r GROUP BY 1)
    SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id)::INTEGER AS rank FROM z""",
)
def search_flow(spark, sf_dir):
    mine = owner(F.col("doc_id")) == 3
    found = flows.search(kb_embeddings(spark, sf_dir), kb_documents(spark, sf_dir), query_vector(spark, sf_dir), " ".join(TERMS), 10, key=["doc_id"], tenant=mine & (F.col("chunk_id") != 0), tenant_texts=mine)
    return found.select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "search_flow_fallback",
    "R6 R13 P10",
    f"""WITH {SQL_DOCS}, l AS (SELECT doc_id, text FROM docs WHERE contains(text, 'icensed unde') AND user_id = 3 ORDER BY doc_id LIMIT 4), t AS (SELECT text, row_number() OVER (ORDER BY doc_id) AS rank FROM l)
    SELECT coalesce(string_agg('[' || rank || '] (score 1.0000)' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank), '') AS context FROM t""",
)
def search_flow_fallback(spark, sf_dir):
    """Nothing near and no word found: the substring search among the tenant's texts, and their context."""
    docs = kb_documents(spark, sf_dir)
    found = flows.search(kb_embeddings(spark, sf_dir), docs, query_vector(spark, sf_dir), "icensed unde", 4, key=["doc_id"], tenant=F.lit(False), tenant_texts=owner(F.col("doc_id")) == 3)
    return flows.search_context(found, docs, key=["doc_id"])


_TALK = "SELECT conv_id, turn, role, text FROM conversations"


def _talk(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query("sink_csv", "S8 S11 S12", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations")
def sink_csv(spark, sf_dir):
    path = f"{_folder(spark)}/talk.csv"
    files.export(_talk(spark, sf_dir), path)
    return files.read_csv_strings(spark, path)


@query("sink_json_lines", "S9 S12", _TALK)
def sink_json_lines(spark, sf_dir):
    path, talk = f"{_folder(spark)}/talk.jsonl", _talk(spark, sf_dir)
    files.export(talk, path)
    return files.read_json(spark, path, talk.schema)


@query("sink_parquet", "S10", _TALK)
def sink_parquet(spark, sf_dir):
    path = f"{_folder(spark)}/talk.parquet"
    files.export(_talk(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("file_listing", "S19", "SELECT 'csv' AS extension, (19 + sum(len(r_regionkey::VARCHAR) + len(r_name) + 2))::BIGINT AS size FROM region")
def file_listing(spark, sf_dir):
    path = f"{_folder(spark)}/region.csv"
    files.export(load(spark, sf_dir, "region").select("r_regionkey", "r_name").coalesce(1), path)
    return files.list_files(spark, path, "*.csv").select("extension", "size")


@F.pandas_udf(T.BinaryType())
def _workbook(turns: pd.Series) -> pd.Series:
    """A workbook of one sheet: a title, a header, and a row for each turn."""

    def one(rows) -> bytes:
        out, head = io.BytesIO(), "http://schemas.openxmlformats.org"
        cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
        lines = [cell("A1", "Talk"), cell("A2", "turn") + cell("B2", "role")]
        lines += [f'<c r="A{k}"><v>{r["turn"]}</v></c>' + cell(f"B{k}", r["role"]) for k, r in enumerate(rows, 3)]
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{head}/spreadsheetml/2006/main" xmlns:r="{head}/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/one.xml"/></Relationships>')
            z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{head}/spreadsheetml/2006/main"><sheetData>{"".join(f"<row>{x}</row>" for x in lines)}</sheetData></worksheet>')
        return out.getvalue()

    return turns.map(one)


def _workbooks(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("rows"))
    return rows.select(F.col("conv_id").cast("string").alias("path"), _workbook("rows").alias("content"))


_TURNS = "t AS (SELECT conv_id::VARCHAR AS path, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 2 AS n FROM conversations), c AS (SELECT DISTINCT path FROM t)"


@query("workbook_rows", "S14", f"WITH {_TURNS} SELECT path, n AS row, 'turn: ' || turn || ' | role: ' || role AS text FROM t UNION ALL SELECT path, 1, 'Talk' FROM c UNION ALL SELECT path, 2, 'turn | role' FROM c")
def workbook_rows(spark, sf_dir):
    return files.parsed_rows(_workbooks(spark, sf_dir)).select("path", "row", "text")


@query("workbook_cells", "S15", f"WITH {_TURNS} SELECT path, 'One A' || n || ': ' || turn AS text FROM t UNION ALL SELECT path, 'One B' || n || ': ' || role FROM t UNION ALL SELECT path, unnest(['One A1: Talk', 'One A2: turn', 'One B2: role']) FROM c")
def workbook_cells(spark, sf_dir):
    return files.parsed_cells(_workbooks(spark, sf_dir)).select("path", "text")
