"""Chunking and text queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import chunking as C
from ..sources.tables import load
from .registry import query

_WINDOWS = """w AS (SELECT doc_id, k AS index, k * 400 AS start, substr(text, k * 400 + 1, 500) AS chunk FROM documents, LATERAL (SELECT unnest(range(CASE WHEN len(text) <= 500 THEN 1 ELSE ceil((len(text) - 500) / 400.0)::BIGINT + 1 END)) AS k) WHERE len(text) > 0)"""


def _windows(spark, sf_dir):
    return C.fixed_windows(load(spark, sf_dir, "documents").select("doc_id", "text"), 500, 100)


@query("chunk_fixed", "C5 C6 C9 W10 C13", f"WITH {_WINDOWS} SELECT doc_id, index::INTEGER AS index, start::INTEGER AS start, chunk FROM w")
def chunk_fixed(spark, sf_dir):
    return _windows(spark, sf_dir)


@query("chunk_stats", "A7 A9", f"WITH {_WINDOWS} SELECT doc_id, count(*) AS n, sum(len(chunk))::BIGINT AS total, floor(avg(len(chunk)))::BIGINT AS mean, arg_min(substr(chunk, 1, 10), index) AS first FROM w GROUP BY 1")
def chunk_stats(spark, sf_dir):
    return C.chunk_stats(_windows(spark, sf_dir), key="doc_id")


@query("chunk_tokens", "C14 C15", "SELECT doc_id, floor(len(text) / 4)::BIGINT AS tokens, (CASE WHEN len(text) <= 800 THEN 1 ELSE ceil((len(text) - 800) / 720.0)::BIGINT + 1 END)::BIGINT AS chunks FROM documents WHERE len(text) > 0")
def chunk_tokens(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    n = C.token_windows(d, 200, 20).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return d.select("doc_id", C.token_estimate(F.col("text")).alias("tokens")).join(n, "doc_id")


@query("chunk_skip_existing", "C12", f"WITH {_WINDOWS} SELECT doc_id, index::INTEGER AS index FROM w WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def chunk_skip_existing(spark, sf_dir):
    done = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    left = load(spark, sf_dir, "documents").select("doc_id", "text").join(done, "doc_id", "left_anti")
    return C.fixed_windows(left, 500, 100).select("doc_id", "index")


@query("chunk_recursive", "C1 C2 C3 C4 U6")
def chunk_recursive(spark, sf_dir):
    return C.chunk_documents(load(spark, sf_dir, "documents"), 500, 50)


@query("chunk_token_packing", "C7 W11")
def chunk_token_packing(spark, sf_dir):
    return C.chunk_documents(load(spark, sf_dir, "documents"), 128, 16, strategy="token")


@query("markdown_sections", "C8", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS section, role || turn AS title, trim(replace(text, chr(10), ' '), ' ') AS body FROM conversations")
def markdown_sections(spark, sf_dir):
    part = F.concat(F.lit("# "), "role", F.col("turn").cast("string"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit(" ")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"])
    docs = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("text"))
    return C.markdown_sections(docs, key="conv_id")


@query("media_context", "C10 W5 T13", "WITH c AS (SELECT conv_id, turn, CASE WHEN turn = 1 THEN '| a | b |' ELSE replace(text, '|', '/') END AS chunk FROM conversations) SELECT conv_id, turn, CASE WHEN turn = 1 THEN concat_ws(chr(10), lag(right(chunk, 5)) OVER w, chunk, lead(substr(chunk, 1, 7)) OVER w) ELSE chunk END AS enriched FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def media_context(spark, sf_dir):
    chunk = F.when(F.col("turn") == 1, "| a | b |").otherwise(F.replace("text", F.lit("|"), F.lit("/")))
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", chunk.alias("chunk"))
    return C.media_context(c, before=5, after=7, key="conv_id", order="turn").select("conv_id", "turn", "enriched")


@query("spreadsheet_rule", "C11 C19", "SELECT conv_id, bool_and(role <> 'system') AS by_row FROM conversations GROUP BY 1")
def spreadsheet_rule(spark, sf_dir):
    return C.one_row_per_chunk(load(spark, sf_dir, "conversations"), key="conv_id", is_row=F.col("role") != "system")


@query("parse_elements", "C16 C17", "SELECT conv_id, turn AS position, CASE role WHEN 'user' THEN 'table' WHEN 'assistant' THEN 'figure' ELSE 'text' END AS kind, len(text)::INTEGER AS n FROM conversations")
def parse_elements(spark, sf_dir):
    item = F.struct("turn", "role", "text")
    packed = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("parsed"))
    each = packed.select("conv_id", F.explode(F.from_json("parsed", "array<struct<turn:long,role:string,text:string>>")).alias("e")).select("conv_id", "e.*")
    kind = F.when(F.col("role") == "user", "table").when(F.col("role") == "assistant", "figure").otherwise("text")
    return each.select("conv_id", F.col("turn").alias("position"), kind.alias("kind"), F.length("text").alias("n"))


@query("metadata_round_trip", "C18", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_id % 5 = 0 AS broken FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 5 = 0")
def metadata_round_trip(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("{not json")).otherwise(F.to_json(F.from_json("props", "map<string,string>")))
    back = F.from_json(raw, "map<string,string>", {"mode": "PERMISSIVE"})
    return load(spark, sf_dir, "events").select("event_id", back["k"].alias("k"), (F.col("event_id") % 5 == 0).alias("broken"))


@query("file_profile", "C20", r"SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS lines, len(regexp_extract_all(text, '[^ \t\n\r]+'))::INTEGER AS words, len(text)::INTEGER AS chars, substr(text, 1, 500) AS preview FROM documents")
def file_profile(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("lines"), F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).alias("words"), F.length("text").alias("chars"), F.substring("text", 1, 500).alias("preview"))


@query("json_paths", "C24", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def json_paths(spark, sf_dir):
    item = F.struct("turn", "role")
    doc = F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("items")))
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(doc.alias("doc"))
    roles = F.from_json(F.get_json_object("doc", "$.items[*].role"), "array<string>")
    one = F.array(F.get_json_object("doc", "$.items[0].role"))
    return c.select("conv_id", F.array_join(F.coalesce(roles, one), ",").alias("roles"))


@query("batched_map", "C25 U1", "SELECT conv_id, turn, reverse(role) AS mapped FROM conversations")
def batched_map(spark, sf_dir):
    @F.pandas_udf("string")
    def mapped(values: pd.Series) -> pd.Series:
        return values.str[::-1]

    return load(spark, sf_dir, "conversations").select("conv_id", "turn", mapped(F.col("role")).alias("mapped"))
