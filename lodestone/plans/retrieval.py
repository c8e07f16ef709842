"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.filters import visible_to
from ..operators import retrieval as R
from ..sources.tables import SQL_DOCS, SQL_EMB, kb_documents, kb_embeddings, load
from .registry import query

TERMS = ["the", "thion", "heaner"]
_DIST = "list_sum(list_transform(list_zip(e.vector, q.vector), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
_DENSE = f"near AS (SELECT e.*, {_DIST} AS distance FROM emb e, (SELECT vector FROM emb WHERE chunk_id = 0) q WHERE e.chunk_id <> 0)"


def _bm25(terms: list[str], docs: str = "docs") -> str:
    tf = [f"len(list_filter(w, lambda x: x = '{t}'))" for t in terms]
    cols = ", ".join(f"{c} AS tf{k}" for k, c in enumerate(tf))
    dfs = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(tf)))
    score = " + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(tf)))
    return f"""tok AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM {docs}),
        tfs AS (SELECT * EXCLUDE w, len(w) AS dl, {cols} FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM tfs),
        bm AS (SELECT tfs.*, {score} AS raw FROM tfs, st)"""


def query_vector(spark, sf_dir):
    """The vector of chunk 0: one row, as a search request carries it."""
    return [float(x) for x in load(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query("vec_topk_l2", "R1 R2 R3 L1", f"WITH {SQL_EMB}, {_DENSE} SELECT chunk_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM near ORDER BY near.distance, chunk_id LIMIT 10")
def vec_topk(spark, sf_dir):
    top = R.vector_top_k(kb_embeddings(spark, sf_dir), query_vector(spark, sf_dir), 10, key=["chunk_id"], where=F.col("chunk_id") != 0)
    return top.select("chunk_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("vec_topk_filtered", "R15 L4 S5", f"WITH {SQL_EMB}, {_DENSE} SELECT chunk_id, model_tag, round(distance, 6) AS distance FROM near WHERE model_tag = 'm1' ORDER BY near.distance, chunk_id LIMIT 7")
def vec_topk_filtered(spark, sf_dir):
    top = R.vector_top_k(kb_embeddings(spark, sf_dir), query_vector(spark, sf_dir), 7, key=["chunk_id"], where=(F.col("model_tag") == "m1") & (F.col("chunk_id") != 0))
    return top.select("chunk_id", "model_tag", F.round("distance", 6).alias("distance"))


@query("fts_bm25_topk", "R4 L2", f"WITH {SQL_DOCS}, {_bm25(TERMS)} SELECT doc_id, round(raw, 6) AS raw, round(raw / (1 + raw), 6) AS score FROM bm WHERE raw > 0 ORDER BY round(bm.raw, 9) DESC, doc_id LIMIT 10")
def fts_bm25(spark, sf_dir):
    top = R.text_top_k(kb_documents(spark, sf_dir), TERMS, 10, key=["doc_id"])
    return top.select("doc_id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


@query("substr_fallback", "R5", f"WITH {SQL_DOCS} SELECT doc_id, 1.0::DOUBLE AS score FROM docs WHERE contains(text, 'Licensed under') AND user_id = 3 ORDER BY doc_id LIMIT 5")
def substr_fallback(spark, sf_dir):
    return R.substring_top_k(kb_documents(spark, sf_dir), "Licensed under", 5, key=["doc_id"], where=visible_to(3)).select("doc_id", "score")


@query("search_with_fallback", "R6 R10", f"WITH {SQL_DOCS} SELECT doc_id, 1.0::DOUBLE AS score FROM docs WHERE contains(text, 'ublic Licens') ORDER BY doc_id LIMIT 5")
def search_with_fallback(spark, sf_dir):
    return R.search_text(kb_documents(spark, sf_dir), "ublic Licens", 5, key=["doc_id"]).select("doc_id", "score")


_LISTS = f"""WITH {SQL_DOCS}, {SQL_EMB}, {_DENSE}, {_bm25(TERMS)},
    d AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS rank FROM (SELECT doc_id, 1 / (1 + distance) AS score FROM near ORDER BY distance, doc_id LIMIT 20)),
    s AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS rank FROM (SELECT doc_id, raw / (1 + raw) AS score FROM bm WHERE raw > 0 ORDER BY round(raw, 9) DESC, doc_id LIMIT 20)),"""
_OWN = "round(f.score, 6) AS score, round(d.score, 6) AS vector_score, d.rank::INTEGER AS vector_rank, round(s.score, 6) AS text_score, s.rank::INTEGER AS text_rank FROM f LEFT JOIN d USING (doc_id) LEFT JOIN s USING (doc_id) ORDER BY round(f.score, 9) DESC, f.doc_id LIMIT 10"
_RRF = "f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT doc_id, rank FROM d UNION ALL SELECT doc_id, rank FROM s) GROUP BY 1)"


def _hybrid(spark, sf_dir, method):
    out = R.hybrid(kb_embeddings(spark, sf_dir), kb_documents(spark, sf_dir), query_vector(spark, sf_dir), TERMS, 10, key=["doc_id"], method=method, where=F.col("chunk_id") != 0)
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("score", "vector_score")), "vector_rank", F.round("text_score", 6).alias("text_score"), "text_rank")


@query("hybrid_rrf", "R7 R9 J16 D6 W2 L3", f"{_LISTS} {_RRF} SELECT f.doc_id, {_OWN}")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, "rrf")


_MM = "CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE {0} END"


@query(
    "hybrid_linear",
    "R8 A28 W3 W4",
    f"""{_LISTS} u AS (SELECT doc_id, 0.5 * {_MM.format("0.0")} AS x FROM d UNION ALL SELECT doc_id, 0.5 * {_MM.format("0.0")} AS x FROM s),
    g AS (SELECT doc_id, sum(x) AS score FROM u GROUP BY 1), f AS (SELECT doc_id, {_MM.format("CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END")} AS score FROM g) SELECT f.doc_id, {_OWN}""",
)
def hybrid_linear(spark, sf_dir):
    return _hybrid(spark, sf_dir, "linear")


@query(
    "rerank_rrf",
    "R11",
    f"""{_LISTS} {_RRF}, top AS (SELECT f.doc_id, d.score AS v, s.score AS t FROM f LEFT JOIN d USING (doc_id) LEFT JOIN s USING (doc_id) ORDER BY round(f.score, 9) DESC, f.doc_id LIMIT 10),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY round(v, 12) DESC, doc_id) AS rank FROM top WHERE v IS NOT NULL UNION ALL SELECT doc_id, row_number() OVER (ORDER BY round(t, 12) DESC, doc_id) FROM top WHERE t IS NOT NULL)
    SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM r GROUP BY doc_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, doc_id LIMIT 5""",
)
def rerank_rrf(spark, sf_dir):
    out = R.hybrid(kb_embeddings(spark, sf_dir), kb_documents(spark, sf_dir), query_vector(spark, sf_dir), TERMS, 10, key=["doc_id"], where=F.col("chunk_id") != 0)
    return R.rerank_by_rrf(out, key=["doc_id"], k=5).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "rerank_mapping",
    "J17 U5",
    """WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n FROM conversations),
    t AS (SELECT role, position, row_number() OVER (PARTITION BY role ORDER BY position) AS n FROM (VALUES ('assistant', 0), ('user', 1), ('assistant', 2)) v(role, position))
    SELECT conv_id, turn, r.role AS text, position FROM r LEFT JOIN t USING (role, n)""",
)
def rerank_mapping(spark, sf_dir):
    results = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("text"))
    texts = spark.createDataFrame([("assistant", 0), ("user", 1), ("assistant", 2)], "text string, position int")
    return R.map_reranked(texts, results, key=["conv_id", "turn"]).select("conv_id", "turn", "text", "position")


@query("topk_per_collection", "R12 D3", f"WITH {SQL_EMB}, {_DENSE} SELECT collection, chunk_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY collection ORDER BY near.distance, chunk_id)::INTEGER AS rank FROM near QUALIFY rank <= 3")
def topk_per_collection(spark, sf_dir):
    near = R.top_k_per_group(kb_embeddings(spark, sf_dir).where("chunk_id <> 0"), query_vector(spark, sf_dir), 3, group="collection", key=["chunk_id"])
    return near.select("collection", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


@query("note_search", "R16", f"WITH {SQL_EMB}, {_DENSE}, top AS (SELECT chunk_id, distance FROM near ORDER BY distance, chunk_id LIMIT 20) SELECT chunk_id, round(distance, 6) AS distance FROM top WHERE distance <= 1.35")
def note_search(spark, sf_dir):
    e = kb_embeddings(spark, sf_dir).where("chunk_id <> 0")
    return R.within_distance(e, query_vector(spark, sf_dir), 20, 1.35, key=["chunk_id"]).select("chunk_id", F.round("distance", 6).alias("distance"))


@query(
    "render_context",
    "R13",
    f"""WITH {SQL_DOCS}, l AS (SELECT doc_id, text, 1.0 / (1 + n_chars) AS score FROM docs ORDER BY n_chars, doc_id LIMIT 5), t AS (SELECT text, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS rank, score FROM l)
    SELECT string_agg('[' || rank || '] (score ' || printf('%.4f', score::DOUBLE) || ')' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM t""",
)
def render_context(spark, sf_dir):
    d = kb_documents(spark, sf_dir).orderBy("n_chars", "doc_id").limit(5).select("text", "doc_id", (1.0 / (1 + F.col("n_chars"))).alias("score"))
    return R.render_context(R.ranked(d, key=["doc_id"]), with_metadata=True)


@query("index_policy", "R14 M16", f"WITH {SQL_EMB} SELECT model_tag, count(*) AS n, CASE WHEN count(*) < 50000 THEN 'none' WHEN count(*) < 10000000 THEN 'hnsw' ELSE 'ivf_pq' END AS index_type, count(*) FILTER (chunk_id % 7 = 0) > 10000 OR count(*) FILTER (chunk_id % 7 = 0) / count(*) > 0.05 AS reindex FROM emb GROUP BY 1")
def index_policy(spark, sf_dir):
    n = kb_embeddings(spark, sf_dir).groupBy("model_tag").agg(F.count("*").alias("n"), F.count_if(F.col("chunk_id") % 7 == 0).alias("late"))
    return n.select("model_tag", "n", R.index_choice(F.col("n")).alias("index_type"), R.needs_reindex(F.col("n"), F.col("late"), F.lit(0)).alias("reindex"))


@query("ann_top_k", "R14")
def ann_top_k(spark, sf_dir):
    return R.approximate_top_k(kb_embeddings(spark, sf_dir), query_vector(spark, sf_dir), 10, key="chunk_id").select("chunk_id", F.round("distance", 6).alias("distance"))


@query("embedding_payloads", "R17", "SELECT vec_id, len(embedding)::INTEGER AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def embedding_payloads(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    as_list = F.to_json("embedding")
    payload = F.when(F.col("vec_id") % 3 == 0, as_list).when(F.col("vec_id") % 3 == 1, F.concat(F.lit('{"data": [{"embedding": '), as_list, F.lit("}]}"))).otherwise(F.concat(F.lit("["), as_list, F.lit("]")))
    v = e.select("vec_id", R.embedding_of(payload).alias("v"))
    return v.select("vec_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("dimension_check", "R18", f"WITH {SQL_EMB} SELECT model_tag, count(DISTINCT len(vector)) AS dims, count(DISTINCT len(vector)) = 1 AS uniform FROM emb GROUP BY 1")
def dimension_check(spark, sf_dir):
    n = F.count_distinct(F.size("vector"))
    return kb_embeddings(spark, sf_dir).groupBy("model_tag").agg(n.alias("dims"), (n == 1).alias("uniform"))


@query("embed_documents", "U4")
def embed_documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", R.hash_embedding("text").alias("vector"))
