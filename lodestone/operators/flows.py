"""Whole flows: a document's way into the knowledge base, and a question's way to its context."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import content_hash
from .chunking import fixed_windows
from .graphs import cut_lineage
from .retrieval import hybrid, ranked, render_context, rerank_by_rrf, substring_top_k
from .versions import merge

KEY = ["collection", "doc_id"]
CHUNK = "chunk_id string, index int, text string, page_number int, parse_hash string, chunk_hash string, config_hash string, generation_id string, user_id long"


def config_digest(**config: object) -> str:
    """SHA-256 of a configuration as JSON text with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def chunk_records(docs: DataFrame, *, parser: str, size: int, overlap: int, generation: str) -> DataFrame:
    """One row for each chunk of ``docs`` (``KEY``, ``text``, ``user_id``), with the columns of ``CHUNK``.

    A chunk's id follows from its place and the two configurations, and its hash from its text and the splitter's, so that a
    repeated run gives the same rows.  Plain text has no pages.
    """
    parse = F.lit(config_digest(parse_method=parser, params={}))
    config = F.lit(config_digest(text="", chunk_params={"chunk_size": size, "chunk_overlap": overlap}))
    cut = fixed_windows(docs.select(*KEY, "user_id", "text"), size, overlap)
    digest = lambda *parts: F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    return cut.select(
        *KEY, digest(*KEY, parse, config, "index").alias("chunk_id"), "index", F.col("chunk").alias("text"), F.lit(None).cast("int").alias("page_number"), parse.alias("parse_hash"),
        digest(config, "chunk").alias("chunk_hash"), config.alias("config_hash"), F.lit(generation).alias("generation_id"), "user_id",
    )


def ingest(state: dict[str, DataFrame], incoming: DataFrame, *, model: str, embed: Column, generation: str, parser: str = "text", size: int = 1000, overlap: int = 200) -> dict[str, DataFrame]:
    """The next state of ``documents, chunks, embeddings``, and ``status`` of the incoming documents.

    ``incoming`` (``KEY``, ``text``, ``user_id``) is merged into the documents.  Those without chunks of this parser and
    splitter are cut; chunks without a vector of this model are embedded, those that an earlier run left out too (``embed`` is a column over
    ``text``).  Joins are by key, texts meet only their own document's rows, and the few new tables are checkpoints.
    """
    new = incoming.withColumn("content_hash", content_hash(F.col("text")))
    documents = merge(state["documents"], new, KEY)
    asked = incoming.select(*KEY).distinct()
    parse, config = config_digest(parse_method=parser, params={}), config_digest(text="", chunk_params={"chunk_size": size, "chunk_overlap": overlap})
    ours = (F.col("parse_hash") == parse) & (F.col("config_hash") == config)
    cut = chunk_records(incoming.join(state["chunks"].where(ours).select(*KEY).distinct(), KEY, "left_anti"), parser=parser, size=size, overlap=overlap, generation=generation)
    chunks = cut_lineage(state["chunks"].unionByName(cut))
    mine = chunks.where(ours).join(asked, KEY, "left_semi")
    have = state["embeddings"].where(F.col("model") == model).select(*KEY, "chunk_id")
    vectors = mine.join(have, [*KEY, "chunk_id"], "left_anti").select(*KEY, "chunk_id", F.lit(model).alias("model"), embed.alias("vector"), F.lit(generation).alias("generation_id"))
    embeddings = cut_lineage(state["embeddings"].unionByName(vectors))
    done = embeddings.where(F.col("model") == model).select(*KEY, "chunk_id", F.lit(1).alias("_e"))
    counts = mine.select(*KEY, "chunk_id").join(done, [*KEY, "chunk_id"], "left").groupBy(*KEY).agg(F.count("*").alias("chunks"), F.count("_e").alias("embedded"))
    n, e = F.coalesce("chunks", F.lit(0)), F.coalesce("embedded", F.lit(0))
    name = F.when(n == 0, "pending").when(e == 0, "chunked").when(e < n, "partially_embedded").otherwise("success")
    status = asked.join(counts, KEY, "left").select(*KEY, n.alias("chunks"), e.alias("embedded"), name.alias("status"))
    return {"documents": documents, "chunks": chunks, "embeddings": embeddings, "status": status}


def search(vectors: DataFrame, texts: DataFrame, query_vector: Sequence[float], query: str, k: int, *, key: Sequence[str], tenant: Column, tenant_texts: Column | None = None) -> DataFrame:
    """``key, score, rank`` of what a tenant finds: both searches among the tenant's own rows, fused and reranked; the substring search where they find nothing."""
    tenant_texts = tenant if tenant_texts is None else tenant_texts
    both = hybrid(vectors, texts, query_vector, query.split(), k, key=key, where=tenant, where_texts=tenant_texts)
    found = cut_lineage(rerank_by_rrf(cut_lineage(both), key=key, k=k))
    if found.isEmpty():
        found = substring_top_k(texts, query, k, key=key, where=tenant_texts).select(*key, "score")
    return ranked(found, key=key)


def search_context(found: DataFrame, texts: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """One row: the texts of a search's few results, by rank."""
    return render_context(texts.select(*key, "text").join(F.broadcast(found), list(key)), with_metadata=True)
