"""Merge, cascade and version queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import versions as V
from ..sources.tables import SQL_DOCS, SQL_EMB, kb_documents, kb_embeddings, load
from .registry import query

W = f"WITH {SQL_DOCS}"
WE = f"WITH {SQL_DOCS}, {SQL_EMB}"
BASE = "b AS (SELECT doc_id, collection, lang, n_chars FROM docs WHERE lang <> 'fr')"
CHANGES = "c AS (SELECT doc_id, 'new' AS collection, lang, n_chars + 1 AS n_chars, 0 AS o FROM docs WHERE lang IN ('fr', 'de') UNION ALL SELECT doc_id, 'last', lang, n_chars + 2, 1 FROM docs WHERE collection IN ('src1', 'src5'))"


def _base(spark, sf_dir):
    return kb_documents(spark, sf_dir).where("lang <> 'fr'").select("doc_id", "collection", "lang", "n_chars")


def _changes(spark, sf_dir):
    d = kb_documents(spark, sf_dir)
    one = lambda rows, name, o: rows.select("doc_id", F.lit(name).alias("collection"), "lang", (F.col("n_chars") + o + 1).alias("n_chars"), F.lit(o).alias("o"))
    return one(d.where("lang IN ('fr', 'de')"), "new", 0).unionByName(one(d.where("collection IN ('src1', 'src5')"), "last", 1))


_LAST = "l AS (SELECT * EXCLUDE o FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o DESC) = 1)"


@query("dml_merge_latest", "M1 M2 M3 M4 M6 M22 M23", f"{W}, {BASE}, {CHANGES}, {_LAST} SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT * FROM l")
def dml_merge_latest(spark, sf_dir):
    return V.merge(_base(spark, sf_dir), _changes(spark, sf_dir), ["doc_id"], ordinal="o")


@query("dml_pointer_upsert", "M12 M13 M14", f"{W}, {BASE}, {CHANGES}, {_LAST} SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT l.doc_id, l.collection, l.lang, coalesce(b.n_chars, l.n_chars) FROM l LEFT JOIN b USING (doc_id)")
def dml_pointer_upsert(spark, sf_dir):
    return V.merge(_base(spark, sf_dir), _changes(spark, sf_dir), ["doc_id"], keep=["n_chars"], ordinal="o")


@query("dml_insert_missing", "M5", f"{W}, {BASE} SELECT * FROM b UNION ALL SELECT doc_id, 'moved', lang, n_chars FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM b)")
def dml_insert_missing(spark, sf_dir):
    new = kb_documents(spark, sf_dir).select("doc_id", F.lit("moved").alias("collection"), "lang", "n_chars")
    return V.insert_missing(_base(spark, sf_dir), new, ["doc_id"])


@query("dml_rename", "M7 M24", f"{W}, {BASE} SELECT doc_id, CASE WHEN collection = 'src1' THEN 'renamed' ELSE collection END AS collection FROM b WHERE NOT (collection = 'src2' AND lang = 'en')")
def dml_rename(spark, sf_dir):
    renamed = V.update_where(_base(spark, sf_dir), F.col("collection") == "src1", {"collection": F.lit("renamed")})
    return V.delete_where(renamed, (F.col("collection") == "src2") & (F.col("lang") == "en")).select("doc_id", "collection")


def _tables(spark, sf_dir):
    return {"embeddings": kb_embeddings(spark, sf_dir).select("doc_id"), "chunks": kb_documents(spark, sf_dir).select("doc_id"), "documents": kb_documents(spark, sf_dir).select("doc_id"), "parses": load(spark, sf_dir, "labels").select("doc_id")}


@query("cascade_preview", "M8 M9 M10", "SELECT step::INTEGER AS step, t AS \"table\", n FROM (SELECT 0 AS step, 'embeddings' AS t, count(*) FILTER (vec_id = 7) AS n FROM embeddings UNION ALL SELECT 1, 'chunks', count(*) FILTER (doc_id = 7) FROM documents UNION ALL SELECT 2, 'parses', count(*) FILTER (doc_id = 7) FROM labels UNION ALL SELECT 3, 'documents', count(*) FILTER (doc_id = 7) FROM documents)")
def cascade_preview(spark, sf_dir):
    return V.cascade_plan(_tables(spark, sf_dir), F.col("doc_id") == 7)


@query("cascade_execute", "M8 M9 M10", "SELECT 'documents' AS t, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM documents WHERE doc_id <> 7 UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id <> 7")
def cascade_execute(spark, sf_dir):
    left = V.cascade(_tables(spark, sf_dir), F.col("doc_id") == 7, "chunk", confirm=True, preview=False)
    parts = [left[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in ("documents", "chunks", "embeddings")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("version_candidates", "M11 T23", f"{W} SELECT doc_id, 'chunk_fixed_' || (n_chars % 3 * 500)::VARCHAR || '_' || substr(sha256(text), 1, 8) AS semantic_id FROM docs WHERE collection = 'src4' ORDER BY n_chars DESC, doc_id LIMIT 20")
def version_candidates(spark, sf_dir):
    d = kb_documents(spark, sf_dir).where("collection = 'src4'")
    name = V.semantic_id(F.lit("chunk"), F.lit("fixed"), F.col("n_chars") % 3 * 500, F.sha2(F.col("text").cast("binary"), 256))
    return d.orderBy(F.col("n_chars").desc(), "doc_id").limit(20).select("doc_id", name.alias("semantic_id"))


def _templates(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select(F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("name"), (F.col("turn") + 1).alias("version"), (F.col("turn") == 0).alias("is_latest"), F.col("role").alias("template"))


_T = "t AS (SELECT 't' || conv_id::VARCHAR AS name, turn + 1 AS version, turn = 0 AS is_latest, role AS template FROM conversations)"


@query("template_next_version", "A29", f"WITH {_T} SELECT name, version, CASE WHEN name = 't3' THEN false ELSE is_latest END AS is_latest, template FROM t UNION ALL SELECT 't3', coalesce(max(version), 0) + 1, true, 'new' FROM t WHERE name = 't3'")
def template_next_version(spark, sf_dir):
    return V.next_version(_templates(spark, sf_dir), "t3", {"template": F.lit("new")})


@query("template_delete_version", "M18", f"WITH {_T}, l AS (SELECT * FROM t WHERE NOT (name = 't3' AND version = 2)) SELECT name, version, CASE WHEN name = 't3' THEN version = max(version) OVER (PARTITION BY name) ELSE is_latest END AS is_latest, template FROM l")
def template_delete_version(spark, sf_dir):
    return V.delete_version(_templates(spark, sf_dir), "t3", 2)


@query("schema_evolution", "M19", f"{W} SELECT doc_id, user_id, NULL::VARCHAR AS config_hash FROM docs")
def schema_evolution(spark, sf_dir):
    d = kb_documents(spark, sf_dir).select("doc_id", F.col("user_id").cast("string").alias("user_id"))
    return V.add_string_columns(V.cast_owner(d), ["config_hash"])


@query("snapshot_restore", "M21", f"{W}, {BASE} SELECT * FROM b WHERE collection <> 'src1' UNION ALL SELECT doc_id, collection, 'xx', n_chars FROM docs WHERE collection = 'src1' AND lang = 'en'")
def snapshot_restore(spark, sf_dir):
    snap = kb_documents(spark, sf_dir).where("collection = 'src1' AND lang = 'en'").select("doc_id", "collection", F.lit("xx").alias("lang"), "n_chars")
    return V.restore(_base(spark, sf_dir), snap, ["doc_id"], F.col("collection") == "src1")


@query("unique_names", "M26", "SELECT w AS wanted, CASE WHEN lower(w) IN (SELECT lower(n_name) FROM nation) THEN w || ' 2' ELSE w END AS name FROM (SELECT lower(n_name) AS w FROM nation UNION SELECT r_name FROM region)")
def unique_names(spark, sf_dir):
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    wanted = n.select(F.lower("n_name").alias("wanted")).union(r.select("r_name")).distinct()
    return V.unique_name(n.select(F.col("n_name").alias("name")), wanted)


@query("latest_row_lease", "M15 ST9", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) < TIMESTAMP '2024-01-30' AS expired FROM events GROUP BY 1")
def latest_row_lease(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("t"))
    return e.select("user_id", "state", (F.col("t") < F.expr("TIMESTAMP_NTZ '2024-01-30'")).alias("expired"))
