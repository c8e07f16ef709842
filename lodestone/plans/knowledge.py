"""Knowledge-base queries: scans, filters, counts, listings, set algebra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.filters import Condition, check_values, compile_filter, parse_filters, project, visible_to
from ..sources import files
from ..sources.tables import SQL_DOCS, SQL_EMB, kb_documents, kb_embeddings, load, register
from .registry import query

W = f"WITH {SQL_DOCS}"
WE = f"WITH {SQL_DOCS}, {SQL_EMB}"


@query("kb_docs_per_collection", "S1 S2 P10 A1", f"{W} SELECT collection, count(*) AS n FROM docs WHERE user_id = 3 AND collection <> '' GROUP BY 1")
def docs_per_collection(spark, sf_dir):
    return kb_documents(spark, sf_dir).where(visible_to(3) & (F.col("collection") != "")).groupBy("collection").agg(F.count("*").alias("n"))


@query("kb_tenancy", "P10", f"{W} SELECT count(*) AS admin_rows, count(*) FILTER (user_id = 2) AS user_rows, 0::BIGINT AS anonymous_rows FROM docs")
def tenancy(spark, sf_dir):
    n = lambda c: F.count_if(c)
    return kb_documents(spark, sf_dir).agg(n(visible_to(None, True)).alias("admin_rows"), n(visible_to(2)).alias("user_rows"), n(visible_to(None)).alias("anonymous_rows"))


@query("kb_filter_ast", "P1 P2 P3 P4 P5 P6 P9 P12", f"{W} SELECT doc_id, lang FROM docs WHERE lang IN ('en', 'fr') AND (n_chars >= 5000 OR text LIKE '%Lic_nsed%') AND user_id IS NOT NULL AND collection <> 'src3'")
def filter_ast(spark, sf_dir):
    d = kb_documents(spark, sf_dir)
    expr = (Condition("lang", "in", ["en", "fr"]), [Condition("n_chars", "gte", 5000), Condition("text", "contains", "Lic_nsed")], Condition("user_id", "is_not_null"), Condition("collection", "ne", "src3"))
    check_values(expr, dict(d.dtypes))
    return project(d.where(compile_filter(expr, set(d.columns))), ["doc_id", "lang", "missing"])


@query("kb_filter_dict", "P7 P8 P11", f"{W} SELECT doc_id FROM docs WHERE lang = 'de' AND n_chars < 900 AND n_chars > 100")
def filter_dict(spark, sf_dir):
    d = kb_documents(spark, sf_dir)
    expr = parse_filters({"lang": "de", "n_chars": {"operator": "lt", "value": 900}}) + parse_filters({"n_chars": {"operator": "gt", "value": 100}})
    return d.where(compile_filter(expr)).select("doc_id")


@query("kb_eq_null", "P6", "SELECT count(*) AS n FROM documents WHERE lang = NULL")
def eq_null(spark, sf_dir):
    return load(spark, sf_dir, "documents").where(compile_filter(Condition("lang", "eq", None))).agg(F.count("*").alias("n"))


@query("kb_ilike", "P13", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%CUSTOMER#0000001%' OR c_mktsegment ILIKE '%auto%'")
def ilike(spark, sf_dir):
    return load(spark, sf_dir, "customer").where(F.col("c_name").ilike("%CUSTOMER#0000001%") | F.col("c_mktsegment").ilike("%auto%")).select("c_custkey")


@query("kb_null_category", "P14 P23", f"{W} SELECT count(*) FILTER (user_id = 1 OR user_id IS NULL) AS standard, count(*) FILTER (user_id <> 1 AND user_id IS NOT NULL) AS others, count(*) FILTER (user_id NOT IN (1, 2)) AS excluded FROM docs")
def null_category(spark, sf_dir):
    u = F.col("user_id")
    return kb_documents(spark, sf_dir).agg(F.count_if((u == 1) | u.isNull()).alias("standard"), F.count_if((u != 1) & u.isNotNull()).alias("others"), F.count_if(~u.isin(1, 2)).alias("excluded"))


@query("kb_shared_visibility", "P15", f"{W} SELECT doc_id FROM docs WHERE user_id = 1 OR (user_id IN (2, 3) AND lang = 'es')")
def shared_visibility(spark, sf_dir):
    u = F.col("user_id")
    return kb_documents(spark, sf_dir).where((u == 1) | (u.isin(2, 3) & (F.col("lang") == "es"))).select("doc_id")


@query("kb_name_exists", "P16", "SELECT count(*) > 0 AS found FROM nation WHERE lower(n_name) = lower((SELECT upper(min(n_name)) FROM nation))")
def name_exists(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    wanted = n.agg(F.upper(F.min("n_name")).alias("w"))
    return n.join(F.broadcast(wanted), F.lower("n_name") == F.lower("w"), "left_semi").agg((F.count("*") > 0).alias("found"))


@query("kb_path_like", "P17", r"SELECT page_id FROM pages WHERE url LIKE '%/en/1%' ESCAPE '!' OR url LIKE '%ref=!x%' ESCAPE '!'".replace("!x", "x"))
def path_like(spark, sf_dir):
    return load(spark, sf_dir, "pages").where(F.expr("url LIKE '%/en/1%' ESCAPE '!' OR url LIKE '%ref=x%' ESCAPE '!'")).select("page_id")


@query("kb_stale", "P18 M17", "SELECT event_type, count(*) AS n FROM events WHERE (event_type = 'view' AND ts < TIMESTAMP '2024-01-10') OR (event_type = 'click' AND ts < TIMESTAMP '2024-01-05') OR (event_type = 'error' AND value > 40) GROUP BY 1")
def stale(spark, sf_dir):
    t, ts = F.col("event_type"), F.col("ts")
    old = ((t == "view") & (ts < F.expr("TIMESTAMP_NTZ '2024-01-10'"))) | ((t == "click") & (ts < F.expr("TIMESTAMP_NTZ '2024-01-05'"))) | ((t == "error") & (F.col("value") > 40))
    return load(spark, sf_dir, "events").where(old).groupBy("event_type").agg(F.count("*").alias("n"))


#: Notes made of events: category, tags, keywords, metadata.
_NOTES = """notes AS (SELECT event_id AS id, event_type AS category, [event_type, 'k' || (user_id % 3)::VARCHAR] AS tags, user_id % 3 AS k, json_extract_string(props, '$.k') AS meta_k, ts,
    'Note by ' || user_id::VARCHAR || ' on ' || event_type AS content FROM events)"""


def notes(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    k = F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string"))
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.array("event_type", k).alias("tags"), F.from_json("props", "map<string,string>").alias("meta"), "ts", F.concat(F.lit("Note by "), F.col("user_id").cast("string"), F.lit(" on "), "event_type").alias("content"))


@query("note_filters", "P19 P20 P21 L13", f"WITH {_NOTES} SELECT id FROM notes WHERE category = 'click' AND coalesce(meta_k, '') = '7' AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29' AND list_has_all(tags, ['click', 'k1']) AND contains(lower(content), lower('ON Click')) ORDER BY ts DESC, id")
def note_filters(spark, sf_dir):
    wanted = F.array(F.lit("click"), F.lit("k1"))
    rows = notes(spark, sf_dir).where((F.col("category") == "click") & (F.coalesce(F.col("meta")["k"], F.lit("")) == "7") & F.col("ts").between(F.expr("TIMESTAMP_NTZ '2024-01-02'"), F.expr("TIMESTAMP_NTZ '2024-01-29'")))
    rows = rows.where((F.size(F.array_except(wanted, "tags")) == 0) & F.contains(F.lower("content"), F.lit("on click")))
    return rows.orderBy(F.col("ts").desc(), "id").select("id")


@query("note_facets", "A20 A21", f"WITH {_NOTES} SELECT 'category' AS facet, category AS value, count(*) AS n FROM notes GROUP BY 2 UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest(tags) AS t FROM notes) GROUP BY 2")
def note_facets(spark, sf_dir):
    n = notes(spark, sf_dir)
    by = lambda name, c: n.select(F.lit(name).alias("facet"), c.alias("value")).groupBy("facet", "value").agg(F.count("*").alias("n"))
    return by("category", F.col("category")).unionByName(by("tag", F.explode("tags")))


@query("prompt_listing", "P22 L5", f"{W} SELECT doc_id, collection FROM docs WHERE collection LIKE '%src1%' AND lang <> 'en' AND (user_id = 4 OR user_id IS NULL) ORDER BY doc_id DESC LIMIT 15")
def prompt_listing(spark, sf_dir):
    d = kb_documents(spark, sf_dir).where(F.col("collection").like("%src1%") & (F.col("lang") != "en") & ((F.col("user_id") == 4) | F.col("user_id").isNull()))
    return d.orderBy(F.col("doc_id").desc()).limit(15).select("doc_id", "collection")


@query("null_safe_key", "P24", f"{W} SELECT a.doc_id, b.n FROM docs a JOIN (SELECT collection, user_id, count(*) AS n FROM docs GROUP BY 1, 2) b ON a.collection = b.collection AND a.user_id IS NOT DISTINCT FROM b.user_id")
def null_safe_key(spark, sf_dir):
    d = kb_documents(spark, sf_dir)
    n = d.groupBy(F.col("collection").alias("c"), F.col("user_id").alias("u")).agg(F.count("*").alias("n"))
    return d.join(n, (F.col("collection") == F.col("c")) & F.col("user_id").eqNullSafe(F.col("u"))).select("doc_id", "n")


@query("embedding_tables", "S4", f"WITH {SQL_EMB} SELECT model_tag, 'embeddings_' || model_tag AS table_name FROM emb GROUP BY 1")
def embedding_tables(spark, sf_dir):
    return kb_embeddings(spark, sf_dir).select("model_tag").distinct().select("model_tag", F.concat(F.lit("embeddings_"), "model_tag").alias("table_name"))


@query("legacy_tag_fallback", "S5", f"WITH {SQL_EMB}, c AS (SELECT *, CASE WHEN model_tag = 'm2' THEN 0 ELSE 1 END AS p FROM emb WHERE model_tag IN ('m2', 'm0')) SELECT doc_id, model_tag FROM c WHERE p = (SELECT min(p) FROM c)")
def legacy_tag_fallback(spark, sf_dir):
    c = kb_embeddings(spark, sf_dir).where(F.col("model_tag").isin("m2", "m0")).withColumn("p", F.when(F.col("model_tag") == "m2", 0).otherwise(1))
    best = c.agg(F.min("p").alias("p"))
    return c.join(F.broadcast(best), "p").select("doc_id", "model_tag")


@query("nan_to_null", "S3", "SELECT event_id, CASE WHEN value > 30 THEN NULL ELSE value END AS value FROM events")
def nan_to_null(spark, sf_dir):
    v = F.when(F.col("value") > 30, F.lit(float("nan"))).otherwise(F.col("value"))
    return load(spark, sf_dir, "events").select("event_id", F.when(~F.isnan(v), v).alias("value"))


@query("sql_passthrough", "S6 S7", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def sql_passthrough(spark, sf_dir):
    register(spark, sf_dir, "customer")
    return files.read_sql(spark, None, "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")


@query("line_range", "S13 C23", "SELECT doc_id, (k + 1)::INTEGER AS line_no, string_split(text, chr(10))[k + 1] AS line FROM documents, (VALUES (1), (2)) v(k) WHERE len(string_split(text, chr(10))) > k")
def line_range(spark, sf_dir):
    return files.line_range(load(spark, sf_dir, "documents").select("doc_id", "text"), "text", 2, 3)


@query("parser_compatibility", "S17", "SELECT e AS extension, p AS parser FROM (VALUES ('txt', 'text'), ('md', 'text'), ('html', 'html'), ('csv', 'table'), ('json', 'json'), ('xlsx', 'workbook'), ('pdf', 'pdf')) v(e, p)")
def parser_compatibility(spark, sf_dir):
    return files.parser_compatibility(spark)


# Aggregates -----------------------------------------------------------------------------------------


@query(
    "collection_stats",
    "A2 A26 T8",
    f"""{WE}, u AS (SELECT collection, 'documents' AS t FROM docs UNION ALL SELECT d.collection, 'embeddings' FROM emb e JOIN docs d USING (doc_id) UNION ALL SELECT d.collection, 'labels' FROM labels l JOIN docs d USING (doc_id))
    SELECT collection, count(*) FILTER (t = 'documents') AS documents, count(*) FILTER (t = 'embeddings') AS embeddings, count(*) FILTER (t = 'labels') AS labels FROM u GROUP BY 1""",
)
def collection_stats(spark, sf_dir):
    d = kb_documents(spark, sf_dir).select("doc_id", "collection")
    of = lambda df, t: df.select("collection", F.lit(t).alias("t"))
    u = of(d, "documents").unionByName(of(kb_embeddings(spark, sf_dir).select("doc_id").join(d, "doc_id"), "embeddings")).unionByName(of(load(spark, sf_dir, "labels").select("doc_id").join(d, "doc_id"), "labels"))
    return u.groupBy("collection").agg(*(F.count_if(F.col("t") == t).alias(t) for t in ("documents", "embeddings", "labels")))


@query(
    "document_stats",
    "A3 A4",
    f"{WE}, u AS (SELECT doc_id, 1 AS d, 0 AS e, 0 AS l FROM docs UNION ALL SELECT doc_id, 0, 1, 0 FROM emb UNION ALL SELECT doc_id, 0, 0, 1 FROM labels) SELECT doc_id, sum(d)::BIGINT AS documents, sum(e)::BIGINT AS embeddings, sum(l)::BIGINT AS labels FROM u WHERE doc_id IS NOT NULL GROUP BY 1",
)
def document_stats(spark, sf_dir):
    one = lambda df, k: df.select("doc_id", *(F.lit(int(c == k)).alias(c) for c in ("documents", "embeddings", "labels")))
    u = one(kb_documents(spark, sf_dir), "documents").unionByName(one(kb_embeddings(spark, sf_dir), "embeddings")).unionByName(one(load(spark, sf_dir, "labels"), "labels"))
    return u.where("doc_id is not null").groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("documents", "embeddings", "labels")))


@query("count_named_collections", "A5 A6", f"{W} SELECT collection, count(*) AS n FROM docs WHERE collection IN ('src1', 'src7', 'none') GROUP BY 1")
def count_named(spark, sf_dir):
    return kb_documents(spark, sf_dir).where(F.col("collection").isin("src1", "src7", "none")).groupBy("collection").agg(F.count("*").alias("n"))


@query("embedding_stats", "A8", f"WITH {SQL_EMB} SELECT model_tag, collection, count(*) AS n, max(len(vector))::INTEGER AS dim FROM emb GROUP BY 1, 2")
def embedding_stats(spark, sf_dir):
    return kb_embeddings(spark, sf_dir).groupBy("model_tag", "collection").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"))


@query("pending_lengths", "A10", f"{WE} SELECT min(len(text))::INTEGER AS low, max(len(text))::INTEGER AS high, sum(len(text))::BIGINT AS total, round(avg(len(text)), 4) AS mean FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM emb)")
def pending_lengths(spark, sf_dir):
    n = F.length("text")
    left = kb_documents(spark, sf_dir).join(kb_embeddings(spark, sf_dir).select("doc_id"), "doc_id", "left_anti")
    return left.agg(F.min(n).alias("low"), F.max(n).alias("high"), F.sum(n).alias("total"), F.round(F.avg(n), 4).alias("mean"))


@query("distinct_values", "A21", "SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("ability_union", "A22", f"WITH {_NOTES} SELECT array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS abilities FROM notes")
def ability_union(spark, sf_dir):
    return notes(spark, sf_dir).select(F.explode("tags").alias("t")).agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("abilities"))


@query("success_rate", "A23", "SELECT user_id, count(*) AS uses, coalesce(round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0), 6), 0) AS rate FROM events GROUP BY 1")
def success_rate(spark, sf_dir):
    good, tried = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type").isin("purchase", "error"))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("uses"), F.coalesce(F.round(F.try_divide(good, tried), 6), F.lit(0.0)).alias("rate"))


@query("collection_entries", "A24 D4 L8", f"{W}, e AS (SELECT DISTINCT collection, coalesce(lang, '') AS name, coalesce(user_id::VARCHAR, '') AS owner FROM docs) SELECT collection, string_agg(name || ':' || owner, '|' ORDER BY name, owner) AS entries, count(DISTINCT owner) AS owners FROM e GROUP BY 1")
def collection_entries(spark, sf_dir):
    e = kb_documents(spark, sf_dir).select("collection", F.coalesce("lang", F.lit("")).alias("name"), F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("owner")).dropDuplicates()
    items = F.transform(F.sort_array(F.collect_list(F.struct("name", "owner"))), lambda s: F.concat_ws(":", s["name"], s["owner"]))
    return e.groupBy("collection").agg(F.array_join(items, "|").alias("entries"), F.count_distinct("owner").alias("owners"))


@query("counter_deltas", "A25", "SELECT source AS collection, sum(CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 2 END)::BIGINT AS documents, count(DISTINCT lang) AS names FROM documents GROUP BY 1")
def counter_deltas(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.when(F.col("doc_id") % 3 == 0, -1).otherwise(2).alias("delta"), "lang")
    return d.groupBy("collection").agg(F.sum("delta").alias("documents"), F.size(F.collect_set("lang")).cast("long").alias("names"))


@query("token_usage_merge", "A27 ST6", "SELECT conv_id, sum(len(text))::BIGINT AS tokens, string_agg(role || ':' || len(text)::VARCHAR, ',' ORDER BY turn) AS details FROM conversations GROUP BY 1")
def token_usage_merge(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    item = F.struct("turn", F.array(F.concat_ws(":", "role", F.length("text").cast("string"))).alias("d"))
    details = F.flatten(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["d"]))
    return c.groupBy("conv_id").agg(F.sum(F.length("text")).alias("tokens"), F.array_join(details, ",").alias("details"))


@query("delete_mode", "A31", f"{W} SELECT collection, count(*) AS total, count(*) FILTER (user_id = 1) AS own, CASE WHEN count(*) FILTER (user_id = 1) = 0 THEN 'none' WHEN count(*) FILTER (user_id = 1) = count(*) THEN 'all' ELSE 'own' END AS mode FROM docs GROUP BY 1")
def delete_mode(spark, sf_dir):
    d = kb_documents(spark, sf_dir).groupBy("collection").agg(F.count("*").alias("total"), F.count_if(F.col("user_id") == 1).alias("own"))
    return d.withColumn("mode", F.when(F.col("own") == 0, "none").when(F.col("own") == F.col("total"), "all").otherwise("own"))


@query("progress", "A32 ST4", "SELECT conv_id, round(avg((role <> 'assistant')::INTEGER), 6) AS progress, arg_min(turn, turn) FILTER (role = 'assistant') AS first_open FROM conversations GROUP BY 1")
def progress(spark, sf_dir):
    done = F.col("role") != "assistant"
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.round(F.avg(done.cast("int")), 6).alias("progress"), F.min(F.when(~done, F.col("turn"))).alias("first_open"))


# Sets -----------------------------------------------------------------------------------------------


@query(
    "set_algebra",
    "D1 D2 D11 D12",
    f"{WE}, a AS (SELECT doc_id FROM docs WHERE user_id = 1), b AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT 'union' AS op, doc_id FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b) UNION ALL SELECT 'intersect', doc_id FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b) UNION ALL SELECT 'except', doc_id FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b)",
)
def set_algebra(spark, sf_dir):
    a = kb_documents(spark, sf_dir).where("user_id = 1").select("doc_id")
    b = load(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    named = lambda op, df: df.select(F.lit(op).alias("op"), "doc_id")
    return named("union", a.union(b).distinct()).unionByName(named("intersect", a.intersect(b))).unionByName(named("except", a.subtract(b)))


@query("source_order_union", "D3", f"{W} SELECT doc_id, collection, k::INTEGER AS source_ordinal FROM docs JOIN (VALUES ('src2', 0), ('src9', 1), ('src4', 2)) v(c, k) ON collection = c")
def source_order_union(spark, sf_dir):
    d = kb_documents(spark, sf_dir)
    parts = [d.where(F.col("collection") == c).select("doc_id", "collection", F.lit(k).alias("source_ordinal")) for k, c in enumerate(("src2", "src9", "src4"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("content_hash_dedup", "D5 D8", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies, count(DISTINCT len(text)) > 1 AS collision FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(S.content_hash(F.col("text")).alias("digest"), "doc_id", F.length("text").alias("n"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), (F.count_distinct("n") > 1).alias("collision"))


@query("stable_id_list", "D9", "SELECT conv_id, array_to_string(list_sort(list_distinct(list(turn % 4))), ',') AS ids FROM conversations GROUP BY 1")
def stable_id_list(spark, sf_dir):
    ids = F.sort_array(F.array_distinct(F.collect_list(F.col("turn") % 4)))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query(
    "owned_or_shared",
    "D10 L18",
    f"{W}, u AS (SELECT doc_id, 'owned' AS via, 0 AS p, n_chars FROM docs WHERE user_id = 2 UNION ALL SELECT doc_id, 'policy', 1, n_chars FROM docs WHERE lang = 'fr') SELECT doc_id, via FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p) = 1 ORDER BY coalesce(n_chars, 0) DESC, doc_id DESC",
)
def owned_or_shared(spark, sf_dir):
    d = kb_documents(spark, sf_dir)
    u = d.where("user_id = 2").select("doc_id", "n_chars", F.lit("owned").alias("via"), F.lit(0).alias("p")).unionByName(d.where("lang = 'fr'").select("doc_id", "n_chars", F.lit("policy").alias("via"), F.lit(1).alias("p")))
    first = u.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("p"))).where("rn = 1")
    return first.orderBy(F.coalesce("n_chars", F.lit(0)).desc(), F.col("doc_id").desc()).select("doc_id", "via")


# Scalars --------------------------------------------------------------------------------------------


@query("model_tags", "2.11 slug", "SELECT m AS model, t AS tag FROM (VALUES ('BAAI/bge-large-zh-v1.5', 'BAAI_bge_large_zh_v1_5'), ('text-embedding-v4', 'text_embedding_v4'), ('Open AI/Ada  002!', 'OPEN_AI_ada_002')) v(m, t)")
def model_tags(spark, sf_dir):
    m = spark.createDataFrame([("BAAI/bge-large-zh-v1.5",), ("text-embedding-v4",), ("Open AI/Ada  002!",)], "model string")
    return m.select("model", S.model_tag(F.col("model")).alias("tag"))


@query(
    "safe_ids",
    "2.11 sanitize",
    "WITH t AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g') AS a FROM pages), u AS (SELECT page_id, url, regexp_replace(substr(regexp_replace(a, '^_+|_+$', '', 'g'), 1, 24), '_+$', '') AS b FROM t) SELECT page_id, CASE WHEN len(b) > 0 THEN b ELSE substr(sha256(url), 1, 8) END AS id FROM u",
)
def safe_ids(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", S.safe_id(F.col("url"), 24).alias("id"))


@query("url_parts", "2.11 url K4", "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages")
def url_parts(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", S.normalize_url(F.col("url")).alias("url"), S.netloc(F.col("url")).alias("host"))


@query("path_parts", "2.11 basename J20", r"SELECT doc_id, f AS file, regexp_replace(f, '\.[^.]*$', '') AS stem, regexp_extract(f, '\.[^.]*$') AS suffix, (doc_id % 7)::BIGINT AS owner FROM (SELECT doc_id, 'doc-' || doc_id || '.v2.' || lang AS f FROM documents)")
def path_parts(spark, sf_dir):
    p = F.concat(F.lit("/data/user_"), (F.col("doc_id") % 7).cast("string"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".v2."), F.col("lang"))
    d = load(spark, sf_dir, "documents").select("doc_id", p.alias("p"))
    return d.select("doc_id", S.basename(F.col("p")).alias("file"), S.stem(F.col("p")).alias("stem"), S.suffix(F.col("p")).alias("suffix"), S.owner_of_path(F.col("p")).alias("owner"))


@query("json_fields", "2.11 json", "SELECT event_id, json_extract_string(props, '$.k') AS k, (json_extract_string(props, '$.k'))::BIGINT * 2 AS twice FROM events")
def json_fields(spark, sf_dir):
    k = S.json_field(F.col("props"), "k")
    return load(spark, sf_dir, "events").select("event_id", k.alias("k"), (k.cast("long") * 2).alias("twice"))


@query("date_functions", "2.11 date", "SELECT event_id, epoch_us(ts) // 1000000 AS epoch, epoch_us(date_trunc('day', ts)) // 1000000 AS day, ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AS old, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6, 6) AS to_february FROM events")
def date_functions(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    end = F.expr("TIMESTAMP_NTZ '2024-02-01'")
    return load(spark, sf_dir, "events").select("event_id", F.unix_seconds(ts).alias("epoch"), F.unix_seconds(F.date_trunc("day", ts)).alias("day"), (F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-31' - INTERVAL 7 DAY")).alias("old"), F.round(S.seconds_between(F.col("ts"), end), 6).alias("to_february"))


@query("safe_casts", "2.11 conversion", "SELECT doc_id, TRY_CAST(substr(text, 1, 2) AS BIGINT) AS maybe, CASE WHEN lang = 'en' THEN 1 ELSE 0 END::INTEGER AS english FROM documents")
def safe_casts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", S.strict_long(F.substring("text", 1, 2)).alias("maybe"), F.when(F.col("lang") == "en", 1).otherwise(0).alias("english"))


@query("formulas", "2.11 math", "SELECT f AS formula, v::DOUBLE AS value FROM (VALUES ('1 + 2 * 3', 7.0), ('2 ** 10 / 4', 256.0), ('sqrt(16) + abs(-3)', 7.0), ('10 % 4', 2.0)) t(f, v)")
def formulas(spark, sf_dir):
    one = spark.range(1)
    out = None
    for f in ("1 + 2 * 3", "2 ** 10 / 4", "sqrt(16) + abs(-3)", "10 % 4"):
        row = one.select(F.lit(f).alias("formula"), S.formula(f).cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


@query("find_replace", "C22", "SELECT doc_id, len(regexp_replace(text, '(?i)licensed', 'L$', 'g'))::INTEGER AS n_chars, len(regexp_extract_all(text, '(?i)licensed'))::INTEGER AS hits FROM documents")
def find_replace(spark, sf_dir):
    text, hits = S.find_replace(F.col("text"), "licensed", "L$", ignore_case=True)
    return load(spark, sf_dir, "documents").select("doc_id", F.length(text).alias("n_chars"), hits.alias("hits"))


@query("canonical_hashes", "2.11 hash D5 T20", "SELECT event_id, sha256('step|' || '{\"k\":' || json_extract_string(props, '$.k') || '}') AS digest FROM events")
def canonical_hashes(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", S.step_hash("step", F.col("props")).alias("digest"))


_OPENED = "length(regexp_replace(regexp_replace(nested, '\"[^\"]*\"', '', 'g'), '[^\\[{]', '', 'g'))"


@query("json_depths", "C21", f"WITH n AS (SELECT event_id, repeat('[', event_id::INTEGER % 7) || props || repeat(']', event_id::INTEGER % 7) AS nested FROM events) SELECT event_id, {_OPENED}::INTEGER AS depth FROM n")
def json_depths(spark, sf_dir):
    """Each event's properties within none to six arrays; the twin counts the brackets that open, of which each is within the one before."""
    k = (F.col("event_id") % 7).cast("int")
    nested = F.concat(F.repeat(F.lit("["), k), "props", F.repeat(F.lit("]"), k))
    return load(spark, sf_dir, "events").select("event_id", S.json_depth(nested).alias("depth"))


@query("utf8_prefixes", "2.11 utf8", None)
def utf8_prefixes(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", S.utf8_prefix(F.col("text"), 50).alias("head"))
