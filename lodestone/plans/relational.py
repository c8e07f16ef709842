"""Joins, windows, ordering and paging over the knowledge base and the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import listing as L
from ..sources.tables import SQL_DOCS, SQL_EMB, kb_documents, kb_embeddings, load
from .registry import query

W = f"WITH {SQL_DOCS}"
WE = f"WITH {SQL_DOCS}, {SQL_EMB}"


@query("kb_pending_anti", "J1", f"{WE} SELECT doc_id FROM docs WHERE user_id = 1 AND doc_id NOT IN (SELECT doc_id FROM emb WHERE model_tag = 'm1')")
def kb_pending_anti(spark, sf_dir):
    have = kb_embeddings(spark, sf_dir).where("model_tag = 'm1'").select("doc_id")
    return kb_documents(spark, sf_dir).where("user_id = 1").join(have, "doc_id", "left_anti").select("doc_id")


_STATUS = "CASE WHEN coalesce(chunks, 0) = 0 THEN 'pending' WHEN coalesce(embedded, 0) = 0 THEN 'chunked' WHEN embedded < chunks THEN 'partially_embedded' ELSE 'success' END"


@query(
    "kb_doc_status",
    "J2 A30 2.11 conditional",
    f"""{WE}, c AS (SELECT doc_id, (1 + n_chars // 2000)::BIGINT AS chunks FROM docs WHERE lang <> 'de'), e AS (SELECT doc_id, 1 + doc_id % 3 AS embedded FROM emb), l AS (SELECT doc_id, quality FROM labels)
    SELECT doc_id, coalesce(chunks, 0) AS chunks, coalesce(embedded, 0) AS embedded, CASE WHEN quality = 0 THEN 'failed' ELSE {_STATUS} END AS status
    FROM docs FULL JOIN c USING (doc_id) FULL JOIN e USING (doc_id) FULL JOIN l USING (doc_id)""",
)
def kb_doc_status(spark, sf_dir):
    d = kb_documents(spark, sf_dir)
    c = d.where("lang <> 'de'").select("doc_id", F.expr("1 + n_chars div 2000").alias("chunks"))
    e = kb_embeddings(spark, sf_dir).select("doc_id", (1 + F.col("doc_id") % 3).alias("embedded"))
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    both = d.select("doc_id").join(c, "doc_id", "full").join(e, "doc_id", "full").join(lab, "doc_id", "full")
    return both.select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("embedded", F.lit(0)).alias("embedded"), F.when(F.col("quality") == 0, "failed").otherwise(F.expr(_STATUS)).alias("status"))


@query(
    "kb_collections_outer",
    "J3 D1",
    f"{WE}, a AS (SELECT collection AS name, count(*) AS documents FROM docs WHERE lang <> 'en' GROUP BY 1), b AS (SELECT 'src' || (label * 3)::VARCHAR AS name, count(*) AS vectors FROM embeddings GROUP BY 1), c AS (SELECT n_name AS name, n_regionkey AS region FROM nation) SELECT name, coalesce(documents, 0) AS documents, coalesce(vectors, 0) AS vectors, region FROM a FULL JOIN b USING (name) FULL JOIN c USING (name)",
)
def kb_collections_outer(spark, sf_dir):
    a = kb_documents(spark, sf_dir).where("lang <> 'en'").groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("documents"))
    b = load(spark, sf_dir, "embeddings").groupBy(F.concat(F.lit("src"), (F.col("label") * 3).cast("string")).alias("name")).agg(F.count("*").alias("vectors"))
    c = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return a.join(b, "name", "full").join(c, "name", "full").select("name", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("vectors", F.lit(0)).alias("vectors"), "region")


@query("kb_visible_semi", "J4", f"{W} SELECT collection, count(*) AS n FROM docs WHERE collection IN (SELECT collection FROM docs WHERE user_id = 1 AND lang = 'es') GROUP BY 1")
def kb_visible_semi(spark, sf_dir):
    d = kb_documents(spark, sf_dir)
    return d.join(d.where("user_id = 1 AND lang = 'es'").select("collection"), "collection", "left_semi").groupBy("collection").agg(F.count("*").alias("n"))


@query(
    "file_status",
    "J5 J21 A30",
    """WITH s AS (SELECT o_custkey AS c_custkey, bool_or(o_orderstatus = 'P') AS p, bool_or(o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
    SELECT c_custkey, CASE WHEN p THEN 'RUNNING' WHEN f THEN 'SUCCESS' WHEN p IS NULL THEN 'UNKNOWN' ELSE 'FAILED' END AS status FROM customer LEFT JOIN s USING (c_custkey)""",
)
def file_status(spark, sf_dir):
    s = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("p"), F.bool_or(F.col("o_orderstatus") == "F").alias("f"))
    c = load(spark, sf_dir, "customer").select("c_custkey").join(s, "c_custkey", "left")
    return c.select("c_custkey", F.when(F.col("p"), "RUNNING").when(F.col("f"), "SUCCESS").when(F.col("p").isNull(), "UNKNOWN").otherwise("FAILED").alias("status"))


@query("indexed_semi_union", "J6", f"{WE} SELECT doc_id FROM docs WHERE doc_id IN (SELECT doc_id FROM emb WHERE model_tag = 'm0' UNION ALL SELECT doc_id FROM labels WHERE toxic = 1)")
def indexed_semi_union(spark, sf_dir):
    seen = kb_embeddings(spark, sf_dir).where("model_tag = 'm0'").select("doc_id").unionByName(load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
    return kb_documents(spark, sf_dir).join(seen, "doc_id", "left_semi").select("doc_id")


@query(
    "kb_latest_per_group",
    "W1 W6 J7",
    f"{W} SELECT d.collection, d.doc_id, d.n_chars, r.labelled FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY n_chars DESC, doc_id DESC) AS rn FROM docs) d JOIN (SELECT collection, count(*) AS labelled FROM docs JOIN labels USING (doc_id) GROUP BY 1) r USING (collection) WHERE rn = 1",
)
def kb_latest_per_group(spark, sf_dir):
    d = kb_documents(spark, sf_dir)
    first = d.withColumn("rn", F.row_number().over(Window.partitionBy("collection").orderBy(F.col("n_chars").desc(), F.col("doc_id").desc()))).where("rn = 1")
    labelled = d.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id").groupBy("collection").agg(F.count("*").alias("labelled"))
    return first.join(labelled, "collection").select("collection", "doc_id", "n_chars", "labelled")


@query(
    "best_link_per_model",
    "J8 L9",
    "SELECT p_partkey, l_orderkey AS best FROM part JOIN (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'R') DESC, l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) ON l_partkey = p_partkey WHERE rn = 1",
)
def best_link_per_model(spark, sf_dir):
    at = Window.partitionBy("l_partkey").orderBy((F.col("l_returnflag") == "R").desc(), F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    li = load(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(at)).where("rn = 1")
    return load(spark, sf_dir, "part").join(li, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", F.col("l_orderkey").alias("best"))


@query(
    "defaults_per_type",
    "J9",
    "WITH j AS (SELECT r_name, n_name, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY r_name ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT r_name, n_name, s_suppkey FROM j WHERE rn = 1",
)
def defaults_per_type(spark, sf_dir):
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("r_name").orderBy(F.col("s_acctbal").desc(), "s_suppkey"))).where("rn = 1").select("r_name", "n_name", "s_suppkey")


@query("lookup_join", "J12", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def lookup_join(spark, sf_dir):
    n = load(spark, sf_dir, "nation").where("n_regionkey < 3")
    c = load(spark, sf_dir, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "n_name")


@query("usage_left_default", "J13", "SELECT p_partkey, coalesce(n, 0) AS uses, coalesce(returned, 0) AS returned FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey")
def usage_left_default(spark, sf_dir):
    u = load(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    p = load(spark, sf_dir, "part")
    return p.join(u, p.p_partkey == u.l_partkey, "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("uses"), F.coalesce("returned", F.lit(0)).alias("returned"))


@query("liked_flag", "J14", "SELECT s_suppkey, coalesce(n, 0) AS views, f.l_suppkey IS NOT NULL AS liked FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) s ON s_suppkey = s.l_suppkey LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 49) f ON s_suppkey = f.l_suppkey")
def liked_flag(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    views = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    liked = li.where("l_discount >= 0.1 AND l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"), F.lit(True).alias("liked")).distinct()
    s = load(spark, sf_dir, "supplier").select("s_suppkey").join(views, "s_suppkey", "left").join(liked, "s_suppkey", "left")
    return s.select("s_suppkey", F.coalesce("n", F.lit(0)).alias("views"), F.coalesce("liked", F.lit(False)).alias("liked"))


@query("backfill_owner", "J15 M20 M25", f"{WE} SELECT emb.doc_id, coalesce(CASE WHEN emb.doc_id % 4 = 0 THEN 9::BIGINT END, docs.user_id, -1) AS user_id FROM emb LEFT JOIN docs ON emb.doc_id = docs.doc_id")
def backfill_owner(spark, sf_dir):
    e = kb_embeddings(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit(9).cast("long")).alias("own"))
    d = kb_documents(spark, sf_dir).select("doc_id", "user_id")
    return e.join(d, "doc_id", "left").select("doc_id", F.coalesce("own", "user_id", F.lit(-1).cast("long")).alias("user_id"))


@query(
    "blob_dereference",
    "J18",
    "WITH r AS (SELECT conv_id, turn AS pos, (turn * 3 + conv_id) % 40 AS item_id FROM conversations), j AS (SELECT conv_id, pos, r.item_id, text FROM r LEFT JOIN benchmark b ON r.item_id = b.item_id) SELECT conv_id, count(*) AS wanted, count(text) AS found, string_agg(coalesce(len(text), 0)::VARCHAR, ',' ORDER BY pos) AS lengths FROM j GROUP BY 1",
)
def blob_dereference(spark, sf_dir):
    refs = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", ((F.col("turn") * 3 + F.col("conv_id")) % 40).alias("item_id")))).alias("refs"))
    each = refs.select("conv_id", F.posexplode("refs").alias("pos", "ref")).select("conv_id", "pos", "ref.item_id")
    j = each.join(load(spark, sf_dir, "benchmark"), "item_id", "left")
    inorder = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce(F.length("text"), F.lit(0)).cast("string").alias("n")))), lambda x: x["n"])
    return j.groupBy("conv_id").agg(F.count("*").alias("wanted"), F.count("text").alias("found"), F.array_join(inorder, ",").alias("lengths"))


@query("nested_relations", "J19", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def nested_relations(spark, sf_dir):
    r, n = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    inorder = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return r.join(n, r.r_regionkey == n.n_regionkey).groupBy("r_name").agg(F.array_join(inorder, ",").alias("nations"), F.count("*").alias("n"))


@query("display_names", "J20", f"{W} SELECT doc_id, coalesce(b.item_id::VARCHAR, 'doc-' || doc_id || '.' || lang) AS name FROM docs LEFT JOIN benchmark b ON doc_id = item_id")
def display_names(spark, sf_dir):
    d, b = kb_documents(spark, sf_dir), load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").cast("string").alias("filename"))
    path = F.concat(F.lit("/x/doc-"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return d.join(b, "doc_id", "left").select("doc_id", F.coalesce("filename", F.regexp_extract(path, "([^/]+)$", 1)).alias("name"))


# Windows --------------------------------------------------------------------------------------------


@query("latest_null_last", "W6 W7 L10", f"{W} SELECT collection, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY user_id DESC NULLS LAST, doc_id) AS rn FROM docs) WHERE rn = 1")
def latest_null_last(spark, sf_dir):
    return L.latest(kb_documents(spark, sf_dir), ["collection"], [F.col("user_id").desc_nulls_last(), F.col("doc_id")]).select("collection", "doc_id")


@query(
    "rank_and_scale",
    "W2 W3",
    "SELECT user_id, event_id, row_number() OVER w::INTEGER AS rank, CASE WHEN max(value) OVER p > min(value) OVER p THEN round((value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p), 6) ELSE 0 END AS scaled FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id), p AS (PARTITION BY user_id)",
)
def rank_and_scale(spark, sf_dir):
    from ..functions.scalars import min_max

    e = load(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))
    return e.select("user_id", "event_id", rank.alias("rank"), F.round(min_max(F.col("value"), Window.partitionBy("user_id")), 6).alias("scaled"))


# Order and paging -----------------------------------------------------------------------------------


@query("kb_page", "L6 L7 L8", f"{W}, t AS (SELECT count(*) AS total FROM docs) SELECT doc_id, total, 3 AS page, ceil(total / 20)::BIGINT AS total_pages, 3 < ceil(total / 20) AS has_next, true AS has_previous FROM docs, t ORDER BY collection, coalesce(lang, ''), doc_id LIMIT 20 OFFSET 40")
def kb_page(spark, sf_dir):
    rows, info = L.page(kb_documents(spark, sf_dir), ["collection", F.coalesce("lang", F.lit("")), "doc_id"], page=3, size=20)
    return rows.select("doc_id", *(F.lit(v).cast("int" if k == "page" else "boolean" if k.startswith("has") else "long").alias(k) for k, v in info.items()))


@query("recent_ten", "L12 L11", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_ten(spark, sf_dir):
    return load(spark, sf_dir, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(L.clamp(10, 200)).select("event_id")


@query("user_pages", "L17", "SELECT c_custkey, ceil((SELECT count(*) FROM customer WHERE c_name ILIKE '%1%') / 7.0)::BIGINT AS pages FROM customer WHERE c_name ILIKE '%1%' ORDER BY c_custkey LIMIT 7 OFFSET 7")
def user_pages(spark, sf_dir):
    rows, info = L.page(load(spark, sf_dir, "customer").where(F.col("c_name").ilike("%1%")), ["c_custkey"], page=2, size=7)
    return rows.select("c_custkey", F.lit(info["total_pages"]).cast("long").alias("pages"))
