"""The queries op1..op10 and pipeline with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import checksums, read_token_files, with_starts, write_token_files
    from .workspace import shared_dir

    path = shared_dir(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    sums = checksums(read_token_files(spark, path, ["doc_id", "part", "part_start", "n_tokens", "ids"]))
    return with_starts(read_token_files(spark, path), sums).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_compact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compaction import compacted
    from .workspace import shared_dir

    return compacted(table(spark, sf_dir, "documents"), shared_dir(spark, "shards"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data, joined

    found = find_personal_data(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import apply_plan, sampling_plan, word_count
    from .workspace import materialize

    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return apply_plan(sized, sampling_plan(sized)).select("doc_id", "size", "source_size", "target", "taken")


def op8_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op10_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .polytope import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    digests = sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_simhash_near_dup": op3_simhash_near_dup,
    "op9_personal_data": op9_personal_data,
    "op10_embedding_near_dup": op10_embedding_near_dup,
    "op4_quality": op4_quality,
    "op5_license_digests": op5_license_digests,
    "op6_compact_shards": op6_compact_shards,
    "op7_mix_sources": op7_mix_sources,
    "op8_pack_windows": op8_pack_windows,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_whitening": op12_whitening,
    "op13_suffix_dedup": op13_suffix_dedup,
}


def _op2_sql() -> str:
    return """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def _op5_sql() -> str:
    from .licenses import COPYRIGHT_LINE, LICENSES, RESERVED_LINE, SPELLINGS

    def canonical(t: str) -> str:
        out = f"lower(coalesce({t}, ''))"
        for form in (COPYRIGHT_LINE, RESERVED_LINE):
            out = f"regexp_replace({out}, '{form}', '', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, '{old}', '{new}')"
        return rf"trim(regexp_replace({out}, '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'), ' ')"

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in LICENSES)
    return f"""
    WITH known AS (SELECT sha256({canonical("text")}) AS digest, min(license) AS license FROM (VALUES {known}) k(license, text) GROUP BY 1),
    whole AS (SELECT doc_id, sha256({canonical("text")}) AS digest FROM documents),
    lines AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    hits AS (SELECT doc_id, sha256({canonical("lines.text")}) AS digest, known.license FROM lines JOIN known ON sha256({canonical("lines.line")}) = known.digest),
    notices AS (SELECT doc_id, digest, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM hits GROUP BY ALL)
    SELECT w.doc_id, w.digest, known.license, coalesce(notices.notices, '') AS notices FROM whole w LEFT JOIN known USING (digest) LEFT JOIN notices ON w.doc_id IS NOT DISTINCT FROM notices.doc_id AND w.digest = notices.digest"""


def _op7_sql() -> str:
    from .mixing import BUCKETS

    same = "IS NOT DISTINCT FROM"
    outside = lambda of: f"len(list_filter(steps, lambda x: length(bin({of}size)) - 1 <= x.most AND {of}rnk > x.lo AND {of}rnk <= x.hi AND {of}size > 0)) = 0"
    steps = [
        r"sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)",
        "sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1)",
        "w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sums)",
        "w2 AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (k % 3 + 1)::BIGINT) AS wt, 3.0::DOUBLE * source_size AS cap FROM w)",
        "w3 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / wt, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(wt) OVER (ORDER BY cap / wt, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w2)",
        "w4 AS (SELECT *, (SELECT lev FROM w3 WHERE lev * wt <= cap ORDER BY cap / wt, k LIMIT 1) AS level FROM w3)",
        "tg AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * wt) END AS target FROM w4)",
        "tr AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio FROM tg)",
        "tp AS (SELECT *, floor(ratio)::BIGINT AS sure, ratio - floor(ratio)::BIGINT AS p, target - floor(ratio)::BIGINT * source_size AS rest FROM tr)",
        f"ru AS (SELECT s.*, t.* EXCLUDE source, (('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, ''), coalesce(s.source, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE AS u FROM sized s JOIN tp t ON s.source {same} t.source)",
        "rq AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS q FROM ru)",
        f"rr AS (SELECT *, q / (1 + q) AS rnk, floor(q / (1 + q) * {BUCKETS})::BIGINT AS bucket FROM rq)",
        "bk AS (SELECT source, bucket, sum(size) AS n, first(rest) AS rest FROM rr WHERE rnk IS NOT NULL GROUP BY 1, 2)",
        "bu AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM bk)",
        "ed AS (SELECT source, min(bucket) AS edge, arg_min(upto - n, bucket) AS before FROM bu WHERE upto > rest GROUP BY 1)",
        f"ins AS (SELECT rr.source, rnk, rest, before, before + sum(size) OVER (PARTITION BY rr.source ORDER BY rnk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM rr JOIN ed ON rr.source {same} ed.source AND bucket = edge)",
        "la AS (SELECT source, coalesce(max(rnk) FILTER (cum <= rest), -1) AS last, first(rest) - coalesce(max(cum) FILTER (cum <= rest), first(before)) AS gap FROM ins GROUP BY 1)",
        f"ot AS MATERIALIZED (SELECT rr.source, size, rnk, length(bin(size)) - 1 AS cls FROM rr JOIN ed ON rr.source {same} ed.source JOIN la ON rr.source {same} la.source WHERE rnk IS NOT NULL AND bucket >= edge AND rnk > last AND size > 0)",
        f"""st AS (SELECT source, gap::DOUBLE AS gap, last::DOUBLE AS lo, []::STRUCT(most BIGINT, lo DOUBLE, hi DOUBLE)[] AS steps, 0 AS turn FROM la
        UNION ALL SELECT source, gap - got, hi, list_append(steps, {{'most': (length(bin(floor(gap)::BIGINT)) - 2)::BIGINT, 'lo': lo, 'hi': hi}}), turn + 1
        FROM (SELECT source, any_value(gap) AS gap, any_value(lo) AS lo, any_value(steps) AS steps, any_value(turn) AS turn, max(rnk) FILTER (cum <= gap) AS hi, max(cum) FILTER (cum <= gap) AS got
              FROM (SELECT st.*, rnk, sum(size) OVER (PARTITION BY st.source ORDER BY rnk RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
                    FROM ot JOIN st ON ot.source {same} st.source WHERE rnk > lo AND cls < length(bin(floor(gap)::BIGINT)) - 1) GROUP BY source) WHERE hi IS NOT NULL)""",
        f"g0 AS (SELECT la.source, last, s.gap, s.steps FROM la JOIN (SELECT source, max(turn) AS turn, arg_max(gap, turn) AS gap, arg_max(steps, turn) AS steps FROM st GROUP BY 1) s ON la.source {same} s.source)",
    ]
    taken = f"(bucket < edge OR rnk <= last OR NOT {outside('rr.')})"
    none = "UNION ALL SELECT source, 0, -1.0 FROM g0"
    steps += [
        f"ls AS (SELECT source, size, min(rnk) AS rnk FROM (SELECT rr.source, size, rnk FROM rr JOIN ed ON rr.source {same} ed.source JOIN g0 ON rr.source {same} g0.source WHERE rnk IS NOT NULL AND size > 0 AND {taken} {none}) GROUP BY 1, 2)",
        f"cs AS (SELECT source, size, min(rnk) AS rnk FROM (SELECT ot.source, size, rnk FROM ot JOIN g0 ON ot.source {same} g0.source WHERE {outside('ot.')} {none}) GROUP BY 1, 2)",
        f"sw AS (SELECT g0.source, ls.rnk AS leaves, cs.rnk AS comes FROM g0 JOIN ls ON g0.source {same} ls.source JOIN cs ON g0.source {same} cs.source WHERE abs(cs.size - (ls.size + gap)) < abs(gap) QUALIFY row_number() OVER (PARTITION BY g0.source ORDER BY abs(cs.size - (ls.size + gap)), ls.rnk, cs.rnk) = 1)",
    ]
    return f"""WITH RECURSIVE {", ".join(steps)},
    c AS (SELECT rr.*, sure + CASE WHEN rnk IS NOT NULL AND ((edge IS NULL OR {taken}) AND coalesce(leaves, -1) <> rnk OR comes IS NOT NULL AND comes = rnk) THEN 1 ELSE 0 END AS copies
          FROM rr LEFT JOIN ed ON rr.source {same} ed.source LEFT JOIN g0 ON rr.source {same} g0.source LEFT JOIN sw ON rr.source {same} sw.source)
    SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM c"""


def _op11_sql() -> str:
    draw = lambda k: f"('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {8 * k - 7}, 8))::BIGINT"
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, {draw(1)} AS h1, {draw(2)} AS h2, {draw(3)} AS h3, {draw(4)} AS h4 FROM documents),
    n AS (SELECT *, len(tokens)::BIGINT AS n FROM t), c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
    p AS (SELECT *, coalesce(array_to_string(tokens[1:a], ''), '') AS prefix, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle, coalesce(array_to_string(tokens[b + 1:n], ''), '') AS suffix,
          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


ORACLES: dict[str, str] = {"op2_exact_top_k": _op2_sql(), "op5_license_digests": _op5_sql(), "op7_mix_sources": _op7_sql(), "op11_fill_in_middle": _op11_sql()}
