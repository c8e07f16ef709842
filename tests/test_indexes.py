"""Indexes against brute force, and what a search reads."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import textindex, vectorindex
from lodestone.operators.textindex import TextIndex, prefix_terms


def rows_read(spark, work):
    """Rows that scans have given while ``work`` ran."""
    sc = spark.sparkContext
    sc.setJobGroup("rows-read", "")
    before = set(sc.statusTracker().getJobIdsForGroup("rows-read"))
    out = work()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jobs = set(sc.statusTracker().getJobIdsForGroup("rows-read")) - before
    stages = {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    store, total = sc._jsc.sc().statusStore(), 0
    for s in stages:
        total += store.lastStageAttempt(s).inputRecords()
    return out, total


def files_of(spark, path):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    out = {}
    while found.hasNext():
        f = found.next()
        out[f.getPath().toString()] = (f.getLen(), f.getModificationTime())
    return {k: v for k, v in out.items() if not k.endswith("_SUCCESS")}


def brute_bm25(docs, terms, k, prefix=None):
    """By counting in every text."""
    tokens = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    if prefix:
        tokens = {i: [w[:s] for w in ws for s in range(prefix[0], prefix[1] + 1) if len(w) >= s] for i, ws in tokens.items()}
    mean = sum(map(len, tokens.values())) / len(tokens)
    counts = {i: Counter(ws) for i, ws in tokens.items()}
    df = {t: sum(t in c for c in counts.values()) for t in terms}
    out = []
    for i, c in counts.items():
        raw = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(tokens[i]) / mean)) for t in terms)
        if raw > 0:
            out.append((i, round(raw, 9)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k:03d}" if k % 3 else f"über{k}" for k in range(400)]
    weight = [1 / (k + 1) for k in range(400)]
    docs = [(k * 3, " ".join(rng.choices(vocabulary, weight, k=rng.randrange(0, 60)))) for k in range(3000)]
    return [*docs, (9001, None), (9004, ""), (9007, "W000, w000; W000-w001 Ωmega_x"), (9010, "a b c"), (9013, "w005 " * 5000), *((9016 + k, "w007 w009") for k in range(40))]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    made = TextIndex(spark, f"file://{tmp_path_factory.mktemp('text-index')}", slice_words=5000)
    docs = spark.createDataFrame([(i, t) for i, t in corpus], "doc_id long, text string")
    made.add(docs.where("doc_id % 2 = 0").repartition(3))
    made.before = files_of(spark, made.path)
    made.add(docs.where("doc_id % 2 = 1").repartition(2))
    return made


def same(found, want):
    got = found.collect()
    assert [r["id"] for r in got] == [i for i, _ in want]
    assert [r["raw"] for r in got] == pytest.approx([raw for _, raw in want])


@pytest.mark.parametrize("k,terms", [(1, ["w000"]), (10, ["w001", "w007", "nowhere"]), (200, ["über0", "w005", "w011", "W007"]), (10, ["mega", "ωmega"]), (10, ["nowhere"]), (50, ["w398", "w001"])])
def test_text_index_equals_brute_force(index, corpus, terms, k):
    same(index.search(terms, k), brute_bm25(corpus, list(dict.fromkeys(t.lower() for t in terms)), k))


def test_prefixes_equal_brute_force(index, corpus):
    terms = prefix_terms("w00 üb1 x")
    assert terms == ["w0", "w00", "üb", "üb1"]
    same(index.search(terms, 20, kind="prefix"), brute_bm25(corpus, terms, 20, prefix=(2, 3)))


def test_second_batch_rebuilds_nothing(spark, index):
    after = files_of(spark, index.path)
    assert {k: v for k, v in after.items() if k in index.before} == index.before and len(after) > len(index.before)
    assert index.segments().count() == 4


def test_postings_of_other_terms_are_not_read(spark, index):
    every = spark.read.parquet(f"{index.path}/postings").count()
    found, read = rows_read(spark, lambda: index.postings("word", ["w398"]).collect())
    plan = index.postings("word", ["w398"])._jdf.queryExecution().toString()
    assert {r["term"] for r in found} == {"w398"}
    assert "In(term" in plan or "EqualTo(term" in plan
    assert len(found) <= read < every / 20


def test_a_dead_write_is_not_read(spark, index, corpus):
    """Blocks without a row of sums, as a killed write leaves them, don't count."""
    blocks = spark.read.parquet(f"{index.path}/postings").drop("segment")
    blocks.write.partitionBy("bucket").parquet(f"{index.path}/postings/segment=dead")
    assert [r["id"] for r in index.search(["w001", "w007"], 10).collect()] == [i for i, _ in brute_bm25(corpus, ["w001", "w007"], 10)]


def test_blocks_below_the_threshold_are_left():
    """One rare term decides; most blocks of a frequent one are never decoded."""
    n = 128 * 400
    block = lambda term, ids, counts: {"term": term, "first": ids[0], "last": ids[-1], "n": len(ids), "most": max(counts), "shortest": 10, "gaps": np.diff(ids, prepend=ids[0]), "counts": counts, "lengths": [10] * len(ids)}
    common = [block("the", list(range(a, a + 128)), [1] * 128) for a in range(0, n, 128)]
    rare = [block("rare", list(range(6400, 6400 + 20)), [3] * 20)]
    best, looked = textindex.best_of_slice(pd.DataFrame(common + rare), {"the": 0.01, "rare": 8.0}, 10.0, 10)
    assert best["id"].tolist() == list(range(6400, 6410)) and looked < 0.05 * n
    none, looked = textindex.best_of_slice(pd.DataFrame(common), {"the": 0.01}, 10.0, 10, least=5.0)
    assert not len(none) and looked == 0


def test_empty_batches(spark, tmp_path):
    made = TextIndex(spark, f"file://{tmp_path}")
    made.add(spark.createDataFrame([], "doc_id long, text string"))
    assert made.search(["a"], 5).collect() == []
    made.add(spark.createDataFrame([(None, "a b"), (1, "a a"), (2, None)], "doc_id long, text string"))
    assert [r["id"] for r in made.search(["A", "b"], 5).collect()] == [1]


# ---- vectors


def vectors(n, dim, seed=0, clusters=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim)) * 3
    return (centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim))).astype(np.float32)


def nearest(x, ids, q, k):
    d = ((x.astype(float) - np.asarray(q, float)) ** 2).sum(1)
    return [ids[i] for i in np.lexsort((ids, d))[:k]]


def test_recall_on_all_queries(spark, sf_dir):
    from lodestone.plans.registry import QUERIES
    from lodestone.sources.tables import kb_embeddings

    rows = kb_embeddings(spark, sf_dir).orderBy("chunk_id").collect()
    x, ids = np.array([r["vector"] for r in rows], np.float32), np.array([r["chunk_id"] for r in rows])
    got = QUERIES["vector_index_top_k"](spark, sf_dir).toPandas()
    asked = [i for i in ids if i % 50 == 0]
    assert sorted(set(got["query_id"])) == asked and set(got.groupby("query_id").size()) == {10}
    hits = sum(len(set(got[got["query_id"] == q]["id"]) & set(nearest(x, ids, x[list(ids).index(q)], 10))) for q in asked)
    assert hits >= 0.9 * 10 * len(asked)
    exact = {(q, i): ((x[list(ids).index(q)].astype(float) - x[list(ids).index(i)]) ** 2).sum() for q, i in zip(got["query_id"], got["id"], strict=True)}
    assert np.allclose([exact[q, i] for q, i in zip(got["query_id"], got["id"], strict=True)], got["distance"])


def test_probed_lists_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "CHUNK", 200)  # so that lists are dealt to several tasks
    x = vectors(3000, 24)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9001, [float("nan")] * 24)], "chunk_id long, vector array<float>")
    index = vectorindex.VectorIndex(spark, f"file://{tmp_path}").fit(rows, lists=40)
    index.add(rows.where("chunk_id < 1000"))
    before = files_of(spark, index.path)
    index.add(rows.where("chunk_id >= 1000"))
    assert before.items() <= files_of(spark, index.path).items() and index.rows().count() == 3000
    asked = spark.createDataFrame([(7, x[7].tolist()), (8, None)], "query_id long, vector array<float>")
    got, read = rows_read(spark, lambda: index.search(asked, 10, probes=3).collect())
    sizes = {r["list"]: r["count"] for r in index.rows().groupBy("list").count().collect()}
    assert {r["query_id"] for r in got} == {7} and got[0]["id"] == 7 and len(got) == 10
    assert read <= 4 * sum(sorted(sizes.values())[-3:]) + 50 < 3000
    every = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 3000, 50)], "query_id long, vector array<float>")
    found = index.search(every, 10).toPandas()
    hits = sum(len(set(found[found["query_id"] == q]["id"]) & set(nearest(x, np.arange(3000), x[q], 10))) for q in range(0, 3000, 50))
    assert hits >= 0.9 * 600
    whole = index.search(every, 5, probes=40, refine=200).toPandas()
    assert all(whole[whole["query_id"] == q].sort_values("rank")["id"].tolist() == nearest(x, np.arange(3000), x[q], 5) for q in range(0, 3000, 50))


def test_vectors_that_are_equal(spark, tmp_path):
    rows = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(30)], "chunk_id long, vector array<float>")
    index = vectorindex.VectorIndex(spark, f"file://{tmp_path}").fit(rows)
    index.add(rows)
    got = index.search(rows.where("chunk_id = 3").withColumnRenamed("chunk_id", "query_id"), 5).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in got] == [(k, 0.0) for k in range(5)]
    with pytest.raises(ValueError):
        index.fit(rows.where("false"))


def test_search_terms_of_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    made = TextIndex(spark, spark.conf.get("spark.checkpoint.dir") + "/text-index-whole")
    made.add(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)))
    common = Counter(w for _, t in docs for w in set(re.findall(r"[^\W_]+", (t or "").lower()))).most_common(3)
    terms = [w for w, _ in common]
    assert [r["id"] for r in made.search(terms, 25).collect()] == [i for i, _ in brute_bm25(docs, terms, 25)]


def test_exact_store_counts_items_that_a_sketch_estimates(spark, tmp_path):
    """Two days share half of 40,000 items; a day that comes anew, with null items alone, counts no more."""
    from lodestone.operators.sketches import SketchStore

    rows = spark.range(60_000).select(F.when(F.col("id") < 30_000, 1).otherwise(2).alias("day"), F.when(F.col("id") % 2 == 0, "a").alias("kind"), (F.col("id") % 40_000).alias("item"), F.lit(1.0).alias("value"))
    store = SketchStore(spark, f"{tmp_path}/s", ["kind"], exact=True)
    store.add(rows)
    assert {(r["kind"], r["n"], r["items"]) for r in store.between(1, 2).collect()} == {("a", 30_000, 20_000), (None, 30_000, 20_000)}
    assert store.between(1, 2, by=[]).first()["items"] == 40_000
    store.add(rows.where("day = 2").withColumn("item", F.lit(None).cast("long")))
    assert {(r["kind"], r["items"]) for r in store.between(1, 2).collect()} == {("a", 15_000), (None, 15_000)}
    assert {r["items"] for r in store.between(2, 2).collect()} == {0}


def test_a_batch_of_many_texts_is_cut_into_slices(spark, tmp_path):
    """A batch of 2,000 texts of 10 words, of which a slice has 1,000 and what comes with its last few texts."""
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 10).alias("text"))
    index = TextIndex(spark, f"{tmp_path}/index", slice_words=1000)
    index.add(docs)
    lengths = [r["last"] for r in spark.read.parquet(f"{tmp_path}/index/postings").where("kind = 'word' and term is null").collect()]
    assert sum(lengths) == 20_000 and max(lengths) <= 1000 + 64 * 10
