"""Fill-in-the-middle examples, whitening and long repeats against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import infill, queries, repeats, whitening

DOCS = "doc_id long, text string, lang string, n long, form string, start int, key long, _text string, _spans int"


def docs_df(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", 1, "x", 2, 3, "y", 4) for i, t in zip(ids, texts, strict=True)], DOCS)


# ---- operator 11


@given(st.lists(st.booleans(), min_size=1, max_size=3000))
@settings(max_examples=60, deadline=None)
def test_rank_and_select(flags):
    flags = np.array(flags)
    v = infill.BitVector(flags)
    assert v.rank(np.arange(len(flags) + 1)).tolist() == [0, *np.cumsum(flags).tolist()]
    assert v.select(np.arange(flags.sum())).tolist() == np.flatnonzero(flags).tolist()


def test_rank_and_select_at_block_bounds():
    for size in (1, 63, 64, 65, 511, 512, 513, 1024, 5000):
        for flags in (np.ones(size, bool), np.arange(size) % 64 == 63, np.arange(size) == size - 1):
            v = infill.BitVector(flags)
            assert v.rank(np.arange(size + 1)).tolist() == [0, *np.cumsum(flags).tolist()]
            assert v.select(np.arange(flags.sum())).tolist() == np.flatnonzero(flags).tolist()


def example(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", "a", "1", "é", "word", "two words", "<", "<P", "<P><S><M>", "a <M> b", "x<S", "中文 ab c\n\n😀é", "a" * 100_000, "ab 12 " * 20_000, "é中😀" * 3000, "\x00a\x00", "<P" + "a>" * 50]


@pytest.mark.parametrize("parts", [1, 5])
def test_examples_equal_brute_force(spark, parts):
    texts = ODD * 12
    ids = [None if k % 37 == 5 else k // 2 for k in range(len(texts))]
    made = infill.fill_in_middle(docs_df(spark, texts, ids).repartition(parts))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter(example(i, t) for i, t in zip(ids, texts, strict=True))
    assert Counter(r["back"] for r in rows) == Counter(t or "" for t in texts)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_examples_of_whole_table_and_of_none(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = sorted(example(*r) for r in docs.select("doc_id", "text").collect())
    got = sorted(map(tuple, queries.op11_fill_in_middle(spark, sf_dir).collect()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    whole = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert got == [(*t[:5], sha(t[5]), sha(whole[t[0]])) for t in truth]
    assert infill.fill_in_middle(docs.where("false")).collect() == []


# ---- operator 12


def embeddings(spark, vectors, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    rows = [(i, v, 1, 2, 3.0) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, component int, _x double")


def truth_whitening(vectors, k=4, scale=256):
    """By numpy's eigendecomposition of the exact covariance."""
    x = [tuple(int(np.floor(scale * float(np.float32(c)))) for c in v) for v in vectors]
    fit = np.array(sorted(set(x)))
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    dev = [sum((n * c - int(t)) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    return n, dev, ((np.array(x) - s / n) @ axes) / np.sqrt(e), e / np.trace(v)


def close_up_to_sign(got, want):
    sign = np.sign((got * want).sum(axis=0))
    return np.allclose(got * sign, want, rtol=1e-7, atol=1e-7)


def test_whitening_equals_eigendecomposition(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(400, 9)) * np.arange(1, 10) + rng.normal(size=9)).astype(np.float32).tolist()
    vectors += vectors[:50] + vectors[:50]
    bad = [None, [None] * 9, [1.0] * 8 + [float("nan")], [float("inf")] + [1.0] * 8]
    got = whitening.whiten(embeddings(spark, vectors + bad)).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, dev, white, explained = truth_whitening(vectors)
    assert len(got) == 4 * len(vectors) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    table = got.sort_values(["vec_id", "component"])
    assert table["deviation"].tolist() == [d for d in dev for _ in range(4)]
    assert close_up_to_sign(table["whitened"].to_numpy().reshape(-1, 4), white)
    assert np.allclose(table["explained"].to_numpy().reshape(-1, 4), explained, rtol=1e-9)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(embeddings(spark, [[1.0, 2.0]] * 3)).collect() == []
    assert whitening.whiten(embeddings(spark, [[], None])).collect() == []
    empty = whitening.whiten(embeddings(spark, [[1.0]]).where("false"))
    assert empty.collect() == [] and empty.columns[0] == "vec_id"
    flat = whitening.whiten(embeddings(spark, [[0.0, 1.0, 5.0], [1.0, 2.0, 5.0], [2.0, 3.0, 5.0], [None, 1.0, 2.0]], [7, None, 7, 8])).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in flat) == [("7", 1), ("7", 1), ("None", 1)] and abs(flat[0]["explained"] - 1) < 1e-12
    two = whitening.whiten(embeddings(spark, [[0.0], [1.0], [0.0, 1.0], [3.0, 1.0], [4.0, 7.0]])).collect()
    assert Counter(r["vec_id"] for r in two) == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2}
    huge = whitening.whiten(embeddings(spark, [[3e9, 0.0], [-3e9, 1.0], [0.0, 2.0]])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 2} == {None} and all(np.isfinite(r["whitened"]) for r in huge)


def test_whitening_of_given_vectors(spark, sf_dir):
    vectors = [r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    n, dev, white, explained = truth_whitening(vectors)
    got = queries.op12_whitening(spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    assert got["deviation"].tolist()[::4] == dev and set(got["n"]) == {n}
    assert close_up_to_sign(got["whitened"].to_numpy().reshape(-1, 4), white)
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 4), explained, rtol=1e-9)


# ---- operator 13


def truth_repeats(texts, length):
    """For each text: removed runs and what is left, from a table of all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[a : a + length] for d in data for a in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for a in range(len(d) - length + 1):
            if seen[d[a : a + length]] > 1:
                gone[a : a + length] = True
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        out.append((len(d), int(gone.sum()), tuple(edge.tolist()), bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])))
    return out


def found_repeats(docs, **options):
    rows = repeats.remove_repeats(docs, **options).collect()
    return [(r["doc_id"], (r["n_bytes"], r["n_removed"], tuple(x for s in r["spans"] for x in s), bytes(r["kept"]))) for r in rows]


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é", "中文", "x1", "omega"]) + str(rng.randrange(1000)) for _ in range(n))


def passages(seed):
    """Texts that share passages of about the length, nested, overlapping, periodic, at the ends, and within one text."""
    rng = random.Random(seed)
    shared = [words(rng, 120) for _ in range(4)]
    texts = [None, "", "short", "a" * 1200, "b" * 399, "c" * 400, "c" * 400, "ab" * 300, "ab" * 205]
    for k in range(40):
        p = shared[k % 4].encode()
        cut = lambda: p[(a := rng.randrange(len(p) - 10)) : a + rng.choice([380, 399, 400, 401, 450, 700])].decode(errors="ignore")
        texts.append(rng.choice(["", words(rng, 30)]) + cut() + rng.choice(["", words(rng, 5)]) + cut() + rng.choice(["", words(rng, 40)]))
    texts += [shared[0]] * 5 + [shared[1][:500] + words(rng, 20) for _ in range(30)] + [words(rng, 100) for _ in range(10)]
    long = words(rng, 60_000)
    return [*texts, long, "z" + long[200_000:], shared[2] + " " + shared[2]]


@pytest.mark.parametrize("seed,batches", [(1, 4), (2, 1), (3, 7)])
def test_repeats_equal_brute_force(spark, seed, batches):
    texts = passages(seed)
    got = dict(found_repeats(docs_df(spark, texts).repartition(3), length=400, batches=batches))
    for k, want in enumerate(truth_repeats(texts, 400)):
        assert got[k] == want, k


def test_windows_of_few_letters(spark):
    """Texts of few different bytes and short periods, which repeat at most distances."""
    rng = random.Random(8)
    unit = lambda: "".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 7, 40, 170, 190])))
    texts = ["".join(unit() * rng.choice([1, 1, 2, 60, 200]) for _ in range(rng.randrange(1, 5)))[: rng.choice([150, 170, 171, 500, 3000])] for _ in range(150)]
    got = dict(found_repeats(docs_df(spark, texts), length=170, batches=2))
    for k, want in enumerate(truth_repeats(texts, 170)):
        assert got[k] == want, k


def test_repeats_of_odd_rows(spark):
    rng = random.Random(9)
    t = words(rng, 100)
    rows = [(None, t), (None, words(rng, 90)), (5, t), (5, words(rng, 80)), (5, None)]
    got = found_repeats(docs_df(spark, [x for _, x in rows], [i for i, _ in rows]))
    assert Counter(got) == Counter(zip([i for i, _ in rows], truth_repeats([x for _, x in rows], 400), strict=True))
    assert found_repeats(docs_df(spark, [t]).where("false")) == []
    assert repeats.remove_repeats(docs_df(spark, [t])).columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept"]


def test_repeats_of_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    truth = truth_repeats([r["text"] for r in docs], 400)
    want = sorted((r["doc_id"], n, gone, len(edges) // 2, hashlib.sha256(kept).hexdigest()) for r, (n, gone, edges, kept) in zip(docs, truth, strict=True))
    assert sorted(map(tuple, queries.op13_suffix_dedup(spark, sf_dir).collect())) == want
    assert any(w[2] for w in want)


def test_family_merges_geometrically(spark):
    rng = random.Random(4)
    family, sizes = repeats.SuffixFamily(), []
    for k in range(7):
        texts = spark.createDataFrame([(k * 10 + j, words(rng, 100).encode(), k) for j in range(3)], f"{repeats.ROW} long, _text binary, batch int")
        family.add(repeats.suffixes(texts, 400).drop("batch"))
        sizes.append([size for size, *_ in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1], [4, 2, 1]]
