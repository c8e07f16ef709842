"""Quality classifier with hierarchical empirical Bayes over hosts and paths (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialize, prepare

FEATURES = ("upper", "digit", "space", "bang", "bar", "symbol", "stop", "other_punct", "non_ascii", "log_words", "word_length", "repeat_next", "distinct_words", "repeat_lines", "words_per_line")
_GROUPS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "bang": b"!?", "bar": b"|", "symbol": b"#$%&*@^~<>{}[]\\=_`", "stop": b".,", "other_punct": b"\"'()+-/:;"}
_CLASS = np.zeros((256, 9))
for _k, _chars in enumerate(_GROUPS.values()):
    _CLASS[list(_chars), _k] = 1
_CLASS[128:, 8] = 1


def features(text: str | None) -> np.ndarray:
    """Shares of character classes and of repeats over the whole text, on a log scale; all finite, also for an empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.split(b"\n")
    n, w = len(raw), len(words)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    smooth = lambda part, whole: np.log((part + 0.5) / (whole + 10.0))
    return np.array([*smooth(shares, n), np.log1p(w), np.log1p(n / (w + 1)), smooth(repeats, w), np.log((len(set(words)) + 1) / (w + 1)), smooth(len(lines) - len(set(lines)), len(lines)), np.log1p(w / len(lines))])


def featurize(docs: DataFrame, kept: list[str], text_col: str = "text") -> DataFrame:
    """``kept`` columns and ``x``, the features of each whole text, in one scan."""
    prepare(docs.sparkSession)
    src = docs.select(*kept, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column("_text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=[*kept, "x"])

    fields = ", ".join(f"`{c}` {t}" for c, t in src.select(*kept).dtypes)
    return src.mapInArrow(run, f"{fields}, x array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``weights, mean, scale`` of a ridge logistic regression by Newton steps; the first weight is the constant."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def _logit(p: F.Column) -> F.Column:
    return F.log(p / (1 - p))


def _concentration(sites: DataFrame, prior: F.Column) -> float:
    """Strength of the beta prior over site means by moments: large when sites differ no more than their sizes explain.

    ``sites`` has ``n, m`` (documents, mean evidence).  One aggregation; no site reaches the driver.
    """
    within = prior * (1 - prior)
    got = sites.where("n > 1").agg(F.count("*").alias("k"), F.sum(F.pow(F.col("m") - prior, 2) * F.col("n")).alias("between"), F.sum(within).alias("within"), F.sum(F.col("n") * within).alias("weighted")).first()
    if not got["k"] or not got["within"]:
        return 100.0
    extra = (got["between"] - got["within"]) / max(got["weighted"], 1e-12)
    return float(np.clip(1 / extra - 1, 1.0, 1e6)) if extra > 0 else 1e6


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    host: F.Column | None = None,
    path: F.Column | None = None,
    threshold: float = 0.5,
    max_train_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: ``doc_id, host, path, p_document, p_site, p_quality, kept`` and the columns to ``carry``.

    1. Evidence of the document: a logistic regression on features of its whole text, fitted on at
       most ``max_train_rows`` labelled documents (those with the smallest hash of their id, so the
       sample doesn't depend on partitions).
    2. Posteriors of sites: the mean evidence of a host shrinks to the global mean, and that of a
       path below it to its host's posterior, by sums over all documents and beta priors whose strengths are estimated
       from how much sites differ.  A document's own evidence is left out of its site's.
    3. The site's log-odds over the global log-odds add to the document's.

    A null text counts as empty; a null host or path is a site of its own; null ids are scored and
    carried; labels that are null, have no document, or disagree for one document are no evidence.
    Without labels of both classes the document's evidence is 0.5, and all documents are kept.
    Repeated rows are scored alike; an empty table gives no rows.  Columns whose names clash aren't read.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("_t"), *carry)
    rows = materialize(featurize(src, ["doc_id", "host", "path", *carry], "_t"), "quality-features")
    known = labels.where("quality in (0, 1)").groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y").drop("_y")
    once = rows.where("doc_id is not null").select("doc_id", "x")
    sample = once.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows).select("x", "y").toPandas()
    evidence = F.lit(0.5)
    if sample["y"].nunique() == 2:
        w, mean, scale = fit_logistic(np.stack(sample["x"].to_numpy()), sample["y"].to_numpy(float))
        w, constant = w[1:] / scale, w[0] - (w[1:] / scale) @ mean
        score = F.aggregate(F.zip_with("x", F.array(*(F.lit(float(v)) for v in w)), lambda a, b: a * b), F.lit(float(constant)), lambda a, b: a + b)
        evidence = 1 / (1 + F.exp(-F.greatest(F.least(score, F.lit(30.0)), F.lit(-30.0))))
    scored = materialize(rows.select("doc_id", "host", "path", *carry, evidence.alias("p_document")), "quality-evidence")
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_document").alias("s")), "quality-paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "quality-hosts")
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    prior = float(np.clip(total["s"] / total["n"], 1e-6, 1 - 1e-6)) if total["n"] else 0.5
    k_host = _concentration(hosts.select(F.col("hn").alias("n"), (F.col("hs") / F.col("hn")).alias("m")), F.lit(prior))
    hosts = hosts.withColumn("hm", (F.col("hs") + k_host * prior) / (F.col("hn") + k_host))
    sites = paths.withColumnRenamed("host", "_h").join(hosts, F.col("_h").eqNullSafe(F.col("host"))).drop("_h")
    k_path = _concentration(sites.select("n", (F.col("s") / F.col("n")).alias("m"), "hm"), F.col("hm"))
    sites = materialize(sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "s", "hn", "hs"), "quality-sites")
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    own = F.col("p_document")
    of_host = (F.col("hs") - own + k_host * prior) / (F.col("hn") - 1 + k_host)
    of_path = (F.col("s") - own + k_path * of_host) / (F.col("n") - 1 + k_path)
    bound = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    out = out.withColumn("p_site", bound(of_path))
    odds = _logit(bound(own)) + _logit(F.col("p_site")) - float(np.log(prior / (1 - prior)))
    out = out.withColumn("p_quality", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "host", "path", "p_document", "p_site", "p_quality", (F.col("p_quality") >= threshold - 1e-9).alias("kept"), *carry)
