"""A text index: posting blocks by term, kept in segments, and the k best by block maxima."""

from __future__ import annotations

import functools
import math
import operator
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import PIECE_ROWS, bound_batches
from .retrieval import K1, B, check_top_k

#: Words are runs of letters and digits, in lower case.
WORD = r"[\p{L}\p{N}]+"
#: Postings of a block, folders that terms are dealt to by their hash, and words that a task inverts at a time.
BLOCK, BUCKETS, SLICE_WORDS = 128, 64, 1_000_000
#: Slices that are read for a first threshold before the others.
FIRST_SLICES = 4
#: Scores that are nearer than this count as equal, so that no order of additions decides.
NEAR = 1e-9
_BLOCKS = "kind string, term string, slice long, first long, last long, n int, most int, shortest int, gaps array<long>, counts array<int>, lengths array<int>"


def _blocks(kind: str, terms: pa.Array, term: np.ndarray, doc: np.ndarray, count: np.ndarray, ids: np.ndarray, lengths: np.ndarray, number: int) -> pa.RecordBatch:
    """Posting blocks from occurrences in order of (term, document)."""
    new = np.ones(len(term), bool)
    new[1:] = term[1:] != term[:-1]
    start = np.flatnonzero(new)
    place = np.arange(len(term)) - np.repeat(start, np.diff(start, append=len(term)))
    at = np.flatnonzero(place % BLOCK == 0)
    n = np.diff(at, append=len(term))
    gaps = np.diff(ids[doc], prepend=0)
    gaps[at] = 0
    offsets = pa.array(np.append(at, len(term)).astype(np.int32))
    listed = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values.astype(kind)))
    columns = {
        "kind": pa.array([kind] * len(at), pa.string()), "term": terms.take(pa.array(term[at])), "slice": pa.array(np.full(len(at), number)),
        "first": pa.array(ids[doc[at]]), "last": pa.array(ids[doc[at + n - 1]]), "n": pa.array(n.astype(np.int32)),
        "most": pa.array(np.maximum.reduceat(count, at).astype(np.int32)), "shortest": pa.array(np.minimum.reduceat(lengths[doc], at).astype(np.int32)),
        "gaps": listed(gaps, np.int64), "counts": listed(count, np.int32), "lengths": listed(lengths[doc], np.int32),
    }
    return pa.RecordBatch.from_pydict(columns)


def _inverted(ids: np.ndarray, words: pa.Array, sizes: np.ndarray, number: int, grams: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Blocks of a slice of documents (ids in order), for words and for their prefixes, and a row with its sums."""
    coded = words.dictionary_encode()
    vocabulary, code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(ids)), sizes)
    pair, count = np.unique(code * len(ids) + doc, return_counts=True)
    term, doc = pair // len(ids), pair % len(ids)
    if len(term):
        yield _blocks("word", vocabulary, term, doc, count, ids, sizes, number)
    length = pc.utf8_length(vocabulary).to_numpy()
    parts = [(size, np.flatnonzero(length >= size)) for size in range(grams[0], grams[1] + 1)]
    prefixes = pa.concat_arrays([pc.utf8_slice_codeunits(vocabulary.take(pa.array(long)), 0, size) for size, long in parts]).dictionary_encode()
    base, sums = 0, np.zeros(len(ids), np.int64)
    keys, weights = [], []
    for _, long in parts:
        of_word = np.full(len(vocabulary), -1)
        of_word[long] = prefixes.indices.to_numpy()[base : base + len(long)]
        base += len(long)
        has = of_word[term] >= 0
        keys.append(of_word[term][has] * len(ids) + doc[has])
        weights.append(count[has])
        sums += np.bincount(doc[has], weights=count[has], minlength=len(ids)).astype(np.int64)
    pair, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    if len(pair):
        total = np.bincount(inverse, weights=np.concatenate(weights)).astype(np.int64)
        yield _blocks("prefix", prefixes.dictionary.cast(pa.string()), pair // len(ids), pair % len(ids), total, ids, sums, number)
    for kind, lengths in (("word", sizes), ("prefix", sums)):
        told = {"kind": [kind], "term": [None], "slice": [number], "first": [len(ids)], "last": [int(lengths.sum())], "n": [0], "most": [0], "shortest": [0], "gaps": [[]], "counts": [[]], "lengths": [[]]}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(told.items(), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)})


class TextIndex:
    """An index in a folder that driver and executors share.

    ``postings`` has a row for each block of up to ``BLOCK`` documents of a term: gaps between ids, counts and lengths, with the ids at its
    ends, the highest count and the shortest length, which bound its scores whatever later segments do to averages.  Folders
    are by segment and by hash of the term, and files are sorted by term, so a search reads its terms' blocks.  A segment counts
    from when its row of sums is in ``segments``: a write that dies leaves nothing behind that is read.
    """

    def __init__(self, spark: SparkSession, path: str, grams: tuple[int, int] = (2, 3), slice_words: int = SLICE_WORDS):
        self.spark, self.path, self.grams, self.slice_words = spark, path.rstrip("/"), grams, slice_words

    def add(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> str:
        """Index a batch of documents with new ids (long); earlier segments aren't read.  Gives the segment's name.

        Each task inverts its documents, so what is shuffled are blocks and not words.  A null text has no words but counts as a
        document; rows with a null id are left out; an id that was added before is another document with the same id.
        """
        grams, slice_words, segment = self.grams, self.slice_words, uuid.uuid4().hex
        rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)).alias("words"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, held, number, n = TaskContext.get().partitionId(), [], 0, 0

            def done() -> Iterator[pa.RecordBatch]:
                table = pa.Table.from_batches(held).combine_chunks().sort_by("id")
                words = table.column("words").combine_chunks()
                yield from _inverted(table.column("id").to_numpy(), words.flatten(), words.value_lengths().to_numpy().astype(np.int64), task << 24 | number, grams)

            for b in batches:
                for at in range(0, b.num_rows, PIECE_ROWS):
                    held.append(b.slice(at, PIECE_ROWS))
                    n += len(held[-1].column("words").flatten())
                    if n >= slice_words:
                        yield from done()
                        held, number, n = [], number + 1, 0
            if held:
                yield from done()

        bound_batches(self.spark)
        blocks = rows.mapInArrow(run, _BLOCKS).withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int"))
        # Rebalanced rather than hashed: the blocks of a very frequent term may go to several tasks.
        sorted_blocks = blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "kind", "term", "first")
        small = {"parquet.block.size": 8 << 20, "parquet.page.row.count.limit": 256, "parquet.writer.version": "v2"}
        at = f"{self.path}/postings/segment={segment}"
        sorted_blocks.write.options(**{k: str(v) for k, v in small.items()}).partitionBy("bucket").parquet(at)
        sums = self.spark.read.schema(f"{_BLOCKS}, bucket int").parquet(at).where("bucket = -1").groupBy("kind").agg(F.sum("first").alias("docs"), F.sum("last").alias("length"))
        sums.withColumn("segment", F.lit(segment)).coalesce(1).write.mode("append").parquet(f"{self.path}/segments")
        return segment

    def segments(self) -> DataFrame:
        """``kind, docs, length, segment``: two rows for each segment."""
        return self.spark.read.schema("kind string, docs long, length long, segment string").parquet(f"{self.path}/segments")

    def postings(self, kind: str, terms: Sequence[str]) -> DataFrame:
        """The blocks of the terms in all segments that count: folders are pruned by hash and segment, pages by term."""
        names = self.segments().select("segment").distinct()
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(BUCKETS)) for t in terms)))).distinct().collect()]
        rows = self.spark.read.schema(f"{_BLOCKS}, bucket int, segment string").parquet(f"{self.path}/postings")
        return rows.where(F.col("bucket").isin(buckets) & (F.col("kind") == kind) & F.col("term").isin(list(terms))).join(F.broadcast(names), "segment", "left_semi")

    def search(self, terms: Sequence[str], k: int, *, kind: str = "word") -> DataFrame:
        """``id, raw``: the k documents with the highest BM25 score above zero, ties to the smaller id.

        Scores use the number of documents, the average length and the terms' document counts of all segments together.  Slices of documents are
        searched apart, each by :func:`best_of_slice`; a few whose bounds are highest give the threshold with which the others start.
        """
        check_top_k(k)
        terms = list(dict.fromkeys(t.lower() for t in terms))
        found = self.postings(kind, terms)
        total = self.segments().where(F.col("kind") == kind).agg(F.sum("docs").alias("n"), (F.sum("length") / F.sum("docs")).alias("mean")).first()
        n, mean = total["n"] or 0, total["mean"] or 1.0
        counts = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        weights = {t: math.log(1 + (n - df + 0.5) / (df + 0.5)) for t, df in counts.items()}
        if not weights:
            return self.spark.createDataFrame([], "id long, raw double")
        bound = F.element_at(F.create_map(*(x for t, w in weights.items() for x in (F.lit(t), F.lit(w)))), F.col("term")) * F.col("most") * (K1 + 1) / (F.col("most") + K1 * (1 - B + B * F.col("shortest") / F.lit(mean)))
        by_term = found.withColumn("bound", bound).groupBy("segment", "slice", "term").agg(F.max("bound").alias("bound"))
        slices = by_term.groupBy("segment", "slice").agg(F.sum("bound").alias("bound")).orderBy(F.desc("bound"), "segment", "slice")
        first = slices.limit(FIRST_SLICES + 1).collect()

        def best(blocks: DataFrame, least: float) -> DataFrame:
            run = lambda part: best_of_slice(part, weights, mean, k, least)[0]
            return blocks.groupBy("segment", "slice").applyInPandas(run, "id long, raw double").orderBy(F.round("raw", 9).desc(), "id").limit(k)

        least = -math.inf
        if len(first) > FIRST_SLICES:
            chosen = functools.reduce(operator.or_, ((F.col("segment") == r["segment"]) & (F.col("slice") == r["slice"]) for r in first[:FIRST_SLICES]))
            scores = [r["raw"] for r in best(found.where(chosen), least).collect()]
            least = min(scores) if len(scores) == k else least
            found = found.join(slices.where(F.col("bound") >= least - NEAR).select("segment", "slice"), ["segment", "slice"], "left_semi")
        return best(found, least)


def best_of_slice(blocks: pd.DataFrame, weights: dict[str, float], mean: float, k: int, least: float = -math.inf) -> tuple[pd.DataFrame, int]:
    """The k best documents of a slice that reach ``least``, and how many postings were looked at.

    The ids at the ends of blocks cut the slice into intervals.  In an interval no score is over the sum of the bounds of the blocks
    that cover it, so intervals are taken from the highest bound down, and those that can't reach the k-th score found so far are
    left, as their blocks are if no other interval needs them.
    """
    blocks = blocks.reset_index(drop=True)
    weight = blocks["term"].map(weights).to_numpy(float)
    most, shortest = blocks["most"].to_numpy(float), blocks["shortest"].to_numpy(float)
    score = lambda w, count, length: w * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))
    bound, low, high = score(weight, most, shortest), blocks["first"].to_numpy(), blocks["last"].to_numpy()
    cuts = np.unique(np.concatenate((low, high + 1)))
    cover = np.zeros(len(cuts))
    np.add.at(cover, np.searchsorted(cuts, low), bound)
    np.add.at(cover, np.searchsorted(cuts, high + 1), -bound)
    cover = np.cumsum(cover)
    by_start = np.argsort(low, kind="stable")
    reach = np.maximum.accumulate(high[by_start])
    read: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    ids, raws, looked = np.zeros(0, np.int64), np.zeros(0), 0
    for at in np.argsort(-cover, kind="stable"):
        if at == len(cuts) - 1 or cover[at] < least - NEAR:
            continue
        start, end = cuts[at], cuts[at + 1]
        some = by_start[np.searchsorted(reach, start) : np.searchsorted(low[by_start], end)]
        parts = []
        for b in some[high[some] >= start]:
            if b not in read:
                row = blocks.iloc[b]
                read[b] = low[b] + np.cumsum(np.asarray(row["gaps"], np.int64)), score(weight[b], np.asarray(row["counts"], float), np.asarray(row["lengths"], float))
                looked += len(read[b][0])
            a, z = np.searchsorted(read[b][0], (start, end))
            parts.append((read[b][0][a:z], read[b][1][a:z]))
        if parts:
            found, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            ids, raws = np.concatenate((ids, found)), np.concatenate((raws, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(found))))
            top = np.lexsort((ids, -np.round(raws, 9)))[:k]
            ids, raws = ids[top], raws[top]
            if len(ids) == k:
                least = max(least, raws.min())
    return pd.DataFrame({"id": ids, "raw": raws}), looked


def prefix_terms(text: str, grams: tuple[int, int] = (2, 3)) -> list[str]:
    """The prefixes by which a query's words are looked up in an index of prefixes."""
    return list(dict.fromkeys(w[:size] for w in re.findall(r"[^\W_]+", text.lower()) for size in range(grams[0], grams[1] + 1) if len(w) >= size))
