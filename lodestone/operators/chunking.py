"""Chunking: one text to many pieces, as pure functions on lists and as DataFrame operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.batches import PIECE_ROWS, bound_batches

#: Where a text may be split, coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", ", ", " ")
#: Patterns of what is never split (code, displayed and inline formulas, images, links).  Table rows may be split.
PROTECTED = (
    r"```[\s\S]*?```",
    r"\$\$[\s\S]*?\$\$",
    r"\$[^$\n]+\$",
    r"!\[.*?\]\(.*?\)",
    r"\[.*?\]\(.*?\)",
)


def check_chunk_params(size: int | None, overlap: int, by_tokens: bool = False) -> None:
    if size is None and by_tokens:
        raise ValueError("token mode needs a size")
    if size is not None and (size <= 0 or not 0 <= overlap < size):
        raise ValueError("size must be positive and 0 <= overlap < size")


def fixed_windows(df: DataFrame, size: int | None, overlap: int = 0, *, text: str = "text") -> DataFrame:
    """``index, start, chunk`` of character windows: each starts ``size - overlap`` after the last; none follows one that reaches the end.

    All in built-in functions.  No size gives the text as one chunk; an empty text gives none.
    """
    check_chunk_params(size, overlap)
    n = F.length(text)
    kept = [c for c in df.columns if c != text]
    if size is None:
        return df.where(n > 0).select(*kept, F.lit(0).alias("index"), F.lit(0).alias("start"), F.col(text).alias("chunk"))
    step = max(size - overlap, 1)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    rows = df.where(n > 0).select(*kept, text, F.explode(F.sequence(F.lit(0), count - 1)).alias("index"))
    start = F.col("index") * step
    return rows.select(*kept, "index", start.alias("start"), F.substring(F.col(text), start + 1, F.lit(size)).alias("chunk"))


def token_estimate(text: Column) -> Column:
    """Four characters to a token."""
    return F.floor(F.length(text) / 4)


def token_windows(df: DataFrame, tokens: int, overlap: int = 0, *, text: str = "text") -> DataFrame:
    return fixed_windows(df, 4 * tokens, 4 * overlap, text=text)


def protected_ranges(text: str, patterns: Sequence[str] = PROTECTED) -> list[tuple[int, int]]:
    """Merged ranges of code, formulas, images and links; ranges that touch are one."""
    found = sorted(m.span() for p in patterns for m in re.finditer(p, text, re.MULTILINE | re.DOTALL))
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def split_units(text: str, separators: Sequence[str] = SEPARATORS, protect: bool = False) -> list[str]:
    """Units that end in their separator, so that joined they are the text; protected ranges stay whole."""
    if not text:
        return []
    if not separators:
        return [text]
    form = re.compile("|".join(re.escape(s) for s in sorted(separators, key=len, reverse=True)))
    closed, out, start, k = protected_ranges(text) if protect else [], [], 0, 0
    for m in form.finditer(text):
        # Both are in order, so ranges that end before this separator are passed for good.
        while k < len(closed) and closed[k][1] <= m.start():
            k += 1
        if k == len(closed) or m.end() <= closed[k][0]:
            out.append(text[start : m.end()])
            start = m.end()
    return [*out, text[start:]] if start < len(text) else out


def pack_units(units: Sequence[str], size: int, overlap: int, length=lambda u: len(u) // 4) -> list[list[str]]:
    """Units in order, in groups of up to ``size``; the last units up to ``overlap`` start the next group if its next unit still fits.

    A unit over the size is a group of its own, so the scan always moves on.
    """
    out: list[list[str]] = []
    group: list[str] = []
    total = 0
    for u in units:
        n = length(u)
        if group and total + n > size:
            out.append(group)
            carry, held = [], 0
            for before in reversed(group):
                if held + length(before) > overlap:
                    break
                carry.insert(0, before)
                held += length(before)
            group, total = (carry, held) if held + n <= size else ([], 0)
        group.append(u)
        total += n
    return [*out, group] if group else out


def recursive_chunks(text: str, size: int, overlap: int = 0, separators: Sequence[str] = SEPARATORS, protect: bool = True) -> list[str]:
    """Separator units packed to ``size`` characters; longer units are cut into windows; blanks are dropped."""
    check_chunk_params(size, overlap)
    units: list[str] = []
    for u in split_units(text, separators, protect):
        if len(u) > size and not (protect and protected_ranges(u)):
            units += [u[k : k + size] for k in range(0, len(u), size)]
        else:
            units.append(u)
    return [c for g in pack_units(units, size, overlap, len) if (c := "".join(g).strip())]


def token_chunks(text: str, size: int, overlap: int = 0) -> list[str]:
    return [c for g in pack_units(split_units(text), size, overlap) if (c := "".join(g).strip())]


def _chunk_batches(batches: Iterator[pa.RecordBatch], split: Callable[[str], list[str]]) -> Iterator[pa.RecordBatch]:
    """``key, index, chunk`` of batches of keys and texts, for a few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, PIECE_ROWS):
            piece = b.slice(at, PIECE_ROWS)
            rows = [(k, n, c) for k, t in zip(piece.column(0).to_pylist(), piece.column(1), strict=True) for n, c in enumerate(split(t.as_py() or ""))]
            if rows:
                ks, ns, cs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ks, b.column(0).type), pa.array(ns, pa.int32()), pa.array(cs, pa.string())], names=["key", "index", "chunk"])


def chunk_documents(df: DataFrame, size: int, overlap: int = 0, *, strategy: str = "recursive", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, index, chunk`` by a Python splitter over Arrow batches; rows stay in their partitions."""
    check_chunk_params(size, overlap)
    split = {"recursive": recursive_chunks, "token": token_chunks}[strategy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _chunk_batches(batches, lambda t: split(t, size, overlap))

    bound_batches(df.sparkSession)
    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"key {kind}, index int, chunk string").withColumnRenamed("key", key)


def markdown_sections(df: DataFrame, *, key: str = "doc_id", text: str = "text", prefixes: Sequence[str] = ()) -> DataFrame:
    """``key, section, title, body``: lines under each heading (# to ######, or the given prefixes, longest first).

    Lines before the first heading are section 0.  Built-in functions: the heading of a line is a
    running count over the document's own lines.
    """
    forms = [re.escape(p) for p in sorted(prefixes, key=len, reverse=True)] or ["#{1,6}"]
    head = rf"^(?:{'|'.join(forms)})\s+(.+?)\s*$"
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    is_head = F.col("line").rlike(head)
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.sum(is_head.cast("int")).over(upto)).withColumn("_h", is_head)
    body = F.transform(F.sort_array(F.collect_list(F.when(~F.col("_h"), F.struct("n", "line")))), lambda x: x["line"])
    out = lines.groupBy(key, "section").agg(F.max(F.when(F.col("_h"), F.regexp_extract("line", head, 1))).alias("title"), F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", "").alias("body"))
    return out.where("title is not null or body <> ''")


TABLE = r"(?s)(^|\n)\|.*\|[ \t]*(\n|$)|<table"
IMAGE = r"!\[[^\]]*\]\([^)]*\)|<img"


def media_context(chunks: DataFrame, *, before: int, after: int, key: str = "doc_id", order: str = "index", text: str = "chunk") -> DataFrame:
    """Table and image chunks get the end of the chunk before and the start of the one after; both as they were, not as enriched."""
    at = Window.partitionBy(key).orderBy(order)
    prior = F.lag(F.expr(f"right(`{text}`, {int(before)})")).over(at)
    later = F.lead(F.substring(text, 1, after)).over(at)
    media = F.col(text).rlike(TABLE) | F.col(text).rlike(IMAGE)
    return chunks.withColumn("enriched", F.when(media, F.concat_ws("\n", prior, F.col(text), later)).otherwise(F.col(text)))


def chunk_stats(chunks: DataFrame, *, key: str, text: str = "chunk", order: str = "index") -> DataFrame:
    n = F.length(text)
    return chunks.groupBy(key).agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.floor(F.avg(n)).alias("mean"), F.min_by(F.substring(text, 1, 10), order).alias("first"))


def one_row_per_chunk(df: DataFrame, *, key: str, is_row: Column) -> DataFrame:
    """Whether a document is a spreadsheet whose rows are its chunks: all of its paragraphs are rows."""
    return df.groupBy(key).agg(F.bool_and(is_row).alias("by_row"))


def spreadsheet_limits(size: int, overlap: int, most: int = 2000) -> tuple[int, int]:
    """Chunk size and overlap for workbooks."""
    size = min(size, most)
    return size, min(overlap, size // 10)
