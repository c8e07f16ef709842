"""Long repeated passages by a logarithmic family of sparse suffix arrays (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import ROW, discard, ids_side, latest, materialize, numbered, prepare

#: Bytes of a suffix that its key stands for.  A window of ``length`` bytes holds ``length - HEAD + 1`` such suffixes.
HEAD = 128
#: Starts of windows that are looked at together; their numbers fill the low bits of what minima are taken of.
BLOCK_BITS = 18
_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Windows of a run whose suffix lies equally far in them, to this many bytes, are compared together first.
STEP = 32
#: A run's place in one number: its first window's start, the number of its windows, and how far its suffix is from the start.
PLACE = "shiftleft(cast(start as long), 32) + shiftleft(cast(windows as long), 16) + cast(ahead as long)"


class Rolling:
    """Polynomial hashes, modulo 2**64, of byte ranges, from prefix sums; bytes stand for random words."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.words = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) | 1
        self.powers, self.inverses = self._powers(base, size), self._powers(pow(base, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, out=out)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.words[data] * self.powers[: len(data)], out=out[1:])
        return out

    def ranges(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefixes[end] - prefixes[start]) * self.inverses[start]

    def windows(self, prefixes: np.ndarray, length: int) -> np.ndarray:
        return (prefixes[length:] - prefixes[:-length]) * self.inverses[: len(prefixes) - length]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    for shift, times in zip((30, 27), _MULTIPLIERS, strict=True):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


def sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def merged(start: np.ndarray, end: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals in order of (group, start): starts, ends and the place of each union's first interval; neighbours that touch are one."""
    if not len(start):
        return start, end, np.zeros(0, np.int64)
    reach = np.maximum.accumulate(end)  # ends of earlier groups are below the starts of later ones, or the group tells
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    if group is not None:
        new[1:] |= group[1:] != group[:-1]
    at = np.flatnonzero(new)
    return start[at], np.maximum.reduceat(end, at), at


class Sampler:
    """The sparse suffixes of texts.

    Each window of ``length`` bytes is anchored at the suffix within it whose first ``HEAD`` bytes have the least
    hash (the first of equal ones), so equal windows have their anchors at the same place, and neighbouring windows share one.  A suffix stands
    for the run of windows anchored at it: ``key`` is the hash of its head, ``ctx`` that of all the run's bytes.
    """

    def __init__(self, length: int):
        if not HEAD + STEP <= length < 1 << 15:
            raise ValueError(f"repeats have {HEAD + STEP} to {(1 << 15) - 1} bytes")
        self.length, size = length, (1 << BLOCK_BITS) + 2 * length + 1
        self.order, self.check = Rolling(11, size), Rolling(13, size)
        self.mask = np.uint64((1 << BLOCK_BITS + 1) - 1)

    def valid(self, offsets: np.ndarray, total: int) -> np.ndarray:
        """Whether a window that starts at each byte lies in one text."""
        edge = np.zeros(total + 1, np.int8)
        long = offsets[1:] - offsets[:-1] >= self.length
        edge[offsets[:-1][long]] += 1
        edge[offsets[1:][long] - self.length + 1] -= 1
        return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)

    def runs(self, data: np.ndarray, valid: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """``key, ctx, start, windows, ahead`` of the runs of each block of starts; the suffix is ``ahead`` of the start."""
        for first in range(0, len(data) - self.length + 1, 1 << BLOCK_BITS):
            end = min(first + (1 << BLOCK_BITS), len(data) - self.length + 1)
            here = np.flatnonzero(valid[first:end])
            if not len(here):
                continue
            block = data[first : end + self.length - 1]
            sums, checks = self.order.prefixes(block), self.check.prefixes(block)
            heads = mixed(self.order.windows(sums, HEAD))
            places = np.arange(len(heads), dtype=np.uint64)
            anchor = (sliding_minimum(heads & ~self.mask | places, self.length - HEAD + 1) & self.mask).astype(np.int64)[here]
            new = np.ones(len(here), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (here[1:] != here[:-1] + 1)
            at = np.flatnonzero(new)
            start, anchor = here[at], anchor[at]
            windows = np.diff(at, append=len(here))
            shape = (windows << 20 | anchor - start).astype(np.uint64)
            ctx = mixed(self.check.ranges(checks, start, start + windows - 1 + self.length) ^ mixed(shape))
            yield heads[anchor].view(np.int64), ctx.view(np.int64), start + first, windows, anchor - start


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, one after the other, and where each begins."""
    texts = column.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _collapsed(key: np.ndarray, ctx: np.ndarray, start: np.ndarray, windows: np.ndarray, ahead: np.ndarray, doc: np.ndarray, length: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """One row for equal runs of a text (``key, ctx, n, start, windows, ahead, doc``), and the spans that these cover (``start, windows, doc``)."""
    order = np.lexsort((start, ctx, key, doc))
    key, ctx, start, windows, ahead, doc = (x[order] for x in (key, ctx, start, windows, ahead, doc))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    n = np.diff(at, append=len(key))
    many = np.flatnonzero(np.repeat(n > 1, n))
    many = many[np.argsort(start[many], kind="stable")]
    s, e, place = merged(start[many], start[many] + windows[many] - 1 + length, doc[many])
    return (key[at], ctx[at], n, start[at], windows[at], ahead[at], doc[at]), (s, e - s - length + 1, doc[many][place])


def suffixes(texts: DataFrame, length: int) -> DataFrame:
    """The sparse suffixes of ``texts`` (``ROW, _text`` binary, ``batch``), some 2 for ``length - HEAD`` bytes: ``key, ctx, n, ROW, start, windows, ahead, batch``.

    Equal runs within a text are one row with their number; what they cover is told by rows with a null key.
    """
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(length)
        for b in batches:
            data, offsets = _texts(b.column("_text"))
            if len(data) < length:
                continue
            rows, batch = b.column(ROW).to_numpy(), b.column("batch").to_numpy()

            def told(key, ctx, n, start, windows, ahead, doc):  # noqa: ANN001, ANN202, B023
                small = (pa.array(x.astype(np.int32)) for x in (n, start - offsets[doc], windows, ahead))  # noqa: B023
                n, start, windows, ahead = small
                return pa.RecordBatch.from_arrays([key, ctx, n, pa.array(rows[doc]), start, windows, ahead, pa.array(batch[doc])], ["key", "ctx", "n", ROW, "start", "windows", "ahead", "batch"])  # noqa: B023

            for key, ctx, start, windows, ahead in sampler.runs(data, sampler.valid(offsets, len(data))):
                doc = np.searchsorted(offsets, start, side="right") - 1
                (key, ctx, *rest), (start, windows, doc) = _collapsed(key, ctx, start, windows, ahead, doc, length)
                yield told(pa.array(key), pa.array(ctx), *rest)
                if len(start):
                    none, zero = pa.nulls(len(start), pa.int64()), np.zeros(len(start), np.int64)
                    yield told(none, none, zero, start, windows, zero, doc)

    return texts.mapInArrow(run, f"key long, ctx long, n int, {ROW} long, start int, windows int, ahead int, batch int")


class SuffixFamily:
    """Suffix arrays of sizes 1, 2, 4, ... batches; each is a table of sorted runs in the shared folder.

    An array holds a row for each distinct run: ``key, ctx``, the number ``n`` of its places and one of them.  It is sorted by the
    digests of the suffixes' heads and of their runs: equal heads are neighbours in any such order, and matches shorter than a head aren't looked for.
    :meth:`add` merges arrays of equal size until none are, sorts the new batch and scans it with each array for equal heads, so a
    suffix is rewritten as often as the logarithm of the number of batches.  Earlier texts aren't read.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.spans: list[DataFrame] = []
        self.edges: list[DataFrame] = []

    def _array(self, runs: DataFrame, size: int) -> tuple[int, DataFrame, str]:
        # The two parts of a place are taken from one row: both are what the group meets first.
        once = runs.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.first(ROW).alias(ROW), F.first("place").alias("place"))
        return size, materialize(once.sortWithinPartitions("key", "ctx"), "suffix-array"), latest()

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a, at), (_, b, old) = self.levels.pop(), self.levels.pop()
            self.levels.append(self._array(a.unionByName(b), 2 * size))
            discard(a.sparkSession, [at, old])

    def add(self, batch: DataFrame) -> None:
        """Take a batch of :func:`suffixes`.  Found spans and the edges of matches join ``spans`` and ``edges``."""
        self._merge()
        runs = batch.where("key is not null").select("key", "ctx", F.col("n").cast("long").alias("n"), ROW, F.expr(PLACE).alias("place"))
        self.levels.append(self._array(runs, 1))
        new = self.levels[-1][1]
        heads = lambda rows: rows.groupBy("key").agg(F.min("ctx").alias("low"), F.max("ctx").alias("high"), F.sum("n").alias("places"))
        own = heads(new)
        both, met = new.withColumn("fresh", F.lit(True)), own
        if len(self.levels) > 1:
            old = self.levels[0][1]
            for _, level, _ in self.levels[1:-1]:
                old = old.unionByName(level)
            old = materialize(old.join(own.select("key"), "key", "left_semi"), "suffix-scan")
            both, met = both.unionByName(old.withColumn("fresh", F.lit(False))), own.unionByName(heads(old))
        # Heads with two places or more; an edge is one that is followed or preceded by different bytes.
        met = met.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("places").alias("places")).where("places > 1")
        met = ids_side(materialize(met.select("key", (F.col("low") != F.col("high")).alias("edge")), "suffix-heads"))
        found = materialize(both.join(met, "key"), "suffix-matches")
        self.edges.append(materialize(found.where("edge").select(ROW, "place"), "suffix-edges"))
        whole = found.groupBy("key", "ctx").agg(F.sum("n").alias("places"), F.sum(F.when(F.col("fresh"), F.col("n"))).alias("mine")).where("places > 1 and mine > 0")
        whole = materialize(whole, "suffix-whole")
        # Runs with one place in this batch, or in an array until now, are told by their row; those with more by their places.
        single = found.where("n = 1").join(ids_side(whole.select("key", "ctx")), ["key", "ctx"], "left_semi").select(ROW, "place")
        copies = runs.join(ids_side(whole.where("mine > 1").select("key", "ctx")), ["key", "ctx"], "left_semi").select(ROW, "place")
        start, windows = F.shiftright("place", 32).cast("int"), F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
        told = single.unionByName(copies).select(ROW, start.alias("start"), windows.alias("windows"))
        self.spans.append(materialize(told.unionByName(batch.where("key is null").select(ROW, "start", "windows")), "suffix-spans"))


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Pieces of the data laid one after the other, a bounded number of bytes at a time: which, where each begins, and the bytes."""
    total, low = np.cumsum(size), 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(total, total[low] - size[low] + (1 << BLOCK_BITS), side="right")))
        lead = total[low:high] - size[low:high] - (total[low] - size[low])
        yield slice(low, high), lead, data[np.repeat(begin[low:high] - lead, size[low:high]) + np.arange(total[high - 1] - total[low] + size[low])]
        low = high


def _hashed(text: np.ndarray, hashes: tuple[Rolling, Rolling], *ranges: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """128 bits, as two longs, for each of some lists of (start, end)."""
    sums = [h.prefixes(text) for h in hashes]
    return [mixed(h.ranges(p, s, e)).view(np.int64) for s, e in ranges for h, p in zip(hashes, sums, strict=True)]


def _at_texts(texts: DataFrame, places: DataFrame, columns: list[str], work, schema: str) -> DataFrame:  # noqa: ANN001
    """``work(data, row number of each place, byte where its text begins, *columns)`` for the texts (``ROW, _text``) of places, in batches."""
    wanted = ids_side(materialize(places.select(ROW).distinct(), "place-rows"))
    by_row = places.groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _texts(b.column("_text"))
            listed = b.column("_places")
            doc = np.repeat(np.arange(b.num_rows), listed.value_lengths().to_numpy())
            yield from work(data, b.column(ROW).to_numpy()[doc], offsets[doc], *(listed.flatten().field(k).to_numpy().astype(np.int64) for k in range(len(columns))))

    return texts.join(wanted, ROW, "left_semi").join(by_row, ROW).mapInArrow(run, schema)


def _cells(texts: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """The windows of the edges' runs by how far their suffix is ahead, ``STEP`` bytes to a cell: ``ROW, start, windows, a, b, c, d``.

    ``a, b`` hash the bytes that all windows of a cell share: if these don't repeat, none of the windows does.  ``c, d`` hash all bytes of a
    whole cell (null for a part of one): if these repeat, so do all its windows.
    """

    def work(data, rows, base, place):  # noqa: ANN001, ANN202
        hashes = Rolling(17, (1 << BLOCK_BITS) + 3 * length), Rolling(19, (1 << BLOCK_BITS) + 3 * length)
        begin, windows, ahead = place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF
        for part, lead, text in _gathered(data, begin + base, windows - 1 + length):
            s, w, high, r = begin[part], windows[part], ahead[part], rows[part]
            low = high - w + 1
            number = high // STEP - low // STEP + 1
            run = np.repeat(np.arange(len(s)), number)
            cell = low[run] // STEP + np.arange(len(run)) - np.repeat(np.cumsum(number) - number, number)
            near, far = np.maximum(low[run], cell * STEP), np.minimum(high[run], cell * STEP + STEP - 1)
            anchor = (lead + high)[run]
            shared = anchor - cell * STEP
            full = far - near == STEP - 1
            around = np.where(full, shared - STEP + 1, 0)
            a, b, c, d = _hashed(text, hashes, (shared, shared + length - STEP + 1), (around, np.where(full, shared + length, 0)))
            start, n = (s + high)[run] - far, far - near + 1
            yield pa.RecordBatch.from_arrays([pa.array(r[run]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(a), pa.array(b), pa.array(c, mask=~full), pa.array(d, mask=~full)], [ROW, "start", "windows", "a", "b", "c", "d"])

    return _at_texts(texts, edges, ["place"], work, f"{ROW} long, start int, windows int, a long, b long, c long, d long")


def _windows(texts: DataFrame, cells: DataFrame, length: int) -> DataFrame:
    """``ROW, start, a, b``: each window of the cells with its hashes."""

    def work(data, rows, base, begin, windows):  # noqa: ANN001, ANN202
        hashes = Rolling(17, (1 << BLOCK_BITS) + 3 * length), Rolling(19, (1 << BLOCK_BITS) + 3 * length)
        for part, lead, text in _gathered(data, begin + base, windows - 1 + length):
            w = windows[part]
            cell = np.repeat(np.arange(len(w)), w)
            inner = np.arange(len(cell)) - np.repeat(np.cumsum(w) - w, w)
            at = lead[cell] + inner
            a, b = _hashed(text, hashes, (at, at + length))
            yield pa.RecordBatch.from_arrays([pa.array(rows[part][cell]), pa.array((begin[part][cell] + inner).astype(np.int32)), pa.array(a), pa.array(b)], [ROW, "start", "a", "b"])

    return _at_texts(texts, cells, ["start", "windows"], work, f"{ROW} long, start int, a long, b long")


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that two rows or more have."""
    return rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key)


def edge_spans(texts: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """``ROW, start, windows``: the windows of the runs in ``edges`` (``ROW, place``) that repeat, first by cells and then, where a match begins or ends within one, each by itself."""
    cells = materialize(_cells(texts, edges, length), "edge-cells")
    some = materialize(cells.join(_repeated(cells, "a", "b"), ["a", "b"], "left_semi"), "edge-cells")
    full = some.where("c is not null")  # the others, which match none, stay where they are
    whole = _repeated(full, "c", "d").withColumn("_whole", F.lit(True))
    some = materialize(full.join(whole, ["c", "d"], "left").unionByName(some.where("c is null").withColumn("_whole", F.lit(None).cast("boolean"))), "edge-cells")
    part = some.where("_whole is null")
    # Windows of cells that repeat as a whole are looked at for their partners' sake, once for each such cell.
    partners = some.where("_whole").join(part.select("a", "b").distinct(), ["a", "b"], "left_semi")
    one = partners.groupBy("c", "d").agg(*(F.first(c).alias(c) for c in (ROW, "start", "windows"))).drop("c", "d")
    windows = materialize(_windows(texts, materialize(part.select(ROW, "start", "windows").unionByName(one), "edge-parts"), length), "edge-windows")
    single = windows.join(_repeated(windows, "a", "b"), ["a", "b"], "left_semi").select(ROW, "start", F.lit(1).alias("windows"))
    return some.where("_whole").select(ROW, "start", "windows").unionByName(single)


def find_repeats(rows: DataFrame, *, text_col: str = "text", length: int = 400, batches: int = 4) -> DataFrame:
    """``ROW, _spans``: for each row (numbered in ``ROW``) that holds any, the array of starts and windows of its repeated passages, in no order.

    A passage is repeated where ``length`` bytes start elsewhere too, in the same text or another.  Texts come in
    ``batches`` arrivals, each of which is matched with all before it.  Runs of windows that are equal as a whole are found by their digests;
    where passages that share a head end or differ, the windows of the runs at these edges are compared by 128 bits of hash.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = rows.where(F.octet_length(text_col) >= length).select(ROW, text.alias("_text"))
    arrival = F.pmod(F.xxhash64(ROW), F.lit(batches)).cast("int")
    sampled = materialize(suffixes(texts.withColumn("batch", arrival), length), "suffixes")
    family, since = SuffixFamily(), latest()
    for k in range(batches):
        family.add(sampled.where(F.col("batch") == k).drop("batch"))
    edges, spans = family.edges[0], family.spans[0]
    for e, s in zip(family.edges[1:], family.spans[1:], strict=True):
        edges, spans = edges.unionByName(e), spans.unionByName(s)
    edges = materialize(edges.distinct(), "suffix-edges")
    discard(rows.sparkSession, [since, *(path for _, _, path in family.levels)])
    spans = spans.unionByName(edge_spans(texts, edges, length))
    return spans.groupBy(ROW).agg(F.collect_list(F.struct("start", "windows")).alias("_spans"))


def _cut(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Texts without their spans."""
    data, offsets = _texts(batch.column("_text"))
    spans = batch.column("_spans")
    start, windows = (spans.flatten().field(k).to_numpy().astype(np.int64) for k in ("start", "windows"))
    doc = np.repeat(np.arange(batch.num_rows), spans.value_lengths().to_numpy())
    order = np.lexsort((start, doc))
    doc, start, windows = doc[order], start[order] + offsets[doc[order]], windows[order]
    s, e, at = merged(start, start + windows - 1 + length, doc)
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, s, 1)
    np.add.at(edge, e, -1)
    gone = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    removed = np.bincount(doc[at], weights=e - s, minlength=batch.num_rows).astype(np.int64)
    kept = data[~gone].tobytes()
    lengths = np.diff(offsets) - removed
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())
    of_doc = np.concatenate(([0], np.cumsum(np.bincount(doc[at], minlength=batch.num_rows))))
    pairs = pa.StructArray.from_arrays([pa.array((x - offsets[doc[at]]).astype(np.int64)) for x in (s, e)], ["start", "end"])
    listed = pa.ListArray.from_arrays(pa.array(of_doc.astype(np.int32)), pairs)
    return pa.RecordBatch.from_arrays([batch.column(ROW), cut, pa.array(removed), listed], [ROW, "kept", "n_removed", "spans"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, batches: int = 4) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept``: each row's UTF-8 bytes without what is covered by repeated strings of ``length`` bytes.

    ``spans`` are the removed runs (``start, end`` in bytes, end exclusive, in order; touching ones are one) and ``kept`` the other bytes, which may begin or
    end within a code point.  All copies of a passage go, the first too.  Matches are judged on the input, overlap as they like, and never cross
    rows: rows with a null id or an id that repeats are texts of their own, and a repeated row removes both.  Null texts are empty.  Other
    columns, whatever their names, aren't read; an empty table gives no rows.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "repeat-rows")
    spans = materialize(find_repeats(rows, length=length, batches=batches), "repeat-spans")
    touched = ids_side(materialize(spans.select(ROW), "repeat-ids"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    none = F.array().cast("array<struct<start: long, end: long>>")
    clean = rows.join(touched, ROW, "left_anti").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), none.alias("spans"), text.alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                done = _cut(b, length)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *done.columns[1:]], ["doc_id", "kept", "n_removed", "spans"])

    found = rows.join(touched, ROW, "left_semi").select(ROW, "doc_id", text.alias("_text")).join(spans, ROW)
    cut = found.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, kept binary, n_removed long, spans array<struct<start: long, end: long>>")
    return clean.unionByName(cut.withColumn("n_bytes", F.octet_length("kept") + F.col("n_removed")))
