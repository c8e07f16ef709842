"""Token ids: encoding, the Parquet token-file format, and reading it back selectively (operator 1).

File format: one Parquet row per document in ascending id order, columns ``doc_id, row, part,
part_start, n_tokens, ids`` (+ any metadata columns).  ``ids`` is a list column of 32-bit integers,
dictionary encoded (a 49k vocabulary fits one dictionary page, so an id takes at most two bytes) or
delta encoded.  Row-group and page sizes are set by the caller; Parquet's column and offset indexes
let a reader fetch the metadata columns, or the pages of a few documents, without touching the rest.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import prepare, settings

END_ID = 2
#: The normalizer and pre-tokenizer for which words may be encoded one by one.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: The same pieces for lower-case characters up to U+00FF.
_LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+").findall
_ODD_SPACE = re.compile(r"[\x1c-\x1f]").search
_BEYOND_LATIN = re.compile(r"[^\x00-\xff]").search
#: Classes of UTF-8 bytes: white space, letter, digit, other, and those whose texts are cut in Python.
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_BYTE_CLASS = np.full(256, _ODD, np.uint8)
_BYTE_CLASS[32:127] = _OTHER
_BYTE_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_BYTE_CLASS[48:58] = _DIGIT
_BYTE_CLASS[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LENGTH_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")
#: Bytes of text looked at together.
SPAN = 1 << 20
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Texts to their ids as little-endian 32-bit bytes, by a table of pieces; new pieces go to the vocabulary's merges.

    Exact because this tokenizer drops white space and never joins across its pre-tokenizer's pieces: a text's
    ids are its pieces' ids in a row.  Up to U+00FF its normalizer does no more than lower the letters.  Spans of
    texts in ASCII and the letters U+00C0..U+00FF are cut into pieces as arrays of bytes, and pieces of up to 16 bytes are
    looked up by their bytes in a hash table of arrays.  Texts with other characters are cut in Python: at white
    space, and their words with characters over U+00FF are encoded whole.  Texts with the separators U+001C..U+001F, which
    Python counts as white space and the tokenizer doesn't, or with an added token are encoded whole, and so are all texts
    if the file has another normalizer or pre-tokenizer, or a model that isn't a plain BPE.

    The table is bounded: it is emptied when it holds ``limit`` pieces, or their ids fill its store.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        model = shape["model"]
        self.by_piece = shape["normalizer"] == _NORMALIZER and shape["pre_tokenizer"] == _PRE_TOKENIZER and model["type"] == "BPE" and not model.get("dropout")
        self.added = [x["content"] for x in shape.get("added_tokens") or []]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        slots = 1 << max(4, (2 * limit - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - slots.bit_length() + 1), slots - 1
        self.first, self.second, self.entry = np.zeros(slots, "<u8"), np.zeros(slots, "<u8"), np.full(slots, -1, np.int32)
        self.start, self.length = np.zeros(limit, np.int32), np.zeros(limit, np.int32)
        self.ids = np.zeros(1 << 16, "<u4")
        self.entries = self.stored = 0
        self.words: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> list[int]:
        """Ids of a lower-case piece of characters up to U+00FF."""
        if not (piece.isascii() and piece.isprintable()):
            piece = "".join(map(self.byte_chars.__getitem__, piece.encode()))
        return [x.id for x in self.tokenizer.model.tokenize(piece)]

    def word(self, word: str) -> bytes:
        """Ids of a word between white space, remembered for a bounded number of words."""
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= self.limit // 8:
                self.words.clear()
            ids = self.raw(word) if _BEYOND_LATIN(word) else array("I", itertools.chain.from_iterable(map(self.piece, _LATIN_PIECES(word.lower())))).tobytes()
            if len(word) <= 64:
                self.words[word] = ids
        return ids

    def odd_text(self, text: str) -> bytes:
        return self.raw(text) if _ODD_SPACE(text) else b"".join(map(self.word, text.split()))

    def _places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second * np.uint64(0xBF58476D1CE4E5B9))
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * np.uint64(0x94D049BB133111EB)) >> self.shift).astype(np.int64)

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Entries of pieces given by their 16 bytes, -1 for new ones."""
        at, found, open_ = self._places(first, second), np.full(len(first), -1, np.int32), np.arange(len(first))
        while len(open_):
            here = self.entry[at]
            hit = (here >= 0) & (self.first[at] == first[open_]) & (self.second[at] == second[open_])
            found[open_[hit]] = here[hit]
            on = ~hit & (here >= 0)
            open_, at = open_[on], at[on] + 1 & self.mask
        return found

    def _store(self, ids: list[int]) -> int:
        end = self.stored + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), "<u4")])
        self.ids[self.stored : end] = ids
        start, self.stored = self.stored, end
        return start

    def _add(self, first: np.ndarray, second: np.ndarray) -> None:
        """Encode distinct new pieces and enter them."""
        n = len(first)
        pairs = np.column_stack([first, second]).astype("<u8").tobytes()
        made = [self.piece(pairs[16 * k : 16 * k + 16].rstrip(b"\0").decode()) for k in range(n)]
        lengths = np.fromiter(map(len, made), np.int32, n)
        start = self._store(list(itertools.chain.from_iterable(made)))
        new = np.arange(self.entries, self.entries + n, dtype=np.int32)
        self.start[new], self.length[new] = start + np.cumsum(lengths) - lengths, lengths
        self.entries += n
        at, open_ = self._places(first, second), np.arange(n)
        while len(open_):
            free = self.entry[at] < 0
            self.entry[at[free]] = new[open_[free]]
            won = free & (self.entry[at] == new[open_])
            self.first[at[won]], self.second[at[won]] = first[open_[won]], second[open_[won]]
            open_, at = open_[~won], at[~won] + 1 & self.mask

    def _empty(self) -> None:
        self.entry.fill(-1)
        self.entries = self.stored = 0

    def _span(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some texts' UTF-8 bytes in a row (``ends``: where each begins and the last ends), where each text's ids begin, and which texts are odd."""
        n = len(raw)
        text = np.zeros((n + 23) // 8 * 8, np.uint8)
        text[:n] = _LOWER[raw]
        kind = _BYTE_CLASS[text[:n]]
        accents = np.flatnonzero(raw == 0xC3)
        if len(accents):
            after = text[accents + 1]
            kind[accents[(after == 0x97) | (after == 0xB7)]] = _ODD
            text[accents[(after >= 0x80) & (after <= 0x9E)] + 1] += 32
        odd_before = np.concatenate([[0], np.cumsum(kind == _ODD)])[ends]
        odd = odd_before[1:] > odd_before[:-1]
        new = np.ones(n, bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[ends[:-1][ends[:-1] < n]] = True
        start = np.flatnonzero(new)
        size, of = np.diff(np.append(start, n)), kind[start]
        # An apostrophe and the ending after it are one piece.
        for k in np.flatnonzero((of[:-1] == _OTHER) & (size[:-1] == 1) & (text[start[:-1]] == 39) & (of[1:] == _LETTER)).tolist():
            a = int(start[k])
            if start[k + 1] == a + 1 and not np.any(ends == a + 1):
                one, two = text[a + 1], bytes(text[a + 1 : a + 3])
                more = 1 if one in b"stmd" else 2 if size[k + 1] > 1 and two in (b"re", b"ve", b"ll") else 0
                size[k], start[k + 1], size[k + 1] = 1 + more, start[k + 1] + more, size[k + 1] - more
        kept = (of != _SPACE) & (size > 0)
        if odd.any():
            kept &= ~odd[np.searchsorted(ends, start, "right") - 1]
        start, size = start[kept], size[kept]
        words = np.lib.stride_tricks.as_strided(text.view("<u8")[:1], (n + 8,), (1,))
        first, second = words[start] & _LENGTH_MASK[np.minimum(size, 8)], words[np.minimum(start + 8, n + 7)] & _LENGTH_MASK[np.clip(size - 8, 0, 8)]
        short = size <= 16
        found = self._find(first, second)
        fresh = np.flatnonzero((found < 0) & short)
        if len(fresh):
            order = fresh[np.lexsort((second[fresh], first[fresh]))]
            head = np.ones(len(order), bool)
            head[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
            distinct = order[head]
            if self.entries + len(distinct) > self.limit or self.stored > 8 * self.limit:
                if not self.entries:
                    return self._directly(text, start, size, ends, odd)
                self._empty()
                return self._span(raw, ends)
            self._add(first[distinct], second[distinct])
            found[fresh] = self._find(first[fresh], second[fresh])
        at, length = self.start[found], self.length[found]
        for k in np.flatnonzero(~short).tolist():
            ids = self.piece(text[start[k] : start[k] + size[k]].tobytes().decode())
            at[k], length[k] = self._store(ids), len(ids)
        upto = np.cumsum(length, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.ids[np.repeat(at - (upto - length), length) + np.arange(total)]
        begins = np.concatenate([[0], upto])[np.searchsorted(start, ends)]
        return ids, begins, odd

    def _directly(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A span's ids without the table, where that is too small for the span's pieces."""
        made = [self.piece(text[a : a + n].tobytes().decode()) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))])
        return np.fromiter(itertools.chain.from_iterable(made), "<u4", int(upto[-1])), upto[np.searchsorted(start, ends)], odd

    def _long(self, raw: np.ndarray) -> bytes:
        """Ids of a text longer than a span, cut after white space."""
        parts, a = [], 0
        while a < len(raw):
            b = min(a + SPAN, len(raw))
            if b < len(raw):
                spaces = np.flatnonzero(_BYTE_CLASS[raw[a:b]] == _SPACE)
                if not len(spaces):
                    return self.odd_text(raw.tobytes().decode())
                b = a + int(spaces[-1]) + 1
            ids, _, odd = self._span(raw[a:b], np.array([0, b - a]))
            if odd[0]:
                return self.odd_text(raw.tobytes().decode())
            parts.append(ids.astype("<u4", copy=False).tobytes())
            a = b
        return b"".join(parts)

    def documents(self, column: pa.Array, end_id: int = END_ID) -> list[bytes]:
        """Ids of whole texts (null: empty), each with the end id."""
        end, out = int(end_id).to_bytes(4, "little"), []
        if not self.by_piece:
            return [self.raw(x or "") + end for x in column.to_pylist()]
        column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
        at = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        added = [x.encode() for x in self.added]
        k = 0
        while k < len(column):
            j = max(k + 1, int(np.searchsorted(at, at[k] + SPAN, "right")) - 1)
            raw = data[at[k] : at[j]]
            if j == k + 1 and len(raw) > SPAN:
                text = raw.tobytes()
                out.append((self.raw(text.decode()) if any(x in text for x in added) else self._long(raw)) + end)
            else:
                ids, begins, odd = self._span(raw, at[k : j + 1] - at[k])
                special = [x in (whole := raw.tobytes()) for x in added] if added else []
                for i, (a, b) in enumerate(itertools.pairwise(begins.tolist())):
                    text = raw[at[k + i] - at[k] : at[k + i + 1] - at[k]].tobytes() if odd[i] or any(special) else b""
                    if any(special) and any(x in text for x in added):
                        out.append(self.raw(text.decode()) + end)
                    elif odd[i]:
                        out.append(self.odd_text(text.decode()) + end)
                    else:
                        out.append(ids[a:b].tobytes() + end)
            k = j
        return out

    def document(self, text: str | None, end_id: int = END_ID) -> bytes:
        """Ids of a whole text (None: empty) and the end id."""
        return self.documents(pa.array([text], pa.string()), end_id)[0]


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def id_lists(parts: list[bytes]) -> pa.ListArray:
    """An Arrow list<int32> of the given little-endian ids, without a copy for each id."""
    ends = np.zeros(len(parts) + 1, "<i4")
    np.cumsum([len(x) // 4 for x in parts], out=ends[1:])
    joined = b"".join(parts)
    values = pa.Array.from_buffers(pa.int32(), len(joined) // 4, [None, pa.py_buffer(joined)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def list_bytes(column: pa.ListArray) -> Iterator[bytes]:
    """The little-endian bytes of each list of ids; a null list has none."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield flat[a:b].tobytes()


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: tuple[str, ...] = (),
    end_id: int = END_ID,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2_000,
    codec: str = "zstd",
    rows_per_batch: int = 256,
) -> None:
    """Encode whole texts and write them as token files in ascending id order.

    Documents are dealt by range of id and, within equal ids, of the text's hash, so no task holds more than
    a range, whatever ids repeat, and files are in order of their part numbers; equal ids are ordered by that hash and
    then by text.  A null text counts as empty (one end id); a null id sorts first; an empty table writes an empty file.  Extra columns
    are dropped unless named in ``metadata``, whose names may clash with the format's: such columns
    get the prefix ``meta_``.
    """
    prepare(docs.sparkSession)
    fixed = ["doc_id", "row", "part_start", "n_tokens", "ids", "part"]
    named = {c: f"meta_{c}" if c.lower() in fixed else c for c in metadata}
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(n) for c, n in named.items()))
    hashed = F.xxhash64("_text")
    src = src.repartitionByRange(F.col("doc_id"), hashed).sortWithinPartitions(F.col("doc_id"), hashed, F.col("_text"))
    extra = [src.schema[n] for n in named.values()]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *extra, T.StructField("row", T.LongType()), T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    kept = ["doc_id", *named.values()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row, start = encoder(tokenizer_path), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_batch):
                piece = batch.slice(at, rows_per_batch)
                parts = enc.documents(piece.column("_text"), end_id)
                n = np.array([len(x) // 4 for x in parts], "int64")
                starts = start + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in kept), pa.array(np.arange(row, row + len(n))), pa.array(starts), pa.array(n), id_lists(parts)],
                    names=[*kept, "row", "part_start", "n_tokens", "ids"],
                )
                row, start = row + len(n), start + int(n.sum())

    out = src.mapInArrow(encode, schema).withColumn("part", F.spark_partition_id())
    writer = out.write.options(
        **{
            "compression": codec,
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.size": str(page_bytes),
            "parquet.page.row.count.limit": str(page_rows),
            "parquet.dictionary.page.size": str(1 << 20),
            "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
            "parquet.writer.version": "v2" if encoding == "delta" else "v1",
        }
    )
    # Batches of few whole texts keep the buffers on both sides of the pipe small.
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows_per_batch * 4)):
        writer.parquet(path)


def read_token_files(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """Token files as a table; naming columns, or filtering by ``doc_id``, reads only those pages."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def with_starts(files: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Add ``start``: ids of all documents before.  Only a row for each written part meets in one task."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = keep if keep is not None else files
    return rows.join(totals, "part").withColumn("start", F.col("_before") + F.col("part_start")).drop("_before")


def checksums(files: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, the unsigned CRC-32 of the little-endian ids as stored."""
    kept = [c for c in files.columns if c != "ids"]
    schema = T.StructType([*(files.schema[c] for c in kept), T.StructField("ids_crc32", T.LongType())])
    prepare(files.sparkSession)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [zlib.crc32(x) for x in list_bytes(b.column("ids"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])

    return files.mapInArrow(crc, schema)
