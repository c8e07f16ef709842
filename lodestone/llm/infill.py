"""Fill-in-the-middle examples cut at token bounds by rank and select on bit vectors (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import prepare

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, SPM, PSM = "plain", "spm", "psm"
#: Words of 64 bits in a block of the popcount directory.
WORDS = 8
_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


class BitVector:
    """Packed bits with the number of ones before each block of 512: rank and select for arrays of arguments."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        words = np.zeros(-(-max(1, len(packed)) // (8 * WORDS)) * WORDS, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words.reshape(-1, WORDS)
        #: Ones before each word of its block, and before each block.
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones, axis=1) - ones
        self.directory = np.concatenate(([0], np.cumsum(ones.sum(axis=1))))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position; positions up to the number of bits."""
        at = np.asarray(at, np.int64)
        out = self.directory[np.minimum(at >> 9, len(self.words))].copy()
        inside = (at >> 9) < len(self.words)
        block, word = at[inside] >> 9, at[inside] >> 6 & WORDS - 1
        low = (np.uint64(1) << (at[inside] & 63).astype(np.uint64)) - np.uint64(1)
        out[inside] += self.before[block, word] + np.bitwise_count(self.words[block, word] & low)
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the one that has ``k`` ones before it; ``k`` below their number."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.directory, k, side="right") - 1
        left = k - self.directory[block]
        word = (self.before[block] <= left[:, None]).sum(axis=1) - 1
        left -= self.before[block, word]
        bits, at = self.words[block, word], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left, at = np.where(up, left - low, left), at + np.where(up, half, 0)
            bits = np.where(up, bits >> np.uint64(half), bits)
        return block * 64 * WORDS + word * 64 + at


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[BitVector, BitVector]:
    """Where tokens (``[A-Za-z]+|[^A-Za-z]``) and where code points begin, in texts that lie one after the other."""
    letter = ((data | 32) - np.uint8(97)) < 26
    point = data & 0xC0 != 0x80
    follows = np.zeros(len(data), bool)
    follows[1:] = letter[1:] & letter[:-1]
    follows[offsets[:-1][offsets[:-1] < len(data)]] = False
    return BitVector(point & ~follows), BitVector(point)


def _examples(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The examples of a batch of texts."""
    texts = batch.column("_text").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    tokens, points = boundaries(data, offsets)
    first = tokens.rank(offsets[:-1])
    n = tokens.rank(offsets[1:]) - first
    h = [batch.column(f"_h{k}").to_numpy() for k in range(1, 5)]
    marked = np.zeros(len(n), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[2] % 100 >= 90)
    ranks = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    cuts = np.stack([offsets[1:], offsets[1:]])
    for k in (0, 1):
        inside = ranks[k] < n
        cuts[k, inside] = tokens.select((first + ranks[k])[inside])
    chars = points.rank(cuts[0]) - points.rank(offsets[:-1]), points.rank(cuts[1]) - points.rank(cuts[0])
    forms = np.where(plain, PLAIN, np.where(h[3] % 100 < 20, SPM, PSM))
    view, out = memoryview(data), []
    for k, form in enumerate(forms):
        start, a, b, end = offsets[k], cuts[0, k], cuts[1, k], offsets[k + 1]
        if form == PLAIN:
            out.append(bytes(view[start:end]))
        elif form == SPM:
            out.append(b"".join((SUFFIX, view[b:end], PREFIX, view[start:a], MIDDLE, view[a:b])))
        else:
            out.append(b"".join((PREFIX, view[start:a], SUFFIX, view[b:end], MIDDLE, view[a:b])))
    cols = {"n": pa.array(n), "form": pa.array(forms.tolist(), pa.string()), "prefix_chars": pa.array(chars[0], mask=plain), "middle_chars": pa.array(chars[1], mask=plain), "output": pa.array(out, pa.binary()).cast(pa.string())}
    return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | cols)


def draw(key: Column, which: int) -> Column:
    """An unsigned 32-bit draw: the ``which``-th group of eight hex digits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 8 * which - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: an example for each row, from its whole text.

    Token and code point bounds are packed bit vectors with a directory of popcounts: the total is ``n``, select on
    the two drawn ranks gives the byte cuts, rank gives their code points.  Draws depend on the seed and the id alone, so a
    run that is repeated, or a task that is run again, gives the same examples; rows with equal ids draw equally.  A
    null id draws as an empty one.  Null and empty texts, texts that hold a mark, and a tenth of the others stay plain, with null
    counts.  Other columns, whatever their names, aren't read; an empty table gives no rows.  A projection: nothing is shuffled.
    """
    prepare(docs.sparkSession)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text, *(draw(key, k).alias(f"_h{k}") for k in range(1, 5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_examples(b) for b in batches if b.num_rows)

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, {_SCHEMA}")


def restored(output: Column, form: Column) -> Column:
    """The text that an example was cut from: marks occur once each, so they split it into its parts."""
    part = lambda k: F.get(F.split(output, f"{PREFIX.decode()}|{SUFFIX.decode()}|{MIDDLE.decode()}", -1), F.lit(k))
    return F.when(form == PSM, F.concat(part(1), part(3), part(2))).when(form == SPM, F.concat(part(2), part(3), part(1))).otherwise(output)
