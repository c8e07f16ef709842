"""Packing documents into fixed windows by minimum bin slack (operator 8)."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import END_ID, encoder, id_lists
from .workspace import prepare


def closest_fill(capacity: int, counts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The multiset of lengths, given as (length, available), whose sum comes closest to ``capacity`` from below.

    Subset sums are the set bits of one integer.  Counts are split into powers of two, each step
    keeps the bitset before it, and the chosen counts are read back from the last step to the first.
    """
    full, reach, steps = (1 << capacity + 1) - 1, 1, []
    for length, available in counts:
        times = 1
        while available > 0 and length * times <= capacity and not reach >> capacity & 1:
            times = min(times, available)
            steps.append((length, times, reach))
            reach |= reach << length * times & full
            available, times = available - times, times * 2
        if reach >> capacity & 1:
            break
    left, chosen = reach.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> left & 1:
            chosen.append((length, times))
            left -= length * times
    return chosen


class Packer:
    """Packs a stream of pieces; holds at most ``pool_windows`` windows of tokens.

    Documents over the window give whole windows first; their rests and the shorter documents wait in
    the pool.  A window starts with the longest waiting piece and is filled by :func:`closest_fill`.  If the best
    multiset leaves a gap, the shortest longer piece is cut to close it.  At the end of
    the stream the rest is cut into sequences of powers of two, which need no padding.
    """

    def __init__(self, window: int, pool_windows: int, first_sequence: int):
        self.window, self.pool_tokens, self.sequence = window, pool_windows * window, first_sequence
        self.pool: dict[int, deque] = defaultdict(deque)
        self.lengths: list[int] = []
        self.total = 0
        self.out: list[tuple] = []

    def place(self, pieces: list[tuple]) -> None:
        """pieces: (doc, start, ids, doc_tokens) in one sequence, gapless from 0."""
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.out.append((doc, start, ids, tokens, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        if not self.pool[n]:
            insort(self.lengths, n)
        self.pool[n].append(piece)
        self.total += n

    def take(self, n: int) -> tuple:
        piece = self.pool[n].popleft()
        if not self.pool[n]:
            del self.lengths[bisect_left(self.lengths, n)]
        self.total -= n
        return piece

    def add(self, doc: int | None, ids: bytes) -> None:
        n, size = len(ids) // 4, 4 * self.window
        whole = len(ids) // size
        for k in range(whole):
            self.place([(doc, k * self.window, ids[k * size : (k + 1) * size], n)])
        if len(ids) % size:
            self.put((doc, whole * self.window, ids[whole * size :], n))
        if self.total >= self.pool_tokens:
            while self.total > self.pool_tokens // 2:
                self.fill()

    def fill(self) -> None:
        first = self.take(self.lengths[-1])
        pieces, left = [first], self.window - len(first[2]) // 4
        counts = [(n, len(self.pool[n])) for n in reversed(self.lengths) if n <= left]
        for n, times in closest_fill(left, counts):
            pieces += [self.take(n) for _ in range(times)]
            left -= n * times
        if left and (k := bisect_left(self.lengths, left + 1)) < len(self.lengths):
            doc, start, ids, tokens = self.take(self.lengths[k])
            pieces.append((doc, start, ids[: 4 * left], tokens))
            self.put((doc, start + left, ids[4 * left :], tokens))
        self.place(pieces)

    def finish(self) -> None:
        while self.total >= self.window:
            self.fill()
        while self.total:
            room, pieces = 1 << self.total.bit_length() - 1, []
            while room:
                doc, start, ids, tokens = self.take(self.lengths[-1])
                pieces.append((doc, start, ids[: 4 * room], tokens))
                if len(ids) > 4 * room:
                    self.put((doc, start + room, ids[4 * room :], tokens))
                room -= len(pieces[-1][2]) // 4
            self.place(pieces)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    window: int = 4096,
    pool_windows: int = 64,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (+ ``ids``).

    Packs each input partition as a stream, with no shuffle and memory bounded by the pool, so the
    padding doesn't depend on the number of rows: every sequence holds ``window`` ids but the last
    few of each partition, whose lengths are powers of two.  ``sequence_id`` is the partition's
    number times 2**33 plus a running number.  A null text is empty and gives the end id alone; a
    null id is carried; repeated rows are packed as often as they come; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in names), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, tokens, sequence, offset = zip(*found, strict=True)
        columns = [doc, start, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], tokens, sequence, offset]
        arrays = [pa.array(c, pa.int64()) for c in columns] + ([id_lists(list(ids))] if with_ids else [])
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        packer = Packer(window, pool_windows, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for doc, ids in zip(piece.column(0).to_pylist(), enc.documents(piece.column(1), end_id), strict=True):
                    packer.add(doc, ids)
                    if len(packer.out) >= 512:
                        yield rows(packer.out)
                        packer.out = []
        packer.finish()
        if packer.out:
            yield rows(packer.out)

    return src.mapInArrow(pack, schema)
