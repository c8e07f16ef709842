"""Comparing all rows within groups of any size, in tiles: shared by the near-duplicate operators.

Rows that share a group key are to be compared with each other.  A group of up to ``tile`` rows is
one task key.  A larger group is split by its rows' lane (a number; lanes further apart than
``radius`` need no comparison) and, within a lane, by a salt, into tiles of about ``tile`` rows, and
each pair of tiles that may hold matches is a task key of its own.  So each pair of rows meets
under exactly one task key of its group, no task key has more than about two tiles of rows, and a
group with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("k1", "k2", "ta", "tb")


def meet_in_tiles(rows: DataFrame, *, radius: int = 0, tile: int = 2048, payload: DataFrame | None = None) -> DataFrame:
    """``rows`` has ``k1, k2`` (group), ``lane``, ``node`` (a row's own number) and payload columns.

    Gives those rows under task keys ``k1, k2, ta, tb`` with ``side`` (0 or 1), grouped and in order in
    each partition.  Rows alone in their group go.  ``rows`` is read twice: hand over a written table.
    """
    counts = rows.groupBy("k1", "k2", "lane").agg(F.count("*").alias("n"))
    groups = counts.groupBy("k1", "k2").agg(F.sum("n").alias("_total"), F.map_from_entries(F.collect_list(F.struct("lane", F.ceil(F.col("n") / tile).cast("long").alias("tiles")))).alias("_lanes")).where("_total > 1")
    groups = groups.withColumn("_lanes", F.when(F.col("_total") > tile, F.col("_lanes")))
    return _dealt(rows.join(groups, ["k1", "k2"]), [c for c in rows.columns if c not in ("k1", "k2")], radius, payload)


def meet_by_lane(rows: DataFrame, *, radius: int, tile: int, payload: DataFrame | None = None) -> DataFrame:
    """Like :func:`meet_in_tiles`, for all rows as one group: ``rows`` has ``lane``, ``node`` and payload columns.

    The driver sees the size of each lane, so lanes must be few (a logarithm, a bit count).
    """
    sizes = {r["lane"]: -(-r["n"] // tile) for r in rows.groupBy("lane").agg(F.count("*").alias("n")).collect()}
    one = F.lit(0).cast("long")
    lanes = F.create_map(*(x for k, v in sorted(sizes.items()) for x in (F.lit(k), F.lit(v).cast("long")))) if sizes else F.lit(None).cast("map<int,bigint>")
    return _dealt(rows.select(one.alias("k1"), one.alias("k2"), *rows.columns).withColumn("_lanes", lanes), rows.columns, radius, payload)


def _dealt(met: DataFrame, kept: list[str], radius: int, payload: DataFrame | None) -> DataFrame:
    """Rows with ``_lanes`` (tiles by lane; null: one task) under each of their task keys, in order."""
    own = F.shiftleft(F.col("lane").cast("long"), 32) + F.pmod(F.xxhash64("node"), F.col("_lanes")[F.col("lane")])

    def tiles_of(lane: F.Column) -> F.Column:
        salts = F.sequence(F.lit(0).cast("long"), F.col("_lanes")[lane] - 1)
        return F.transform(salts, lambda s: F.shiftleft(lane.cast("long"), 32) + s)

    near = F.filter(F.map_keys("_lanes"), lambda x: F.abs(x - F.col("lane")) <= radius)
    others = F.flatten(F.transform(near, tiles_of))
    pairs = F.transform(others, lambda o: F.struct(F.least(own, o).alias("ta"), F.greatest(own, o).alias("tb"), F.when(own <= o, 0).otherwise(1).alias("side")))
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("ta"), F.lit(-1).cast("long").alias("tb"), F.lit(0).alias("side")))
    met = met.withColumn("_task", F.explode(F.when(F.col("_lanes").isNull(), alone).otherwise(pairs)))
    met = met.select("k1", "k2", "_task.ta", "_task.tb", "_task.side", *kept)
    if payload is not None:
        met = met.join(payload, "node")
    return met.repartition(*KEYS).sortWithinPartitions(*KEYS, "side")


def whole_groups(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Call ``work`` on runs of whole task keys: a table and where each key's rows start and end."""
    waiting: list[pa.RecordBatch] = []

    def run(table: pa.Table, final: bool) -> tuple[Iterator[pa.RecordBatch], list[pa.RecordBatch]]:
        n = table.num_rows
        changed = np.zeros(max(n - 1, 0), bool)
        for k in KEYS:
            column = table.column(k).to_numpy()
            changed |= column[1:] != column[:-1]
        edges = np.concatenate([[0], np.flatnonzero(changed) + 1, [n]])
        if not final:
            edges = edges[:-1]
        done = int(edges[-1])
        return (work(table.slice(0, done), edges) if done else iter(())), table.slice(done).to_batches()

    for batch in batches:
        if batch.num_rows == 0:
            continue
        waiting.append(batch)
        first, last = waiting[0], batch
        if all(first.column(k)[0] == last.column(k)[-1] for k in KEYS) and sum(b.num_rows for b in waiting) < 1 << 16:
            continue
        out, waiting = run(pa.Table.from_batches(waiting), False)
        yield from out
    if waiting:
        yield from run(pa.Table.from_batches(waiting), True)[0]


class Forest:
    """Joins positions into classes; keeps a parent with a smaller position for each."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up
            a, b = self.parent[i], self.parent[j]
            differ = a != b
            if not differ.any():
                return
            np.minimum.at(self.parent, np.maximum(a, b)[differ], np.minimum(a, b)[differ])

    def root(self, i: int) -> int:
        """The first position of i's class; shortens the path to it."""
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """A link from each position to the first of its class; these keep classes whole."""
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]
