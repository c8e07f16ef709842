"""Leases that heartbeats keep and timers end, as keyed state of a stream."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a lease's changes are told as; times are microseconds.
CHANGES = "job long, kind string, at long, attempt int, beats int"
_STATE = "last long, beats int, attempt int, held boolean"


class Lease(StatefulProcessor):
    """A job's lease: taken by its first heartbeat, kept by each next one within ``ttl``, ended by a timer, forgotten ``evict`` after that.

    A heartbeat that comes after the end, but before the lease is forgotten, takes the job up again as its next attempt; after it
    attempts begin anew.  A job has one row of state and one timer, so what is held follows the jobs that are alive.
    """

    def __init__(self, ttl_us: int, evict_us: int):
        self.ttl, self.evict = ttl_us, evict_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("lease", _STATE)

    def _ends(self, state: tuple, now: int) -> tuple[list[tuple], tuple | None]:
        """What has ended by ``now``: rows, and the state that is left (none when forgotten)."""
        last, beats, attempt, held = state
        rows, end = [], last + self.ttl
        if held and now > end:
            rows.append(("expired", end, attempt, beats))
            held = False
        if not held and now > end + self.evict:
            rows.append(("evicted", end + self.evict, attempt, beats))
            return rows, None
        return rows, (last, beats, attempt, held)

    def _due(self, state: tuple) -> int:
        """When a job's timer fires, in milliseconds: it follows from the state, so none is asked for or kept."""
        return (state[0] + self.ttl + (0 if state[3] else self.evict)) // 1000 + 1

    def _timer(self, before: tuple | None, state: tuple | None) -> None:
        """Move the timer from where the state before put it, if that is another place; one that has fired is gone by itself."""
        old, new = self._due(before) if before else None, self._due(state) if state else None
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def _told(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            kinds, at, attempt, beats = zip(*rows, strict=True)
            yield pd.DataFrame({"job": key[0], "kind": pd.Series(kinds, dtype=object), "at": at, "attempt": attempt, "beats": beats})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        found, out = self.state.get(), []
        before = state = tuple(found) if found else None
        for us in sorted(v for part in rows for v in part["us"].tolist()):
            if state:
                ended, state = self._ends(state, us)
                out += ended
            if state and state[3]:
                state = (max(us, state[0]), state[1] + 1, state[2], True)
            else:
                state = (us, 1, state[2] + 1 if state else 1, True)
                out.append(("acquired", us, state[2], 1))
        self.state.update(state)
        self._timer(before, state)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out: list[tuple] = []
        found = self.state.get()
        if found:
            # What the watermark has passed ends at once, the eviction too: there may be no later batch.
            out, state = self._ends(tuple(found), timerValues.getCurrentWatermarkInMs() * 1000)
            if state:
                self.state.update(state)
                self._timer(None, state)
            else:
                self.state.clear()
        yield from self._told(key, out)

    def close(self) -> None:
        pass


def leases(beats: DataFrame, *, ttl_s: int, evict_s: int, late: str = "0 seconds") -> DataFrame:
    """``job, kind, at, attempt, beats``: leases as they are acquired, expire (the job is to be queued again) and are evicted.

    ``beats`` is a stream with ``job`` (long) and ``ts``; times are event times, and timers fire when the watermark passes them.  Within a batch
    heartbeats may come in any order.  A lease that no later event overtakes is open and not told.  Null times and jobs are left out.
    """
    rows = beats.where("job is not null and ts is not null").withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    keep = Lease(ttl_s * 1_000_000, evict_s * 1_000_000)
    return rows.groupBy("job").transformWithStateInPandas(keep, StructType.fromDDL(CHANGES), "Append", "EventTime")


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on disk, with changes in the checkpoint: what keyed state with timers needs."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
