"""Tables of files that rewrite what changes, and a sink that takes each batch once."""

import datetime

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodestone.operators import filetable
from lodestone.operators.filetable import FileTable
from lodestone.operators.sketches import SketchStore
from lodestone.operators.versions import merge
from lodestone.streaming.leases import leases, rocksdb
from lodestone.streaming.sinks import OnceSink, drain
from lodestone.streaming.streams import run_to_table

from .test_indexes import files_of, rows_read


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def data_files(spark, table):
    return {k: v for k, v in files_of(spark, f"{table.path}/data").items() if k.endswith(".parquet")}


def listed(table, version=None):
    return {r["file"].replace("file:///", "file:/") for r in table.files(version).collect()}


@pytest.fixture
def base(spark):
    return spark.range(0, 20_000).select("id", (F.col("id") % 97).alias("v"), F.lit("old").alias("name"))


def test_filters_hold_their_keys():
    rng = np.random.default_rng(1)
    keys, others = (rng.integers(-(1 << 63), 1 << 63, n) for n in (5000, 50_000))
    made = filetable.bloom(keys)
    assert filetable.passes(made, keys).all() and filetable.passes(made, others).mean() < 0.01
    assert not filetable.passes(filetable.bloom(keys[:0]), keys).any()


def test_merge_touches_only_what_changes(spark, base, tmp_path):
    table = FileTable(spark, f"file://{tmp_path}", ["id"], file_rows=1000)
    table.create(base)
    before, first = data_files(spark, table), listed(table)
    assert len(first) >= 20
    changes = spark.createDataFrame([(5, 1, "new"), (6, 2, "new"), (19_500, 3, "new"), (40_000, 4, "more"), (-7, 5, "more")], "id long, v long, name string")
    assert table.merge(changes) == 2
    assert rows_of(table.read()) == rows_of(merge(base, changes, ["id"]))
    assert data_files(spark, table).items() >= before.items()  # names, bytes and times
    assert len(first - listed(table)) == 2
    assert rows_of(table.read(1)) == rows_of(base)
    again = changes.withColumn("name", F.lit("kept")).withColumn("v", F.lit(9).cast("long"))
    table.merge(again, keep=["name"])
    assert rows_of(table.read()) == rows_of(merge(merge(base, changes, ["id"]), again, ["id"], keep=["name"]))
    assert table.delete(spark.createDataFrame([(5,), (6,), (77_777,)], "id long")) == 1
    assert table.read().where("id in (5, 6)").count() == 0 and table.read().count() == 20_000


def test_rows_of_other_files_are_not_read(spark, base, tmp_path):
    table = FileTable(spark, f"file://{tmp_path}", ["id"], file_rows=1000)
    table.create(base)
    changes = spark.createDataFrame([(12_345, 1, "new")], "id long, v long, name string")
    _, read = rows_read(spark, lambda: table.merge(changes))
    assert read < 6000


def test_keys_of_texts_and_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1, "a"), ("", 2, "b"), ("é" * 20, 3, "c"), ("é" * 20, 4, "d"), *((f"k{n:05d}", n, "x") for n in range(3000))], "a string, b long, c string")
    table = FileTable(spark, f"file://{tmp_path}", ["a", "b"], file_rows=500)
    table.create(rows)
    changes = spark.createDataFrame([(None, 1, "new"), ("", 3, "other"), ("é" * 20, 4, "new"), ("k01234", 1234, "new"), ("k01234", None, "null")], "a string, b long, c string")
    touched = table.merge(changes)
    assert rows_of(table.read()) == rows_of(merge(rows, changes, ["a", "b"])) and touched < 7


def test_last_of_equal_keys_and_many_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filetable, "FULL_EVERY", 3)
    table = FileTable(spark, f"file://{tmp_path}", ["id"])
    state = spark.range(10).select("id", F.lit(0).alias("o"))
    table.create(state)
    for n in range(1, 6):
        changes = spark.createDataFrame([(n, n), (n, n + 100), (n + 20, n)], "id long, o int")
        table.merge(changes.withColumn("at", F.col("o")), ordinal="at")
        state = merge(state, changes.withColumn("at", F.col("o")), ["id"], ordinal="at")
        assert rows_of(table.read()) == rows_of(state)
    assert table.version() == 6 and rows_of(table.read(1)) == [(k, 0) for k in range(10)]


def test_empty_tables_and_changes(spark, base, tmp_path):
    table = FileTable(spark, f"file://{tmp_path}", ["id"])
    table.create(base.where("false"))
    assert table.read().count() == 0
    assert table.merge(base.limit(3)) == 0 and table.read().count() == 3
    assert table.merge(base.where("false")) == 0 and table.read().count() == 3


def test_second_writer_fails(spark, base, tmp_path):
    table = FileTable(spark, f"file://{tmp_path}", ["id"])
    table.create(base.limit(100))
    late = FileTable(spark, f"file://{tmp_path}", ["id"])
    late.version = lambda: 1  # it has read version 1 and comes to its commit after the other
    table.merge(spark.createDataFrame([(1, 2, "first")], "id long, v long, name string"))
    with pytest.raises(Exception, match="exists"):
        late.merge(spark.createDataFrame([(1, 3, "second")], "id long, v long, name string"))
    assert [r["name"] for r in table.read().where("id = 1").collect()] == ["first"]


# ---- the sink


@pytest.fixture
def stream(spark, tmp_path):
    path = f"{tmp_path}/in"
    rows = spark.range(600).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"))
    for part in range(6):
        rows.where(F.col("event_id") % 600 >= part * 100).where(F.col("event_id") < part * 100 + 100).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def dies(at):
    def fail(batch):
        if batch == at:
            raise RuntimeError("lost")

    return fail


def test_batch_that_dies_counts_once(spark, stream, tmp_path):
    path, checkpoint = f"file://{tmp_path}/sink", f"file://{tmp_path}/checkpoint"
    with pytest.raises(StreamingQueryException):
        drain(stream, OnceSink(spark, path, fail=dies(1)), checkpoint)
    sink = OnceSink(spark, path)
    assert sink.done() == [0] and sink.pending() == [1] and sink.read(stream.schema).count() == 200
    drain(stream, sink, checkpoint)
    assert sink.done() == [0, 1, 2] and sink.pending() == []
    assert sorted(r["event_id"] for r in sink.read(stream.schema).collect()) == list(range(600))
    sink.write(sink.read(stream.schema), 1)  # a batch that is done is left as it is
    assert sink.read(stream.schema).count() == 600


def test_without_markers_rows_come_twice(spark, stream, tmp_path):
    path, checkpoint, fail = f"file://{tmp_path}/plain", f"file://{tmp_path}/checkpoint", [dies(1)]

    def append(rows, batch):
        rows.write.mode("append").parquet(path)
        fail[0](batch)

    start = lambda: stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(StreamingQueryException):
        start()
    fail[0] = dies(-1)
    start()
    assert spark.read.parquet(path).count() == 800 and spark.read.parquet(path).distinct().count() == 600


def test_old_messages_are_left_out(spark, stream, tmp_path):
    sink = OnceSink(spark, f"file://{tmp_path}/sink", clock="ts")
    drain(stream, sink, f"file://{tmp_path}/checkpoint")
    n = sink.read(stream.schema).count()
    assert sink.high_water().startswith("2023-11-15T") and sink.high_water().endswith("Z") and n <= 600
    # The same files again under a new checkpoint, as a source that forgot where it was: batch numbers go on in the sink.
    replay = OnceSink(spark, f"file://{tmp_path}/sink", clock="ts")
    stream.writeStream.foreachBatch(lambda rows, b: replay.write(rows, b + 10)).option("checkpointLocation", f"file://{tmp_path}/other").trigger(availableNow=True).start().awaitTermination()
    assert replay.read(stream.schema).count() == n


# ---- leases


def told(beats, ttl, evict, end):
    """By walking through each job's heartbeats (seconds)."""
    out = []
    for job in sorted({j for j, _ in beats}):
        last = attempt = n = None
        for t in [*sorted(t for j, t in beats if j == job), None]:
            now = end if t is None else t
            if last is not None and now > last + ttl:
                out.append((job, "expired", last + ttl, attempt, n))
                if now > last + ttl + evict:
                    out.append((job, "evicted", last + ttl + evict, attempt, n))
            if t is None:
                continue
            if last is not None and t <= last + ttl:
                n += 1
            else:
                attempt = 1 if last is None or t > last + ttl + evict else attempt + 1
                n = 1
                out.append((job, "acquired", t, attempt, 1))
            last = t
    return sorted(out)


def test_leases_expire_and_are_forgotten(spark, tmp_path):
    """Heartbeats each few seconds, leases of 30 s, eviction 60 s later; the query is stopped and goes on from its checkpoint."""
    rng, t0 = np.random.default_rng(2), 1_700_000_000
    beats = [(int(j), int(t)) for j in range(6) for t in np.unique(np.cumsum(rng.choice([1, 5, 29, 30, 31, 60, 89, 90, 91, 95, 200], 40)))]
    beats = [(j, t) for j, t in beats if t < 2400] + [(9, 5), (9, 2399)]
    rows = spark.createDataFrame([(j, t) for j, t in beats], "job long, t long").select("job", F.timestamp_seconds(F.col("t") + t0).alias("ts"))
    path = f"{tmp_path}/beats"
    for k in range(4):
        part = rows.where(F.unix_seconds("ts").between(t0 + 600 * k, t0 + 600 * k + 599)).coalesce(1)
        part.write.mode("append").parquet(path)
        if k in (1, 3):
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
            with rocksdb(spark):
                got = run_to_table(leases(stream, ttl_s=30, evict_s=60), f"file://{tmp_path}/out", mode="append")
    rows = sorted((r["job"], r["kind"], r["at"] // 1_000_000 - t0, r["attempt"], r["beats"]) for r in got.collect())
    assert rows == told(beats, 30, 60, max(t for _, t in beats))
    assert {r[3] for r in rows} > {1, 2} and {r[1] for r in rows} == {"acquired", "expired", "evicted"}


# ---- sketches


def test_sketches_of_any_range(spark, tmp_path):
    """Within the stated errors at every range; a new day neither reads nor writes the old ones, and a repeated load counts once."""
    day = F.expr("date_add(DATE '2024-03-01', cast(id % 10 as int))")
    rows = spark.range(200_000).select(day.alias("day"), (F.col("id") % 3).alias("key"), (F.col("id") * 7919 % 60_000).alias("item"), F.pow(F.rand(5), 3).alias("value"))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows").unionByName(spark.createDataFrame([(datetime.date(2024, 3, 10), 7, None, None)], "day date, key long, item long, value double"))
    store = SketchStore(spark, f"file://{tmp_path}/store", ["key"])
    store.add(rows.where("day < DATE '2024-03-08'"))
    before = files_of(spark, store.path)
    for _ in range(2):
        store.add(rows.where("day >= DATE '2024-03-08'"))
    assert before.items() <= files_of(spark, store.path).items()
    known = rows.toPandas()
    for a, b in ((1, 1), (1, 10), (3, 8), (9, 10)):
        low, high = datetime.date(2024, 3, a), datetime.date(2024, 3, b)
        some = known[(known["day"] >= low) & (known["day"] <= high)]
        for by in (["key"], []):
            for r in store.between(low, high, by=by, quantiles=(0.1, 0.5, 0.95)).collect():
                mine = some[some["key"] == r["key"]] if by else some
                values = mine["value"].dropna().sort_values().to_numpy()
                assert r["n"] == len(mine)
                if not len(values):
                    assert r["items"] == 0 and r["q50"] is None
                    continue
                assert r["items"] == pytest.approx(mine["item"].nunique(), rel=0.03) and (r["least"], r["greatest"]) == (values[0], values[-1])
                for q in (0.1, 0.5, 0.95):
                    assert abs(np.searchsorted(values, r[f"q{round(100 * q)}"]) / len(values) - q) < 0.02
    _, read = rows_read(spark, lambda: store.between(datetime.date(2024, 3, 2), datetime.date(2024, 3, 2)).collect())
    assert read == 3


def test_a_lease_moves_its_timer_without_asking_for_timers():
    """A state and timers as the stream keeps them: one timer at a time, moved in two calls, none asked for."""
    import pandas as pd

    from lodestone.streaming.leases import Lease

    class Handle:
        state, timers, calls = None, set(), 0

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            return self.state

        def update(self, state):
            self.state = state

        def clear(self):
            self.state = None

        def deleteTimer(self, at):  # noqa: N802
            self.calls += 1
            self.timers.remove(at)

        def registerTimer(self, at):  # noqa: N802
            self.calls += 1
            self.timers.add(at)

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.now

    lease, handle = Lease(30_000_000, 60_000_000), Handle()
    lease.init(handle)
    told = lambda parts: [tuple(r) for p in parts for r in p[["kind", "at"]].itertuples(index=False)]
    beat = lambda *s: told(lease.handleInputRows((1,), iter([pd.DataFrame({"us": [x * 1_000_000 for x in s]})]), None))
    assert beat(10, 0) == [("acquired", 0)] and handle.timers == {40_001} and handle.calls == 1
    assert beat(5) == [] and handle.timers == {40_001} and handle.calls == 1
    assert beat(20) == [] and handle.timers == {50_001} and handle.calls == 3
    for handle.now, want, timers in ((50_001, [("expired", 50_000_000)], {110_001}), (110_001, [("evicted", 110_000_000)], set())):
        handle.timers.clear()
        assert told(lease.handleExpiredTimer((1,), handle, None)) == want and handle.timers == timers
    assert handle.state is None
