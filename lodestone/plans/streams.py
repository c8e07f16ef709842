"""Streaming queries, run to the end over the event table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources.tables import SQL_TRACE, load
from ..streaming import streams as S
from .registry import query


def _folder(spark) -> str:
    """A fresh folder that driver and executors share; a local one only where none is set and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    return S.event_stream(spark, sf_dir)


@query("stream_tumbling", "2.14", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = S.run_to_table(S.tumbling(_events(spark, sf_dir), "1 hour", "10 minutes", by="event_type"), _folder(spark))
    return out.withColumn("total", F.round("total", 4))


@query("stream_sliding", "2.14", "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR) // 1000000 AS start, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    return S.run_to_table(S.tumbling(_events(spark, sf_dir), "12 hours", "10 minutes", slide="6 hours").select("start", "n"), _folder(spark))


_GAPS = "g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)"


@query("stream_sessions", "2.14 ST9", f"WITH {_GAPS} SELECT user_id, min(epoch_us(ts)) AS start, max(epoch_us(ts)) + 21600000000 AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf_dir):
    return S.run_to_table(S.sessions(_events(spark, sf_dir), "6 hours", "10 minutes", by="user_id"), _folder(spark))


@query("stream_dedup", "ST1 ST2", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20'")
def stream_dedup(spark, sf_dir):
    e = _events(spark, sf_dir)
    twice = S.after_mark(e, "2024-01-20").unionByName(S.after_mark(e, "2024-01-20"))
    return S.run_to_table(S.once(twice, ["event_id"], "1 day").select("event_id"), _folder(spark), mode="append")


@query("stream_running_totals", "ST6 ST7", "SELECT user_id, round(sum(value), 4) AS total, max(event_id) AS token, count(*) AS n FROM events GROUP BY 1")
def stream_running_totals(spark, sf_dir):
    out = S.run_to_table(S.running_totals(_events(spark, sf_dir), by="user_id", value="value"), _folder(spark))
    return out.withColumn("total", F.round("total", 4))


@query(
    "stream_pairing",
    "ST3 ST4 W8",
    f"""WITH {SQL_TRACE}, n AS (SELECT *, lead(phase) OVER w AS np, lead(id) OVER w AS nid, lead(ts) OVER w AS nts FROM trace WHERE phase IN ('start', 'end') WINDOW w AS (PARTITION BY task_id ORDER BY ts, id))
    SELECT task_id, id AS start_id, nid AS end_id, CASE WHEN np IS NULL THEN 'running' ELSE 'completed' END AS status, round((epoch_us(nts) - epoch_us(ts)) / 1e6, 3) AS seconds FROM n WHERE phase = 'start' AND (np IS NULL OR np = 'end')""",
)
def stream_pairing(spark, sf_dir):
    phase = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "end")
    e = _events(spark, sf_dir).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("id"), phase.alias("phase"), "ts").where("phase is not null")
    return S.run_to_table(S.pair_steps(e), _folder(spark), mode="update").withColumn("seconds", F.round("seconds", 3))


@query("stream_static_join", "2.14", "SELECT c_mktsegment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY 1")
def stream_static_join(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return S.run_to_table(_events(spark, sf_dir).join(c, "user_id").groupBy("c_mktsegment").agg(F.count("*").alias("n")), _folder(spark))
