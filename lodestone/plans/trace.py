"""Trace and monitoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import json_field
from ..operators import traces as T
from ..sources.tables import SQL_TRACE, load, trace_events
from .registry import query

W = f"WITH {SQL_TRACE}"
_SEC = "(epoch_us({1}) - epoch_us({0})) / 1e6"


@query(
    "trace_pairing",
    "W8 L14 T10 ST3 ST8",
    f"""{W}, n AS (SELECT *, lead(phase) OVER w AS np, lead(id) OVER w AS nid, lead(ts) OVER w AS nts FROM trace WHERE phase IN ('start', 'end') WINDOW w AS (PARTITION BY task_id ORDER BY ts, id))
    SELECT task_id, id AS start_id, nid AS end_id, CASE WHEN np IS NULL THEN 'running' ELSE 'completed' END AS status, round({_SEC.format("ts", "nts")}, 3) AS seconds FROM n WHERE phase = 'start' AND (np IS NULL OR np = 'end')""",
)
def trace_pairing(spark, sf_dir):
    steps = T.pair_steps(trace_events(spark, sf_dir), keys=["task_id"], order=["ts", "id"])
    return steps.select("task_id", "start_id", "end_id", "status", F.round("seconds", 3).alias("seconds"))


@query(
    "trace_stats",
    "A11 A12 A18 J10 T17",
    f"""{W} SELECT count(*) AS events, count(*) FILTER (phase = 'end') AS total_calls, count(*) FILTER (phase = 'start' AND ts >= TIMESTAMP '2024-01-30') AS today_calls, count(DISTINCT task_id) FILTER (phase = 'end') AS completed,
    count(DISTINCT task_id) AS total, round(100.0::DOUBLE * count(DISTINCT task_id) FILTER (phase = 'end') / count(DISTINCT task_id), 1) AS success_rate FROM trace WHERE task_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def trace_stats(spark, sf_dir):
    own = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("task_id"))
    e, end = trace_events(spark, sf_dir).join(own, "task_id", "left_semi"), F.col("phase") == "end"
    done, total = F.count_distinct(F.when(end, F.col("task_id"))), F.count_distinct("task_id")
    today = (F.col("phase") == "start") & (F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-30'"))
    return e.agg(F.count("*").alias("events"), F.count_if(end).alias("total_calls"), F.count_if(today).alias("today_calls"), done.alias("completed"), total.alias("total"), F.round(100.0 * done / total, 1).alias("success_rate"))


@query(
    "trace_durations",
    "J11 A14 T18",
    f"{W}, e AS (SELECT task_id, max(ts) AS ets FROM trace WHERE phase = 'end' GROUP BY 1), d AS (SELECT {_SEC.format('ts', 'ets')} AS s FROM trace JOIN e USING (task_id) WHERE phase = 'start') SELECT count(*) AS n, round(avg(s), 2) AS mean FROM d WHERE s > 0 AND s <= 86400",
)
def trace_durations(spark, sf_dir):
    d = T.durations(trace_events(spark, sf_dir), keys=["task_id"], longest=86400.0)
    return d.agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 2).alias("mean"))


@query("trace_active_models", "A13", "SELECT count(DISTINCT json_extract_string(props, '$.k')) AS models FROM events WHERE ts >= TIMESTAMP '2024-01-29'")
def trace_active_models(spark, sf_dir):
    return trace_events(spark, sf_dir).where("ts >= TIMESTAMP_NTZ '2024-01-29'").agg(F.count_distinct(json_field(F.col("props"), "k")).alias("models"))


_TOKENS = """CASE WHEN event_id % 4 = 0 THEN '{"total_tokens": ' || event_id || '}' WHEN event_id % 4 = 1 THEN '{"usage": {"total_tokens": ' || event_id || '}}' WHEN event_id % 4 = 2 THEN '{"prompt_tokens": 5, "completion_tokens": ' || event_id || '}' ELSE props END"""


@query("trace_tokens", "A15", "SELECT sum(CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN event_id + 5 END)::BIGINT AS tokens FROM events")
def trace_tokens(spark, sf_dir):
    return T.token_total(load(spark, sf_dir, "events").select(F.expr(_TOKENS).alias("data")))


@query("trace_top_json", "A16", "SELECT json_extract_string(props, '$.k') AS tool, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, tool LIMIT 10")
def trace_top_json(spark, sf_dir):
    t = trace_events(spark, sf_dir).groupBy(json_field(F.col("props"), "k").alias("tool")).agg(F.count("*").alias("n"))
    return t.orderBy(F.col("n").desc(), "tool").limit(10)


@query("trace_model_share", "A17 T9", "SELECT json_extract_string(props, '$.k') AS model, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS usage_rate FROM events GROUP BY 1")
def trace_model_share(spark, sf_dir):
    m = trace_events(spark, sf_dir).groupBy(json_field(F.col("props"), "k").alias("model")).agg(F.count("*").alias("n"))
    return m.withColumn("usage_rate", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("trace_change_token", "A19 ST7", "SELECT user_id AS task_id, coalesce(max(event_id), 0) AS token FROM events GROUP BY 1")
def trace_change_token(spark, sf_dir):
    return trace_events(spark, sf_dir).groupBy("task_id").agg(F.coalesce(F.max("id"), F.lit(0)).alias("token"))


@query("trace_plan_numbers", "W9", f"{W} SELECT id, sum((phase = 'start')::INTEGER) OVER (PARTITION BY task_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS plan FROM trace")
def trace_plan_numbers(spark, sf_dir):
    return T.plan_numbers(trace_events(spark, sf_dir), key="task_id", order=["ts", "id"]).select("id", "plan")


@query("chat_transcript", "L15", "SELECT conv_id, turn, role FROM conversations c WHERE turn < 3 AND EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.turn = 3) ORDER BY conv_id, turn")
def chat_transcript(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return c.where("turn < 3").join(c.where("turn = 3").select("conv_id"), "conv_id", "left_semi").orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@query("chat_latest_answer", "L16", "SELECT conv_id, max(turn) AS turn, arg_max(len(text), turn)::INTEGER AS n_chars FROM conversations WHERE role = 'assistant' GROUP BY 1")
def chat_latest_answer(spark, sf_dir):
    return load(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by(F.length("text"), "turn").alias("n_chars"))


@query(
    "chat_context_window",
    "W12",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations), k AS (SELECT * FROM r WHERE a <= 1 OR z <= 2) SELECT conv_id, turn, role FROM k QUALIFY lead(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role",
)
def chat_context_window(spark, sf_dir):
    at = Window.partitionBy("conv_id").orderBy("turn")
    r = load(spark, sf_dir, "conversations").withColumn("a", F.row_number().over(at)).withColumn("z", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc())))
    k = r.where("a <= 1 OR z <= 2").withColumn("after", F.lead("role").over(at))
    return k.where(~F.col("after").eqNullSafe(F.col("role"))).select("conv_id", "turn", "role")


@query(
    "checkpoint_latest",
    "ST10",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, max(event_id) AS event_id FROM r WHERE n <= 100 AND json_extract_string(props, '$.k')::INTEGER % 5 = 0 GROUP BY 1",
)
def checkpoint_latest(spark, sf_dir):
    r = load(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id").desc())))
    return r.where((F.col("n") <= 100) & (json_field(F.col("props"), "k").cast("int") % 5 == 0)).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
