"""Queries over gateway events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.operators import gateway, store
from wardspark.plans.common import EVENTS, events, table


def events_recent_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = gateway.within(events(spark, sf_dir).where("decision = 'deny'"), "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return gateway.newest(e, 100).select("event_id", "ts", "tool", "decision")


def events_limit_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc_nulls_last("ts"), F.col("event_id")]
    return store.limit_then_filter(events(spark, sf_dir).select("event_id", "ts", "decision"), order, 50, F.col("decision") == "deny")


def gateway_summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gateway.summary(events(spark, sf_dir))


def gateway_top_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gateway.top_values(events(spark, sf_dir), "tool")


def sliding_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("client"), "event_id", "ts")
    return gateway.sliding_counts(e, 3600)


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "decision").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start"), "decision", "n", "total")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "n")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


def job_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), F.when(F.col("role") != "user", F.col("role")).alias("status"), F.when(F.col("role") == "user", F.col("text")).alias("line"))
    return store.fold_jobs(c)


def masked_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    args = F.to_json(F.struct(F.concat(F.lit("key-"), F.col("event_id").cast("string")).alias("api_token"), F.col("tool").alias("tool")))
    masked = gateway.masked_args(args)
    return e.select("event_id", F.get_json_object(masked, "$.api_token").alias("api_token"), F.get_json_object(masked, "$.tool").alias("tool"))


def gateway_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    tools = F.when(k == 0, "fs.read").when(k == 1, "fs.write").when(k == 2, "validator.run").when(k == 3, "github.create_or_update_comment").when(k == 4, "shell.exec").otherwise("fs.read")
    args = F.when(k == 5, "{}").when(k == 3, '{"repo":"r","pr_number":1,"body":"b","token":"ghp_aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"}').when(k == 2, '{"repo":"r","commit":"c","patch":1}').when(k == 1, '{"path":"p","content":"c"}').otherwise('{"path":"p"}')
    scope = F.when(F.col("event_id") % 3 == 0, "write").otherwise("read")
    r = events(spark, sf_dir).select(F.col("event_id").alias("request_id"), tools.alias("tool"), scope.alias("scope"), args.alias("args"), F.lit(False).alias("asks_approval"), (F.col("event_id") % 2 == 0).alias("approved"))
    return gateway.decide(r, gateway.policies(spark))


QUERIES = {f.__name__: f for f in (events_recent_filtered, events_limit_then_filter, gateway_summary_totals, gateway_top_tools, sliding_log_counts, tumbling_windows, sliding_windows, session_windows, job_fold, masked_props, gateway_decisions)}
ORACLE = {
    "events_recent_filtered": f"WITH {EVENTS} SELECT event_id, ts, tool, decision FROM ev WHERE decision = 'deny' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 100",
    "events_limit_then_filter": f"WITH {EVENTS} SELECT event_id, ts, decision FROM (SELECT * FROM ev ORDER BY ts DESC, event_id LIMIT 100) WHERE decision = 'deny' ORDER BY ts DESC, event_id LIMIT 50",
    "gateway_summary_totals": f"WITH {EVENTS} SELECT count(*) AS total, count(*) FILTER (WHERE decision IN ('deny', 'require_approval')) AS blocked FROM (SELECT * FROM ev ORDER BY ts DESC, event_id LIMIT 500)",
    "gateway_top_tools": f"WITH {EVENTS}, n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS k FROM ev QUALIFY k <= 500) SELECT tool, count(*) AS n FROM n GROUP BY tool ORDER BY n DESC, min(k) LIMIT 5",
    "sliding_log_counts": "SELECT user_id AS client, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events",
    "tumbling_windows": f"WITH {EVENTS} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, decision, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY 1, 2",
    "sliding_windows": "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start",
    "session_windows": "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s",
    "job_fold": "SELECT conv_id AS job_id, arg_max(role, turn) FILTER (WHERE role <> 'user') AS status, min(turn) AS first_seq, max(turn) AS last_seq, count(*) FILTER (WHERE role = 'user' AND text IS NOT NULL) AS lines, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_line FROM conversations GROUP BY conv_id",
    "masked_props": f"WITH {EVENTS}, k AS (SELECT event_id, concat('key-', event_id) AS v, tool FROM ev) SELECT event_id, CASE WHEN length(v) <= 8 THEN '***REDACTED***' ELSE left(v, 4) || '***' || right(v, 4) END AS api_token, tool FROM k",
    "gateway_decisions": """WITH r AS (SELECT event_id AS request_id, event_id % 7 AS k, event_id % 3 = 0 AS w, event_id % 2 = 0 AS approved FROM events)
        SELECT request_id, CASE k WHEN 1 THEN 'fs.write' WHEN 2 THEN 'validator.run' WHEN 3 THEN 'github.create_or_update_comment' WHEN 4 THEN 'shell.exec' ELSE 'fs.read' END AS tool,
        CASE WHEN k = 4 THEN 'deny' WHEN k IN (0, 5, 6) AND w THEN 'deny' WHEN k IN (1, 3) AND NOT w THEN 'deny' WHEN k IN (2, 5) THEN 'deny' WHEN k IN (1, 3) AND NOT approved THEN 'require_approval' WHEN k = 3 THEN 'mask' ELSE 'allow' END AS decision,
        CASE WHEN k = 4 THEN 'tool not in allowlist' WHEN k IN (0, 5, 6) AND w THEN 'scope not allowed' WHEN k IN (1, 3) AND NOT w THEN 'scope not allowed' WHEN k = 2 THEN 'args schema violation: patch type mismatch'
            WHEN k = 5 THEN 'args schema violation: missing path' WHEN k IN (1, 3) AND NOT approved THEN 'approval required' ELSE 'allowed' END AS reason FROM r""",
}
