"""Queries over the event log as a stream, and over logs that are replayed in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions.shared import new_folder
from wardspark.operators import gateway, replays
from wardspark.plans.common import events, table
from wardspark.streaming import events as log
from wardspark.streaming import sinks

_ASKED = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'pending_pr' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream; as a pattern, its path may be a file or a folder."""
    return log.source(spark, f"{sf_dir}/event[s].parquet")


def sunk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with arguments that name secrets, streamed into the sink; of every tenth they are broken."""
    args = F.to_json(F.struct(F.concat(F.lit("key-"), F.col("event_id").cast("string")).alias("ApiToken"), F.struct(F.lit("short").alias("client_secret"), F.col("event_type").alias("tool")).alias("inner")))
    s = _stream(spark, sf_dir).withColumn("props", F.when(F.col("event_id") % 10 == 0, F.lit("{no")).otherwise(args))
    path = new_folder(spark, "sink")
    sinks.run(s, sinks.EventSink(f"{path}/events", f"{path}/failures"), f"{path}/checkpoint")
    ok, bad = sinks.table(spark, f"{path}/events"), sinks.failed(spark, f"{path}/events", f"{path}/failures")
    return ok.withColumn("failure", F.lit(None).cast("string")).unionByName(bad).select("event_id", "user_id", "event_type", "props", "failure")


def streamed_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter over the log as a stream: what the watermark has passed when all is read."""
    s = log.rate_limited(_stream(spark, sf_dir), 3, 6 * 3600, "2 days")
    path = new_folder(spark, "limits")
    s.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{path}/out")


def rate_limit_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("client"), "event_id", "ts")
    return gateway.rate_limit(e, 3, 6 * 3600)


def job_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of a job for each user; users of even ids have one that runs already."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 > 0, F.expr(_ASKED)).alias("asked"), F.when(F.col("event_id") % 4 < 2, F.col("props")).alias("line"))
    begun = e.where("job_id % 2 = 0").select("job_id", F.lit("running").alias("status"), F.lit(0).cast("long").alias("started_at"), F.lit(None).cast("long").alias("finished_at"), F.lit(5).cast("long").alias("lines")).distinct()
    return replays.job_steps(e, begun)


_LIMIT = """WITH RECURSIVE e AS (SELECT user_id AS client, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT client, event_id, n, true AS accepted, [t] AS log FROM e WHERE n = 1
  UNION ALL
  SELECT e.client, e.event_id, e.n, len(list_filter(r.log, lambda x: x > e.t - 21600000000)) < 3,
    CASE WHEN len(list_filter(r.log, lambda x: x > e.t - 21600000000)) < 3 THEN list_append(list_filter(r.log, lambda x: x > e.t - 21600000000), e.t) ELSE list_filter(r.log, lambda x: x > e.t - 21600000000) END
  FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1)
SELECT client, event_id, accepted FROM r"""

_JOBS = f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, ts, event_id AS seq, CASE WHEN event_id % 4 > 0 THEN {_ASKED} END AS asked, event_id % 4 < 2 AND props IS NOT NULL AS said,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
may(before, asked) AS (VALUES ('', 'queued'), ('queued', 'running'), ('queued', 'failed'), ('running', 'pending_pr'), ('running', 'completed'), ('running', 'failed'), ('pending_pr', 'completed'), ('pending_pr', 'failed')),
s AS (SELECT DISTINCT user_id AS job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS asked, false AS legal,
    CASE WHEN user_id % 2 = 0 THEN 'running' END AS status, CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '1970-01-01' END AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at, CAST(CASE WHEN user_id % 2 = 0 THEN 5 ELSE 0 END AS BIGINT) AS lines FROM events
  UNION ALL
  SELECT job_id, n, seq, before, asked, legal, CASE WHEN legal AND asked IS NOT NULL THEN asked ELSE before END,
    CASE WHEN legal AND asked IN ('running', 'pending_pr') THEN ts ELSE started_at END, CASE WHEN legal AND asked IN ('completed', 'failed') THEN ts ELSE finished_at END, lines + CASE WHEN legal AND said THEN 1 ELSE 0 END
  FROM (SELECT e.*, b.before, CASE WHEN b.before IS NULL THEN NULL ELSE b.started_at END AS started_at, CASE WHEN b.before IS NULL THEN NULL ELSE b.finished_at END AS finished_at, CASE WHEN b.before IS NULL THEN 0 ELSE b.lines END AS lines,
      CASE WHEN e.asked IS NULL THEN b.before IS NOT NULL ELSE (coalesce(b.before, ''), e.asked) IN (SELECT (before, asked) FROM may) END AS legal
    FROM e JOIN (SELECT s.job_id, s.n, s.started_at, s.finished_at, s.lines, CASE WHEN s.status IN ('completed', 'failed') AND f.ts >= s.finished_at + INTERVAL 7 DAY THEN NULL ELSE s.status END AS before
      FROM s JOIN e f ON f.job_id = s.job_id AND f.n = s.n + 1) b ON e.job_id = b.job_id AND e.n = b.n + 1))
SELECT job_id, seq, before, asked, legal, status, started_at, finished_at, lines FROM s WHERE n > 0"""

QUERIES = {f.__name__: f for f in (sunk_events, streamed_limits, rate_limit_accept, job_steps)}
ORACLE = {
    "sunk_events": """SELECT event_id, user_id, event_type, CASE WHEN event_id % 10 = 0 THEN '{no' ELSE '{"ApiToken":"' || CASE WHEN length('key-' || event_id) < 8 THEN '***REDACTED***' ELSE left('key-' || event_id, 4) || '***' || right('key-' || event_id, 4) END
        || '","inner":{"client_secret":"***REDACTED***","tool":"' || event_type || '"}}' END AS props, CASE WHEN event_id % 10 = 0 THEN 'arguments are not JSON' END AS failure FROM events""",
    "streamed_limits": _LIMIT.replace("SELECT client, event_id, accepted FROM r", "SELECT r.client, r.event_id, r.accepted FROM r JOIN e USING (event_id) WHERE t <= ((SELECT max(t) FROM e) // 1000 - 172800000) * 1000"),
    "rate_limit_accept": _LIMIT,
    "job_steps": _JOBS,
}
