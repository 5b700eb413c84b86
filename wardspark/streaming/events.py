"""The event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.operators.gateway import masked_args
from wardspark.operators.replays import Limiter
from wardspark.operators.store import safe_json
from wardspark.streaming.replay import replayed

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files: int = 8) -> DataFrame:
    """New Parquet files of a folder; the time is an instant, as watermarks need."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def ingest(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once each, with arguments masked; those that are longer than a store takes are cut to a preview."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).withColumn("props", safe_json(masked_args(F.col("props"))))


def windowed(events: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of each window and type; a window is given out when the watermark has passed it."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def rate_limited(events: DataFrame, most: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """client, event_id, accepted: as the batch operator, for each event once the watermark has passed it."""
    d = events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))
    return replayed(d, Limiter(most, seconds), late).select(F.col("key").alias("client"), F.col("seq").alias("event_id"), "accepted")


def jobs(events: DataFrame) -> DataFrame:
    """job_id and its latest status, as statuses come in (job_id, seq, status)."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("last_seq"))


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything there is by now, in a table in memory (for tests)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
