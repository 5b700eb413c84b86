import pytest
from pyspark.sql import functions as F

from wardspark.operators import gateway
from wardspark.streaming import events

FILE = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "events")
    spark.read.parquet(FILE).repartition(3).write.parquet(path)
    return path


def test_windows_as_in_batch(spark, folder):
    s = events.windowed(events.source(spark, folder), "1 day")
    got = {(r.start, r.event_type): r.n for r in events.run_once(s, "w", "complete").collect()}
    b = spark.read.parquet(FILE).groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").count()
    assert got == {(r.w.start, r.event_type): r["count"] for r in b.collect()}


def test_rate_limit_as_in_batch(spark, folder):
    """Of all events that the watermark has passed: it stands an hour behind the last."""
    s = events.rate_limited(events.source(spark, folder), 2, 36000)
    got = {(r.event_id, r.accepted) for r in events.run_once(s, "r", "append").collect()}
    b = spark.read.parquet(FILE).select(F.col("user_id").alias("client"), "event_id", "ts")
    past = {r.event_id for r in b.where(F.col("ts") < b.agg(F.expr("max(ts) - INTERVAL 1 HOUR")).first()[0]).collect()}
    assert len(past) > 900 and got == {(r.event_id, r.accepted) for r in gateway.rate_limit(b, 2, 36000).collect() if r.event_id in past}


def test_ingest_drops_repeats(spark, tmp_path):
    b = spark.read.parquet(FILE)
    b.union(b).write.parquet(str(tmp_path / "twice"))
    assert events.run_once(events.ingest(events.source(spark, str(tmp_path / "twice"))), "i").count() == b.count()
