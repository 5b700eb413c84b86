"""One place for the settings of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "wardspark", **more: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in more.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
