"""Queries over kept scanner results and over tables laid out for lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions.shared import new_folder
from wardspark.plans.common import table
from wardspark.sources import cache, lookup


def _hits(run: int):
    """Lines that name a licence, and which run found them."""

    def scan(files: DataFrame) -> DataFrame:
        rows = files.select("repo", "path", F.posexplode(F.split("text", "\n")).alias("line", "code"))
        return rows.where(F.lower("code").contains("license")).select("repo", "path", (F.col("line") + 1).alias("line"), F.lit(run).alias("run"))

    return scan


def reused_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of a repository for each source and language; after a first scan those in ``en`` change."""
    path = new_folder(spark, "scans")
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text")
    settings = {"lines": {"version": "1.0.0"}}
    cache.refresh(path, d, _hits(1), settings)
    cache.refresh(path, d.withColumn("text", F.when(F.col("repo").endswith("/en"), F.concat("text", F.lit("\nLicense: none"))).otherwise(F.col("text"))), _hits(2), settings)
    return cache.findings(spark, path)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have labels, looked up by id in a bucketed table."""
    d = lookup.by_bucket(table(spark, sf_dir, "documents"), "doc_id", 16)
    return lookup.get_all(d, "doc_id", table(spark, sf_dir, "labels")).select("doc_id", "lang", "n_chars")


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a few users, from a table that is sorted by user."""
    t = lookup.by_range(table(spark, sf_dir, "events"), new_folder(spark, "events"), "user_id")
    return lookup.get(t, "user_id", 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 10**12).select("user_id", "event_id", "event_type", "value")


QUERIES = {f.__name__: f for f in (reused_scans, labelled_documents, events_by_user)}
ORACLE = {
    "reused_scans": """WITH f AS (SELECT source || '/' || lang AS repo, CAST(doc_id AS VARCHAR) AS path, text || CASE WHEN lang = 'en' THEN chr(10) || 'License: none' ELSE '' END AS text, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS run FROM documents),
        l AS (SELECT repo, path, run, unnest(string_split(text, chr(10))) AS code, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM f)
        SELECT repo, path, CAST(line AS INTEGER) AS line, run FROM l WHERE contains(lower(code), 'license')""",
    "labelled_documents": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "events_by_user": "SELECT user_id, event_id, event_type, value FROM events WHERE user_id IN (3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)",
}
