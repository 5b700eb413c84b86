"""What a store does, as DataFrames: inserts, upserts, folds of event logs, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table and those rows whose key it lacks; of new rows with one key the first. What is there stays as it is."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = rows.join(table.select(*keys).distinct(), keys, "left_anti").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return table.unionByName(new, allowMissingColumns=True)


def replace_by_key(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table with new rows in place of those with their key; of new rows with one key the last."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    new = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_keeping(table: DataFrame, rows: DataFrame, keys: list[str], kept: list[str], order: list[str]) -> DataFrame:
    """As replace_by_key, but columns in ``kept`` keep the table's value."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    old = table.select(*keys, *[F.col(c).alias(f"_{c}") for c in kept])
    new = rows.join(old, keys, "left")
    new = new.select(*[F.coalesce(f"_{c}", c).alias(c) if c in kept else F.col(c) for c in rows.columns])
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def fold_jobs(events: DataFrame) -> DataFrame:
    """events: job_id, seq, status (or null), line (or null). The state of each job: its last status, when it was first
    and last heard of, its number of log lines and the last of them."""
    at = F.col("seq")
    return events.groupBy("job_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"),
        F.min(at).alias("first_seq"),
        F.max(at).alias("last_seq"),
        F.count("line").alias("lines"),
        F.max_by("line", F.when(F.col("line").isNotNull(), at)).alias("last_line"),
    )


def counts_by_source(findings: DataFrame) -> DataFrame:
    """report_id, a column per scanner and their total, 0 where there are none."""
    p = findings.groupBy("report_id").pivot("source", ["bandit", "semgrep"]).count().na.fill(0)
    return p.withColumn("total", F.col("bandit") + F.col("semgrep"))


def overlay(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of ``over`` where it has any, else of ``base``."""
    o = over.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(o, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def resume(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def limit_then_filter(rows: DataFrame, order: list[Column], n: int, condition: Column) -> DataFrame:
    """Twice as many as asked for, then the condition, then as many as asked for. The condition stays above the first
    limit: it may leave fewer rows than there are."""
    return rows.orderBy(*order).limit(2 * n).where(condition).orderBy(*order).limit(n)


def safe_json(text: Column, most: int = 4000) -> Column:
    """JSON as it is up to a length; beyond, an object with its beginning."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.to_json(F.struct(F.lit(True).alias("truncated"), F.left(text, F.lit(most)).alias("preview"))))
