"""Results of scanners, kept by repository and made anew only where a repository's files or the scanners changed.

Findings lie in partitions by repository and content, a digest of all its files and of the scanners' settings; a manifest
says which content of each repository counts. A refresh scans only repositories whose digest the manifest lacks, writes
their partitions (dynamic overwrite: a run that breaks off is simply repeated), then a new manifest. Readers take the
newest manifest that is complete, so they see a refresh as a whole or not at all. Without changes nothing is written.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardspark.functions import shared
from wardspark.functions.size import small

MANIFEST = "repo string, content string, settings string, files bigint"


def version_of(output: Column) -> Column:
    """The first version number in what a tool says of itself."""
    found = F.regexp_extract(output, r"(\d+\.\d+\.\d+)", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", "unknown").otherwise(found)


def contents(files: DataFrame, settings: dict) -> DataFrame:
    """files: repo, path, text. repo, content, settings, files: a digest of the set of a repository's files and of the
    settings. Sums over parts of each file's digest, so it doesn't depend on an order and is added up before the shuffle."""
    said = json.dumps(settings, sort_keys=True)
    path, text = F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))
    each = F.sha2(F.concat(F.octet_length(path).cast("string"), F.lit(":"), path, F.when(F.col("text").isNull(), "0").otherwise("1"), text), 256)
    parts = [F.sum(F.conv(F.substring("each", k, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{k}") for k in (1, 16, 31, 46)]
    d = files.select("repo", each.alias("each")).groupBy("repo").agg(F.count("*").alias("files"), *parts)
    return d.select("repo", F.sha2(F.concat_ws(",", F.lit(said), F.col("files").cast("string"), *[f"p{k}" for k in (1, 16, 31, 46)]), 256).alias("content"), F.lit(said).alias("settings"), "files")


def _newest(spark: SparkSession, path: str) -> int:
    """The number of the newest complete manifest, 0 if there is none."""
    for n in sorted((int(x) for x in shared.names(spark, f"{path}/manifests")), reverse=True):
        if shared.exists(spark, f"{path}/manifests/{n}/_SUCCESS"):
            return n
    return 0


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """What counts by now: repo, content, settings (of the scanners, with their versions, as JSON), files."""
    n = _newest(spark, path)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{n}") if n else spark.createDataFrame([], MANIFEST)


def refresh(path: str, files: DataFrame, scan: Callable[[DataFrame], DataFrame], settings: dict, reuse: bool = True) -> dict[str, int]:
    """Brings the findings under ``path`` up to date with ``files`` (all files of all repositories). scan: from files to
    findings with their repo. Returns how many repositories were scanned, reused and are gone. Files without a repo take
    no part."""
    spark = files.sparkSession
    files = files.where("repo IS NOT NULL")
    now = shared.staged(contents(files, settings), "contents")
    old = manifest(spark, path)
    changed = now.join(old.select("repo", "content"), ["repo", "content"], "left_anti") if reuse else now
    todo, every, gone = changed.count(), now.count(), old.join(now, "repo", "left_anti").count()
    if todo:
        found = scan(files.join(small(changed.select("repo")), "repo", "left_semi"))
        found = found.join(small(changed.select("repo", "content")), "repo")
        shared.write_text(spark, f"{path}/schema.json", found.schema.json())
        rows = found.hint("rebalance", "repo", "content").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy("repo", "content").parquet(f"{path}/findings")
    if todo or gone:
        now.write.parquet(f"{path}/manifests/{_next(spark, path)}")
    return {"scanned": todo, "reused": every - todo, "gone": gone}


def _next(spark: SparkSession, path: str) -> int:
    """A number that no manifest has, not even one that was broken off."""
    return max([0, *(int(x) for x in shared.names(spark, f"{path}/manifests"))]) + 1


def findings(spark: SparkSession, path: str, repos: list[str] | None = None) -> DataFrame:
    """The findings that count. The manifest prunes partitions as the query runs, a list of repositories before."""
    schema = StructType.fromJson(json.loads(shared.read_text(spark, f"{path}/schema.json")))
    if not shared.exists(spark, f"{path}/findings"):
        return spark.createDataFrame([], schema)
    d, m = spark.read.schema(schema).parquet(f"{path}/findings"), manifest(spark, path).select("repo", "content")
    if repos is not None:
        d, m = d.where(F.col("repo").isin(repos)), m.where(F.col("repo").isin(repos))
    return d.join(small(m), ["repo", "content"]).select(*[c for c in schema.names if c != "content"])


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes partitions and manifests that no longer count; returns how many partitions went."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    there = spark.read.schema("repo string, content string").parquet(f"{path}/findings").select("repo", "content").distinct()
    gone = 0
    for r in there.join(manifest(spark, path), ["repo", "content"], "left_anti").toLocalIterator():
        shared.delete(spark, f"{path}/findings/repo={escape(r.repo)}/content={r.content}")
        gone += 1
    n = _newest(spark, path)
    for x in shared.names(spark, f"{path}/manifests"):
        if int(x) < n:
            shared.delete(spark, f"{path}/manifests/{x}")
    return gone
