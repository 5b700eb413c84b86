"""What dashboards ask for: reports, jobs and patches joined with their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.functions.text import mask_value, redact_secrets


def report_list(reports: DataFrame, counts: DataFrame, n: int, repo: str | None = None) -> DataFrame:
    """Newest reports first with their counts, 0 where there are none. The limit is taken before the join."""
    r = reports if repo is None else reports.where(F.col("repo") == repo)
    r = r.orderBy(F.desc("created_at"), F.desc("report_id")).limit(min(n, 100))
    return r.join(counts, "report_id", "left").na.fill(0)


def job_reports(jobs: DataFrame, artifacts: DataFrame, counts: DataFrame) -> DataFrame:
    """Jobs that have a report; the others are left out."""
    return jobs.join(artifacts, "job_id").join(counts, "job_id", "left").na.fill(0)


def slim(findings: DataFrame, most: int = 400) -> DataFrame:
    """Findings for a list: the message redacted and cut."""
    m = redact_secrets(F.col("message"))
    return findings.withColumn("message", F.when(F.char_length(m) > most, F.concat(F.rtrim(F.left(m, F.lit(most))), F.lit("..."))).otherwise(m))


def patch_statuses(findings: DataFrame, selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """finding_id and whether it was patched, rejected or has no candidate."""
    c = candidates.groupBy("finding_id").agg(F.max(F.col("validated").cast("int")).alias("valid"), F.count("*").alias("n"))
    s = selected.select("finding_id", "candidate_id")
    j = findings.select("finding_id").join(s, "finding_id", "left").join(c, "finding_id", "left")
    status = F.when(F.col("candidate_id").isNotNull(), "patched").when(F.col("n").isNull(), "no_candidate").when(F.col("valid") == 0, "rejected").otherwise("validated")
    return j.select("finding_id", status.alias("status"))


def summarise(statuses: DataFrame, times: DataFrame) -> DataFrame:
    """One row: findings by status, and the mean validation time of those that have one."""
    return statuses.join(times, "finding_id", "left").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("patched", "validated", "rejected", "no_candidate")], F.round(F.avg("seconds"), 6).alias("avg_seconds"))


def risk_summary(scored: DataFrame) -> DataFrame:
    """One row: scores above 0.7, from 0.4 to 0.7, and below."""
    s = F.col("score")
    return scored.agg(F.count("*").alias("total"), F.count_if(s > 0.7).alias("high"), F.count_if((s >= 0.4) & (s <= 0.7)).alias("medium"), F.count_if(s < 0.4).alias("low"))


def mapping_rates(mapped: DataFrame, by: str) -> DataFrame:
    """Lines and mapped lines of each and of all (null)."""
    return mapped.rollup(by).agg(F.count("*").alias("total"), F.count("sample_id").alias("mapped"), F.grouping_id().alias("level"))


def length_statistics(docs: DataFrame, tokens, by: str) -> DataFrame:
    return docs.select(by, F.size(tokens).alias("n")).groupBy(by).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"))


def citations(tiers: DataFrame, most: int = 5) -> DataFrame:
    """finding_id, tier, place, chunk_id: two of the first two tiers each, then the rest, five in all."""
    w = Window.partitionBy("finding_id", "tier").orderBy("place", "chunk_id")
    t = tiers.withColumn("_k", F.row_number().over(w)).withColumn("_late", F.when((F.col("tier") <= 2) & (F.col("_k") <= 2), 0).otherwise(1))
    all_ = Window.partitionBy("finding_id").orderBy("_late", "tier", "_k", "chunk_id")
    return t.withColumn("n", F.row_number().over(all_)).where(F.col("n") <= most).select("finding_id", "chunk_id", "n")


def outcomes_to_log(outcomes: DataFrame) -> DataFrame:
    """Outcomes as kept: notes redacted, tokens masked, the diff by its hash."""
    return outcomes.select("id", "job_id", "action", redact_secrets(F.col("notes")).alias("notes"), mask_value(F.col("user")).alias("user"), F.sha2("diff", 256).alias("diff_hash"))
