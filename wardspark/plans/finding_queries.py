"""Queries over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions import severity as sev
from wardspark.operators import findings as ops
from wardspark.operators import spans as joins
from wardspark.operators import store
from wardspark.plans.common import FINDINGS, SPANS_SQL, findings, spans, table


def severity_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.severity_counts(findings(spark, sf_dir), "source")


def counts_pivot_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.when(F.col("l_returnflag") == "R", "bandit").when(F.col("l_returnflag") == "A", "semgrep").otherwise("ml").alias("source"))  # noqa: E741
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"))
    return o.join(store.counts_by_source(l), "report_id", "left").na.fill(0)


def file_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_per_file(findings(spark, sf_dir)).select("filepath", "ordinal", "place")


def file_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("value")), F.struct(F.lit("rule").alias("kind"), F.col("rule_id").alias("value"))))
    return findings(spark, sf_dir).select("filepath", kinds.alias("k")).groupBy("filepath", "k.kind", "k.value").agg(F.count("*").alias("n"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With unknown words, nulls, and ends that are not known."""
    word = F.when(F.col("ordinal") % 17 == 0, F.lit(None)).when(F.col("ordinal") % 13 == 0, "WARNING").when(F.col("ordinal") % 11 == 0, "ERROR").when(F.col("ordinal") % 19 == 0, "odd").otherwise(F.upper("severity"))
    sure = F.when(F.col("ordinal") % 7 == 0, F.lit(None)).when(F.col("ordinal") % 5 == 0, "UNDEFINED").otherwise(F.col("confidence_word"))
    end = F.when(F.col("ordinal") % 3 > 0, F.col("end_line"))
    kind = F.concat("rule_id", F.element_at(F.array(*map(F.lit, ("-sqli", "-Exec", "-token", "-other"))), (F.col("ordinal") % 4 + 1).cast("int")))
    return findings(spark, sf_dir).select(F.col("filepath").alias("file_path"), F.col("start_line").alias("line_start"), end.alias("line_end"), kind.alias("category"), word.alias("severity"), sure.alias("confidence"), F.col("source").alias("scanner"), "ordinal", F.col("message").alias("code_snippet"))


def consensus_bucket_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.consensus(_scanned(spark, sf_dir)).withColumn("consensus_score", F.round("consensus_score", 6)).withColumn("scanner_sources", F.array_join("scanner_sources", ","))


def consensus_stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.consensus_statistics(ops.consensus(_scanned(spark, sf_dir)))


def gold_label_min_scanners(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).select(F.col("filepath").alias("file_path"), F.col("start_line").alias("line_start"), "severity", F.col("source").alias("scanner"))
    return ops.gold_labels(f).withColumn("score", F.round("score", 6))


def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return f.select("ordinal", ops.finding_id(F.col("filepath"), F.col("start_line"), F.col("end_line"), F.col("rule_id"), F.col("source"), F.col("message")).alias("finding_id"), sev.rank(F.col("severity")).alias("rank"))


def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return ops.at_least(f, "high").groupBy("source").agg(F.count("*").alias("n")).join(ops.must_fail(f, "critical"))


def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.last_wins(findings(spark, sf_dir), ["filepath", "rule_id"], ["ordinal"]).select("filepath", "rule_id", "ordinal")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_wins(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest")), ["digest"], ["doc_id"])


def _split(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    return f.where("source <> 'ml'"), f.where("source = 'ml'")


def span_overlap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.overlap_candidates(*_split(findings(spark, sf_dir)))


def span_merge_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.merge(findings(spark, sf_dir))


def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.render(findings(spark, sf_dir).where("source = 'bandit'"), 100_000)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select(F.col("ordinal").alias("row_id"), F.lit("r").alias("repo"), "filepath", F.col("end_line").alias("line"))


def span_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.enclosing(_lines(spark, sf_dir), spans(spark))


def span_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest(_lines(spark, sf_dir), spans(spark), 3)


def span_mapping_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.map_lines(_lines(spark, sf_dir), spans(spark)).agg(F.count("*").alias("total"), F.count("sample_id").alias("mapped"))


def weak_label_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = findings(spark, sf_dir).select(F.col("ordinal").alias("label_id"), F.when(F.col("ordinal") % 3 == 0, F.lit(None)).when(F.col("ordinal") % 3 == 1, "r").otherwise("q").alias("repo"), "filepath", F.col("start_line").alias("line"))
    return joins.attach_labels(spans(spark), labels)


def version_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("django", "requests", "flask", "left-pad", "pyyaml", "jinja2", "tornado")])
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.lit("pypi").alias("ecosystem"), F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int")).alias("package"), F.concat_ws(".", (F.col("p_size") % 6).cast("string"), (F.col("p_partkey") % 40).cast("string"), F.lit("0")).alias("version"))
    return joins.vulnerable(p, joins.advisories(spark)).select("part_id", "package", "version", "advisory")


QUERIES = {
    f.__name__: f
    for f in (severity_counts_by_source, counts_pivot_total, file_top20, file_histograms, consensus_bucket_merge, consensus_stats_grouping_sets, gold_label_min_scanners, finding_ids, threshold_gate, dedup_last, dedup_first, span_overlap_candidates, span_merge_greedy, report_blocks, span_enclosing, span_nearest, span_mapping_rate, weak_label_attach, version_theta_join)
}
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_CONSENSUS = f"""{FINDINGS},
r AS (SELECT filepath AS file_path, start_line AS line_start, CASE WHEN ordinal % 3 > 0 THEN end_line END AS line_end, rule_id || CASE ordinal % 4 WHEN 0 THEN '-sqli' WHEN 1 THEN '-Exec' WHEN 2 THEN '-token' ELSE '-other' END AS raw, source, message, ordinal,
    CASE WHEN ordinal % 17 = 0 THEN NULL WHEN ordinal % 13 = 0 THEN 'WARNING' WHEN ordinal % 11 = 0 THEN 'ERROR' WHEN ordinal % 19 = 0 THEN 'odd' ELSE upper(severity) END AS sw,
    CASE WHEN ordinal % 7 = 0 THEN NULL WHEN ordinal % 5 = 0 THEN 'UNDEFINED' ELSE confidence_word END AS cw FROM findings),
s AS (SELECT *, CASE sw WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'ERROR' THEN 3 WHEN 'LOW' THEN 1 WHEN 'INFO' THEN 1 ELSE 2 END AS sr, CASE cw WHEN 'HIGH' THEN 2 WHEN 'LOW' THEN 0 ELSE 1 END AS cr FROM r),
g AS (SELECT file_path, CAST(line_start // 3 AS INT) AS bucket, max(sr) AS sr, max(cr) AS cr, first(raw ORDER BY ordinal) AS raw, min(line_start) AS line_start, coalesce(max(line_end), min(line_start)) AS line_end, count(*) AS scanner_count,
    first(message ORDER BY length(message) DESC, ordinal) AS code_snippet, string_agg(source, ',' ORDER BY ordinal) AS scanner_sources FROM s GROUP BY 1, 2),
h AS (SELECT *, CASE sr WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE cr WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    CASE WHEN raw LIKE '%sqli' THEN 'sql.injection' WHEN raw LIKE '%Exec' THEN 'command.injection' WHEN raw LIKE '%token' THEN 'hardcoded.secrets' ELSE lower(raw) END AS category FROM g),
c AS (SELECT *, left(sha256(concat_ws(':', file_path, line_start, category)), 16) AS finding_id,
    CASE severity WHEN 'CRITICAL' THEN 1.0::DOUBLE WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.6 ELSE 0.4 END * CASE confidence WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.75 ELSE 0.5 END * least(1.0::DOUBLE, 0.5::DOUBLE + scanner_count * 0.1::DOUBLE) AS consensus_score FROM h)"""
_LINES = f"{FINDINGS}, {SPANS_SQL}, li AS (SELECT ordinal AS row_id, filepath, end_line AS line FROM findings)"
_INSIDE = "inside AS (SELECT row_id, sample_id FROM li JOIN spans USING (filepath) WHERE line BETWEEN start_line AND end_line QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY end_line - start_line, start_line DESC, sample_id) = 1)"
_NEAR = """f AS (SELECT *, lead(start_line) OVER (PARTITION BY filepath ORDER BY start_line, end_line, sample_id) AS following FROM spans),
near AS (SELECT row_id, sample_id, greatest(0, start_line - line, line - end_line) AS away, start_line, end_line FROM li JOIN f USING (filepath)
    WHERE start_line BETWEEN line - 3 AND line + 3 OR (start_line < line - 3 AND (following IS NULL OR following >= line - 3))),
nearest AS (SELECT row_id, sample_id FROM near WHERE away <= 3 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY away, start_line, end_line, sample_id) = 1)"""
ORACLE = {
    "severity_counts_by_source": f"WITH {FINDINGS} SELECT source, count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) AS total FROM findings GROUP BY source",
    "counts_pivot_total": "SELECT o_orderkey AS report_id, count(*) FILTER (WHERE l_returnflag = 'R') AS bandit, count(*) FILTER (WHERE l_returnflag = 'A') AS semgrep, count(*) FILTER (WHERE l_returnflag IN ('R', 'A')) AS total FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "file_top20": f"WITH {FINDINGS} SELECT filepath, ordinal, CAST(row_number() OVER (PARTITION BY filepath ORDER BY {_RANK} DESC, start_line, ordinal) AS INT) AS place FROM findings QUALIFY place <= 20",
    "file_histograms": f"WITH {FINDINGS} SELECT filepath, 'severity' AS kind, severity AS value, count(*) AS n FROM findings GROUP BY ALL UNION ALL SELECT filepath, 'rule', rule_id, count(*) FROM findings GROUP BY ALL",
    "consensus_bucket_merge": f"WITH {_CONSENSUS} SELECT file_path, bucket, severity, confidence, category, line_start, line_end, scanner_count, code_snippet, scanner_sources, finding_id, round(consensus_score, 6) AS consensus_score, CAST(CASE WHEN scanner_count >= 3 OR severity = 'CRITICAL' OR (scanner_count >= 2 AND confidence = 'HIGH') OR consensus_score >= 0.4 THEN 1 ELSE 0 END AS INT) AS label FROM c",
    "consensus_stats_grouping_sets": f"WITH {_CONSENSUS} SELECT severity, category, count(*) AS n, round(avg(consensus_score), 6) AS avg_score, grouping(severity, category) AS level FROM c GROUP BY GROUPING SETS ((), (severity), (category))",
    "gold_label_min_scanners": f"WITH {FINDINGS}, g AS (SELECT filepath AS file_path, CAST(start_line // 3 AS INT) AS bucket, count(DISTINCT source) AS scanners, max(CASE WHEN severity IN ('high', 'critical') THEN 1 ELSE 0 END) AS high FROM findings GROUP BY 1, 2) SELECT file_path, bucket, scanners, round(least(1.0, scanners / 3) + 0.3 * high, 6) AS score FROM g WHERE scanners >= 2",
    "finding_ids": f"WITH {FINDINGS} SELECT ordinal, left(sha1(concat_ws(':', filepath, start_line, end_line, rule_id, source, message)), 12) AS finding_id, {_RANK} AS rank FROM findings",
    "threshold_gate": f"WITH {FINDINGS} SELECT source, count(*) AS n, (SELECT count(*) FILTER (WHERE severity = 'critical') > 0 FROM findings) AS failed FROM findings WHERE severity IN ('high', 'critical') GROUP BY source",
    "dedup_last": f"WITH {FINDINGS} SELECT filepath, rule_id, max(ordinal) AS ordinal FROM findings GROUP BY 1, 2",
    "dedup_first": "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY md5(text)",
    "span_overlap_candidates": f"WITH {FINDINGS}, t AS (SELECT * FROM findings WHERE source <> 'ml') SELECT m.ordinal AS m_id, t.ordinal AS t_id FROM findings m JOIN t ON m.filepath = t.filepath AND t.start_line <= m.end_line AND m.start_line <= t.end_line WHERE m.source = 'ml' QUALIFY row_number() OVER (PARTITION BY m.ordinal ORDER BY t.end_line - t.start_line, t.start_line, t.rule_id, t.ordinal) = 1",
    "report_blocks": f"""WITH {FINDINGS}, b AS (SELECT *, concat('- [', severity, '] ', rule_id, ' lines ', start_line, '-', end_line, ': ', message) AS block FROM findings WHERE source = 'bandit'),
        h AS (SELECT filepath, ordinal, block, sum(length(block) + 2) OVER (ORDER BY filepath, {_RANK} DESC, start_line, rule_id, ordinal ROWS UNBOUNDED PRECEDING) + sum(CASE WHEN k = 1 THEN length(filepath) + 4 ELSE 0 END) OVER (ORDER BY filepath, k ROWS UNBOUNDED PRECEDING) AS upto
            FROM (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY {_RANK} DESC, start_line, rule_id, ordinal) AS k FROM b))
        SELECT filepath, ordinal, block, CAST(upto AS BIGINT) AS upto FROM h WHERE upto <= 100000""",
    "span_enclosing": f"WITH {_LINES}, {_INSIDE} SELECT row_id, sample_id FROM inside",
    "span_nearest": f"WITH {_LINES}, {_NEAR} SELECT row_id, sample_id FROM nearest",
    "span_mapping_rate": f"WITH {_LINES}, {_INSIDE}, {_NEAR} SELECT count(*) AS total, count(coalesce(i.sample_id, n.sample_id)) AS mapped FROM li LEFT JOIN inside i USING (row_id) LEFT JOIN nearest n USING (row_id)",
    "weak_label_attach": f"WITH {FINDINGS}, {SPANS_SQL}, la AS (SELECT ordinal AS label_id, CASE ordinal % 3 WHEN 0 THEN NULL WHEN 1 THEN 'r' ELSE 'q' END AS repo, filepath, start_line AS line FROM findings) SELECT s.sample_id, l.label_id FROM spans s LEFT JOIN la l ON s.filepath = l.filepath AND l.line BETWEEN s.start_line AND s.end_line AND coalesce(l.repo, s.repo) = s.repo",
    "version_theta_join": "WITH a(package, v, below_major, below_minor, below_patch) AS (VALUES "
    + ", ".join("('{}', '{}', {})".format(p, cve, ", ".join((below.split(".") + ["0", "0"])[:3])) for eco, p, below, _, cve in joins.ADVISORIES if eco == "pypi")
    + """), p AS (SELECT p_partkey AS part_id, ['django', 'requests', 'flask', 'left-pad', 'pyyaml', 'jinja2', 'tornado'][CAST(p_partkey % 7 + 1 AS INT)] AS package, p_size % 6 AS x, p_partkey % 40 AS y FROM part)
        SELECT part_id, package, concat(x, '.', y, '.0') AS version, v AS advisory FROM p JOIN a USING (package) WHERE (x, y, 0) < (below_major, below_minor, below_patch)""",
}
