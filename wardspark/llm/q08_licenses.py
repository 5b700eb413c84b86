"""Query op8: licence phrases and templates in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardspark.llm import licenses
from wardspark.llm.q01_decontam import words_sql
from wardspark.llm.stage import table


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({k}, '{t[0]}', {_literal(t[1])})" for k, t in enumerate(licenses.TEMPLATES))
SQL = f"""
WITH dw AS (SELECT doc_id, {words_sql("text")} AS words FROM documents),
pl AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM dw)),
base AS (SELECT doc_id, i - 1 AS p, CASE WHEN a = 'mit' THEN 'mit' WHEN a = 'apache' THEN 'apache' ELSE 'gpl' END AS label FROM pl
    WHERE (a IN ('mit', 'apache') AND b = 'license') OR (a = 'general' AND b = 'public' AND c = 'license')),
t AS (SELECT k, label, list_distinct({words_sql("text")}) AS words FROM (VALUES {_TEMPLATES}) AS v(k, label, text)),
tw AS (SELECT k, label, len(words) AS n, unnest(words) AS word FROM t),
lines AS (SELECT doc_id, line, unnest(list_distinct({words_sql("text")})) AS word FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)),
found AS (SELECT doc_id, line, k, label, count(*) / n AS share FROM lines JOIN tw USING (word) GROUP BY doc_id, line, k, label, n
    HAVING count(*) >= greatest(1, ceil(0.8 * n - 1e-9))),
per AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
alls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
    FROM (SELECT doc_id, label, 1.0 AS share FROM base UNION ALL SELECT doc_id, label, share FROM found) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM dw LEFT JOIN per USING (doc_id) LEFT JOIN alls USING (doc_id)
"""
QUERIES = {"op8_license_scan": op8_license_scan}
ORACLE = {"op8_license_scan": SQL}
