"""Query op4: base counts and verdict of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardspark.llm import quality
from wardspark.llm.stage import table

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*COLUMNS)


#: Also the first step of the pipeline's SQL: table judged.
CTE = r"""
w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
feat AS (SELECT w.doc_id, stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    least(floor(n_symbols / greatest(word_chars, 1) * 50), 50) AS symbols,
    least(floor(n_dup_lines / greatest(n_lines, 1) * 50), 50) AS dup_lines,
    least(floor(n_repeat_words / greatest(n_words, 1) * 50), 50) AS repeats FROM feat),
known AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
lab AS (SELECT stratum, good, rule, v FROM (
    SELECT stratum, good, unnest(['symbols', 'dup_lines', 'repeats']) AS rule, unnest([symbols, dup_lines, repeats]) AS v
    FROM failed JOIN known USING (doc_id) WHERE NOT base_failed)),
test AS (SELECT stratum, rule, b, count_if(good) AS n, count_if(good AND v >= b) AS k, count_if(NOT good AND v >= b) AS hits
    FROM lab, (SELECT unnest(range(1, 51)) AS b) GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k >= n * (0.02 / 3) THEN 1 ELSE list_sum(list_transform(range(0, CAST(k + 1 AS BIGINT)), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02 / 3) + (n - i) * ln(1 - 0.02 / 3)))) END AS p,
    (SELECT count(*) FROM (SELECT DISTINCT stratum, rule FROM lab)) AS m FROM test),
chain AS (SELECT *, min(CASE WHEN p <= 0.05 / m THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY b DESC) AS ok FROM tail),
cut AS (SELECT stratum, rule, arg_max(b, (hits - k) * 1000 + b) AS c FROM chain WHERE ok = 1 AND hits > k GROUP BY ALL),
judged AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(symbols >= (SELECT c FROM cut WHERE cut.stratum = failed.stratum AND rule = 'symbols'), false)
    AND NOT coalesce(dup_lines >= (SELECT c FROM cut WHERE cut.stratum = failed.stratum AND rule = 'dup_lines'), false)
    AND NOT coalesce(repeats >= (SELECT c FROM cut WHERE cut.stratum = failed.stratum AND rule = 'repeats'), false) AS kept FROM failed)
"""
SQL = f"WITH {CTE} SELECT * FROM judged"

QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE = {"op4_quality_rules": SQL}
