"""Query op3: what substring dedup leaves of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import substring
from wardspark.llm.stage import table


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


CTE = r"""
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
grams AS (SELECT doc_id, s, array_to_string(words[s:s + 12], ' ') AS t
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS s FROM dw WHERE len(words) >= 13)),
gone AS (SELECT doc_id, s FROM grams QUALIFY min(doc_id) OVER (PARTITION BY t) < doc_id),
places AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM dw)
    WHERE (doc_id, p) NOT IN (SELECT doc_id, unnest(ps) FROM places) GROUP BY doc_id)
"""
SQL = f"""WITH {CTE}
SELECT doc_id, len(words) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN kept USING (doc_id)"""
QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE = {"op3_substring_dedup": SQL}
