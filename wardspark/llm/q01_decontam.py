"""Query op1: contamination of every document by the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import decontam
from wardspark.llm.stage import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


#: Tables judged, from documents and benchmark.
CTE = f"""
dw AS (SELECT doc_id, {words_sql("text")} AS words FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words_sql("text")} AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, len(words[s:s + 12]) AS n, array_to_string(words[s:s + 12], ' ') AS t
    FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 11, 2))) AS s FROM iw WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, s, n, array_to_string(words[s:s + n - 1], ' ') AS t
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM dw, sizes WHERE len(words) >= n)),
hit AS (SELECT doc_id, s, grams.n, item_id FROM grams JOIN win ON grams.t = win.t AND grams.n = win.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id),
judged AS (SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id))
"""
QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE = {"op1_decontaminate": f"WITH {CTE} SELECT * FROM judged"}
