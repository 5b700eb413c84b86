"""Query op11: conversations that are damaged by a fixed rule, their faults and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import structure
from wardspark.llm.stage import staged, table

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def damaged(t: DataFrame) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = t.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[part(c).alias(c) for c in ("role", "text")])
    return structure.damaged(t, F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20)


def repairs(t: DataFrame) -> DataFrame:
    faulty = staged(structure.faults(damaged(t)), "faults")
    found = structure.digests(structure.applied(faulty, structure.edits(faulty)))
    rows = t.select(F.col("conv_id").cast("long")).distinct()
    for d in (structure.summary(faulty), found):
        rows = rows.unionByName(d, allowMissingColumns=True)
    digest = F.coalesce(F.max("repaired_sha256"), F.lit(EMPTY)).alias("repaired_sha256")
    return rows.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), digest)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(table(spark, sf_dir, "conversations"))


#: The program turn by turn, with whole audits and texts in its states.
SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS h
  FROM conversations),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, (SELECT unnest([1, 2]) AS copy) WHERE h <> 0 AND (copy = 1 OR h = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (SELECT *, role[1:1] AS i, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) AS i0,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
       WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
  count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(i0 || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
tr(p, r, ins, name) AS (VALUES ('', 's', 0, ''), ('', 'u', 0, 'user'), ('', 'a', 1, 'assistant'), ('s', 'u', 0, 'user'), ('s', 'a', 1, 'assistant'),
  ('u', 'a', 0, 'assistant'), ('u', 'u', 1, 'user'), ('a', 'u', 0, 'user'), ('a', 'a', 1, 'assistant')),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS j, '' AS p, {'cost': 0, 'audit': '', 'kept': CAST([] AS VARCHAR[])} AS w FROM f
  UNION ALL
  SELECT conv_id, j, r, min(w) FROM (
    SELECT dp.conv_id, f.pos AS j, dp.p AS r, {'cost': w.cost + 3, 'audit': w.audit || 'D', 'kept': w.kept} AS w
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.j + 1
    UNION ALL
    SELECT dp.conv_id, f.pos, tr.r, {'cost': w.cost + 2 * ins + CASE WHEN edit = 'R' THEN 2 ELSE 0 END + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END,
      'audit': w.audit || repeat('I', ins) || edit,
      'kept': list_concat(w.kept, CASE WHEN ins = 0 THEN CAST([] AS VARCHAR[]) WHEN tr.r = 'a' THEN ['user:'] ELSE ['assistant:'] END, [CASE WHEN edit = 'K' THEN role ELSE name END || ':' || text])}
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.j + 1 JOIN tr ON tr.p = dp.p, (SELECT unnest(['K', 'R']) AS edit)
    WHERE fault NOT IN ('blank', 'duplicate') AND CASE WHEN edit = 'K' THEN i = tr.r ELSE tr.r <> 's' END)
  GROUP BY conv_id, j, r),
e AS (SELECT dp.conv_id, min({'cost': w.cost + CASE p WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END, 'audit': w.audit || CASE p WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
    'kept': list_concat(w.kept, CASE p WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE CAST([] AS VARCHAR[]) END)}) AS w
  FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.j = g.n GROUP BY dp.conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.cost, 0) AS BIGINT) AS cost,
  coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

QUERIES = {"op11_structure_repair": op11_structure_repair}
ORACLE = {"op11_structure_repair": SQL}
