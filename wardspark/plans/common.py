"""Shared inputs: findings, events and queries made from the driver's tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FINDING = [
    "concat('src/f', cast(l_orderkey % 997 AS {text}), '.py') AS filepath",
    "cast(l_partkey % 200 + 1 AS int) AS start_line",
    "cast(l_partkey % 200 + 1 + l_suppkey % 7 AS int) AS end_line",
    "CASE l_returnflag WHEN 'R' THEN 'bandit' WHEN 'A' THEN 'semgrep' ELSE 'ml' END AS source",
    "CASE l_linenumber % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity",
    "CASE l_suppkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_word",
    "cast(l_discount * 10 AS double) AS confidence",
    "concat('R', cast(l_partkey % 23 AS {text})) AS rule_id",
    "concat('found ', cast(l_partkey AS {text})) AS message",
    "(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + cast(l_quantity AS bigint) % 100 AS ordinal",
]


#: The ordinal where it fits; where a long would overflow (orders from 11.5 million on, for which the SQL has no result
#: either) it is computed wide and folded back into one that is not negative.
_WIDE = "CASE WHEN l_orderkey <= 11000000 AND l_partkey <= 100000000000 AND l_suppkey <= 100000000000 THEN {0} ELSE cast(({1}) % 9223372036854775808BD AS bigint) END AS ordinal".format(
    _FINDING[-1].removesuffix(" AS ordinal"), _FINDING[-1].removesuffix(" AS ordinal").replace("l_orderkey * 8", "cast(l_orderkey AS decimal(20,0)) * 8")
)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[e.format(text="string") for e in _FINDING[:-1]], _WIDE)


FINDINGS = "findings AS (SELECT " + ", ".join(e.format(text="varchar") for e in _FINDING) + " FROM lineitem)"

#: Spans of a file for the interval joins: 20 per file, of lengths 5 to 40, some within others.
SPANS = """spans AS (SELECT f AS n, concat('src/f', cast(f AS {text}), '.py') AS filepath, 'r' AS repo, concat('s', cast(f AS {text}), '-', cast(k AS {text})) AS sample_id,
    cast(k * 10 + 1 + f % 5 AS int) AS start_line, cast(k * 10 + 6 + f % 5 + (k * k + f) % 35 AS int) AS end_line
    FROM (SELECT {f} AS f) {a} CROSS JOIN (SELECT {k} AS k) {b})"""


def spans(spark: SparkSession) -> DataFrame:
    return spark.sql("WITH " + SPANS.format(text="string", f="explode(sequence(0, 996))", k="explode(sequence(0, 19))", a="x", b="y") + " SELECT * FROM spans")


SPANS_SQL = SPANS.format(text="varchar", f="unnest(range(0, 997))", k="unnest(range(0, 20))", a="x", b="y")

_EVENT = ["event_id", "ts", "user_id", "value", "props", "event_type AS tool", "CASE event_type WHEN 'error' THEN 'deny' WHEN 'purchase' THEN 'require_approval' ELSE 'allow' END AS decision"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_EVENT)


EVENTS = "ev AS (SELECT " + ", ".join(_EVENT) + " FROM events)"
