"""Queries over what models say: temperature, label sets; and over tables of several schema versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions.shared import new_folder
from wardspark.operators import calibration, metrics
from wardspark.plans.common import table
from wardspark.sources import versions
from wardspark.sources.versions import Version

CLASSES = ["late", "returned", "air", "bulk", "priced", "never"]
_SETS = [
    "filter(array('late', 'returned', 'air', 'bulk', 'odd'), c -> (c = 'late' AND l_tax > 0.04) OR (c = 'returned' AND l_returnflag = 'R') OR (c = 'air' AND l_suppkey % 5 = 1) OR (c = 'bulk' AND l_quantity > 40) OR (c = 'odd' AND l_linenumber % 2 = 1))",
    "filter(array('late', 'returned', 'air', 'bulk', 'odd'), c -> (c = 'late' AND l_discount > 0.05) OR (c = 'returned' AND l_linestatus = 'F') OR (c = 'air' AND l_suppkey % 5 < 3) OR (c = 'bulk' AND l_quantity > 30) OR (c = 'odd' AND l_linenumber > 3))",
]


def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature of a noisy logit for whether a quantity is large."""
    d = table(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 25) / 4 + (F.col("l_extendedprice") - 53000) / 15000).alias("logit"), (F.col("l_quantity") > 25).cast("int").alias("label"))
    f = calibration.fit_temperature(d, "logit", "label")
    return spark.createDataFrame([(round(f.temperature, 6), round(f.loss, 6), f.rows)], "temperature double, loss double, rows long")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.expr(_SETS[0]).alias("y"), F.when(F.col("l_linenumber") < 7, F.expr(_SETS[1])).alias("p"))
    return metrics.label_counts(d, "y", "p", CLASSES)


def label_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return metrics.label_scores(_counts(spark, sf_dir)).select("class", r("precision"), r("recall"), r("f1"), "support")


def label_set_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_averages(_counts(spark, sf_dir)).select(F.round("macro_f1", 6).alias("macro_f1"), F.round("micro_f1", 6).alias("micro_f1"))


OUTCOMES = [
    Version("id int, action string, at date"),
    Version("id bigint, action string, at date, repo string", {"repo": "concat('r', id % 3)"}),
    Version("id bigint, verdict string, at timestamp_ntz, repo string, notes string", {"notes": "CASE WHEN action = 'O' THEN 'open' END"}, {"action": "verdict"}),
]


def outcomes_of_all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outcomes, a third of them written under each version of the schema."""
    path, o = new_folder(spark, "outcomes"), table(spark, sf_dir, "orders")
    d = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("action"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderdate").alias("at"), F.concat(F.lit("own"), (F.col("o_custkey") % 2).cast("string")).alias("repo"), F.col("o_orderpriority").alias("notes"))
    for n in (1, 2, 3):
        versions.write(d.where(F.col("id") % 3 == n - 1), path, OUTCOMES, n)
    return versions.read(spark, path, OUTCOMES)


_LISTS = [s.replace("filter(array(", "list_filter([").replace("'odd'), c ->", "'odd'], lambda c:") for s in _SETS]
_N = f"""WITH s AS (SELECT {_LISTS[0]} AS y, CASE WHEN l_linenumber < 7 THEN {_LISTS[1]} ELSE [] END AS p FROM lineitem),
    n AS (SELECT c AS class, count_if(list_contains(y, c) AND list_contains(p, c)) AS tp, count_if(list_contains(p, c) AND NOT list_contains(y, c)) AS fp, count_if(list_contains(y, c) AND NOT list_contains(p, c)) AS fn
    FROM s, (SELECT unnest({CLASSES}) AS c) GROUP BY c)"""

QUERIES = {f.__name__: f for f in (temperature_fit, label_set_scores, label_set_averages, outcomes_of_all_versions)}
ORACLE = {
    "temperature_fit": """WITH RECURSIVE d AS (SELECT (l_quantity - 25) / 4 + (l_extendedprice - 53000) / 15000 AS x, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
        b AS (SELECT 0 AS i, CAST(0.001 AS DOUBLE) AS lo, CAST(1000 AS DOUBLE) AS hi
          UNION ALL SELECT i + 1, CASE WHEN sum(x * (1 / (1 + exp(-x * sqrt(lo * hi))) - y)) < 0 THEN sqrt(lo * hi) ELSE lo END, CASE WHEN sum(x * (1 / (1 + exp(-x * sqrt(lo * hi))) - y)) < 0 THEN hi ELSE sqrt(lo * hi) END FROM b, d WHERE i < 60 GROUP BY i, lo, hi),
        t AS (SELECT lo FROM b WHERE i = 60)
        SELECT round(1 / lo, 6) AS temperature, round(avg(greatest(x * lo, 0) + ln(1 + exp(-abs(x * lo))) - x * lo * y), 6) AS loss, count(*) AS rows FROM d, t GROUP BY lo""",
    "label_set_scores": f"{_N} SELECT class, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, CAST(tp + fn AS BIGINT) AS support FROM n",
    "label_set_averages": f"{_N} SELECT round(avg(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) AS micro_f1 FROM n",
    "outcomes_of_all_versions": """SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus AS verdict, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS at, CASE o_orderkey % 3 WHEN 0 THEN 'r' || (o_orderkey % 3) ELSE 'own' || (o_custkey % 2) END AS repo,
        CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority WHEN o_orderstatus = 'O' THEN 'open' END AS notes FROM orders""",
}
