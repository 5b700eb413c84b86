"""Query op9: fingerprints and components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import simhash
from wardspark.llm.stage import table


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
#: XXH64 and reachability cannot be had in SQL; tests compare with brute force.
ORACLE: dict[str, str] = {}
