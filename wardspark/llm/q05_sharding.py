"""Query op5: all documents in shards 0 to 23."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardspark.llm import sharding
from wardspark.llm.stage import table


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 24).drop("grp")


QUERIES = {"op5_sharding": op5_sharding}
#: The propagation is iterative; tests check the law, the slots and the links that are cut.
ORACLE: dict[str, str] = {}
