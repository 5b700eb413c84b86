"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q01_decontam", "q02_chat", "q03_substring", "q04_quality", "q05_sharding", "q06_repair", "q07_tokencount", "q08_licenses", "q09_simhash", "q10_encode", "q11_structure", "q12_topk", "q13_fim")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= importlib.import_module(f"wardspark.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= importlib.import_module(f"wardspark.llm.{name}").ORACLE
    return found
