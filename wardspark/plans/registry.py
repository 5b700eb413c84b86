"""Collects the queries and their SQL from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("event_queries", "finding_queries", "dataset_queries", "label_queries", "ingest_queries", "stream_queries", "layout_queries", "graph_queries", "model_queries", "retrieval_queries", "sample_queries", "job_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= importlib.import_module(f"wardspark.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= importlib.import_module(f"wardspark.plans.{name}").ORACLE
    return found
