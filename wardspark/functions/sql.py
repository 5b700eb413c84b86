"""The expressions as functions for SQL: native ones, no Python in them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wardspark.functions.severity import RANK
from wardspark.functions.text import LONG_TOKEN, SECRETS


def _redact(text: str) -> str:
    for p in [*SECRETS, LONG_TOKEN]:
        text = f"regexp_replace({text}, r'{p}', '[REDACTED]')"
    return text


FUNCTIONS = {
    "severity_rank(s STRING) RETURNS INT": "CASE lower(s) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANK.items()) + " ELSE 0 END",
    "mask_value(v STRING) RETURNS STRING": "CASE WHEN char_length(v) <= 8 THEN '***REDACTED***' ELSE concat(left(v, 4), '***', right(v, 4)) END",
    "redact_secrets(t STRING) RETURNS STRING": _redact("t"),
    "code_tokens(t STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(t, r'[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]', 0)",
    "identifier_tokens(t STRING) RETURNS ARRAY<STRING>": "regexp_extract_all(lower(t), '[a-z_][a-z0-9_]+', 0)",
    "hash_bucket(token STRING, dim INT) RETURNS INT": "cast(cast(conv(substring(sha1(token), 1, 8), 16, 10) AS BIGINT) % dim AS INT)",
    "split_bucket(seed STRING, id STRING) RETURNS DOUBLE": "cast(conv(substring(sha2(concat(seed, ':', id), 256), 1, 16), 16, 10) AS DOUBLE) / 18446744073709551616D",
    "lexical_weight(tf BIGINT) RETURNS DOUBLE": "2.2D * tf / (tf + 1.2D)",
    "cosine_sim(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": """coalesce(try_divide(aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> x * y), 0D, (s, x) -> s + x),
        sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)""",
    "diff_added(d STRING) RETURNS INT": "size(filter(split(d, '\\n'), x -> startswith(x, '+') AND NOT startswith(x, '+++')))",
    "diff_removed(d STRING) RETURNS INT": "size(filter(split(d, '\\n'), x -> startswith(x, '-') AND NOT startswith(x, '---')))",
}


def register(spark: SparkSession) -> None:
    """These functions, and the table functions over source code."""
    from wardspark.operators import code

    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    code.register(spark)
