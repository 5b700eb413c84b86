"""Query op7: token counts of all documents for the byte-level vocabulary."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardspark.llm import tokencount
from wardspark.llm.stage import table

VOCABULARY = "byte_bpe_50k.json"


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {"op7_token_counts": op7_token_counts}
#: A tokenizer cannot be had in SQL; tests compare with the library.
ORACLE: dict[str, str] = {}
