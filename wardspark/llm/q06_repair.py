"""Query op6: token-id files of all documents, written and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import repair
from wardspark.llm.stage import table

VOCABULARY = "byte_bpe_50k.json"


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = repair.write(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return repair.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op6_token_files": op6_token_files}
#: A tokenizer cannot be had in SQL; tests compare with the library.
ORACLE: dict[str, str] = {}
