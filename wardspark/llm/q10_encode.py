"""Query op10: ids of all documents and what they decode to, for the vocabulary with word ends."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import encode
from wardspark.llm.stage import table

VOCABULARY = "word_bpe_49k.json"


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)


def op10_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


QUERIES = {"op10_encode_decode": op10_encode_decode}
#: A tokenizer cannot be had in SQL; tests compare with the library.
ORACLE: dict[str, str] = {}
