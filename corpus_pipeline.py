"""From raw documents to token ids: quality rules, near-dedup, substring dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Ids are
expected to be unique and not null. Rows without an id go in the first stage, as nothing could be joined to them; of
rows that share an id one stays after near-dedup (the first by text), and before that they are judged together: the id
goes if any of its rows is rejected. Empty tables pass through empty; extra columns stay, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardspark.llm import decontam, encode, quality, similar, substring
from wardspark.llm.q10_encode import VOCABULARY, digests
from wardspark.llm.stage import staged, table


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less these ids: broadcast if they are counted to be few, else joined by a shuffle."""
    return docs.join(decontam.small(ids.select("doc_id").where("doc_id IS NOT NULL").distinct()), "doc_id", "left_anti").select(*_names(docs))


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = staged(quality.judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "kept"), "judged")
    return without(docs.where("doc_id IS NOT NULL"), judged.where("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, Jaccard 0.8 or more) the document with the smallest id stays."""
    near = staged(similar.near_duplicates(docs), "near")
    kept = without(docs, near.where("doc_id <> component_id"))
    repeated = staged(near.groupBy("doc_id").count().where("count > 1"), "repeated")
    if repeated.isEmpty():
        return kept
    ids = decontam.small(repeated.select("doc_id"))
    order = Window.partitionBy("doc_id").orderBy(F.col("text"), F.xxhash64(*_names(docs)))
    number = "_number_" + "_".join(docs.columns)  # a name that no column has
    once = kept.join(ids, "doc_id", "left_semi").withColumn(number, F.row_number().over(order)).where(F.col(f"`{number}`") == 1)
    return without(kept, repeated).unionByName(once.select(*_names(docs)))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; n_chars follows."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = substring.substring_dedup(docs, joined=False, keep=keep)
    values = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return cut.select(*[values[c].alias(c) if c in values else F.col("rest").getField(c).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    judged = staged(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated"), "contaminated")
    return without(docs, judged.where("contaminated"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of what they decode to, and the ids (unsigned 32 bits, little-endian)."""
    encoded = encode.encode_decode(docs, public_tokenizers.path(VOCABULARY))
    return digests(encoded, "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("bpe encoding and decoding", encode_texts),
]
#: Fingerprints, reachability and tokenizers cannot be had in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs
