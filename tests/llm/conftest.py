import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = ["words", "pos", "rest", "fp", "rep", "kept", "stratum", "n_words", "shard", "grp", "key", "ids", "bucket", "component_id", "term", "item", "_text", "_lines", "count", "contaminated", "n", "h", "good"]


def texts() -> list:
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage, other = some(30), some(60)
    long = some(20_000)
    return [
        None, "", " \n\t ", "one", passage, passage.upper(), some(40) + " " + passage + " " + some(7), some(12), some(13), other, other, other + " x",
        other.replace(" ", "\n", 5), "a " * 300, "a b c " * 50, "line one two\n" * 30, "#$%& " * 80, long, long[:5000] + " " + some(30), passage + passage,
        "Licensed under the Apache License, Version 2.0.\nmore", "mit license MIT-License general public license", "<|endoftext|> x<|im_end|>", "ΑΣ İstanbul 漢字 １２ \U0001f600", "x" * 3000,
        *[some(r.randint(1, 200)) for _ in range(20)], *[other + " " + some(3) for _ in range(6)],
    ]


@pytest.fixture(scope="session")
def rows():
    langs = ["en", None, "fr"]
    return [(k, t, langs[k % 3], f"s{k % 4}", None if t is None else len(t)) for k, t in enumerate(texts())]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark, rows):
    passage = rows[4][1]
    items = [(0, passage), (1, "a b c a b c a b c a b c a b c"), (2, None), (3, ""), (4, "mit license"), (5, rows[9][1]), (None, passage), (10, passage), (10, passage), (6, "one")]
    return spark.createDataFrame(items, "item_id long, text string")
