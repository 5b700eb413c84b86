"""The pipeline on a small fixture, stage by stage against brute force, and as a whole."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import CLASHING
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_text_operators import contamination, counted, deduped
from wardspark.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, docs, benchmark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def brute(rows, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect() if r.item_id is not None]
    rows = [r for r in rows if (n := counted(r[1]))[0] >= 50 and 100 * n[4] <= 50 * n[0]]
    yield {r[0]: r[1] for r in rows}
    name = near([r[:2] for r in rows])
    rows = [r for r in rows if name[r[0]] == r[0]]
    yield {r[0]: r[1] for r in rows}
    cut = deduped(rows)
    rows = [(r[0], cut[r[0]][2]) for r in rows]
    yield dict(rows)
    hit = contamination(rows, items)
    rows = [r for r in rows if not (hit[r[0]][1] and 20 * hit[r[0]][1] >= hit[r[0]][0])]
    yield dict(rows)


def test_stages(spark, docs, rows, benchmark, folder):
    d = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], brute(rows, benchmark), strict=True):
        out = stage(spark, d, folder)
        assert (out.columns, out.dtypes) == (d.columns, d.dtypes), name
        got = {r.doc_id: r for r in out.collect()}
        joined = (lambda t: " ".join(t.split())) if name in ("substring dedup", "benchmark decontamination") else (lambda t: t)  # cuts leave the white space of what is kept
        assert {i: joined(r.text) for i, r in got.items()} == {i: joined(t) for i, t in want.items()}, name
        assert all(r.kept == "own kept" and r.n_chars == len(r.text) for r in got.values())
        d = spark.createDataFrame(list(got.values()), out.schema)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in d.collect()}
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, d, folder).collect()}
    assert {i: bytes(r.ids) for i, r in got.items()} == {i: bpe.packed(lib.encode(t, add_special_tokens=False).ids) for i, t in text.items()}


def test_run(spark, rows, benchmark, folder):
    *_, want = brute(rows, benchmark)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))  # which drops white space
    ids = {i: bpe.packed(lib.encode(t, add_special_tokens=False).ids) for i, t in want.items()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in got} == {i: (len(x) // 4, hashlib.sha256(x).hexdigest()) for i, x in ids.items()}


def test_stages_of_nothing(spark, empty, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_repeated_ids_and_nulls(spark, rows, folder):
    long = next(t for _, t, *_ in rows if t and len(t.split()) > 100 and len(set(t.split())) > 80)
    d = spark.createDataFrame([(1, long, "en", None, None), (1, long, "en", None, None), (None, long, None, None, None), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.quality_rules(spark, d, folder).count() == 2
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, d.where("doc_id = 1"), folder).collect()] == [1]
