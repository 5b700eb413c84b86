"""The registered queries on the driver's tables: against their SQL, or against libraries and brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.compare import connection, same
from tests.llm.test_text_operators import components
from wardspark.llm import bpe, registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall())


def test_one_query_for_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE[name]).df())


def test_shards(spark, texts):
    """Sizes, checksums, the law of equal counts, gapless slots; equal texts are together, as far as a brute-force count says."""
    got = QUERIES["op5_sharding"](spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(texts)
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "rows")
    counts = got.groupby("shard").size().reindex(range(24), fill_value=0)
    assert counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    groups = got.assign(text=got.doc_id.map(texts)).groupby("text")
    links, cut = sum(len(g) - 1 for _, g in groups), sum(g.shard.nunique() - 1 for _, g in groups)
    assert links > 0 and cut <= 0.25 * links


def test_token_files(spark, texts):
    lib, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in QUERIES["op6_token_files"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(bpe.packed(ids))), i
        start += len(ids)


def test_token_counts(spark, texts):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op7_token_counts"](spark, SF).collect()}
    n = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert got == {i: (len(t.encode()), n[i], n[i] > 1024) for i, t in texts.items()}


def test_fingerprints_and_components(spark, texts):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op9_simhash"](spark, SF).collect()}
    assert got == components(list(texts.items()))


def test_encoding(spark, texts):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_encode_decode"](spark, SF).collect()}
    want = {}
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode())
    assert got == want
