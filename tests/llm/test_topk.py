import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspark.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def best(vectors, queries, k=5):
    """All scores in Python's integers, ids of queries once each."""
    whole = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    cand = [(i, whole(v)) for i, v in vectors if i is not None and good(v)]
    asked = {}
    for i, v in queries:
        if i is not None and good(v):
            asked[i] = min(asked.get(i, whole(v)), whole(v))
    out = []
    for q, v in asked.items():
        scores = sorted((-min(sum(a * b for a, b in zip(v, w)), topk.LONG), i) for i, w in cand if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def got(spark, vectors, queries, schema=SCHEMA, k=5):
    d = topk.top_inner(spark.createDataFrame(vectors, schema).repartition(3), spark.createDataFrame(queries, schema), k)
    assert d.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in d.collect())


def vectors(n=400, dim=24, seed=1, skew=0.5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) * np.exp(r.normal(size=(n, 1)) * skew) * np.exp(-np.arange(dim) * 0.15)
    return [(int(i), [float(np.float32(y)) for y in v]) for i, v in enumerate(x @ np.linalg.qr(r.normal(size=(dim, dim)))[0])]


def test_against_all_scores(spark):
    v = vectors()
    assert got(spark, v, v[::20]) == best(v, v[::20])


def test_ties_repeats_and_odd_vectors(spark):
    v = vectors(60, 5)
    v += [(100 + k, v[7][1]) for k in range(30)] + [(7, v[7][1])] * 2 + [(None, v[7][1]), (200, None), (201, [1.0, None]), (202, [float("nan")] * 5), (203, [float("inf"), 1.0]), (204, []), (205, [0.0] * 5), (206, [2.0]), (207, [0.5] * 9), (208, [-3.0e4] * 5)]
    asked = [x for x in v if x[0] is None or x[0] % 5 == 0 or x[0] > 199 or x[0] == 7] + [(999, [0.0]), (10, [9.0])]
    assert got(spark, v, asked) == best(v, asked)
    assert got(spark, v, asked, k=1) == best(v, asked, 1)


def test_large_numbers(spark):
    v = [(k, [1.0e9 + 7 * k, -3.0e5, float(k)]) for k in range(20)]
    assert got(spark, v, v[::4]) == best(v, v[::4])
    v = [(k, [1.0e6 + 7 * k, -3.0e5, float(k)]) for k in range(20)]  # beyond what double precision holds, within a long
    assert got(spark, v, v[::4]) == best(v, v[::4])


def test_few_and_none(spark):
    v = vectors(3, 4)
    assert got(spark, v, v) == best(v, v)
    assert got(spark, v[:1], v[:1]) == [] and got(spark, [], v) == [] and got(spark, v, []) == []


def test_clashing_columns(spark):
    v = vectors(50, 4)
    d = spark.createDataFrame(v, SCHEMA).select("*", *[F.lit("own").alias(c) for c in ("v", "length", "part", "query_id", "rank", "score", "least", "block", "k", "g", "dim")])
    assert sorted(tuple(r) for r in topk.top_inner(d, d.where("vec_id % 7 = 0")).collect()) == best(v, [x for x in v if x[0] % 7 == 0])


@pytest.mark.parametrize("tile", [7, 64])
def test_many_blocks_and_small_tiles(spark, monkeypatch, tile):
    """Queries in several blocks, few seeds, products of many partitions: the same hits."""
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8000)
    v = vectors(300, 16, seed=4)
    assert got(spark, v, v[::3]) == best(v, v[::3])
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "QUERIES", tile)
    b = block(v, v[::10])
    b.scan(*arrays(v))
    assert hits(b) == [(q, i, s) for q, _, i, s in best(v, v[::10])]


def arrays(v):
    return np.array([i for i, _ in v]), np.array([[math.floor(256 * x) for x in w] for _, w in v], np.int64)


def block(v, asked, rotate=True):
    ids, m = arrays(asked)
    _, all_ = arrays(v)
    turn = np.linalg.eigh(all_.T.astype(float) @ all_)[1][:, ::-1] if rotate else np.eye(m.shape[1])
    return topk.Block(ids, m, np.full(len(ids), -np.inf), turn, 5)


def hits(b):
    return sorted(((r["query_id"], r["vec_id"], r["score"]) for r in b.hits().to_pylist()), key=lambda x: (x[0], -x[2], x[1]))


def test_pruning_leaves_few_pairs(monkeypatch):
    """Where lengths and singular values fall, most pairs are never summed and few are scored; the rotation helps."""
    monkeypatch.setattr(topk, "TILE", 256)
    v = vectors(20_000, 32, seed=9, skew=0.8)
    asked = v[::50]
    turned, plain = block(v, asked), block(v, asked, rotate=False)
    ids, m = arrays(v)
    order = np.argsort(-(m**2).sum(1))
    for b in (turned, plain):
        b.scan(ids[order], m[order])
    pairs = len(v) * len(asked)
    assert turned.summed < 0.5 * pairs and turned.scored < 0.02 * pairs
    assert hits(turned) == hits(plain) == [(q, i, s) for q, _, i, s in sorted(dense(v, asked))]


def dense(v, asked):
    ids, m = arrays(v)
    for q, w in zip(*arrays(asked)):
        s = m @ w
        s[ids == q] = -(1 << 62)
        for n, x in enumerate(np.lexsort((ids, -s))[:5]):
            yield int(q), n + 1, int(ids[x]), int(s[x])


def test_rotation_is_that_of_the_singular_vectors(spark):
    v = vectors(500, 8)
    rows = spark.createDataFrame([(w,) for w in arrays(v)[1].tolist()], "v array<long>").repartition(40)
    turn, want = topk.rotation(rows, 8), np.linalg.svd(arrays(v)[1].astype(float))[2].T
    assert np.allclose(np.abs((turn * want).sum(0)), 1, atol=1e-6)
