"""Queries over whole vectors and texts against brute force."""

import math

import numpy as np

from wardspark.plans import dataset_queries, event_queries


def test_whole_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.1, (30, 64))
    x[7, 63] = 9.0  # far out in the last dimension only
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.i, r.j): r.cov for r in dataset_queries.mean_cov(spark, str(tmp_path)).collect()}
    cov = np.cov(x.T) + 1e-3 * np.eye(64)
    assert len(got) == 4096 and all(abs(c - cov[k]) < 2e-5 for k, c in got.items())
    p = np.abs(x) / np.abs(x).sum(axis=1, keepdims=True)
    entropy = -(p * np.log(p + 1e-8)).sum(axis=1)
    far = np.sqrt((x * x).sum(axis=1)) > 0.45 * math.sqrt(8)
    rows = {r.vec_id: r for r in dataset_queries.ood_reasons(spark, str(tmp_path)).collect()}
    assert all(abs(rows[k].entropy - entropy[k]) < 1e-5 for k in range(30))
    assert {k: r.reason for k, r in rows.items()} == {k: "embedding_distance" if far[k] else "entropy" if entropy[k] > 1.7 + math.log(8) else None for k in range(30)}
    assert rows[7].reason == "embedding_distance"


def test_whole_lines(spark, tmp_path):
    long = "word " * 50
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", long), (1, 2, "assistant", "b")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = event_queries.job_fold(spark, str(tmp_path)).first()
    assert (r.status, r.lines, r.last_line) == ("assistant", 2, long)
