"""Kept scanner results and layouts for lookups: what is written, what is read."""

import json
import os

import pytest
from pyspark.sql import functions as F

from wardspark.sources import cache, lookup

FILES = "repo string, path string, text string"


def files(spark, **changed):
    texts = {"a/x": {"m.py": "eval(1)\nok", "n.py": "ok"}, "b": {"m.py": "eval(2)"}, "7": {"m.py": None, "é b.py": "eval(3)\neval(4)"}, "none": {"q.py": "fine"}} | changed
    return spark.createDataFrame([(r, p, t) for r, fs in texts.items() for p, t in fs.items()] + [(None, "p", "eval(9)")], FILES).repartition(3)


def scan(files):
    rows = files.select("repo", "path", F.posexplode(F.split("text", "\n")).alias("line", "code"))
    return rows.where("code LIKE '%eval%'").select("repo", "path", (F.col("line") + 1).alias("line"))


def stamps(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs}


def found(spark, path, repos=None):
    return sorted(tuple(r) for r in cache.findings(spark, path, repos).select("repo", "path", "line").collect())


def test_only_what_changed_is_scanned(spark, tmp_path):
    path, seen = str(tmp_path / "scans"), []
    settings = {"bandit": {"version": "1.2.3", "args": ["-q"]}}

    def watched(d):
        seen.append(sorted(r.repo for r in d.select("repo").distinct().collect()))
        return scan(d)

    run = lambda settings=settings, **k: cache.refresh(path, files(spark, **k), watched, settings)
    assert run() == {"scanned": 4, "reused": 0, "gone": 0}
    first, all_ = stamps(path), [("7", "é b.py", 1), ("7", "é b.py", 2), ("a/x", "m.py", 1), ("b", "m.py", 1)]
    assert found(spark, path) == all_ and found(spark, path, ["b", "none"]) == [("b", "m.py", 1)]
    assert run() == {"scanned": 0, "reused": 4, "gone": 0} and stamps(path) == first
    assert run(b={"m.py": "ok"}) == {"scanned": 1, "reused": 3, "gone": 0}
    assert found(spark, path) == all_[:3] and {p: t for p, t in stamps(path).items() if p in first and "findings" in p and not os.path.basename(p).startswith((".", "_"))} == {p: t for p, t in first.items() if "findings" in p and not os.path.basename(p).startswith((".", "_"))}
    assert run(b={"m.py": "ok"}) == {"scanned": 0, "reused": 4, "gone": 0}
    assert run(b={}) == {"scanned": 0, "reused": 3, "gone": 1}
    new = {"bandit": {"version": "1.3.0", "args": ["-q"]}}
    assert run(new)["scanned"] == 4 and found(spark, path) == all_
    assert {r.settings for r in cache.manifest(spark, path).collect()} == {json.dumps(new, sort_keys=True)}
    assert seen == [["7", "a/x", "b", "none"], ["b"], ["7", "a/x", "b", "none"]]
    assert cache.vacuum(spark, path) == 3 and found(spark, path) == all_ and cache.vacuum(spark, path) == 0


def test_a_refresh_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "scans")
    cache.refresh(path, files(spark), scan, {})
    before = found(spark, path)
    with monkeypatch.context() as m:
        m.setattr(cache, "_next", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            cache.refresh(path, files(spark, b={"m.py": "eval(1)\neval(2)"}), scan, {})
    assert found(spark, path) == before
    assert cache.refresh(path, files(spark, b={"m.py": "eval(1)\neval(2)"}), scan, {})["scanned"] == 1
    assert len(found(spark, path)) == len(before) + 1


def test_contents_tell_files_apart(spark):
    one = lambda **k: {r.repo: r.content for r in cache.contents(files(spark, **k), {}).where("repo IS NOT NULL").collect()}
    base = one()
    assert base == one()
    for change in ({"m.py": "eval(2) "}, {"m.p": "yeval(2)"}, {"m.py": None}, {"m.py": ""}, {"m.py": "eval(2)", "z": ""}, {"n.py": "eval(2)"}):
        assert one(b=change)["b"] not in base.values() and one(b=change)["a/x"] == base["a/x"]


def test_nothing_to_scan(spark, tmp_path):
    path = str(tmp_path / "scans")
    assert cache.refresh(path, spark.createDataFrame([], FILES), scan, {}) == {"scanned": 0, "reused": 0, "gone": 0}
    cache.refresh(path, files(spark).where("repo = 'none'"), scan, {})
    assert found(spark, path) == []


def test_versions(spark):
    said = ["bandit 1.2.3\n", "semgrep\n1.88.0", "none here", None, "10.20.30.40"]
    d = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string").select("k", cache.version_of(F.col("s")).alias("v"))
    assert [r.v for r in d.orderBy("k").collect()] == ["1.2.3", "1.88.0", "unknown", "unknown", "10.20.30"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(200_000).select(F.sha1(F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("n"), "id")


def test_lookup_reads_few_row_groups(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup, "GROUP_BYTES", 64 << 10)
    d = rows.toDF("key", "n", "id")
    t = lookup.by_range(d, str(tmp_path / "jobs"), "key")
    key = d.where("id = 4711").first().key
    q = lookup.get(t, "key", key)
    assert [r.id for r in q.collect()] == [4711]
    assert f"EqualTo(key,{key})" in q._jdf.queryExecution().toString().split("PushedFilters")[1]
    assert 0 < lookup.scanned(q) < 20_000
    none = lookup.get(t, "key", "f" * 40)
    assert none.collect() == [] and lookup.scanned(none) < 20_000
    many = [r.key for r in d.where("id % 9000 = 0").collect()]
    assert sorted(r.id for r in lookup.get(t, "key", *many).collect()) == list(range(0, 200_000, 9000))
    assert lookup.get(t, "key").count() == 0


def test_shared_key_is_spread_over_files(spark, rows, tmp_path):
    t = lookup.by_range(rows.toDF("key", "n", "id"), str(tmp_path / "n"), "n")
    assert lookup.get(t, "n", 0).count() == 66_667
    assert lookup.get(t, "n", 0).select(F.input_file_name()).distinct().count() > 1


def test_buckets_are_pruned_and_joined_in_place(spark, rows):
    t = lookup.by_bucket(rows.toDF("key", "n", "id"), "key", 16)
    key = rows.toDF("key", "n", "id").where("id = 5").first().key
    q = lookup.get(t, "key", key)
    assert [r.id for r in q.collect()] == [5] and lookup.scanned(q) < 200_000 / 8
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else a plan that needs no buckets doesn't show them
    try:
        assert "SelectedBucketsCount: 1 out of 16" in lookup.get(t, "key", key)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    keys = t.select("key").where("id < 1000")
    assert lookup.get_all(t, "key", keys).count() == 1000
    big = t.join(keys.select("key").distinct().hint("merge"), "key", "left_semi")
    assert big._jdf.queryExecution().toString().count("Exchange hashpartitioning(key") == 0 and big.count() == 1000
