"""Temperature, label sets and schema versions on small tables."""

import datetime as dt
import math
import random

import pytest

from wardspark.operators import calibration, metrics
from wardspark.sources import versions
from wardspark.sources.versions import Version


def best(rows):
    """By bisection over the derivative, in Python."""
    lo, hi = 1e-3, 1e3
    slope = lambda b: sum(x * (1 / (1 + math.exp(-max(min(x * b, 700), -700))) - y) for x, y in rows)
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if slope(mid) < 0 else (lo, mid)
    return 1 / lo


def fit(spark, rows):
    return calibration.fit_temperature(spark.createDataFrame(rows, "x double, y int"), "x", "y")


@pytest.mark.parametrize("true", [0.3, 1.0, 4.0])
def test_temperature_is_the_minimum(spark, true):
    r = random.Random(2)
    xs = [r.gauss(0, 3) for _ in range(600)]
    rows = [(x, int(r.random() < 1 / (1 + math.exp(-x / true)))) for x in xs]
    f = fit(spark, [*rows, (None, 1), (1.0, None), (2.0, -1), (float("nan"), 1), (float("inf"), 0)])
    assert abs(f.temperature - best(rows)) < 1e-6 * true and f.rows == 600 and f.rounds < 40
    mean = lambda t: sum(math.log1p(math.exp(-abs(x / t))) + max(x / t, 0) - x / t * y for x, y in rows) / len(rows)
    assert abs(f.loss - mean(f.temperature)) < 1e-9 and f.loss <= min(mean(f.temperature * k) for k in (0.9, 0.99, 1.01, 1.1))


def test_temperature_at_its_ends(spark):
    assert fit(spark, [(0.1, 0), (1.2, 1), (-0.7, 0), (0.3, 1)]).temperature > 0
    assert fit(spark, [(1.0, 1), (-1.0, 0)]).temperature == pytest.approx(1e-3)
    assert fit(spark, [(1.0, 0), (-1.0, 1)]).temperature == pytest.approx(1e3)
    assert fit(spark, [(0.0, 1)]).temperature > 0 and fit(spark, [(None, 1)]) == (1.0, None, 0, 0)
    huge = fit(spark, [(1e4, 1), (-1e4, 0), (5e3, 0), (-5e3, 1)])
    assert 1e-3 <= huge.temperature <= 1e3 and math.isfinite(huge.loss)


def test_label_sets(spark):
    classes = ["a", "b", "c", "none"]
    rows = [(["a", "b"], ["a"]), (["a"], ["a", "c", "zz"]), ([], []), (None, ["b"]), (["c", "c", None], None), (["zz"], ["c", "c"])]
    d = spark.createDataFrame(rows, "y array<string>, p array<string>")
    got = {r["class"]: (r.tp, r.fp, r.fn) for r in metrics.label_counts(d, "y", "p", classes).collect()}
    assert got == {"a": (2, 0, 0), "b": (0, 1, 1), "c": (0, 2, 1), "none": (0, 0, 0)}
    c = metrics.label_counts(d, "y", "p", classes)
    s = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in metrics.label_scores(c).collect()}
    assert s["a"] == (1, 1, 1, 2) and s["none"] == (0, 0, 0, 0) and s["c"] == (0, 0, 0, 1)
    assert tuple(metrics.label_averages(c).first()) == (0.25, 4 / 9)
    nothing = metrics.label_counts(d.limit(0), "y", "p", classes)
    assert tuple(metrics.label_averages(nothing).first()) == (0, 0) and metrics.label_counts(d, "y", "p", []).count() == 0


def test_label_sets_from_scores(spark):
    d = spark.createDataFrame([([0.5, 0.49, None, 1.0],), ([],), (None,)], "s array<double>")
    assert [r[0] for r in d.select(metrics.label_set(d.s, ["a", "b", "c", "d"])).collect()] == [["a", "d"], [], None]


V = [
    Version("id int, score float, day date"),
    Version("id bigint, score double, day date, repo string", {"repo": "concat('repo-', id)"}),
    Version("id bigint, points double, day timestamp_ntz, repo string, ok boolean", {"ok": "score > 0.5"}, {"score": "points"}),
]


def test_three_versions_are_one_table(spark, tmp_path):
    path, day = str(tmp_path / "t"), dt.date(2024, 5, 1)
    versions.write(spark.createDataFrame([(1, 0.25, day), (2, 0.75, None)], V[0].columns), path, V, 1)
    versions.write(spark.createDataFrame([(3, 0.9, day, "r"), (2**40, None, day, None)], V[1].columns), path, V, 2)
    versions.write(spark.createDataFrame([(5, 0.1, dt.datetime(2024, 1, 2, 3), "s", None)], V[2].columns), path, V)
    d, noon = versions.read(spark, path, V), dt.datetime(2024, 5, 1)
    assert sorted(map(tuple, d.collect())) == [(1, 0.25, noon, "repo-1", False), (2, 0.75, None, "repo-2", True), (3, 0.9, noon, "r", True), (5, 0.1, dt.datetime(2024, 1, 2, 3), "s", None), (2**40, None, noon, None, None)]
    assert [f.simpleString() for f in d.schema] == ["id:bigint", "points:double", "day:timestamp_ntz", "repo:string", "ok:boolean"]
    plan = d.where("id = 3").select("points")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(id), EqualTo(id,3") == 3 and "day" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert versions.read(spark, path, [*V[:2], Version("id bigint, score double, day date, repo string, ok boolean")]).columns[-1] == "ok"


def test_versions_refuse_what_loses(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read(spark, path, V).count() == 0
    versions.write(spark.createDataFrame([(1, 0.5, None)], V[0].columns), path, V, 1)
    with pytest.raises(ValueError, match="does not fit"):
        versions.read(spark, path, [V[0], Version("id smallint, score float, day date")])
    versions.write(spark.createDataFrame([(1, 0.5, None, "r")], V[1].columns), path, V, 2)
    with pytest.raises(ValueError, match="version 2"):
        versions.read(spark, path, V[:1])
    assert versions.fits("decimal(10,2)", "decimal(12,3)") and not versions.fits("decimal(10,2)", "decimal(10,3)") and not versions.fits("bigint", "int")
