"""Job artifacts, predictions, citations, splits and variants on small tables."""

import json
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from wardspark.operators import augment, datasets, jobs, pipelines
from wardspark.sources import readers


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    find = lambda i, sev, path, line, **k: {"finding_id": i, "severity": sev, "location": {"filepath": path, "start_line": line}, **k}
    reports = {
        "j1": {"findings": [find("a", "error", "x.py", 9, rule={"rule_id": "B1", "category": "sql"}, evidence={"excerpt": "k = ghp_" + "a" * 36}), find("b", "CRITICAL", "x.py", 20), find("c", "?", "", None), *[find(f"m{k:02}", "low", "many.py", 99 - k) for k in range(25)]]},
        "j2": {}, "j3": [1], "j 4": {"findings": [find("z", None, "y.py", 1, evidence={"excerpt": "w " * 300})]},
    }
    for job, r in reports.items():
        (root / job).mkdir()
        (root / job / "unified_report.json").write_text(json.dumps(r, indent=1))
    (root / "j1" / "patch_summary.json").write_text(json.dumps({"summary": {"total": 3, "validated": 2}, "findings": [{"finding_id": "a", "status": "validated"}], "run_id": "r1"}))
    (root / "j2" / "patch_summary.json").write_text("{broken")
    (root / "j1" / "final.diff").write_text("\n".join(f"+{k}" for k in range(500)))
    (root / "j 4" / "final.diff").write_text("+a\n+b\n")
    return jobs.artifacts(spark, str(root)).cache()


def test_reports_of_files(files):
    r = jobs.unified_reports(files)
    counts = {x.job_id: (x.critical, x.high, x.medium, x.low, x.info, x.total) for x in jobs.report_counts(r).collect()}
    assert counts == {"j1": (1, 1, 0, 25, 1, 28), "j2": (0,) * 6, "j 4": (0, 0, 0, 0, 1, 1)}
    assert {x.job_id: x.total for x in jobs.report_counts(r, "high").collect()}["j1"] == 2
    by = {(x.job_id, x.filepath): x for x in jobs.report_files(r).collect()}
    assert set(by) == {("j1", "x.py"), ("j1", "unknown"), ("j1", "many.py"), ("j 4", "y.py")}
    x = by["j1", "x.py"]
    assert x.severity_counts == {"critical": 1, "high": 1} and x.category_counts == {"sql": 1, "unknown": 1} and x.rule_counts == {"B1": 1, "unknown": 1}
    assert [(f.finding_id, f.severity) for f in x.findings] == [("b", "critical"), ("a", "high")] and x.findings[1].excerpt == "k = [REDACTED]"
    assert [f.start_line for f in by["j1", "many.py"].findings] == list(range(75, 95)) and by["j1", "many.py"].severity_counts == {"low": 25}
    assert by["j 4", "y.py"].findings[0].excerpt == ("w " * 190).rstrip() + "...(truncated)"


def test_patches_of_jobs(spark, files):
    j = spark.createDataFrame([("j1", "r", "c", "completed"), ("j2", None, None, "failed"), ("j9", "r", "c", "queued")], "job_id string, repo string, commit string, status string")
    o = spark.createDataFrame([("j1", str(k), "accepted" if k % 2 else "rejected", k if k < 9 else None) for k in range(10)], "job_id string, id string, action string, ts int")
    d = jobs.patch_details(j, jobs.patch_summaries(files), jobs.final_diffs(files), o, 4).collect()
    assert [x.job_id for x in d] == ["j1"] and [x.id for x in d[0].outcomes] == ["8", "7", "6", "5"] and d[0].summary.validated == 2 and d[0].findings[0].status == "validated"
    assert d[0].diff.endswith("\n+399\n... (truncated)") and d[0].diff.count("\n") == 400
    assert {x.job_id: x.diff for x in jobs.final_diffs(files).collect()}["j 4"] == "+a\n+b\n"


def test_findings_of_a_file(spark):
    texts = ['{"findings": [{"a": 1}, {"a": [2]}]}', '[{"b": 1}]', '{"other": []}', "3", "", None, "{x"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", jobs.loaded_findings(F.col("t")).alias("f"))
    assert [r.f for r in d.orderBy("k").collect()] == [['{"a":1}', '{"a":[2]}'], ['{"b":1}'], [], [], [], [], []]


def test_npm_audit_and_rulesets(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"vulnerabilities": {"lodash": {"name": "lodash", "severity": "HIGH", "range": "<4.17.21", "isDirect": True}, "x": {"severity": "low"}}}))
    (tmp_path / "b.json").write_text("{}")
    assert sorted(map(tuple, readers.npm_audit(spark, str(tmp_path)).collect()), key=str) == [("lodash", "high", "<4.17.21", True), ("x", "low", None, False)]
    d = spark.createDataFrame([("r", "a.py"), ("r", "b.tsx"), ("s", "c.md")], "repo string, path string")
    got = {r.repo: r.rulesets for r in readers.rulesets_for(d, ["repo"]).collect()}
    assert got["s"] == sorted(readers.RULESETS) and set(got["r"]) == {*readers.RULESETS, "p/python", "p/django", "p/flask", "p/typescript", "p/react", "p/nextjs"}


def test_predictions(spark):
    rows = [(0, None, None, None, None, None, None), (1, 0.5, ["a"], None, None, None, None), (2, 0.9, ["a", "b", "c"], 0.95, 0.1, None, None), (3, None, [], None, 0.2, 0.4, 1.7), (4, 0.4, None, None, 0.8, 0.1, None), (5, None, ["x"] * 9, None, None, 0.3, 0.9)]
    d = spark.createDataFrame(rows, "k int, consensus_score double, scanner_sources array<string>, binary_score double, transformer_score double, gnn_score double, weighted_score double")
    got = {r.k: (round(r.ml_risk_score, 6), r.ml_risk_label, round(r.ml_confidence, 6), r.ml_model_source) for r in pipelines.with_predictions(d).collect()}
    assert got == {
        0: (0.5, "MEDIUM_RISK", 0.5, "fallback"), 1: (0.5, "MEDIUM_RISK", 0.55, "consensus"), 2: (1.0, "HIGH_RISK", 0.71, "binary_classifier+consensus"),
        3: (1.0, "HIGH_RISK", 0.5, "ensemble"), 4: (0.64, "MEDIUM_RISK", 0.68, "transformer+consensus"), 5: (0.36, "LOW_RISK", 0.7, "gnn"),
    }


def test_citation_queries(spark):
    d = spark.createDataFrame([("sql_injection:raw", "cursor.EXECUTE(md5(password))"), (None, None), ("x", "eval(pickle)")], "c string, s string")
    assert [r[0] for r in d.select(pipelines.citation_query(F.col("c"), F.col("s"))).collect()] == ["sql injection raw SQL injection parameterized query weak hash MD5 SHA1 SHA256 fix secure pattern", " fix secure pattern", "x code injection eval exec pickle deserialization RCE fix secure pattern"]


def test_numbers_are_those_of_one_sort(spark):
    d = spark.range(3000).select("id", (F.col("id") % 3).alias("y")).where("y > 0 OR id < 300").withColumn("y", F.when(F.col("y") == 2, None).otherwise(F.col("y")))
    got = datasets.numbered(d, ["y"], "id").collect()
    for y in (0, 1, None):
        rows = sorted((sha256(f"42:{r.id}".encode()).hexdigest(), r.id, r._k, r._n) for r in got if r.y == y)
        assert [r[2] for r in rows] == list(range(1, len(rows) + 1)) and {r[3] for r in rows} == {len(rows)}
    assert len(got) == d.count() and datasets.numbered(d.limit(0), ["y"], "id").count() == 0


def test_balanced_categories(spark):
    rows = [(k, 1, "few" if k < 3 else "many" if k < 60 else None) for k in range(62)] + [(100 + k, 0, "x") for k in range(500)]
    d = spark.createDataFrame(rows, "id long, y int, c string")
    g = datasets.balance_categories(d, "id", F.col("y") == 1, "c", 5, 10, 2).collect()
    n = lambda c: sum(r.c == c for r in g if r.y == 1)
    assert (n("few"), n("many"), n(None), sum(r.y == 0 for r in g)) == (5, 10, 5, 40) and {r.id for r in g if r.c == "few"} == {0, 1, 2}
    assert datasets.balance_categories(d, "id", F.col("y") == 1, "c").count() == 562
    assert datasets.balance_categories(d.where("y = 0"), "id", F.col("y") == 1, "c", 5, 10).count() == 500


def test_scaled_splits_and_overlap(spark):
    d = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 10).cast("string").alias("g"))
    s = {r.split: r["count"] for r in datasets.ood_split_of(d, "id", "g", 0.7, 0.15, 0.05).groupBy("split").count().collect()}
    assert s == {"ood_test": 100, "train": int(900 * 0.7 / 0.95), "val": int(900 * 0.15 / 0.95), "test": 900 - int(900 * 0.7 / 0.95) - int(900 * 0.15 / 0.95)}
    o = datasets.with_overlap(d, "id", 25, 0.1).collect()  # 2.5 to even
    twice = [r for r in o if r.duplicate_group]
    assert len(o) == 1002 and len({r.id for r in twice}) == 2 and {r.copy for r in twice} == {0, 1}
    assert twice[0].duplicate_group == sha256(f"{twice[0].id}|42|overlap".encode()).hexdigest()[:12]
    assert datasets.with_overlap(d, "id", 25, 0.0).count() == 1000


def test_three_variants(spark):
    codes = ["data = user_data + my_data # data\n  x  =  1  \n\n", "a // b\n/* c\nd */ e", "plain", "", None, "payload", "s = '#'\n\t\n"]

    def want(code):
        n = [0]

        def number(_):
            n[0] += 1
            return f"var_{n[0]}"

        bare = re.sub(r"/\*.*?\*/", "", re.sub(r"//.*$", "", re.sub(r"#.*$", "", code, flags=re.M), flags=re.M), flags=re.S)
        even = "\n".join(x for x in (re.sub(r"  +", " ", row.rstrip()) for row in code.split("\n")) if x)
        made = {"var_rename": re.sub(r"\b(user_input|user_data|user_id|data|payload|content)\b", number, code), "no_comments": bare, "whitespace_norm": even}
        return {k: v for k, v in made.items() if v != code}

    d = spark.createDataFrame([(str(k), c, "f", 7) for k, c in enumerate(codes)], "sample_id string, code_snippet string, filepath string, more int").withColumn("k", F.col("sample_id"))
    got = {}
    for r in augment.three_variants(d).collect():
        got.setdefault(r.k, {})[r.augmentation] = r.code_snippet
        assert r.more == 7 and r.sample_id == sha256(f"f:{r.code_snippet}".encode()).hexdigest()
    assert got == {str(k): want(c) for k, c in enumerate(codes) if c is not None and want(c)}


def test_texts_of_jobs_are_not_broadcast(spark):
    """Diffs and summaries are long, whatever Spark guesses of them."""
    from wardspark.plans import job_queries

    plan = job_queries.job_patch_details(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan


def test_lines_of_reports_are_gathered_by_numbers(spark):
    """What a line says is longer than its numbers, so it is not sent."""
    from wardspark.plans import job_queries

    plan = job_queries.job_report_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    gathered = [x for x in plan.splitlines() if "collect_list" in x]
    assert gathered and not any("repeat(" in x or "excerpt" in x.split("collect_list")[1].split("AS")[0] for x in gathered)


def test_reports_are_read_once(spark, files):
    """Counts and shown findings come from one reading of the reports."""
    plan = jobs.report_files(jobs.unified_reports(files))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "parse_json" not in plan
    odd = ["{broken", "[]", "[{}]", "3", "", None, " {}", '{"findings": null}', '{"findings": [{"severity": 1}]}', '{"a": 1, "a": 2}']
    d = spark.createDataFrame([(str(k), "unified_report.json", t) for k, t in enumerate(odd)], "job_id string, name string, text string")
    assert sorted((r.job_id, len(r.findings)) for r in jobs.unified_reports(d).collect()) == [("6", 0), ("7", 0), ("8", 1)]
