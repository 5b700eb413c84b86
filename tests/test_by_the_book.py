"""Cases for verdicts, ingest, policies, redaction, patches and the steps made of them."""

import json
import random
import time

import numpy as np
from pyspark.sql import functions as F

from wardspark.operators import datasets, findings, ingest, patches, pipelines, policies, redaction, retrieval, spans, verdicts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


GROUP = "code string, scanners array<string>, rules array<string>, categories array<string>, severity_rank int, confidence_rank int, trusted long, trusted_category string"


def test_verdicts_by_ladder_and_by_council(spark):
    cases = [
        ("x = 1 # NOSEC", ["a", "b"], ["R"], ["c"], 3, 3, 1, "s"),
        ("OS.SYSTEM (c)", ["a"], [], [], 0, 0, 0, None),
        ("plain", ["secrets"], [], [], 1, 1, 1, "s"),
        ("plain", ["a", "b"], [], [], 2, 1, 0, None),
        ("plain", ["a"], [], [], 2, 2, 0, None),
        ("plain", ["a"], [], [], 1, 1, 0, None),
        (None, ["a"], ["other"], ["x:y"], 3, 1, 0, None),
    ]
    d = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, " + GROUP)
    got = {r.k: (r.label, r.detected) for r in verdicts.gold_label(d, ["none"], ["none"]).collect()}
    assert got == {0: (0, None), 1: (1, "command_injection"), 2: (1, "s"), 3: (1, None), 4: (1, None), 5: (0, None), 6: (0, None)}
    got = {r.k: (r.label, r.detected) for r in verdicts.gold_label(d.where("k = 6")).collect()}
    assert got == {6: (1, "other")}  # an empty list holds everything
    got = {r.k: (r.label, r.true_votes, r.false_votes) for r in verdicts.council_label(d, ["none"], ["none"]).collect()}
    assert got == {0: (1, 4, 2), 1: (1, 2, 1), 2: (1, 2, 1), 3: (None, 1, 0), 4: (None, 0, 0), 5: (None, 0, 1), 6: (None, 0, 0)}


def test_rule_tables(spark):
    d = spark.createDataFrame([("B602", "x"), ("r", "uses SHA1"), ("r", "sha1 here"), ("B999", ""), (None, None)], "rule string, message string")
    c = verdicts.infer_category(F.col("rule"), F.col("message"))
    got = [tuple(r) for r in d.select(c, verdicts.infer_fix(F.col("rule"), F.col("message"), F.lit("path.traversal"))).collect()]
    assert got == [("injection.command", "use_subprocess_list"), ("crypto.weak_algorithm", "upgrade_algorithm"), ("misc.other", "canonicalize_path"), ("misc.other", "unknown"), ("misc.other", "canonicalize_path")]


def test_scanners_come_in_alike(spark):
    b = spark.createDataFrame([("a.py", 3, [3, 4, 6], "B1", "n", "HIGH", "LOW", "t")], "filename string, line_number int, line_range array<int>, test_id string, test_name string, issue_severity string, issue_confidence string, issue_text string")
    shape = "check_id string, path string, start struct<line:int>, end struct<line:int>, extra struct<message:string,severity:string,lines:string>"
    s = spark.createDataFrame([("js.x", "b.js", (2,), (5,), ("m", "ERROR", "code")), (None, "b.js", (2,), None, None)], shape)
    got = {(r.scanner, r.line_start, r.line_end, r.category, r.severity, r.confidence, r.message) for r in ingest.from_scanners(b, s, s, s, s).collect()}
    assert ("bandit", 3, 6, "B1:n", "HIGH", "LOW", "t") in got and ("semgrep", 2, 5, "js.x", "HIGH", "HIGH", "m") in got
    assert ("semgrep", 2, 2, "unknown", "MEDIUM", "MEDIUM", "") in got and ("secrets", 2, 2, "secrets.hardcoded", "HIGH", "HIGH", "Secret detected") in got
    assert ("patterns", 2, 5, "js.x", "ERROR", "MEDIUM", "m") in got and ("dependencies", 2, 2, "dependency.vuln", "HIGH", "HIGH", "") in got


def test_patch_inputs_need_a_place(spark):
    f = [("1", "a", 3, 0), ("2", "", 3, 4), ("", "a", 3, 4), ("3", "a", 0, 4), ("4", "a", 3, None)]
    d = spark.createDataFrame(f, "finding_id string, filepath string, start_line int, end_line int")
    assert rows(ingest.patch_inputs(d).select("finding_id", "end_line")) == [("1", 3), ("4", 3)]


def test_merging_takes_two_scanners_only(spark):
    f = [("a", 1, 9, "T1", "patterns", "high", 0.6, 1), ("a", 3, 3, "m", "ml", "high", 0.8, 2), ("b", 3, 3, "m", "ml", "high", None, 3), ("b", 3, 3, "T", "bandit", "low", None, 4)]
    d = spark.createDataFrame(f, "filepath string, start_line int, end_line int, rule_id string, source string, severity string, confidence double, ordinal long")
    m = findings.merge(d)
    assert {(r.filepath, r.rule_id, r.source) for r in m.collect()} == {("a", "T1", "patterns"), ("a", "m", "ml"), ("b", "T", "hybrid")}
    assert [r.ordinal for r in m.orderBy(*findings.report_order()).collect()] == [1, 2, 4]


def test_greedy_merge_against_a_plain_loop(spark):
    r = np.random.default_rng(1)
    f = [(f"f{r.integers(3)}", int(a := r.integers(1, 40)), int(a + r.integers(0, 9)), f"R{r.integers(4)}", str(r.choice(["bandit", "semgrep", "patterns", "ml"])), "low", float(r.random()), k) for k in range(300)]
    d = spark.createDataFrame(f, "filepath string, start_line int, end_line int, rule_id string, source string, severity string, confidence double, ordinal long")
    tools = {}
    for x in f:
        if x[4] != "ml":
            tools[(x[4], x[3], x[0], x[1], x[2])] = x
    have, want = list(tools.values()), []
    for x in f:
        if x[4] == "ml":
            fit = [t for t in have if t[4] in ("bandit", "semgrep") and t[0] == x[0] and t[1] <= x[2] and x[1] <= t[2]]
            if fit:
                t = min(fit, key=lambda t: (t[2] - t[1], t[1], t[3]))
                have.remove(t)
                want.append((t[7], x[7], max(t[6], x[6])))
            else:
                want.append((x[7], None, x[6]))
    want += [(t[7], None, t[6]) for t in have]
    assert sorted((r.ordinal, r.merged_ordinal, r.confidence) for r in findings.merge(d).collect() if r.merged_ordinal is not None) == sorted(w for w in want if w[1] is not None)
    assert sorted(r.ordinal for r in findings.merge(d).collect()) == sorted(w[0] for w in want)


def test_policies(spark):
    good = {"version": 1, "tools": [{"name": "fs.read", "allowed": True, "scopes": ["read"], "arg_constraints": {"type": "object", "properties": {"path": {"type": "string"}}, "required": ["path"], "additionalProperties": False}}]}
    assert policies.errors(good) == [] and policies.errors([]) == ["policy not an object"] and policies.errors({"version": 2}) == ["version must be 1", "tools must be an array"]
    assert policies.errors({"version": 1, "tools": [{"allowed": 1, "scopes": [], "arg_constraints": {"type": "x"}}]}) == ["tool missing name", "tool None allowed must be boolean", "tool None scopes must be non-empty array", "tool None arg_constraints.type must be object"]
    assert policies.override_errors({"tools": [{"odd": 1}, 3]}) == ["policy_overrides.tools entry missing name", "policy_overrides.tools.odd not allowed", "policy_overrides.tools entries must be object"]
    assert policies.override_errors({}) == [] and policies.override_errors({"tools": 1}) == ["policy_overrides.tools must be list"]
    assert policies.merged({"a": {"x": 1, "y": 2}, "tools": [1]}, {"a": {"y": 3}, "tools": [2]}) == {"a": {"x": 1, "y": 3}, "tools": [2]}
    over = {"tools": [{"name": "fs.read", "scopes": ["read", "write"], "requires_approval": True}, {"name": "unknown", "allowed": False}]}
    t = policies.apply(policies.table(spark, good), policies.table(spark, over))
    r = policies.usable(t).first()
    assert t.count() == 1 and (r.tool, r.scopes, r.requires_approval, r.properties, r.required, r.additional, r.mode) == ("fs.read", ["read", "write"], True, {"path": "string"}, ["path"], False, "mask")


def test_redaction_of_objects(spark):
    o = {"api_key": "12345678", "apiToken": "abcdefghij", "n": 5, "deep": [{"note": "Bearer abc.def"}, "sk-short"], "msg": "x ghp_" + "a" * 36}
    d = spark.createDataFrame([(json.dumps(o),), ("no json",), (None,)], "j string")
    stored, sent, obj = ([r[0] for r in d.select(f(F.col("j"))).collect()] for f in (redaction.redact_stored, redaction.redact_event, redaction.redact_object))
    assert json.loads(stored[0]) == {"api_key": "12345678", "apiToken": "abcd***ghij", "n": 5, "deep": [{"note": "Bear***.def"}, "***REDACTED***"], "msg": o["msg"]}
    assert json.loads(sent[0])["deep"] == o["deep"] and json.loads(sent[0])["apiToken"] == "abcd***ghij"
    assert stored[1:] == ["no json", None] and obj[1].sanitized == "no json" and obj[1].findings == []
    assert [(f.path, f.type) for f in obj[0].findings] == [("api_key", "key_match"), ("apiToken", "key_match"), ("deep[0].note", "generic_bearer"), ("msg", "github_token")]


def test_repeated_diff_ids_are_not_mixed(spark):
    one, two = "--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n@@ -9 +9 @@\n-d", "+++ b/y\n@@ -5 +7 @@\n+" + "z" * 1_100_000
    d = spark.createDataFrame([(1, one), (1, two), (2, ""), (2, None)], "diff_id int, diff string")
    got = [(r.path, r.hunk, r.kind, r.old_line, r.new_line, len(r.text)) for r in patches.diff_lines(d).collect()]
    assert sorted(got, key=str) == sorted([("x", 1, " ", 1, 1, 1), ("x", 1, "-", 2, None, 1), ("x", 1, "+", None, 2, 1), ("x", 2, "-", 9, None, 1), ("y", 1, "+", None, 7, 1_100_000)], key=str)


def test_imports_may_be_added_at_the_top(spark):
    diff = "+++ b/a.py\n@@ -1 +1,2 @@\n+import os\n@@ -50 +51 @@\n-a\n+b"
    d = spark.createDataFrame([(1, diff, 50, 50, "import sys\n\nx = 1"), (2, diff, 50, 50, "x = 1")], "diff_id int, diff string, start_line int, end_line int, source string")
    assert rows(patches.policy(d)) == [(1, None), (2, "outside the finding")]


def test_mahalanobis_against_numpy(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 5)) * [1, 5, 1, 100, 1] + 1000
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<double>").repartition(5)
    mean, cov = retrieval.mean_and_covariance(d, "v")
    m, inverse = retrieval.inverse_covariance(mean, cov)
    want = np.cov(x.T) + 1e-3 * np.eye(5)
    assert np.allclose(m, x.mean(axis=0)) and np.allclose(np.linalg.pinv(np.array(inverse)), want)
    got = dict(d.select("k", retrieval.mahalanobis(F.col("v"), m, inverse)).collect())
    y = x - x.mean(axis=0)
    assert np.allclose([got[k] for k in range(200)], np.sqrt(np.einsum("ij,jk,ik->i", y, np.linalg.inv(want), y)))


def test_splits(spark):
    d = spark.createDataFrame([(k, "a" if k < 40 else "b" if k < 43 else "c") for k in range(44)], "k int, y string")
    s = datasets.floor_split(d, "k", "y")
    n = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert n == {("a", "train"): 32, ("a", "val"): 4, ("a", "test"): 4, ("b", "train"): 2, ("b", "test"): 1, ("c", "test"): 1}
    r = datasets.with_every_class(s, "k", "y")
    n = {(r.y, r.split): r["count"] for r in r.groupBy("y", "split").count().collect()}
    assert n[("b", "val")] == 1 and n[("b", "train")] == 1 and r.count() == 44 and ("c", "val") not in n


def test_steps(spark):
    files = spark.createDataFrame([("requirements.txt", "requests==2.25.0\n"), ("web/package.json", '{"dependencies":{"lodash":"1.0.0"}}'), (".x/package.json", '{"dependencies":{"qs":"1.0.0"}}'), ("a.py", "k = 'ghp_" + "a" * 36 + "'\nok")], "path string, text string")
    assert rows(pipelines.scan_dependencies(files, spans.advisories(spark)).select("package")) == [("lodash",), ("requests",)]
    assert rows(pipelines.scan_secrets(files).select("path", "line", "masked"))[0] == ("a.py", 1, "ghp_***aaaa")
    p = pipelines.diff_pairs(spark.createDataFrame([("d", "+++ b/x\n@@ -1 +1 @@\n-old\n+new\n@@ -5 +5 @@\n+only")], "path string, diff string"))
    assert [(r.old, r.new) for r in p.collect()] == [("old", "new")]
    g = pipelines.guidance_pairs(spark.createDataFrame([("k.md", "text " * 300)], "path string, text string"))
    assert pipelines.training_pairs([p, g], 2).count() == 2 and g.first().old.startswith("guidance: text")
    jobs = spark.createDataFrame([("j", "done", 1, 1, 1, 0, "\n".join(["+x"] * 300), None), ("k", "pending", 0, 0, 0, 0, None, "l")], "job_id string, status string, total int, patched int, validated int, rejected int, diff string, logs string")
    f = spark.createDataFrame([("j", "f1", "B1", "a.py", 1, 2, "patched", "r")], "job_id string, finding_id string, rule_id string, filepath string, start_line int, end_line int, status string, reason string")
    c = pipelines.comments(jobs, f)
    text = dict(c.collect())
    assert "- `f1` B1 a.py:1-2 **patched** — r" in text["j"] and text["j"].count("+x") == 200 and "...diff truncated..." in text["j"] and "_Work in progress" in text["k"] and "- Logs: `l`" in text["k"]
    e = spark.createDataFrame([("j", 7, text["j"]), ("j", 9, text["j"]), ("k", 8, "other")], "job_id string, comment_id int, body string")
    assert rows(pipelines.comment_actions(c, e).select("job_id", "action", "comment_id")) == [("j", "update", 7), ("k", "create", None)]
    w = pipelines.ensemble_weights(spark.createDataFrame([("a", 0.2), ("b", 0.6)], "model string, f1 double"))
    assert {k: round(v, 6) for k, v in w.collect()} == {"a": 0.25, "b": 0.75}
    v = pipelines.first_seen_vocabulary(spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c", "a"])], "k int, t array<string>"), "t", "k", least=1)
    assert rows(v.select("index", "token")) == [(4, "b"), (5, "a"), (6, "c")]
    assert pipelines.ratios("8,1,1") == (0.8, 0.1, 0.1) and pipelines.weights("high=3, low=1") == {"HIGH": 3, "LOW": 1}
    s = spark.createDataFrame([(k, f"total = total + value{k} # c", int(k % 4 == 0)) for k in range(60)], "sample_id long, code string, label int")
    b = pipelines.balanced_dataset(s, "label", 3, 2)
    of = {}
    for r in b.collect():
        of.setdefault(r.sample_id, set()).add(r.split)
    assert all(len(x) == 1 for x in of.values()) and b.where("variant >= 0").count() > 0 and b.where("variant >= 0 AND split <> 'train'").count() == 0
    x = spark.createDataFrame([(0.9, 0.5, 1), (None, 0.2, 1), (0.6, 0.6, 3)], "model_score double, consensus_score double, scanner_count int")
    assert [(r.ml_risk_label, r.wants_patch) for r in pipelines.scored_findings(x).collect()] == [("high", True), ("low", False), ("high", True)]


def test_overlap_candidates_as_in_plain_loops(spark):
    """Long, short, negative and equal spans, and a file whose rows all overlap: these must not meet in pairs."""
    draw = random.Random(5)
    spans = [(f"f{n % 3}", a := draw.randint(-40, 300), a + draw.choice([0, 0, 1, 3, 7, 64, 500]), f"r{draw.randint(0, 3)}", n) for n in range(900)]
    spans += [("hot", 5 + n % 2, 9, f"r{n % 5}", 1000 + n) for n in range(4000)]
    d = spark.createDataFrame(spans, "filepath string, start_line int, end_line int, rule_id string, ordinal long")
    got = findings.overlap_candidates(d.where("ordinal % 3 > 0"), d.where("ordinal % 3 = 0"))
    tools = [t for t in spans if t[4] % 3]
    want = {}
    for path, a, b, _, m in [x for x in spans if x[4] % 3 == 0]:
        fit = [(t[2] - t[1], t[1], t[3], t[4]) for t in tools if t[0] == path and t[1] <= b and a <= t[2]]
        want |= {m: min(fit)[3]} if fit else {}
    assert {r.m_id: r.t_id for r in got.collect()} == want
    said = got._jdf.queryExecution().optimizedPlan().toString()
    assert "<=" not in "".join(x for x in said.splitlines() if "Join" in x)


def test_merge_as_in_plain_loops_and_soon(spark):
    """Spans of all lengths, some turned round or unknown; and a file of many rows on the same lines, which must not be
    compared with each other one by one."""
    draw = random.Random(6)
    line = lambda: draw.choice([None, *[draw.randint(-30, 200)] * 12])
    some = [("f", a := line(), None if a is None or draw.random() < 0.05 else a + draw.choice([-3, 0, 1, 2, 9, 70]), f"r{draw.randint(0, 2)}", draw.choice(["bandit", "semgrep", "ml", "ml", "other"]), "low", draw.random(), n) for n in range(700)]
    d = spark.createDataFrame(some, "filepath string, start_line int, end_line int, rule_id string, source string, severity string, confidence double, ordinal long")
    tools = {}
    for x in some:
        if x[4] != "ml":
            tools[x[4], x[3], x[1], x[2]] = x
    have, want = list(tools.values()), []
    for m in [x for x in some if x[4] == "ml"]:
        fit = [t for t in have if t[4] in ("bandit", "semgrep") and None not in (t[1], t[2], m[1], m[2]) and t[1] <= m[2] and m[1] <= t[2]]
        best = min(fit, key=lambda t: (t[2] - t[1], t[1], t[3]), default=None)
        have = [t for t in have if t is not best]
        want.append((best[7], m[7]) if best else (m[7], None))
    got = findings.merge(d).collect()
    assert sorted((r.ordinal, r.merged_ordinal or -1) for r in got) == sorted((a, -1 if b is None else b) for a, b in want + [(t[7], None) for t in have])
    many = spark.range(24000).selectExpr("'g' AS filepath", "cast(id % 2 AS int) AS start_line", "cast(10 + id % 4000 AS int) AS end_line", "concat('r', id) AS rule_id", "CASE WHEN id % 2 = 0 THEN 'ml' ELSE 'bandit' END AS source", "'low' AS severity", "0.5D AS confidence", "id AS ordinal")
    t = time.time()
    assert findings.merge(many).where("source = 'hybrid'").count() == 12000
    assert time.time() - t < 30


def test_ordinals_of_large_keys(spark, tmp_path):
    """Keys beyond which eight hundred thousand million times an order is no long."""
    from wardspark.plans import common, dataset_queries, ingest_queries, sample_queries

    d = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(50)
    d.withColumn("l_orderkey", F.col("l_orderkey") + 40_000_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    wide = lambda r: ((((r.l_orderkey * 8 + r.l_linenumber) * 100000 + r.l_partkey) * 10000 + r.l_suppkey) * 100 + int(r.l_quantity) % 100) % 2**63
    want = sorted(wide(r) for r in spark.read.parquet(f"{tmp_path}/lineitem.parquet").collect())
    assert sorted(r.ordinal for r in common.findings(spark, str(tmp_path)).collect()) == want
    for q in (dataset_queries.diff_line_numbers, ingest_queries.inferred_categories, ingest_queries.patch_policy_reasons, sample_queries.noted_findings):
        assert q(spark, str(tmp_path)).count() in (50, 250)


def test_long_hunks_take_time_by_their_lines(spark):
    """8,000 lines took 48 seconds, and four times that at twice as many; heads, paths and numbers of odd kinds are read as before."""
    n = 32_000
    odd = "+++ /dev/null\n@@ -1 +1 @@\n+no\n+++ b/b/y \n@@ -007 +99999999999 @@\r\n x\n--- a\n-b\n+++c\n+\n\\ no\n+é d\n@@\n+++ z\n-q\n@@ +4\n+w"
    d = spark.createDataFrame([("long", "+++ b/y\n@@ -5 +7 @@\n" + "+z\n-z\n" * n), ("odd", odd), ("none", "@@ -1 +1 @@\n+a")], "diff_id string, diff string")
    started = time.time()
    got = patches.diff_lines(d).where("diff_id = 'long'").agg(F.count("*"), F.max("old_line"), F.max("new_line"), F.sum("old_line"), F.min("hunk")).first()
    assert tuple(got) == (2 * n, n + 4, n + 6, sum(range(5, n + 5)), 1) and time.time() - started < 60
    got = [(r.path, r.hunk, r.kind, r.old_line, r.new_line, r.text) for r in patches.diff_lines(d).where("diff_id <> 'long'").collect()]
    assert got == [("b/y", 1, " ", 7, 0, "x"), ("b/y", 1, "-", 9, None, "b"), ("b/y", 1, "+", None, 3, ""), ("b/y", 1, "+", None, 5, "é d"), ("b/y", 2, "-", 1, None, "q"), ("z", 3, "+", None, 4, "w")]
