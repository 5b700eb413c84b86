"""Small cases with known results, and brute force where the order of steps matters."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardspark.functions import severity, text, vector
from wardspark.operators import augment, code, datasets, findings, fixes, gateway, graphs, labelling, metrics, patches, retrieval, spans, store
from wardspark.sources import readers, writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_three_severities(spark):
    d = spark.createDataFrame([("ERROR",), ("odd",), (None,)], "s string")
    assert [r[0] for r in d.select(severity.finding_severity(F.col("s"))).collect()] == ["high", "info", "info"]
    assert [r[0] for r in d.select(severity.consensus_severity(F.col("s"))).collect()] == ["HIGH", "MEDIUM", "MEDIUM"]
    assert [r[0] for r in d.select(severity.stored_severity(F.col("s"), F.lit("bandit"))).collect()] == ["ERROR", "ODD", "UNKNOWN"]


def test_confidence(spark):
    d = spark.createDataFrame([("HIGH", 0.9), ("7", 1.0), ("-1", 0.0), ("0.25", 0.25), ("odd", 0.5), (None, 0.5)], "c string, want double")
    assert all(r[0] == r[1] for r in d.select(severity.confidence(F.col("c")), "want").collect())


def test_redaction_is_idempotent(spark):
    d = spark.createDataFrame([("key AKIA" + "A" * 16 + " and " + "x" * 40,), ("plain",)], "t string")
    once = text.redact_secrets(F.col("t"))
    got = [r for r in d.select(once, text.redact_secrets(once)).collect()]
    assert got[0][0] == "key [REDACTED] and [REDACTED]" and all(a == b for a, b in got)


def test_mask(spark):
    d = spark.createDataFrame([("12345678",), ("123456789",)], "v string")
    assert [r[0] for r in d.select(text.mask_value(F.col("v"))).collect()] == ["***REDACTED***", "1234***6789"]


def test_chunks(spark):
    d = spark.createDataFrame([("a" * 20,), ("b" * 25,), ("",)], "t string")
    assert [[len(x) for x in r[0]] for r in d.select(text.chunks(F.col("t"), 10, 2)).collect()] == [[10, 10, 4], [10, 10, 9], []]


SPANS = [("class1", "r", "a.py", 1, 20), ("method1", "r", "a.py", 5, 10), ("func2", "r", "a.py", 30, 40)]


def mapped(spark, found, lines, *more):
    s = spark.createDataFrame(SPANS + list(more), "sample_id string, repo string, filepath string, start_line int, end_line int")
    li = spark.createDataFrame([(n, "r", "a.py", n) for n in lines], "row_id int, repo string, filepath string, line int")
    return dict(rows(found(li, s)))


def test_enclosing(spark):
    assert mapped(spark, spans.enclosing, [6, 15, 25]) == {6: "method1", 15: "class1"}
    assert mapped(spark, spans.enclosing, [55], ("x", "r", "a.py", 51, 60), ("y", "r", "a.py", 53, 62)) == {55: "y"}


def test_nearest(spark):
    assert mapped(spark, lambda a, b: spans.nearest(a, b, 5), [25]) == {25: "func2"}
    assert mapped(spark, lambda a, b: spans.nearest(a, b, 3), [25]) == {}


def test_nearest_does_not_see_beyond_the_one_before(spark):
    s = spark.createDataFrame([("A", "r", "a.py", 1, 22), ("B", "r", "a.py", 10, 12)], "sample_id string, repo string, filepath string, start_line int, end_line int")
    li = spark.createDataFrame([(1, "r", "a.py", 25)], "row_id int, repo string, filepath string, line int")
    assert rows(spans.nearest(li, s, 3)) == []


def test_merge_takes_a_tool_row_once(spark):
    f = [("a", 1, 9, "T1", "bandit", "high", 0.6, 1), ("a", 3, 3, "T2", "semgrep", "low", 0.5, 2), ("a", 3, 3, "m", "ml", "high", 0.8, 3), ("a", 3, 3, "m", "ml", "low", 0.3, 4), ("a", 3, 3, "m", "ml", "low", 0.3, 5)]
    d = spark.createDataFrame(f, "filepath string, start_line int, end_line int, rule_id string, source string, severity string, confidence double, ordinal long")
    got = {(r.rule_id, r.source, r.confidence, r.merged_ordinal) for r in findings.merge(d).collect()}
    assert got == {("T2", "hybrid", 0.8, 3), ("T1", "hybrid", 0.6, 4), ("m", "ml", 0.3, None)}


def test_reports_to_findings(spark, tmp_path):
    b = {"results": [{"filename": "./src/app.py", "line_number": 8, "line_range": [8, 9], "test_id": "B101", "test_name": "assert", "issue_severity": "HIGH", "issue_confidence": "MEDIUM", "issue_text": "t"}]}
    s = {"results": [{"check_id": "js.eval", "path": "web/app.js", "start": {"line": 5, "col": 1}, "end": {"line": 5, "col": 9}, "extra": {"message": "m", "severity": "WARNING"}}]}
    (tmp_path / "b.json").write_text(json.dumps(b, indent=1))
    (tmp_path / "s.json").write_text(json.dumps(s, indent=1))
    r = findings.from_bandit(readers.bandit(spark, str(tmp_path / "b.json"))).first()
    assert (r.filepath, r.severity, r.confidence, r.start_line, r.end_line, r.rule_name) == ("src/app.py", "high", 0.6, 8, 9, "assert")
    r = findings.from_semgrep(readers.semgrep(spark, str(tmp_path / "s.json"))).first()
    assert (r.severity, r.confidence, r.start_line) == ("medium", 0.5, 5)


def test_versions(spark):
    req = spark.createDataFrame([("requirements.txt", "requests==2.25.0\n# note\ndjango==2.1.0\n")], "path string, text string")
    got = rows(spans.vulnerable(spans.requirements(req), spans.advisories(spark)).select("package", "advisory"))
    assert len(got) == 3
    js = spark.createDataFrame([("package.json", '{"dependencies":{"lodash":"4.17.15","qs":"^1.0.0"},"devDependencies":{"minimist":"1.2.0","qs":"99.0.0"}}')], "path string, text string")
    assert sorted(p for p, in rows(spans.vulnerable(spans.package_json(js), spans.advisories(spark)).select("package"))) == ["lodash", "minimist"]


def test_line_rules(spark):
    files = [("a.py", "x = eval(y)\n# eval(z)\nos.system(c)"), ("b.ts", "el.innerHTML = s\n// eval(1)"), ("c.txt", "eval(1)")]
    got = rows(code.scan_lines(spark.createDataFrame(files, "path string, text string")).select("path", "line", "rule_id"))
    assert got == [("a.py", 1, "PATTERN-PY-001"), ("a.py", 3, "PATTERN-PY-006"), ("b.ts", 1, "PATTERN-JS-002")]


def test_python_trees(spark):
    f = spark.createDataFrame([("a.py", "def f(x):\n    if x and x > 1:\n        return eval(x)\n\nclass C:\n    pass\n"), ("b.py", "def (")], "path string, text string")
    assert rows(code.functions_of(f).select("name", "start_line", "end_line", "complexity")) == [("C", 5, 6, 1), ("f", 1, 3, 3)]
    assert rows(spark.sql("SELECT t.rule_id, t.line FROM _files f, LATERAL py_calls(f.text) t")) == [("AST-eval", 3)]
    assert spark.sql("SELECT t.* FROM _files f, LATERAL py_graph(f.text) t WHERE kind = 'use'").count() == 2


def test_rate_limit_against_brute_force(spark):
    times = [0, 10, 20, 30, 61, 62, 70, 100, 121, 122]
    d = spark.createDataFrame([(1, i, datetime(2024, 1, 1) + timedelta(seconds=t)) for i, t in enumerate(times)], "client long, event_id long, ts timestamp_ntz")
    log, want = [], []
    for i, t in enumerate(times):
        log = [x for x in log if x > t - 60]
        want.append((1, i, len(log) < 2))
        if want[-1][2]:
            log.append(t)
    assert rows(gateway.rate_limit(d, 2)) == want


def test_gateway_fails_open(spark):
    d = spark.createDataFrame([(1, None), (2, datetime(2024, 1, 5))], "event_id long, ts timestamp_ntz")
    assert rows(gateway.within(d, "nonsense", None).select("event_id")) == [(1,), (2,)]
    assert rows(gateway.within(d, "2024-02-01", None).select("event_id")) == [(1,)]


def test_safe_output(spark):
    d = spark.createDataFrame([(1, "rm  -rf /"), (2, "fine"), (3, "```x```")], "output_id long, text string")
    got = {r.output_id: (r.blocked, r.trusted, r.untrusted) for r in gateway.safe_output(d, False, [], "llm").collect()}
    assert got == {1: (True, False, True), 2: (False, False, True), 3: (True, False, True)}


def test_select_keeps_caps(spark):
    items = [(f"i{k}", "ab"[k % 2], f"R{k % 3}", k % 3 + 1, k % 5) for k in range(60)]
    d = spark.createDataFrame(items, "item_id string, source string, rule_id string, weight long, hardness long")
    got = datasets.select_round_robin(d, 10, 3).toPandas()
    assert len(got) == 9 and got.rule_id.value_counts().max() <= 3 and got.item_id.is_unique
    assert rows(datasets.select_round_robin(d, 10, 3)) == rows(datasets.select_round_robin(d.orderBy(F.desc("item_id")), 10, 3))


def test_split_rules(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), *[(k, "c") for k in range(10, 30)]], "id long, y string")
    got = datasets.stratified_split(d, "id", "y").groupBy("y", "split").count()
    assert {(r.y, r.split): r["count"] for r in got.collect()} == {("a", "train"): 1, ("b", "train"): 1, ("b", "test"): 1, ("c", "train"): 16, ("c", "val"): 2, ("c", "test"): 2}


def test_ranking_of_patches(spark):
    head = "+++ b/x\n@@ -1 +1 @@\n"
    c = [("f", "long", head + "+a\n+b\n+c", "llm", True, 0.0), ("f", "llm", head + "+a", "llm", True, 0.0), ("f", "det", head + "+a", "deterministic", True, 0.0), ("f", "bad", head, "llm", False, 9.0)]
    d = spark.createDataFrame(c, "finding_id string, candidate_id string, diff string, source string, valid boolean, score double")
    assert [r.candidate_id for r in patches.rank(d).orderBy("place").collect()] == ["det", "llm", "long"]


def test_new_failures(spark):
    b = spark.createDataFrame([("lint", 1), ("test", 0)], "step string, code int")
    p = spark.createDataFrame([("lint", 1), ("test", 2), ("new", 1), ("ok", 0)], "step string, code int")
    assert rows(patches.new_failures(b, p)) == [("new", 1), ("test", 2)]


def test_auroc_is_null_with_one_class(spark):
    d = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert metrics.auroc(d, F.col("y"), F.col("s")).first()[0] is None


def test_filter_stays_above_the_limit(spark):
    d = spark.range(100).withColumn("ok", F.col("id") < 50)
    assert store.limit_then_filter(d, [F.desc("id")], 10, F.col("ok")).count() == 0


def test_upsert_keeps_what_it_should(spark):
    t = spark.createDataFrame([("a", 1, "x")], "k string, created int, v string")
    n = spark.createDataFrame([("a", 9, "y"), ("b", 9, "z")], "k string, created int, v string")
    assert rows(store.upsert_keeping(t, n, ["k"], ["created"], ["v"])) == [("a", 1, "y"), ("b", 9, "z")]


def test_vectors(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in d.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
    assert metrics.weighted_average([0.2, 0.8], [0.25, 0.75]) == pytest.approx(0.65)


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(1, "train", "a"), (2, "test", "a")], "id long, split string, y string")
    assert rows(writers.splits(d, str(tmp_path / "d"), "y").select("split", "y", "n")) == [("test", "a", 1), ("train", "a", 1)]


def test_tree_walk(spark, tmp_path):
    for p in ("a.py", "sub/b.py", "node_modules/c.py", ".x/d.py", "e.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert rows(readers.text_files(spark, str(tmp_path), [".py"]).select("path")) == [("a.py",), ("sub/b.py",)]


def test_pyproject(spark):
    f = spark.createDataFrame([("pyproject.toml", '[project]\ndependencies = ["requests==2.0.0", "flask>=1.0"]'), ("bad", "[[")], "path string, text string")
    assert rows(readers.pyproject(f).select("package", "version")) == [("flask", "1.0"), ("requests", "2.0.0")]


def test_allowlist(spark):
    d = spark.createDataFrame([("a.x",), ("b",), ("ab",)], "r string")
    assert readers.allowlist("# n\na.*\nb # y\n") == ["a.*", "b"]
    assert rows(readers.allowed(d, "r", ["a.*", "b"])) == [("a.x",), ("b",)]


def test_model_rows_without_a_place_go(spark):
    d = spark.createDataFrame([("src/a.py", (3, None), 0.82, [("xss", 0.5)], "m"), (None, (1, 2), 0.9, None, "m")], "filepath string, span struct<start_line:int,end_line:int>, risk_score double, top_categories array<struct<category:string,confidence:double>>, model string")
    assert [(r.severity, r.end_line, r.rule_id) for r in findings.from_model(d).collect()] == [("high", 3, "xss")]


def test_nearest_vectors_against_brute_force(spark):
    v = [(k, [float(k % 5), float(k % 3), 1.0]) for k in range(30)]
    d = spark.createDataFrame(v, "item_id long, embedding array<double>")
    got = retrieval.nearest(d.where("item_id < 3").withColumnRenamed("item_id", "query_id"), d, 4)

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 6)

    want = {(q, i) for q, a in v[:3] for i, _ in sorted(v, key=lambda x: (-cos(a, x[1]), x[0]))[:4]}
    assert {(r.query_id, r.item_id) for r in got.collect()} == want


def test_fixes_go_from_the_end_and_once_a_line(spark):
    f = spark.createDataFrame([("a.ts", "el.innerHTML = x\nok\nb.innerHTML = y")], "filepath string, text string")
    g = spark.createDataFrame([("1", "a.ts", 1, "untrusted_to_innerhtml"), ("2", "a.ts", 3, "untrusted_to_innerhtml"), ("3", "a.ts", 3, "untrusted_to_innerhtml"), ("4", "a.ts", 2, "json_eval"), ("5", "a.ts", 9, "json_eval"), ("6", "a.ts", 1, "?")], "finding_id string, filepath string, line int, fix string")
    got = {r.finding_id: r for r in fixes.apply_fixes(f, g).collect()}
    assert {k: r.reason for k, r in got.items()} == {"1": None, "2": None, "3": "overlap", "4": "pattern not found", "5": "out of bounds", "6": "no fix"}
    assert "+el.textContent = x" in got["1"].diff and "+b.textContent = y" in got["1"].diff and got["2"].diff is None


def test_label_items_and_resolution(spark):
    s = spark.createDataFrame([("s", "python", "a.py", [("bandit", "B1", None, None, "m", 0), ("bandit", "B1", None, None, "m", 3)]), ("t", "python", "b.py", [])], "sample_id string, language string, filepath string, weak_labels array<struct<source:string,rule_id:string,severity:string,confidence:string,message:string,line:int>>")
    assert labelling.label_items(s).select("item_id").distinct().count() == 2
    d = spark.createDataFrame([(1, None, "FP"), (None, True, "FP"), (None, None, "tp"), (None, None, "UNCERTAIN")], "y int, v boolean, w string")
    assert [r[0] for r in d.select(labelling.risk_label(F.col("y"), F.col("v"), F.col("w"))).collect()] == [1, 1, 1, None]


def test_rule_queries(spark):
    d = spark.createDataFrame([("b602",), ("B999",), ("cwe-1",), ("odd",)], "r string")
    assert [r[0] for r in d.select(labelling.rule_query(F.col("r"))).collect()] == ["subprocess shell=True command injection Python", "Bandit B999 Python security vulnerability fix", "cwe-1 vulnerability security fix pattern", "odd security vulnerability fix"]


def test_graph_bounds(spark):
    n = spark.range(30).select(F.lit(1).alias("graph_id"), F.col("id").alias("node_id"))
    e = n.select("graph_id", F.col("node_id").alias("src"), ((F.col("node_id") + 1) % 30).alias("dst"), F.lit(0).alias("type"))
    a, b = graphs.bounded(n, e, 10, 5)
    assert a.count() == 10 and rows(b.select("src")) == [(0,), (1,), (2,), (3,), (4,)]


def test_sql_functions(spark):
    from wardspark.functions import sql

    sql.register(spark)
    r = spark.sql("SELECT severity_rank('HIGH') a, mask_value('123456789') b, redact_secrets(repeat('x', 40)) c, code_tokens('a+1') d, cosine_sim(array(1D, 0D), array(1D, 1D)) e, diff_added('+++ x\n+a\n+b') f, hash_bucket('tok', 256) g").first()
    assert (r.a, r.b, r.c, r.d, round(r.e, 6), r.f) == (3, "1234***6789", "[REDACTED]", ["a", "+", "1"], 0.707107, 2)
    d = spark.createDataFrame([("tok",)], "t string")
    assert d.select(vector.hash_bucket(F.col("t"), 256)).first()[0] == r.g


def test_augment_is_the_same_each_time(spark):
    d = spark.createDataFrame([("s", "total = 1  # n\nprint(total)\n\n\n\nx = total"), ("t", "y")], "sample_id string, code string")
    got = rows(augment.augment(d, 4))
    assert got == rows(augment.augment(d.repartition(3), 4))
    assert {(s, v) for s, v, _ in got} == {("s", 0), ("s", 1), ("s", 2), ("s", 3)} and "#" not in got[0][2]


def test_labels_of_all_shapes(spark, tmp_path):
    one = {"rule_id": "R", "filepath": "./a.py", "line": 3, "severity": "HIGH"}
    (tmp_path / "a.jsonl").write_text(json.dumps(one) + "\n" + json.dumps(one) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"test_id": "R", "filename": "a.py", "line_number": 3, "issue_text": "t"}]}, indent=1))
    assert readers.labels(spark, str(tmp_path / "a.jsonl")).count() == 2
    r = readers.labels(spark, str(tmp_path / "b.json")).first()
    assert (r.rule_id, r.filepath, r.line, r.message, r.severity) == ("R", "a.py", 3, "t", "UNKNOWN")
