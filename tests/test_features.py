"""The engineered numbers of a finding against Python's own patterns."""

import re

import pytest
from pyspark.sql import functions as F

from wardspark.operators import features

CODES = [
    "def f(a):\n    if a:\n        return eval (a) + 'x'\n    else:\n        exec(a)\n\n", "class A:\n\tpass\nfor i in x:\n  while y: elif_ = f\"{a}\" + f'b'\n", "subprocess.run(c, shell = True)\nselect * from t; Delete", "req.get; request.post; argv; input(",
    "open (f).read()\nMD5 crypto hashlib\npickle marshal yaml.load yaml.unsafe_load", "innerHTML = a + \"b\" + 'c' + d; '%s' % (a)\n'{}'.format (1).format(2)", "", "\n\n  \n", "function g() {}\nfunction  h(", "x" * 1000 + "\n y",
]
META = [("src/tests/a.py", "B101", "high", None), ("node_modules/x/.env", "p.SemGrep.y", "CRITICAL", "low"), ("a.py", "", None, "HIGH"), ("/c/Config/spec.js", "b1", "odd", "odd")]


def want(code, path, rule, severity, confidence):
    lines, n, has = code.split("\n"), (lambda p, fl=0: len(re.findall(p, code, fl))), (lambda p, fl=0: int(bool(re.search(p, code, fl))))
    return {
        "code_lines": len(lines), "code_chars": len(code), "avg_line_length": len(code) / len(lines), "max_line_length": max(map(len, lines)), "blank_line_ratio": sum(not x.strip() for x in lines) / len(lines), "nested_depth": 0,
        "function_count": n(r"\bdef\s+\w+|function\s+\w+"), "class_count": n(r"\bclass\s+\w+"), "loop_count": n(r"\bfor\b|\bwhile\b"), "conditional_count": n(r"\bif\b|\belse\b|\belif\b"),
        "has_eval": has(r"\beval\s*\("), "has_exec": has(r"\bexec\s*\("), "has_subprocess": has(r"\bsubprocess\b"), "has_shell_true": has(r"shell\s*=\s*True"), "has_sql": has(r"\bSELECT\b|\bINSERT\b|\bUPDATE\b|\bDELETE\b", re.I), "has_request": has(r"request\.|req\."),
        "has_user_input": has(r"input\(|argv|request\.(get|post|form|args)"), "has_file_ops": has(r"open\s*\(|read\(|write\("), "has_crypto": has("md5|sha1|hashlib|crypto", re.I), "has_pickle": has("pickle|marshal"), "has_yaml_load": has(r"yaml\.load|yaml\.unsafe"), "has_innerhtml": has("innerHTML|dangerouslySetInnerHTML"),
        "string_concat_count": n(r"\+\s*[\"']|[\"']\s*\+"), "fstring_count": n("f[\"']"), "format_count": n(r"\.format\s*\("), "percent_format_count": n(r"%\s*\("),
        "severity_score": {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}.get((severity or "MEDIUM").upper(), 2), "confidence_score": {"HIGH": 3, "MEDIUM": 2, "LOW": 1}.get((confidence or "MEDIUM").upper(), 2),
        "is_test_file": int(bool(re.search("test|spec|mock|fixture", path, re.I))), "is_vendor": int(bool(re.search("vendor|node_modules|static", path, re.I))), "is_config": int(bool(re.search(r"config|settings|\.env", path, re.I))), "path_depth": path.count("/"),
        "is_bandit": int(rule.startswith("B")), "is_semgrep": int("semgrep" in rule.lower()),
    }


def test_engineered_features(spark):
    cases = [(c, *m) for c in CODES for m in META]
    d = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, c string, p string, r string, s string, f string")
    got = {x.k: x.f.asDict() for x in d.select("k", features.engineered_features(*map(F.col, "cprsf")).alias("f")).collect()}
    for k, c in enumerate(cases):
        hashed = got[k].pop("rule_hash")
        assert 0 <= hashed < 1000
        assert got[k] == pytest.approx(want(*c)), c
