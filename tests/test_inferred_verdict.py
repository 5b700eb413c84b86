"""Verdicts against phases written out in Python."""

import re
from itertools import product

from pyspark.sql import functions as F

from wardspark.operators import labelling as L


def want(rule, message, path, code, severity, confidence):
    search = lambda p, t: re.search(p, t, re.IGNORECASE)
    has = lambda t, *words: any(w in t for w in words)
    combined, code, path = f"{rule} {message}".lower(), (code or "").lower(), path.lower()
    if any(search(p, path) for p in L.FALSE_PATHS):
        return "FP"
    for r, p in [("B101", "test|spec|pytest|unittest"), ("B110", "optional|fallback|ignore|skip"), ("B311", "shuffle|sample|choice|display|ui|color|game|demo"), ("innerhtml", r"ckeditor|tinymce|jquery|vendor|static/.*\.js"), ("B404", ".*"), ("B105|B106|B107", "test|example|placeholder|dummy|sample|config")]:
        if search(r, rule) and search(p, path + " " + code):
            return "FP"
    if any(search(p, code) for p in L.FALSE_CODE):
        return "FP"
    if any(search(p, code) for p in L.TRUE_CODE):
        return "TP"
    if "B101" in rule or "assert" in rule.lower():
        return "UNCERTAIN" if has(path, "auth", "security", "permission", "access") else "FP"
    if "B110" in rule:
        return "TP" if has(code, "security", "auth", "password", "token", "secret") else "FP"
    if "B404" in rule:
        return "FP"
    if "B311" in rule or "random" in rule.lower():
        if has(code, "secret", "token", "password", "key", "salt", "nonce", "iv"):
            return "TP"
        return "FP" if has(code, "shuffle", "sample", "choice", "color", "display", "game") else "UNCERTAIN"
    if re.search("B10[567]", rule):
        return "FP" if has(code, "xxx", "placeholder", "changeme", "example", "your_", "TODO") or has(path, "test", "example", "sample", "config") else "TP"
    if "innerhtml" in rule.lower() or "xss" in message.lower():
        if has(path, "ckeditor", "tinymce", "vendor", "node_modules", ".min.js"):
            return "FP"
        return "TP" if re.search("request|user|param|input", code) else "UNCERTAIN"
    score = L.SEVERITY_WEIGHT.get(severity.upper(), 0.5) * L.CONFIDENCE_WEIGHT.get((confidence or "MEDIUM").upper(), 0.7)
    if score >= 0.7:
        return "TP"
    if score <= 0.3:
        return "UNCERTAIN"
    return "UNCERTAIN" if any(search(p, combined) for p in ("generic|informational|info[-_]?only", "potential|possible|may[-_]?be")) else "TP"


def test_all_phases(spark):
    rules = ["B101", "b101", "assert_used", "B110", "B404", "B311", "py.random", "B105", "B107", "js.innerHTML", "B608", "R1"]
    paths = ["src/a.py", "tests/a.py", "Auth/a.py", "src/config.py", "src/latest.py", "specx/a.py", "static/x/a.js"]
    codes = [None, "z = 1", "y() # NOSEC", "request.args", "token()", "shuffle(x)", "TODO", "changeme", "user", "fallback", "a\nb"]
    cases = list(product(rules, ["m", "Possible flaw", "XSS"], paths, codes, ["HIGH", "low", "Critical", "info", "odd"], ["HIGH", None, "low", "odd"]))
    d = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, r string, m string, p string, c string, s string, f string")
    got = {x.k: x.v for x in d.select("k", L.inferred_verdict(*map(F.col, "rmpcsf")).alias("v")).collect()}
    assert [c for k, c in enumerate(cases) if got[k] != want(*c)] == []
    assert set(got.values()) == {"TP", "FP", "UNCERTAIN"}


def test_low_severity_is_uncertain(spark):
    d = spark.createDataFrame([("R1", "m", "src/a.py", "z = 1", "low", "LOW")], "r string, m string, p string, c string, s string, f string")
    assert d.select(L.inferred_verdict(*map(F.col, "rmpcsf")).alias("v")).first().v == "UNCERTAIN"
