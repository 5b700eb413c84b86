"""Labels: categories, vulnerability labels, staged verdicts, resolution, vocabularies, query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words of a category, first match wins
CATEGORIES = [
    ("sql.injection", ["sql", "injection"]),
    ("command.injection", ["command", "exec", "os.", "subprocess"]),
    ("xss", ["xss", "script", "html"]),
    ("hardcoded.secrets", ["secret", "password", "api_key", "token", "credential"]),
    ("deserialization", ["pickle", "deserial", "yaml", "marshal"]),
    ("crypto.weak", ["crypto", "hash", "md5", "sha1", "random"]),
    ("path.traversal", ["path", "traversal", "file"]),
    ("ssrf", ["ssrf", "request"]),
    ("dependency.vulnerability", ["cve", "vuln", "dependency"]),
]
# fixed values: patterns of vulnerable code, first match wins
VULNERABLE = [
    (r"subprocess\.\w+\([^)]*shell\s*=\s*True", "command_injection"),
    (r"os\.system\s*\(", "command_injection"),
    (r"eval\s*\(", "code_injection"),
    (r"exec\s*\(", "code_injection"),
    (r"execute\s*\([^)]*%s|execute\s*\([^)]*\+", "sql_injection"),
    (r"cursor\.\w+\s*\([^)]*\+\s*[\"']", "sql_injection"),
    (r"innerHTML\s*=", "xss"),
    (r"document\.write\s*\(", "xss"),
    (r"password\s*=\s*[\"'][^\"']+[\"']", "hardcoded_secret"),
    (r"api_key\s*=\s*[\"'][^\"']+[\"']", "hardcoded_secret"),
    (r"secret\s*=\s*[\"'][^\"']+[\"']", "hardcoded_secret"),
    (r"pickle\.loads?\s*\(", "deserialization"),
    (r"yaml\.load\s*\([^)]*\)", "deserialization"),
    (r"open\s*\([^)]*\+", "path_traversal"),
]
# fixed values: paths whose findings are false alarms
FALSE_PATHS = [
    r"test[-_]?file|test[-_]?case|mock|fixture",
    r"\.test\.|_test\.|test_|tests/|__tests__/",
    r"spec\.|\.spec\.|specs/",
    r"pytest|unittest|jest|mocha|cypress",
    r"example|demo|sample|tutorial|playground",
    r"documentation|readme|docs/",
    r"vendor/|vendors/|third[-_]?party|external/",
    r"node_modules/|bower_components/",
    r"static/ckeditor|ckeditor/|tinymce/|codemirror/",
    r"jquery|bootstrap|lodash|moment\.js",
    r"\.min\.js$|\.bundle\.js$",
    r"dist/|build/|\.next/|__pycache__/",
    r"\.generated\.|auto[-_]?generated",
    r"conftest\.py|setup\.py|setup\.cfg",
    r"webpack\.config|vite\.config|next\.config",
    r"migrations?/|seeds?/|fixtures/",
]
# fixed values: code whose findings are false alarms
FALSE_CODE = [
    r"# nosec|# noqa|# pragma: no cover",
    r"// eslint-disable|/\* eslint-disable",
    r"@pytest\.|def test_|it\(.*should|describe\(",
    r"mock\.|Mock\(|patch\(|stub\(",
    r"assert[A-Z]|self\.assert|expect\(",
]
# fixed values: code whose findings are true
TRUE_CODE = [
    r"request\.(get|post|args|form|data|json)",
    r"sys\.argv|input\(|raw_input",
    r"os\.environ\.get.*\+.*sql|query",
    r"eval\s*\(\s*request|exec\s*\(\s*request",
    r"subprocess.*shell\s*=\s*True.*request",
    r"pickle\.loads?\s*\(\s*request",
    r"(password|secret|key|token)\s*=\s*['\"][a-zA-Z0-9]{16,}['\"]",
    r"-----BEGIN.*PRIVATE KEY-----",
    r"(api[_-]?key|access[_-]?token)\s*=\s*['\"][^'\"]+['\"]",
    r"execute\s*\([^)]*%s|execute\s*\([^)]*\+|execute\s*\(.*\.format",
    r"cursor\.execute\s*\(\s*f['\"]|cursor\.execute\s*\([^,]+\+",
    r"innerHTML\s*=.*req|innerHTML\s*=.*user|innerHTML\s*=.*param",
]
# fixed values: rules whose findings are false alarms where path or code says so
FALSE_RULES = [
    ("B101", r"test|spec|pytest|unittest"),
    ("B110", r"optional|fallback|ignore|skip"),
    ("B311", r"shuffle|sample|choice|display|ui|color|game|demo"),
    ("innerhtml", r"ckeditor|tinymce|jquery|vendor|static/.*\.js"),
    ("B404", r".*"),
    ("B105|B106|B107", r"test|example|placeholder|dummy|sample|config"),
]
# fixed values: messages that leave a verdict open
UNCERTAIN_WORDS = [r"generic|informational|info[-_]?only", r"potential|possible|may[-_]?be"]
# fixed values: weights of a staged verdict
SEVERITY_WEIGHT = {"CRITICAL": 1.0, "HIGH": 0.9, "MEDIUM": 0.7, "LOW": 0.4, "WARNING": 0.6, "INFO": 0.2, "INFORMATION": 0.2}
CONFIDENCE_WEIGHT = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4}
# fixed values: what a query is widened by, at its first known term
EXPANSIONS = [
    ("shell=true", "subprocess shell command injection B602"),
    ("innerhtml", "innerHTML XSS DOM cross-site scripting"),
    ("eval", "eval code injection remote execution"),
    ("pickle", "pickle deserialization RCE B301"),
    ("sql", "SQL injection SQLi parameterized query"),
    ("password", "password hash bcrypt secret credential"),
    ("md5", "MD5 weak hash SHA256 cryptographic"),
    ("jwt", "JWT token verify signature authentication"),
    ("cors", "CORS origin header cross-origin"),
    ("path", "path traversal directory LFI"),
    ("ssrf", "SSRF server-side request forgery URL"),
    ("yaml", "YAML safe_load deserialization"),
    ("xml", "XML XXE external entity"),
]
# fixed values: queries of known rules
RULE_QUERIES = {
    "B602": "subprocess shell=True command injection Python",
    "B601": "paramiko shell command injection",
    "B608": "SQL injection string formatting Python",
    "B301": "pickle deserialization Python",
    "B324": "MD5 SHA1 weak hash Python",
    "B501": "requests verify=False SSL certificate",
    "B307": "eval code injection Python",
    "CWE-78": "OS command injection shell",
    "CWE-79": "XSS cross-site scripting",
    "CWE-89": "SQL injection",
    "CWE-502": "deserialization pickle yaml",
    "CWE-22": "path traversal directory",
}


def first_of(pairs: list[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    out = F.when(pairs[0][0], pairs[0][1])
    for cond, value in pairs[1:]:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def category(raw: Column) -> Column:
    """A category by the words in a raw one; itself, lower-cased, where none is known."""
    low = F.lower(raw)
    any_word = lambda words: low.rlike("|".join(w.replace(".", "\\.") for w in words))
    return first_of([(any_word(w), name) for name, w in CATEGORIES], low)


def vulnerability(code: Column) -> Column:
    """The kind of the first pattern that a code matches, or null."""
    return first_of([(code.rlike("(?i)" + p), kind) for p, kind in VULNERABLE])


def staged_verdict(path: Column, code: Column, severity: Column, confidence: Column) -> Column:
    """Signs of a false alarm in path or code, signs of a true one, then the product of the weights: from 0.6 on true,
    below 0.3 false, else uncertain."""
    from wardspark.functions.severity import lookup
    from wardspark.operators.datasets import any_of

    score = lookup(SEVERITY_WEIGHT, F.upper(severity), 0.5) * lookup(CONFIDENCE_WEIGHT, F.upper(confidence), 0.5)
    return first_of([(any_of(path, FALSE_PATHS, True) | any_of(code, FALSE_CODE, True), "FP"), (any_of(code, TRUE_CODE, True), "TP"), (score >= 0.6, "TP"), (score < 0.3, "FP")], F.lit("UNCERTAIN"))


def inferred_verdict(rule: Column, message: Column, path: Column, code: Column, severity: Column, confidence: Column) -> Column:
    """All phases: false alarms by path, by rule in its context and by code; true ones by code; analysis by rule; the
    product of the weights (from 0.7 on true, up to 0.3 uncertain); words of the message; else true. Null values are
    empty; a confidence that is empty is medium."""
    from wardspark.functions.severity import lookup
    from wardspark.operators.datasets import any_of

    rule, message, path, code, severity, confidence = [F.coalesce(c, F.lit("")) for c in (rule, message, path, code, severity, confidence)]
    low_path, low_code, low_rule = F.lower(path), F.lower(code), F.lower(rule)
    has = lambda c, *words: any_of(c, [w.replace(".", r"\.") for w in words])
    context = F.concat(low_path, F.lit(" "), low_code)
    weight = lookup(SEVERITY_WEIGHT, F.upper(severity), 0.5) * lookup(CONFIDENCE_WEIGHT, F.upper(F.when(confidence == "", "MEDIUM").otherwise(confidence)), 0.7)
    asserts, random = rule.contains("B101") | low_rule.contains("assert"), rule.contains("B311") | low_rule.contains("random")
    secret, markup = rule.rlike("B10[567]"), low_rule.contains("innerhtml") | F.lower(message).contains("xss")
    return first_of(
        [
            (any_of(low_path, FALSE_PATHS, True), "FP"),
            *[(any_of(rule, [r], True) & any_of(context, [p], True), "FP") for r, p in FALSE_RULES],
            (any_of(low_code, FALSE_CODE, True), "FP"),
            (any_of(low_code, TRUE_CODE, True), "TP"),
            (asserts & has(low_path, "auth", "security", "permission", "access"), "UNCERTAIN"),
            (asserts, "FP"),
            (rule.contains("B110") & has(low_code, "security", "auth", "password", "token", "secret"), "TP"),
            (rule.contains("B110") | rule.contains("B404"), "FP"),
            (random & has(low_code, "secret", "token", "password", "key", "salt", "nonce", "iv"), "TP"),
            (random & has(low_code, "shuffle", "sample", "choice", "color", "display", "game"), "FP"),
            (random, "UNCERTAIN"),
            (secret & has(low_code, "xxx", "placeholder", "changeme", "example", "your_"), "FP"),
            (secret & has(low_path, "test", "example", "sample", "config"), "FP"),
            (secret, "TP"),
            (markup & has(low_path, "ckeditor", "tinymce", "vendor", "node_modules", ".min.js"), "FP"),
            (markup & has(low_code, "request", "user", "param", "input"), "TP"),
            (markup, "UNCERTAIN"),
            (weight >= 0.7, "TP"),
            (weight <= 0.3, "UNCERTAIN"),
            (any_of(F.lower(F.concat(rule, F.lit(" "), message)), UNCERTAIN_WORDS, True), "UNCERTAIN"),
        ],
        F.lit("TP"),
    )


def risk_label(label: Column, is_vulnerable: Column, verdict: Column) -> Column:
    """0 or 1 by the first that is given; uncertain verdicts are null."""
    said = F.when(F.upper(verdict) == "TP", 1).when(F.upper(verdict) == "FP", 0)
    return F.coalesce(F.when(label.isin(0, 1), label), is_vulnerable.cast("int"), said)


def unknown_words(rows: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Rows whose value isn't in a closed vocabulary (word)."""
    return rows.join(vocabulary.select(F.col("word").alias(column)), column, "left_anti")


def expanded(query: Column) -> Column:
    """With the terms that go with the first word of the list that it holds, unless it holds these terms too."""
    low = F.lower(query)
    return F.concat(query, F.coalesce(F.concat(F.lit(" "), first_of([(low.contains(t) & ~low.contains(e), e) for t, e in EXPANSIONS])), F.lit("")))


def rule_query(rule: Column) -> Column:
    from wardspark.functions.severity import lookup

    known = lookup(RULE_QUERIES, F.upper(rule), None)
    other = F.when(rule.rlike("^B[0-9]+$"), F.concat(F.lit("Bandit "), rule, F.lit(" Python security vulnerability fix"))).when(F.lower(rule).startswith("cwe"), F.concat(rule, F.lit(" vulnerability security fix pattern")))
    return F.coalesce(known, other, F.concat(rule, F.lit(" security vulnerability fix")))


def label_items(samples: DataFrame) -> DataFrame:
    """One item per weak label of a sample, with its id; null parts of the id are empty."""
    d = samples.select("sample_id", "language", "filepath", F.explode("weak_labels").alias("l"))
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    item = F.sha2(F.concat_ws("|", *[part(c) for c in (F.col("sample_id"), F.col("l.source"), F.col("l.rule_id"), F.when(F.col("l.line") != 0, F.col("l.line")), F.col("l.message"))]), 256)
    return d.select(item.alias("item_id"), "sample_id", "language", "filepath", "l.*")


def hardness(confidence: Column, start: Column, end: Column, line: Column, noisy: Column) -> Column:
    """0 to 4: low confidence, a span over 40 lines, a finding within 2 lines of its edges, a noisy rule."""
    one = lambda c: F.when(c, 1).otherwise(0)
    return one(F.upper(confidence) == "LOW") + one(end - start + 1 > 40) + one((line - start <= 2) | (end - line <= 2)) + one(noisy)


def safe_files(files: DataFrame, findings: DataFrame, per_repo: int, per_file: int = 5) -> DataFrame:
    """Samples (repo, filepath, sample_id) of files without findings, capped by file and by repository."""
    from wardspark.operators.datasets import cap_per, draw

    d = files.join(findings.select("filepath").distinct(), "filepath", "left_anti")
    return cap_per(cap_per(d, "filepath", per_file, "sample_id"), "repo", per_repo, draw("safe", F.col("sample_id")), "sample_id")
