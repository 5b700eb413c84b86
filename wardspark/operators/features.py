"""Feature vectors of code, each a projection of its own: fields of one name differ from vector to vector."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardspark.functions.severity import SEVERITY_WEIGHT, lookup
from wardspark.functions.text import code_tokens


def _any(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _times(text: Column, *words: str) -> Column:
    """How often words stand in a text, without overlaps."""
    one = lambda w: F.floor((F.char_length(text) - F.char_length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("int")
    return reduce(lambda a, b: a + b, [one(w) for w in words])


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _longest(lines: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(lines, F.char_length)), F.lit(0))


def _mean_line(text: Column, lines: Column) -> Column:
    """Mean length of the lines, line feeds left out."""
    return (F.char_length(text) - F.size(lines) + 1) / F.size(lines)


def _depth(lines: Column, blank: bool) -> Column:
    """White space before the first sign of a line, in fours, of the deepest line; blank lines count or don't."""
    rows = lines if blank else F.filter(lines, lambda x: x.rlike(r"\S"))
    indent = F.transform(rows, lambda x: F.char_length(F.regexp_extract(x, r"^\s*", 0)))
    return F.floor(F.coalesce(F.array_max(indent), F.lit(0)) / 4).cast("int")


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def consensus_features(code: Column, category: Column, scanners: Column, severity: Column) -> Column:
    """Of a merged finding: code, category, scanners (an array) and severity."""
    low, kind = F.lower(code), F.lower(category)
    return _struct(
        scanner_count=F.size(scanners),
        has_bandit=F.array_contains(scanners, "bandit"),
        has_semgrep=F.array_contains(scanners, "semgrep"),
        has_secrets_scanner=F.array_contains(scanners, "secrets"),
        has_pattern_scanner=F.array_contains(scanners, "patterns"),
        has_dependency_scanner=F.array_contains(scanners, "dependencies"),
        scanner_agreement_ratio=F.size(scanners) / 5.0,
        severity_score=lookup(SEVERITY_WEIGHT, F.upper(severity), 0.5),
        is_injection=kind.contains("injection"),
        is_secrets=_any(kind, "secret", "credential"),
        is_crypto=kind.contains("crypto"),
        is_xss=kind.contains("xss"),
        is_path_traversal=kind.contains("path"),
        is_deserialization=_any(kind, "deserial", "pickle"),
        is_dependency_vuln=_any(kind, "dependency", "cve"),
        code_length=F.char_length(code),
        has_user_input=_any(low, "request", "input", "args", "params", "query"),
        has_dangerous_function=_any(low, "eval", "exec", "system", "popen", "shell"),
        has_sql_keyword=_any(F.upper(code), "SELECT", "INSERT", "UPDATE", "DELETE", "DROP"),
        has_file_operation=_any(low, "open(", "read(", "write(", "file"),
    )


def sample_features(code: Column) -> Column:
    """Of a labelled sample's code."""
    lines = _lines(code)
    return _struct(
        n_lines=F.size(lines),
        n_chars=F.char_length(code),
        n_tokens=F.least(F.size(code_tokens(code)), F.lit(512)),
        avg_line_length=_mean_line(code, lines),
        has_import=code.contains("import "),
        has_function_def=code.contains("def "),
        has_class_def=code.contains("class "),
        has_try_except=_any(code, "try:", "except"),
        has_eval=code.contains("eval("),
        has_exec=code.contains("exec("),
        has_subprocess=code.contains("subprocess"),
        has_os_system=code.contains("os.system"),
        has_sql=_any(F.lower(code), "select", "insert", "update", "delete", "execute"),
        has_shell=_any(code, "shell=True", "shell = True"),
    )


def generated_features(code: Column, n_tokens: Column) -> Column:
    """Of a sample made from a merged finding, whose tokens are counted already."""
    lines = _lines(code)
    return _struct(
        n_lines=F.size(lines),
        n_chars=F.char_length(code),
        n_tokens=n_tokens,
        avg_line_length=_mean_line(code, lines),
        max_line_length=_longest(lines),
        n_functions=_times(code, "def ", "function "),
        n_classes=_times(code, "class "),
        n_imports=_times(code, "import ", "from "),
        n_comments=_times(code, "#", "//", "/*"),
        has_try_except=_any(code, "try:", "try {"),
        has_assert=code.contains("assert "),
        has_logging=_any(code, "logger.", "logging.", "console.log"),
        has_hardcoded_string=_any(code, '"sk-', '"pk_') | F.lower(code).contains('"aws_'),
        has_sql_keywords=_any(F.upper(code), "SELECT", "INSERT", "UPDATE", "DELETE"),
        has_shell_calls=_any(code, "os.system", "subprocess", "shell=True", "exec("),
        has_file_ops=_any(code, "open(", ".read(", ".write(", "file"),
        has_network=_any(code, "requests.", "http", "socket", "urllib"),
        has_crypto=_any(code, "hashlib", "crypto", "encrypt", "decrypt"),
        has_user_input=_any(code, "request.", "input(", "argv", "args"),
        indentation_depth=_depth(lines, blank=False),
    )


def improved_features(code: Column, n_tokens: Column) -> Column:
    """Of a sample of the improved set, whose tokens are counted already."""
    lines = _lines(code)
    return _struct(
        n_lines=F.size(lines),
        n_chars=F.char_length(code),
        n_tokens=n_tokens,
        avg_line_length=_mean_line(code, lines),
        max_line_length=_longest(lines),
        n_functions=_times(code, "def ", "function "),
        n_classes=_times(code, "class "),
        n_imports=_times(code, "import ", "require("),
        n_comments=_times(code, "#", "//"),
        has_try_except=_any(code, "try:", "try {"),
        has_assert=code.contains("assert "),
        has_logging=_any(code, "logging.", "logger.", "console.log"),
        has_hardcoded_string=code.rlike("[\"'][a-zA-Z0-9]{16,}[\"']"),
        has_sql_keywords=code.rlike(r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|WHERE)\b"),
        has_shell_calls=_any(code, "subprocess", "os.system", "exec("),
        has_file_ops=_any(code, "open(", "read(", "write("),
        has_network=_any(code, "requests.", "urllib") | F.lower(code).contains("http"),
        has_crypto=code.contains("hashlib") | F.lower(code).contains("crypto") | code.contains("encrypt"),
        has_user_input=_any(code, "input(", "request.", "argv"),
        indentation_depth=_depth(lines, blank=True),
    )


def engineered_features(code: Column, path: Column, rule: Column, severity: Column, confidence: Column) -> Column:
    """Of a finding with its code: 36 numbers. The rule's number comes from a hash that is the same everywhere."""
    lines = _lines(code)
    number = lambda p: F.regexp_count(code, F.lit(p))
    flag = lambda c, p: c.rlike(p).cast("int")
    deep = F.transform(F.filter(lines, lambda x: x.rlike(r"\S")), lambda x: F.when(x.rlike(r"^\s+"), 1).otherwise(0))
    return _struct(
        code_lines=F.size(lines),
        code_chars=F.char_length(code),
        avg_line_length=F.char_length(code) / F.size(lines),
        max_line_length=_longest(lines),
        blank_line_ratio=F.size(F.filter(lines, lambda x: ~x.rlike(r"\S"))) / F.size(lines),
        nested_depth=F.floor(F.coalesce(F.array_max(deep), F.lit(0)) / 4).cast("int"),
        function_count=number(r"\bdef\s+\w+|function\s+\w+"),
        class_count=number(r"\bclass\s+\w+"),
        loop_count=number(r"\bfor\b|\bwhile\b"),
        conditional_count=number(r"\bif\b|\belse\b|\belif\b"),
        has_eval=flag(code, r"\beval\s*\("),
        has_exec=flag(code, r"\bexec\s*\("),
        has_subprocess=flag(code, r"\bsubprocess\b"),
        has_shell_true=flag(code, r"shell\s*=\s*True"),
        has_sql=flag(code, r"(?i)\bSELECT\b|\bINSERT\b|\bUPDATE\b|\bDELETE\b"),
        has_request=flag(code, r"request\.|req\."),
        has_user_input=flag(code, r"input\(|argv|request\.(get|post|form|args)"),
        has_file_ops=flag(code, r"open\s*\(|read\(|write\("),
        has_crypto=flag(code, r"(?i)md5|sha1|hashlib|crypto"),
        has_pickle=flag(code, "pickle|marshal"),
        has_yaml_load=flag(code, r"yaml\.load|yaml\.unsafe"),
        has_innerhtml=flag(code, "innerHTML|dangerouslySetInnerHTML"),
        string_concat_count=number("\\+\\s*[\"']|[\"']\\s*\\+"),
        fstring_count=number("f[\"']"),
        format_count=number(r"\.format\s*\("),
        percent_format_count=number(r"%\s*\("),
        severity_score=lookup({"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}, F.upper(F.coalesce(severity, F.lit("MEDIUM"))), 2),
        confidence_score=lookup({"HIGH": 3, "MEDIUM": 2, "LOW": 1}, F.upper(F.coalesce(confidence, F.lit("MEDIUM"))), 2),
        is_test_file=flag(path, "(?i)test|spec|mock|fixture"),
        is_vendor=flag(path, "(?i)vendor|node_modules|static"),
        is_config=flag(path, r"(?i)config|settings|\.env"),
        path_depth=_times(path, "/"),
        is_bandit=rule.startswith("B").cast("int"),
        is_semgrep=F.lower(rule).contains("semgrep").cast("int"),
        rule_hash=F.pmod(F.xxhash64(rule), F.lit(1000)).cast("int"),
    )


def gold_features(code: Column, scanners: Column) -> Column:
    """Of a gold label: code and the scanners (an array) that agree."""
    return _struct(
        n_lines=F.size(_lines(code)),
        n_chars=F.char_length(code),
        scanner_count=F.size(scanners),
        has_bandit=F.array_contains(scanners, "bandit"),
        has_semgrep=F.array_contains(scanners, "semgrep"),
        has_secrets=F.array_contains(scanners, "secrets"),
        has_patterns=F.array_contains(scanners, "patterns"),
        has_deps=F.array_contains(scanners, "dependencies"),
        has_user_input=_any(code, "request", "input", "argv", "args"),
        has_dangerous_fn=_any(code, "eval", "exec", "system", "pickle"),
        has_sql=_any(F.upper(code), "SELECT", "INSERT", "UPDATE", "DELETE"),
    )
