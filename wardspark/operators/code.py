"""Source code: pattern rules on lines, and Python syntax trees by UDTFs."""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from wardspark.functions.text import language_of

# fixed values: rules on lines: id, severity, category, weakness, pattern
PYTHON_RULES = [
    ("PATTERN-PY-001", "critical", "injection", "CWE-95", r"\beval\s*\("),
    ("PATTERN-PY-002", "critical", "injection", "CWE-95", r"\bexec\s*\("),
    ("PATTERN-PY-003", "critical", "deserialization", "CWE-502", r"\bpickle\.loads?\s*\("),
    ("PATTERN-PY-004", "high", "deserialization", "CWE-502", r"\byaml\.load\s*\([^)]*\)(?!\s*,\s*Loader\s*=\s*(?:yaml\.)?SafeLoader)"),
    ("PATTERN-PY-005", "high", "injection", "CWE-78", r"subprocess\.\w+\s*\([^)]*shell\s*=\s*True"),
    ("PATTERN-PY-006", "high", "injection", "CWE-78", r"\bos\.system\s*\("),
    ("PATTERN-PY-007", "medium", "crypto", "CWE-327", r"\bhashlib\.md5\s*\("),
    ("PATTERN-PY-008", "medium", "crypto", "CWE-327", r"\bhashlib\.sha1\s*\("),
    ("PATTERN-PY-009", "medium", "crypto", "CWE-330", r"\brandom\.(choice|randint|random|shuffle|sample)\s*\("),
    ("PATTERN-PY-010", "low", "misc", "CWE-617", r"^\s*assert\s+.+,?\s*['\"]"),
    ("PATTERN-PY-011", "low", "misc", "CWE-396", r"\bexcept\s*:"),
    ("PATTERN-PY-012", "medium", "network", "CWE-400", r"requests\.(get|post|put|delete|patch|head|options)\s*\([^)]+\)"),
    ("PATTERN-PY-013", "high", "crypto", "CWE-295", r"requests\.\w+\s*\([^)]*verify\s*=\s*False"),
    ("PATTERN-PY-014", "medium", "network", "CWE-200", r"host\s*=\s*['\"]0\.0\.0\.0['\"]"),
    ("PATTERN-PY-015", "medium", "config", "CWE-215", r"(?i)(debug\s*=\s*True|DEBUG\s*=\s*True)"),
    ("PATTERN-PY-016", "high", "injection", "CWE-89", r"(execute|cursor\.execute)\s*\([^)]*(%s|\.format\(|f['\"])"),
    ("PATTERN-PY-017", "medium", "misc", "CWE-377", r"\btempfile\.mktemp\s*\("),
    ("PATTERN-PY-018", "high", "injection", "CWE-611", r"\b(xml\.etree|xml\.dom|xml\.sax)\.\w+\.(parse|fromstring)"),
]
SCRIPT_RULES = [
    ("PATTERN-JS-001", "critical", "injection", "CWE-95", r"\beval\s*\("),
    ("PATTERN-JS-002", "high", "xss", "CWE-79", r"\.innerHTML\s*="),
    ("PATTERN-JS-003", "high", "xss", "CWE-79", r"\bdocument\.write\s*\("),
    ("PATTERN-JS-004", "high", "xss", "CWE-79", r"\.outerHTML\s*="),
    ("PATTERN-JS-005", "critical", "injection", "CWE-95", r"\bnew\s+Function\s*\("),
    ("PATTERN-JS-006", "high", "injection", "CWE-95", r"(setTimeout|setInterval)\s*\(\s*['\"]"),
    ("PATTERN-JS-007", "medium", "injection", "CWE-1333", r"\bnew\s+RegExp\s*\("),
    ("PATTERN-JS-008", "medium", "redirect", "CWE-601", r"location\.(href|replace)\s*="),
    ("PATTERN-JS-009", "high", "misc", "CWE-346", r"\.postMessage\s*\([^,]+,\s*['\"]?\*['\"]?\s*\)"),
    ("PATTERN-JS-010", "medium", "storage", "CWE-922", r"(?i)localStorage\.(setItem|getItem)\s*\([^)]*(token|password|secret|key|auth)"),
    ("PATTERN-JS-011", "low", "logging", "CWE-532", r"(?i)console\.(log|debug|info)\s*\([^)]*(password|secret|token|key|credential)"),
    ("PATTERN-JS-012", "high", "xss", "CWE-79", r"dangerouslySetInnerHTML"),
    ("PATTERN-JS-013", "high", "injection", "CWE-89", r"(query|execute)\s*\(\s*`[^`]*\$\{"),
    ("PATTERN-JS-014", "medium", "config", "CWE-346", r"cors\s*\(\s*\{[^}]*origin\s*:\s*['\"]?\*['\"]?"),
    ("PATTERN-JS-015", "high", "config", "CWE-352", r"(?i)csrf\s*[=:]\s*(false|disabled|off)"),
]
# fixed values: calls that are reported, bare and by module
CALLS = {"eval": "critical", "exec": "critical", "compile": "high", "input": "low", "__import__": "medium"}
MODULES = {
    "pickle": ["load", "loads", "Unpickler"],
    "marshal": ["load", "loads"],
    "yaml": ["load", "unsafe_load"],
    "subprocess": ["call", "run", "Popen", "check_output", "check_call"],
    "os": ["system", "popen", "spawn", "exec"],
    "commands": ["getoutput", "getstatusoutput"],
}


def scan_lines(files: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """files: path, text. path, line, rule_id, severity, category, cwe of every rule that a line matches; comment lines
    don't count. The lines are cut once; a line meets an array of its language's rules, so nothing is multiplied out
    but hits. rules: in place of those by language, for all files."""
    lang = language_of(F.col("path"))
    d = files.select("path", lang.alias("lang"), F.posexplode(F.split("text", "\n")).alias("k", "row"))
    comment = F.ltrim("row").startswith("#") & (F.col("lang") == "python") | (F.ltrim("row").startswith("//") | F.ltrim("row").startswith("*")) & (F.col("lang") != "python")
    groups = [(F.lit(True), rules)] if rules is not None else [(F.col("lang") == "python", PYTHON_RULES), (F.col("lang").isin("javascript", "typescript"), SCRIPT_RULES)]
    hits = []
    for where, group in groups:
        for r in group:
            value = F.struct(*[F.lit(x).alias(n) for n, x in zip(("rule_id", "severity", "category", "cwe"), r, strict=False)])
            hits.append(F.when(where & F.col("row").rlike(r[4]), value))
    # one look with all patterns of the language first: most lines match none
    may = reduce(lambda a, b: a | b, [where & F.col("row").rlike("|".join(f"(?:{r[4]})" for r in group)) for where, group in groups])
    d = d.where(~comment & may).select("path", (F.col("k") + 1).alias("line"), F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("x"))
    return d.select("path", "line", "x.*")


@udtf(returnType="name string, kind string, start_line int, end_line int, complexity int")
class PyFunctions:
    """Functions and classes at the top of a Python text, up to 400 lines each; nothing for a text that doesn't parse."""

    def eval(self, code: str):
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError):
            return
        branch = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension)
        for n in tree.body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n.end_lineno - n.lineno + 1 <= 400:
                inner = list(ast.walk(n))
                c = 1 + sum(isinstance(x, branch) for x in inner) + sum(len(x.values) - 1 for x in inner if isinstance(x, ast.BoolOp))
                yield n.name, "class" if isinstance(n, ast.ClassDef) else "function", n.lineno, n.end_lineno, c


@udtf(returnType="rule_id string, severity string, line int")
class PyCalls:
    """Dangerous calls by the syntax tree, bare names and module members."""

    def eval(self, code: str):
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError):
            return
        for n in ast.walk(tree):
            if isinstance(n, ast.Call):
                f = n.func
                if isinstance(f, ast.Name) and f.id in CALLS:
                    yield f"AST-{f.id}", CALLS[f.id], n.lineno
                elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.attr in MODULES.get(f.value.id, ()):
                    yield f"AST-{f.value.id}.{f.attr}", "high", n.lineno


@udtf(returnType="src int, dst int, kind string, src_type string, dst_type string, line int")
class PyGraph:
    """Edges of a Python text's syntax tree: child, next (statements in a body), use (first to later places of a name);
    nodes are numbered in depth-first order, up to 2048, edges are cut at 8192."""

    def eval(self, code: str):
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError):
            return
        number, order, stack = {}, [], [tree]
        while stack and len(order) < 2048:
            n = stack.pop()
            number[id(n)] = len(order)
            order.append(n)
            stack += reversed(list(ast.iter_child_nodes(n)))
        edges, first = [], {}
        for n in order:
            for c in ast.iter_child_nodes(n):
                if id(c) in number:
                    edges.append((n, c, "child"))
            for body in (getattr(n, k, None) for k in ("body", "orelse", "finalbody")):
                if isinstance(body, list):
                    edges += [(a, b, "next") for a, b in zip(body, body[1:]) if id(a) in number and id(b) in number]
            if isinstance(n, ast.Name):
                if n.id in first:
                    edges.append((first[n.id], n, "use"))
                first.setdefault(n.id, n)
        for a, b, k in edges[:8192]:
            yield number[id(a)], number[id(b)], k, type(a).__name__, type(b).__name__, getattr(a, "lineno", 0)


def register(spark: SparkSession) -> None:
    """The table functions, for SQL."""
    for name, f in (("py_functions", PyFunctions), ("py_calls", PyCalls), ("py_graph", PyGraph)):
        spark.udtf.register(name, f)


def functions_of(files: DataFrame) -> DataFrame:
    """files: path, text."""
    register(files.sparkSession)
    files.createOrReplaceTempView("_files")
    return files.sparkSession.sql("SELECT f.path, t.* FROM _files f, LATERAL py_functions(f.text) t")
