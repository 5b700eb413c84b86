"""Queries over graphs of programs: texts are put together from the customers' numbers, so their graphs can be counted in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.operators import pygraph, scripts
from wardspark.plans.common import table

_A, _B, _C = "c_custkey % 4", "c_nationkey % 5", "cast(floor(abs(c_acctbal)) AS bigint) % 3"
_IF = "    if x > 0:\n        y = 1\n    else:\n        y = 2\n"
_FOR = "    for i in x:\n        y = i\n        z = y\n"
_TRY = "    try:\n        y = 1\n    except E:\n        y = 2\n"


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (the customer's key) and text: a function with so many branches, loops and handlers."""
    many = lambda text, n: F.repeat(F.lit(text), F.expr(f"cast({n} AS int)"))
    text = F.concat(F.lit("def f(x):\n"), many(_IF, _A), many(_FOR, _B), many(_TRY, _C), F.lit("    return x\n"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), text.alias("text"))


def python_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each kind, by program."""
    e = pygraph.edges(pygraph.nodes(programs(spark, sf_dir)))
    return e.groupBy("path", "kind").agg(F.count("*").alias("n"), F.max("dst").alias("last"))


def python_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each name that its definitions reach, by program."""
    return pygraph.flow_edges(programs(spark, sf_dir)).groupBy("path", "name").agg(F.count("*").alias("n"))


_FUNCTION = "function f() {\n  return 1; // }\n}\n"
_CLASS = "export class C {\n  async m(a) {\n    return `${a}}`;\n  }\n}\n"
_ARROW = "const g = (x) => {\n  return call(x);\n};\n"


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (the customer's key), repo, commit and text: so many functions, classes and arrow functions."""
    many = lambda text, n: F.repeat(F.lit(text), F.expr(f"cast({n} AS int)"))
    text = F.concat(many(_FUNCTION, _A), many(_CLASS, _B), many(_ARROW, _C))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit("local/r").alias("repo"), F.lit("WORKDIR").alias("commit"), text.alias("text"))


def script_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of all scripts, with a line before and behind."""
    f = script_files(spark, sf_dir)
    return scripts.code_samples(f, scripts.spans(f), "ts", 1).select("sample_id", "filepath", "kind", "name", "start_line", "start_col", "end_line", "end_col", "code_snippet", "context_before", "context_after", "n_lines")


def script_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all scripts' simple graphs."""
    return scripts.script_graph(script_files(spark, sf_dir))[0]


def python_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of all programs as samples."""
    f = programs(spark, sf_dir).withColumns({"repo": F.lit("local/r"), "commit": F.lit("WORKDIR"), "text": F.concat(F.lit("# head\n"), "text", F.lit("\nclass C:\n    x = 1\ny = 2"))})
    return scripts.code_samples(f, pygraph.spans(f), "python", 2).select("sample_id", "filepath", "kind", "name", "start_line", "end_line", "end_col", "complexity", F.md5("code_snippet").alias("digest"), "context_before", "context_after", "n_lines")


_K = f"k AS (SELECT CAST(c_custkey AS VARCHAR) AS path, {_A} AS a, {_B} AS b, {_C} AS c FROM customer)"
# a branch has 14 nodes, a loop 15, a handler 12; the function, its arguments, the argument and the return are 6
QUERIES = {f.__name__: f for f in (python_graph_edges, python_flow_edges, script_samples, script_nodes, python_samples)}
ORACLE = {
    "python_graph_edges": f"""WITH {_K}, n AS (SELECT *, 6 + 14 * a + 15 * b + 12 * c AS nodes FROM k),
        e AS (SELECT path, unnest([0, 1, 2, 3, 4, 5, 6]) AS kind, unnest([nodes - 1, nodes - 1, a + b + c + b, a + b, a, b, c]) AS n,
            unnest([nodes - 1, nodes - 2, nodes - 3, CASE WHEN b > 0 THEN 3 + 14 * a + 15 * (b - 1) + 5 ELSE 3 + 14 * (a - 1) + 6 END, 3 + 14 * (a - 1) + 10, 3 + 14 * a + 15 * (b - 1), 3 + 14 * a + 15 * b + 12 * (c - 1) + 5]) AS last FROM n)
        SELECT path, CAST(kind AS INTEGER) AS kind, CAST(n AS BIGINT) AS n, CAST(last AS INTEGER) AS last FROM e WHERE n > 0""",
    "python_flow_edges": f"""WITH {_K}, e AS (SELECT path, unnest(['x', 'i', 'y']) AS name, unnest([a + b + 1, b, b]) AS n FROM k)
        SELECT path, name, CAST(n AS BIGINT) AS n FROM e WHERE n > 0""",
    "script_samples": f"""WITH {_K}, s AS (
          SELECT path, a, b, c, 'function' AS kind, 'f' AS name, 3 * i + 1 AS x, 0 AS y, 3 * i + 3 AS z, 1 AS w FROM (SELECT *, unnest(range(0, a)) AS i FROM k)
          UNION ALL SELECT path, a, b, c, 'class', 'C', 3 * a + 5 * i + 1, 7, 3 * a + 5 * i + 5, 1 FROM (SELECT *, unnest(range(0, b)) AS i FROM k)
          UNION ALL SELECT path, a, b, c, 'method', 'm', 3 * a + 5 * i + 2, 2, 3 * a + 5 * i + 4, 3 FROM (SELECT *, unnest(range(0, b)) AS i FROM k)
          UNION ALL SELECT path, a, b, c, 'arrow', 'g', 3 * a + 5 * b + 3 * i + 1, 10, 3 * a + 5 * b + 3 * i + 3, 1 FROM (SELECT *, unnest(range(0, c)) AS i FROM k)),
        l AS (SELECT *, string_split(repeat('{_FUNCTION}', CAST(a AS BIGINT)) || repeat('{_CLASS}', CAST(b AS BIGINT)) || repeat('{_ARROW}', CAST(c AS BIGINT)), chr(10)) AS rows, 3 * a + 5 * b + 3 * c AS n FROM s)
        SELECT sha256('ts|local/r|WORKDIR|' || path || '|' || x || '|' || z) AS sample_id, path AS filepath, kind, name, CAST(x AS INTEGER) AS start_line, y AS start_col, CAST(z AS INTEGER) AS end_line, w AS end_col,
          array_to_string(rows[x:z], chr(10)) AS code_snippet, CASE WHEN x > 1 THEN rows[x - 1] ELSE '' END AS context_before, CASE WHEN z < n THEN rows[z + 1] ELSE '' END AS context_after, CAST(n AS INTEGER) AS n_lines FROM l""",
    "python_samples": f"""WITH {_K}, t AS (SELECT *, 4 * a + 3 * b + 4 * c + 2 AS n, 'def f(x):' || chr(10) || repeat('{_IF}', CAST(a AS BIGINT)) || repeat('{_FOR}', CAST(b AS BIGINT)) || repeat('{_TRY}', CAST(c AS BIGINT)) || '    return x' AS code FROM k),
        s AS (SELECT path, 'function' AS kind, 'f' AS name, 2 AS x, n + 1 AS z, 12 AS w, 1 + a + b + 2 * c AS complexity, code, '# head' AS before, chr(10) || 'class C:' AS after, n FROM t
          UNION ALL SELECT path, 'class', 'C', n + 3, n + 4, 9, NULL, 'class C:' || chr(10) || '    x = 1', '    return x' || chr(10), 'y = 2', n FROM t)
        SELECT sha256('python|local/r|WORKDIR|' || path || '|' || x || '|' || z) AS sample_id, path AS filepath, kind, name, CAST(x AS INTEGER) AS start_line, CAST(z AS INTEGER) AS end_line, w AS end_col, CAST(complexity AS INTEGER) AS complexity,
          md5(code) AS digest, before AS context_before, after AS context_after, CAST(n + 5 AS INTEGER) AS n_lines FROM s""",
    "script_nodes": f"""WITH {_K}, s AS (
          SELECT path, 0 AS n, 'FunctionDef' AS type, 'f' AS name, 3 * i + 1 AS line, 0 AS o FROM (SELECT *, unnest(range(0, a)) AS i FROM k)
          UNION ALL SELECT path, 1, 'ClassDef', 'C', 3 * a + 5 * i + 1, 0 FROM (SELECT *, unnest(range(0, b)) AS i FROM k)
          UNION ALL SELECT path, 2, 'ConstDef', 'g', 3 * a + 5 * b + 3 * i + 1, 0 FROM (SELECT *, unnest(range(0, c)) AS i FROM k)
          UNION ALL SELECT path, 5, 'Call', 'f', 3 * i + 1, 0 FROM (SELECT *, unnest(range(0, a)) AS i FROM k)
          UNION ALL SELECT path, 5, 'Call', 'm', 3 * a + 5 * i + 2, 0 FROM (SELECT *, unnest(range(0, b)) AS i FROM k)
          UNION ALL SELECT path, 5, 'Call', 'call', 3 * a + 5 * b + 3 * i + 2, 0 FROM (SELECT *, unnest(range(0, c)) AS i FROM k))
        SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n, line) - 1 AS INTEGER) AS node, type, name, CAST(line AS INTEGER) AS line FROM s""",
}
