"""Graphs of Python texts: nodes from the parser, seven kinds of edges, and what flows from definitions to uses.

A text is parsed once and gives out its nodes, each with its place under its parent and among the edges of control; all
kinds of edges but the flow are projections of that table, without a shuffle. The flow is reaching definitions: an
environment of the definitions that can hold for each name goes through the statements, is joined where ways meet, and
goes round loops until it stays. Texts are spread over tasks first, and a worker keeps the rows of the texts that it has met.
"""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from wardspark.operators.graphs import feature_hash

# fixed values: numbers of the kinds of edges, sizes of the hash spaces, most nodes and edges of a graph
PARENT, CHILD, NEXT, TRUE, FALSE, LOOP, EXCEPT = range(7)
TYPE_BUCKETS, NAME_BUCKETS = 1024, 65536
MOST_NODES, MOST_EDGES = 2048, 8192
LISTS = ["body", "orelse", "handlers", "finalbody"]
LITERALS = ["string", "number", "bool", "null", "bytes"]
#: Bytes of texts and their rows that a worker keeps before it starts anew, and rows of a batch that it gives out.
KEPT, BATCH = 32 << 20, 1 << 15

NODE = "graph int, node int, size int, walk int, parent int, parent_walk int, parent_type string, field string, place int, last boolean, next int, next_at int, ways_at int, type string, name string, literal string, depth int, line int, cut boolean"
FLOW = "graph int, name string, src int, dst int"


def roots(code: str | None) -> list[ast.AST]:
    """The functions at the top of a text, or its module if it has none; a text that only parses with less indentation or
    within a function is taken so, one that doesn't parse has none."""
    if not (code or "").strip():
        return []
    bare = textwrap.dedent(code)
    for text in (code, bare, "def __snippet__():\n" + textwrap.indent(bare, "    ")):
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
        return [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] or [tree]
    return []


def numbered(root: ast.AST, most: int) -> list[tuple]:
    """Nodes in the order of the text, with parent, field, place and depth, as far as there are numbers."""
    out, stack = [], [(root, None, None, 0, True, 0)]
    while stack and len(out) < most:
        node, parent, field, place, last, depth = stack.pop()
        number = len(out)
        out.append((node, parent, field, place, last, depth))
        below = []
        for f, value in ast.iter_fields(node):
            if isinstance(value, list):
                kids = [v for v in value if isinstance(v, ast.AST)]
                below += [(v, number, f, k, k == len(kids) - 1, depth + 1) for k, v in enumerate(kids)]
            elif isinstance(value, ast.AST):
                below.append((value, number, None, 0, True, depth + 1))
        stack += reversed(below)
    return out


def _name(n: ast.AST) -> str | None:
    return getattr(n, "id", None) or getattr(n, "attr", None) or (n.arg if isinstance(n, ast.arg) else n.name if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None)


def _literal(n: ast.AST) -> str | None:
    if not isinstance(n, ast.Constant) or n.value is Ellipsis:
        return None
    return "string" if isinstance(n.value, str) else "null" if n.value is None else "bytes" if isinstance(n.value, bytes) else "number"


def controlled(rows: list[tuple], walk: dict[int, int]) -> list[tuple]:
    """Of each numbered node: the next of its list, that edge's place among the edges of control, and the place of the first
    way between its parent and its parent's lists. The order is that of parents in breadth, of lists, then of ways."""
    lists: dict[int, dict[str, list[int]]] = {}
    for k, (_, parent, field, *_) in enumerate(rows):
        if field in LISTS:
            lists.setdefault(parent, {}).setdefault(field, []).append(k)
    out: list[tuple] = [(None, None, None)] * len(rows)
    at = 0
    for p in sorted(lists, key=lambda p: walk[id(rows[p][0])]):
        below, after = lists[p], {}
        for field in LISTS:
            for a, b in zip(below.get(field, ()), below.get(field, ())[1:]):
                after[a] = (b, at)
                at += 1
        for k in (k for ks in below.values() for k in ks):
            out[k] = (*after.get(k, (None, None)), at)
        node, body = rows[p][0], below.get("body")
        loop = isinstance(node, (ast.For, ast.AsyncFor, ast.While))
        if loop or isinstance(node, ast.If):
            at += bool(body) + bool(loop and body and rows[body[-1]][4]) + ("orelse" in below)
        elif isinstance(node, ast.Try):
            at += "handlers" in below
    return out


def node_rows(code: str | None, most: int) -> Iterator[tuple]:
    for g, root in enumerate(roots(code)):
        walk = {id(n): k for k, n in enumerate(ast.walk(root))}
        rows = numbered(root, most + 1)
        cut, rows = len(rows) > most, rows[:most]
        for k, ((n, parent, field, place, last, depth), control) in enumerate(zip(rows, controlled(rows, walk))):
            p = rows[parent][0] if parent is not None else None
            yield g, k, len(rows), walk[id(n)], parent, None if p is None else walk[id(p)], None if p is None else type(p).__name__, field, place, last, *control, type(n).__name__, _name(n), _literal(n), depth, getattr(n, "lineno", 0) or 0, cut


class Flow:
    """The definitions that reach each use of a name in a function or module."""

    def __init__(self, root: ast.AST):
        self.edges: set[tuple[ast.AST, ast.AST]] = set()
        self.jumps: list[dict[str, list]] = []  # environments at break and continue, by loop
        self.risky: list[list[dict]] = []  # environments in which a statement of a try body may fail
        env: dict[str, frozenset] = {}
        if isinstance(root, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = root.args
            for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg]:
                if x is not None:
                    env[x.arg] = frozenset([x])
        self.block(root.body, env)

    @staticmethod
    def join(*envs: dict | None) -> dict | None:
        some = [e for e in envs if e is not None]
        return {k: frozenset().union(*[e.get(k, frozenset()) for e in some]) for e in some for k in e} if some else None

    def use(self, node: ast.AST | None, env: dict) -> None:
        """What an expression reads; what it defines by the way."""
        if node is None:
            return
        if isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Load):
                self.edges |= {(d, node) for d in env.get(node.id, ())}
        elif isinstance(node, ast.Lambda):
            for d in [*node.args.defaults, *node.args.kw_defaults]:
                self.use(d, env)
            own = {x.arg for x in ast.walk(node.args) if isinstance(x, ast.arg)}
            self.use(node.body, {k: v for k, v in env.items() if k not in own})
        elif isinstance(node, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            inner = dict(env)
            for g in node.generators:
                self.use(g.iter, inner)
                self.bind(g.target, inner)
                for x in g.ifs:
                    self.use(x, inner)
            for x in [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]:
                self.use(x, inner)
        elif isinstance(node, ast.NamedExpr):
            self.use(node.value, env)
            self.bind(node.target, env)
        else:
            for x in ast.iter_child_nodes(node):
                self.use(x, env)

    def bind(self, target: ast.AST | None, env: dict) -> None:
        """Names that a target or pattern defines, in place of what they had."""
        for x in ast.walk(target) if target is not None else ():
            if isinstance(x, ast.Name) and not isinstance(x.ctx, ast.Load):
                env[x.id] = frozenset([x]) if isinstance(x.ctx, ast.Store) else frozenset()
            elif isinstance(x, (ast.MatchAs, ast.MatchStar)) and x.name:
                env[x.name] = frozenset([x])
            elif isinstance(x, ast.MatchMapping) and x.rest:
                env[x.rest] = frozenset([x])
            else:
                self.use(x, env) if isinstance(x, ast.Name) else None

    def block(self, body: list[ast.stmt], env: dict | None) -> dict | None:
        for s in body:
            if env is None:
                return None
            if self.risky:
                self.risky[-1].append(env)
            env = self.step(s, dict(env))
            if self.risky and env is not None:
                self.risky[-1].append(env)
        return env

    def step(self, s: ast.stmt, env: dict) -> dict | None:
        """The environment behind a statement; none if nothing goes on there."""
        if isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
                self.edges |= {(d, s.target) for d in env.get(s.target.id, ())}
            self.use(s.value, env)
            if not isinstance(s, ast.AnnAssign) or s.value is not None:
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    self.bind(t, env)
        elif isinstance(s, ast.If):
            self.use(s.test, env)
            return self.join(self.block(s.body, env), self.block(s.orelse, env))
        elif isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            return self.loop(s, env)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for i in s.items:
                self.use(i.context_expr, env)
                self.bind(i.optional_vars, env)
            return self.block(s.body, env)
        elif isinstance(s, (ast.Try, ast.TryStar)):
            return self.attempt(s, env)
        elif isinstance(s, ast.Match):
            self.use(s.subject, env)
            ways = []
            for c in s.cases:
                inner = dict(env)
                self.bind(c.pattern, inner)
                self.use(c.guard, inner)
                ways.append(self.block(c.body, inner))
            return self.join(env, *ways)
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for x in [*s.decorator_list, *(s.bases if isinstance(s, ast.ClassDef) else [*s.args.defaults, *s.args.kw_defaults])]:
                self.use(x, env)
            env[s.name] = frozenset([s])
        elif isinstance(s, (ast.Import, ast.ImportFrom)):
            for a in s.names:
                env[a.asname or a.name.split(".")[0]] = frozenset([a])
        elif isinstance(s, ast.Delete):
            for t in s.targets:
                self.bind(t, env)
        elif isinstance(s, (ast.Break, ast.Continue)):
            if self.jumps:
                self.jumps[-1][type(s).__name__].append(env)
            return None
        else:
            self.use(s, env)
            return None if isinstance(s, (ast.Return, ast.Raise)) else env
        return env

    def loop(self, s: ast.stmt, env: dict) -> dict | None:
        if not isinstance(s, ast.While):
            self.use(s.iter, env)
        head = env
        while True:
            inner = dict(head)
            self.use(s.test, inner) if isinstance(s, ast.While) else self.bind(s.target, inner)
            self.jumps.append({"Break": [], "Continue": []})
            back = self.block(s.body, inner)
            jumps = self.jumps.pop()
            again = self.join(env, back, *jumps["Continue"])
            if again == head:
                break
            head = again
        done = dict(head)
        if isinstance(s, ast.While):
            self.use(s.test, done)
        return self.join(self.block(s.orelse, done), *jumps["Break"])

    def attempt(self, s: ast.stmt, env: dict) -> dict | None:
        self.risky.append([])
        good = self.block(s.body, env)
        failed = self.join(env, *self.risky.pop())
        ways = [self.block(s.orelse, good) if good is not None else None]
        for h in s.handlers:
            inner = dict(failed)
            self.use(h.type, inner)
            if h.name:
                inner[h.name] = frozenset([h])
            ways.append(self.block(h.body, inner))
        out = self.join(*ways)
        if not s.finalbody:
            return out
        behind = self.block(s.finalbody, self.join(out, failed))
        return None if out is None else behind


def flow_rows(code: str | None, most: int) -> Iterator[tuple]:
    for g, root in enumerate(roots(code)):
        number = {id(n): k for k, (n, *_) in enumerate(numbered(root, most))}
        found = {(number.get(id(a)), number.get(id(b)), b.id) for a, b in Flow(root).edges}
        for a, b, name in sorted(x for x in found if x[0] is not None and x[1] is not None):
            yield g, name, a, b


@udtf(returnType="kind string, name string, start_line int, start_col int, end_line int, end_col int, complexity int", useArrow=True)
class PySpans:
    def eval(self, code: str):
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        branch = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.IfExp, ast.ExceptHandler, ast.BoolOp, ast.comprehension)
        for n in tree.body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                of_class = isinstance(n, ast.ClassDef)
                yield "class" if of_class else "function", n.name, n.lineno, n.col_offset, n.end_lineno, n.end_col_offset, None if of_class else 1 + sum(isinstance(x, branch) for x in ast.walk(n))


def spans(files: DataFrame) -> DataFrame:
    """files: path, text. Functions and classes at the top of each text, and the cyclomatic complexity of functions: one,
    and one for each branch, loop, handler, with, comprehension and chain of and or or. Columns count bytes."""
    return files.select("path", "text").lateralJoin(PySpans(F.col("text").outer())).drop("text")


_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_kept: dict[tuple, pa.RecordBatch] = {}
_kept_bytes = 0


def _table(rows: Callable, schema: str, code: str | None, most: int) -> pa.RecordBatch:
    """The rows of a text, made once for equal texts that come close together."""
    global _kept_bytes
    key = (rows.__name__, code, most)
    if key not in _kept:
        fields = [f.split() for f in schema.split(", ")]
        found = list(rows(code, most))
        columns = zip(*found) if found else [()] * len(fields)
        made = pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])
        if _kept_bytes > KEPT:
            _kept.clear()
            _kept_bytes = 0
        _kept[key] = made
        _kept_bytes += made.nbytes + 4 * len(code or "") + 1024
    return _kept[key]


def _parsed(files: DataFrame, rows: Callable, schema: str, most: int) -> DataFrame:
    """files: path, text. The rows of each text. Parsing takes far longer than sending, so texts go to as many tasks as a
    shuffle has, however few parts they were read in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, tables, start, n = batch.column("path"), [], 0, 0
            for k in range(batch.num_rows):
                tables.append(_table(rows, schema, batch.column("text")[k].as_py(), most))
                n += tables[-1].num_rows
                if n >= BATCH or k == batch.num_rows - 1:
                    path = paths.take(pa.array(np.repeat(np.arange(start, k + 1), [t.num_rows for t in tables])))
                    out = pa.Table.from_batches(tables).combine_chunks()
                    yield from out.add_column(0, "path", path).to_batches()
                    tables, start, n = [], k + 1, 0

    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = files.schema["path"].dataType.simpleString()
    return files.select("path", "text").repartition(tasks, "path").mapInArrow(run, f"path {kind}, {schema}")


def nodes(files: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """files: path, text. Each text's graphs node by node: the number in text order and in breadth order, how many numbers
    the graph has, parent, field (of those that are lists) and place in it, the next there, places among the edges of
    control, type, name, literal, depth, line; cut: whether the graph has more nodes."""
    return _parsed(files, node_rows, NODE, most)


def flow_edges(files: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """path, graph, name, src (a definition), dst (a use that it reaches)."""
    return _parsed(files, flow_rows, FLOW, most)


def edges(found: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """path, graph, place, src, dst, kind: parent and child of each node in text order, then, node by node in breadth order,
    statements to the next of their list and the ways of control; the first ``most`` of a graph."""
    d = found.where("parent IS NOT NULL")
    loop, first = F.col("parent_type").isin("For", "AsyncFor", "While"), F.col("place") == 0
    body, other = F.col("field") == "body", F.col("field") == "orelse"
    control = 2 * (F.col("size") - 1)
    way = control + F.col("ways_at")

    def edge(when: Column | None, place: Column, src: str, dst: str, kind: int) -> Column:
        one = F.struct(place.cast("int").alias("place"), F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"))
        return one if when is None else F.when(when, one)

    ways = [
        edge(None, 2 * (F.col("node") - 1), "parent", "node", PARENT),
        edge(None, 2 * F.col("node") - 1, "node", "parent", CHILD),
        edge(F.col("next").isNotNull(), control + F.col("next_at"), "node", "next", NEXT),
        edge(((F.col("parent_type") == "If") | loop) & body & first, way, "parent", "node", TRUE),
        edge(loop & body & F.col("last"), way + 1, "node", "parent", LOOP),
        edge(((F.col("parent_type") == "If") | loop) & other & first, way + F.when(loop, 2).otherwise(1), "parent", "node", FALSE),
        edge((F.col("parent_type") == "Try") & (F.col("field") == "handlers") & first, way, "parent", "node", EXCEPT),
    ]
    e = d.select("path", "graph", F.explode(F.array(*ways)).alias("e")).where(F.col("e.place") < most)
    return e.select("path", "graph", "e.place", "e.src", "e.dst", "e.kind")


def node_features(found: DataFrame) -> DataFrame:
    """path, graph, node, type_id, name_id (hashes from 1; no name: 0), literal (five flags), depth, line."""
    name = F.when(F.coalesce("name", F.lit("")) == "", 0).otherwise(feature_hash(F.col("name"), NAME_BUCKETS))
    flags = F.array(*[F.when(F.col("literal") == k, 1.0).otherwise(0.0) for k in LITERALS])
    return found.select("path", "graph", "node", feature_hash(F.col("type"), TYPE_BUCKETS).alias("type_id"), name.alias("name_id"), flags.alias("literal"), "depth", "line")
