"""Graphs of Python texts against a plain walk over their trees and against their runs."""

import ast
import hashlib
import random
import textwrap

import pytest

from wardspark.operators import pygraph

TEXTS = [
    "def f(x):\n    if x > 0:\n        y = x + 1\n    else:\n        y = x - 1\n    for i in range(3):\n        y += i\n    try:\n        z = 1 / x\n    except ZeroDivisionError:\n        z = 0\n    return y + z\n",
    "a = 1\nwhile a:\n    a -= 1\n    if a == 3:\n        break\n    elif a == 4:\n        continue\nelse:\n    b = a\nprint(a, b)\n",
    "    x = 'in' 'dented'\n    y = [x for x in x]\n", "return 5\n", "def (", "", "  \n", None, "class C:\n    def m(self):\n        return self.m\n",
    "async def g(*a, k=None, **q):\n    async for x in a:\n        async with q as (b, c):\n            yield b\n    with open(k) as f, f as h:\n        pass\n\ndef h():\n    return lambda v, w=g: v + w\n",
    "try:\n    import os.path as p, sys\n    from m import n\nexcept (A, B) as e:\n    print(e, p)\nexcept C:\n    raise\nelse:\n    q = sys\nfinally:\n    print(n)\n",
    "match p:\n    case [1, *rest]:\n        z = rest\n    case {'k': v, **more} if v:\n        z = more\n    case C(a=q) as w:\n        z = w\nprint(z)\n",
    "for i in a:\n    for j in b:\n        if i:\n            continue\n        c = j\n    else:\n        c = i\nelse:\n    c = None\n", "x = b'' or 1.5 or None or True or ...\ndel x\nprint(x)\n", "if (n := 5) > 3:\n    print(n)\nf'{n!r:>{w}}'\n", "def f():\n" + "".join(f"    x{k} = {k}\n" for k in range(200)),
]


def plain(code, most_nodes, most_edges):
    """Graph by graph: nodes and edges."""
    trees = []
    if (code or "").strip():
        for t in (code, textwrap.dedent(code), "def __snippet__():\n" + textwrap.indent(textwrap.dedent(code), "    ")):
            try:
                trees = [ast.parse(t)]
                break
            except SyntaxError:
                pass
    for tree in trees:
        for g, root in enumerate([n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] or [tree]):
            ids, nodes, edges = {}, [], []

            def visit(n, parent, depth):
                if len(nodes) == most_nodes:
                    return
                ids[id(n)] = k = len(nodes)
                nodes.append((type(n).__name__, depth, getattr(n, "lineno", 0)))
                if parent is not None:
                    edges.extend([(parent, k, 0), (k, parent, 1)])
                for c in ast.iter_child_nodes(n):
                    visit(c, k, depth + 1)

            visit(root, None, 0)
            put = lambda a, b, kind: edges.append((ids[id(a)], ids[id(b)], kind)) if id(a) in ids and id(b) in ids else None
            for n in ast.walk(root):
                for f in ("body", "orelse", "handlers", "finalbody"):
                    body = getattr(n, f, None)
                    if isinstance(body, list):
                        for a, b in zip(body, body[1:]):
                            put(a, b, 2)
                loops = isinstance(n, (ast.For, ast.AsyncFor, ast.While))
                if isinstance(n, ast.If) or loops:
                    put(n, n.body[0], 3)
                    if loops:
                        put(n.body[-1], n, 5)
                    if n.orelse:
                        put(n, n.orelse[0], 4)
                if isinstance(n, ast.Try) and n.handlers:
                    put(n, n.handlers[0], 6)
            yield g, nodes, edges[:most_edges]


def files(spark, texts=TEXTS):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string").repartition(3)


@pytest.mark.parametrize("most", [(2048, 8192), (10, 20), (57, 130)])
def test_nodes_and_edges_of_all_kinds(spark, most):
    found = pygraph.nodes(files(spark), most[0]).cache()
    got = {}
    for r in found.orderBy("path", "graph", "node").collect():
        got.setdefault((r.path, r.graph), ([], []))[0].append((r.type, r.depth, r.line))
        assert r.node == len(got[r.path, r.graph][0]) - 1
    for r in pygraph.edges(found, most[1]).orderBy("path", "graph", "place").collect():
        got[r.path, r.graph][1].append((r.src, r.dst, r.kind))
    want = {(str(k), g): (n, e) for k, t in enumerate(TEXTS) for g, n, e in plain(t, *most)}
    assert got == want
    assert {r.cut for r in found.where("path = '15'").collect()} == {most[0] < 800}


def test_features(spark):
    rows = {(r.path, r.graph, r.node): r for r in pygraph.node_features(pygraph.nodes(files(spark))).collect()}
    bucket = lambda s, n: int(hashlib.sha1(s.encode()).hexdigest(), 16) % n + 1
    assert (rows["0", 0, 0].type_id, rows["0", 0, 0].name_id) == (bucket("FunctionDef", 1024), bucket("f", 65536))
    flags = [r.literal for r in rows.values() if r.path == "13" and sum(r.literal)]
    assert sorted(flags) == sorted([[0, 0, 0, 0, 1], [0, 1, 0, 0, 0], [0, 0, 0, 1, 0], [0, 1, 0, 0, 0]])
    assert sum(r.name_id == 0 for r in rows.values() if r.path == "0") > 10


def lines_of_flow(spark, text):
    d = files(spark, [text])
    lines = {r.node: (r.line, r.name) for r in pygraph.nodes(d).collect()}
    return sorted((r.name, lines[r.src][0], lines[r.dst][0]) for r in pygraph.flow_edges(d).collect())


def test_flow_by_hand(spark):
    assert lines_of_flow(spark, TEXTS[1]) == sorted([("a", 1, 2), ("a", 3, 2), ("a", 1, 3), ("a", 3, 3), ("a", 3, 4), ("a", 3, 6), ("a", 1, 9), ("a", 3, 9), ("a", 3, 10), ("a", 1, 10), ("b", 9, 10)])
    assert lines_of_flow(spark, TEXTS[10]) == sorted([("p", 2, 5), ("e", 4, 5), ("sys", 2, 9), ("n", 3, 11)])
    assert lines_of_flow(spark, "def f(a):\n    g = [a for a in a if a]\n    a = lambda a: a + g\n    return a\n") == [("a", 1, 2), ("a", 2, 2), ("a", 2, 2), ("a", 3, 4), ("g", 2, 3)]
    assert lines_of_flow(spark, "x = 1\ndef f():\n    x = 2\n    return x\n") == [("x", 3, 4)]


def program(r, depth=0):
    """A random program over a few names whose every choice is made by a driver."""
    out, pad = [], "    " * depth
    for _ in range(r.randint(1, 4)):
        v, u = r.choice("abc"), r.choice("abc")
        kind = r.randint(0, 6 if depth < 2 else 1)
        if kind <= 1:
            out.append(f"{pad}{v} = {u}")
        elif kind == 2:
            out += [f"{pad}if go():", program(r, depth + 1), f"{pad}else:", program(r, depth + 1)]
        elif kind == 3:
            out += [f"{pad}while go():", program(r, depth + 1), f"{pad}    if go(): {r.choice(['break', 'continue', 'pass'])}"]
        elif kind == 4:
            out += [f"{pad}for {v} in some({u}):", program(r, depth + 1)]
        elif kind == 5:
            out += [f"{pad}if go():", program(r, depth + 1)]
        else:
            out += [f"{pad}try:", f"{pad}    fail()", program(r, depth + 1), f"{pad}    fail()", f"{pad}except Stop:", program(r, depth + 1)]
    return "\n".join(out)


class Traced(ast.NodeTransformer):
    """A name's value is the line that defined it; every use of one reports it."""

    def visit_Name(self, n):
        return ast.parse(f"report('{n.id}', {n.lineno}, names.get('{n.id}'))", mode="eval").body if n.id in "abc" and isinstance(n.ctx, ast.Load) else n

    def visit_Assign(self, n):
        n.value = ast.Subscript(ast.Tuple([self.visit(n.value), ast.Constant(n.lineno)], ast.Load()), ast.Constant(1), ast.Load())
        return n

    def visit_For(self, n):
        n.iter.args.append(ast.Constant(n.lineno))
        return self.generic_visit(n)


def test_flow_holds_on_runs(spark):
    """What runs of random programs read was defined where an edge says; and over many runs nearly all edges are met."""
    r = random.Random(6)
    texts = [program(r) for _ in range(40)]
    d = files(spark, texts)
    lines = {(x.path, x.node): x.line for x in pygraph.nodes(d).collect()}
    edges: dict[str, set] = {}
    for x in pygraph.flow_edges(d).where("name IN ('a', 'b', 'c')").collect():
        edges.setdefault(x.path, set()).add((x.name, lines[x.path, x.src], lines[x.path, x.dst]))
    met = total = 0
    for k, text in enumerate(texts):
        tree = ast.fix_missing_locations(Traced().visit(ast.parse(text)))
        code, seen = compile(tree, "p", "exec"), set()
        for seed in range(400):
            run(code, random.Random(seed), seen)
        found = edges.get(str(k), set())
        assert seen <= found, text
        met, total = met + len(seen), total + len(found)
    assert total > 100 and met > 0.8 * total


def run(code, r, seen):
    class Stop(Exception):
        pass

    steps = [0]

    def go():
        steps[0] += 1
        if steps[0] > 100:
            raise EOFError
        return r.random() < 0.5

    def fail():
        if go():
            raise Stop

    def report(name, line, where):
        if where is not None:
            seen.add((name, where, line))

    def some(x, line):
        for _ in range(r.randint(0, 2)):
            yield line

    env = {"go": go, "fail": fail, "report": report, "some": some, "Stop": Stop}
    env["names"] = env
    try:
        exec(code, env)
    except EOFError:
        pass


def test_equal_texts_and_few_parts(spark, monkeypatch):
    """Texts are parsed by more tasks than they were read in, equal ones once by a worker, and edges need no shuffle of their own."""
    texts = [TEXTS[k % 3] for k in range(300)]
    d = files(spark, texts).coalesce(1)
    found = pygraph.nodes(d)
    assert found.rdd.getNumPartitions() == 4
    plan = pygraph.edges(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    want = [(g, e) for t in TEXTS[:3] for g, _, e in plain(t, 2048, 8192)]
    got = {}
    for r in pygraph.edges(found).collect():
        got.setdefault((int(r.path), r.graph), []).append((r.place, (r.src, r.dst, r.kind)))
    assert len(got) == 300 and all([e for _, e in sorted(es)] == want[p % 3][1] for (p, _), es in got.items())
    calls, made = [], pygraph.roots
    monkeypatch.setattr(pygraph, "roots", lambda code: calls.append(code) or made(code))
    monkeypatch.setattr(pygraph, "_kept", {})
    tables = [pygraph._table(pygraph.flow_rows, pygraph.FLOW, t, 2048) for t in texts]
    assert len(calls) == 3 and tables[0].equals(tables[3])
    monkeypatch.setattr(pygraph, "KEPT", 0)
    assert pygraph._table(pygraph.flow_rows, pygraph.FLOW, TEXTS[4], 2048).num_rows == 0 and len(pygraph._kept) == 1


def test_flow_is_spread_over_tasks(spark):
    d = pygraph.flow_edges(files(spark, [TEXTS[0]] * 40).coalesce(1))
    assert d.rdd.getNumPartitions() == 4
    by = {}
    for r in d.collect():
        by.setdefault(r.path, []).append((r.name, r.src, r.dst))
    assert len(by) == 40 and len({tuple(sorted(e)) for e in by.values()}) == 1
