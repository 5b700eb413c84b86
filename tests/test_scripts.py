"""Spans of script functions against a generator that knows them, and samples of code."""

import random
import re

import pytest

from wardspark.operators import scripts

BOOK = "\n".join(["function foo() {", "  return 1;", "}", "const bar = () => {", "  return 2;", "};", "class Baz {", "  method() {", "    return 3;", "  }", "}", ""])


class Writer:
    """Writes scripts; notes where declarations begin and end."""

    def __init__(self, seed):
        self.r, self.text, self.found = random.Random(seed), "", []

    def put(self, s):
        self.text += s

    def here(self):
        return self.text.count("\n") + 1, len(self.text) - self.text.rfind("\n") - 1

    def noise(self):
        return self.r.choice(["", "", " ", " // } { ( class X {\n", " /* function f() { */ ", "\n\n"])

    def statement(self, depth):
        r, name = self.r, f"n{self.r.randint(0, 99)}"
        kinds = ["plain"] * 3 + (["function", "async", "class", "arrow", "short", "block", "expression", "object", "param"] if depth < 3 else [])
        kind = r.choice(kinds)
        if kind == "plain":
            self.put(r.choice(["call(a, [1, 2], '}{');\n", "x = `t ${ {a: 1}.a + `}` } {`;\n", "let y = /[/}]{2}'/g.test(s) ? 1 : 2;\n", "const s = \"it's \\\" {\";\n", "z += a / b / c;\n", "if (a < b) { go(); } else { stop(); }\n", "for (const q of list) { q(); }\n", "const v1 = cb(() => 1, function () { return 2; });\n"]))
        elif kind in ("function", "async"):
            self.put(r.choice(["", "export "]))
            start = self.here()
            self.put(("async " if kind == "async" else "") + f"function {name}" + r.choice(["(a, b = {c: 1})", "()", "<T>(x: T): Promise<T>", "(a: number): string"]) + self.noise() + " {\n")
            self.body(depth)
            self.put("}")
            self.found.append(("function", name, *start, *self.here()))
            self.put("\n")
        elif kind == "class":
            self.put(r.choice(["", "export default "]))
            start = self.here()
            self.put(f"class {name}" + r.choice(["", " extends Base", " extends mix({a: 1}) implements I"]) + " {\n")
            for _ in range(r.randint(0, 3)):
                self.put(r.choice(["  field = 1;\n", "  handler = (e) => { go(e); };\n", ""]))
                self.method(depth, r.choice(["", "static ", "async ", "private static async ", "get ", "* "]), r.choice(["(): void", "(a, b)", "()"]))
                self.put("\n")
            self.put("}")
            self.found.append(("class", name, *start, *self.here()))
            self.put("\n")
        elif kind in ("arrow", "short"):
            self.put(r.choice(["const ", "export const ", "let ", ""]) + name + r.choice(["", ": Fn"] if kind == "arrow" else [""]) + " =" + r.choice([" ", "\n  "]))
            start = self.here()
            self.put(r.choice(["(a, b)", "a", "async (x)", "()"]) + " =>")
            if kind == "arrow":
                self.put(" {\n")
                self.body(depth)
                self.put("}")
            else:
                self.put(r.choice([" a + b(1, {c: 2})", " ({ a: 1 })", " a\n  .map(x => x)\n  .join('')"]))
            self.found.append(("arrow", name, *start, *self.here()))
            self.put(";\n")
        elif kind == "block":
            self.put(r.choice(["while (a) {\n", "try {\n", "switch (f(x)) { default: {\n"]))
            closing = "}}\n" if self.text.endswith(": {\n") else "} catch (e) { }\n" if self.text.endswith("try {\n") else "}\n"
            self.body(depth)
            self.put(closing)
        elif kind == "expression":
            self.put(f"const {name} = function inner() {{\n")
            self.body(depth)
            self.put("};\n")
        elif kind == "object":
            self.put(f"const {name} = {{ a: function () {{ }}, b: () => 1,\n")
            self.method(depth, "", "(q)")
            self.put(", };\n")
        else:
            self.put(f"use((cb = () => 1, d) => {{ {name}.on = () => {{ }}; }});\n")

    def method(self, depth, modifiers, rest):
        self.put("  ")
        start = self.here()
        name = f"m{self.r.randint(0, 99)}"
        self.put(f"{modifiers}{name}{rest} {{\n")
        self.body(depth)
        self.put("}")
        self.found.append(("method", name, *start, *self.here()))

    def body(self, depth):
        for _ in range(self.r.randint(0, 3)):
            self.statement(depth + 1)


def written(n=60):
    out = []
    for seed in range(n):
        w = Writer(seed)
        for _ in range(6):
            w.statement(0)
        out.append((str(seed), w.text, w.found))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def rows_of(d):
    got = {}
    for r in d.select(*scripts.SPAN).collect():
        got.setdefault(r.path, []).append(tuple(r)[1:])
    return {k: sorted(v) for k, v in got.items()}


def test_spans_that_were_written(spark):
    all_ = written()
    got = rows_of(scripts.spans(frame(spark, [x[:2] for x in all_]).repartition(4)))
    assert sum(len(x[2]) for x in all_) > 400
    for path, text, found in all_:
        assert got.get(path, []) == sorted(found), text


def test_the_book(spark):
    got = rows_of(scripts.spans(frame(spark, [("app.ts", BOOK), ("none", None), ("empty", ""), ("open", "function f( {{{ ["), ("close", "}}); function g() { }"), ("quote", "'abc\nfunction h() {}")])))
    assert got["app.ts"] == [("arrow", "bar", 4, 12, 6, 1), ("class", "Baz", 7, 0, 11, 1), ("function", "foo", 1, 0, 3, 1), ("method", "method", 8, 2, 10, 3)]
    assert got["close"] == [("function", "g", 1, 5, 1, 21)] and got["quote"] == [("function", "h", 2, 0, 2, 15)] and set(got) == {"app.ts", "close", "quote"}


def test_left_out(spark):
    text = "function* g() { }\nabstract class A { }\na.b = () => 1;\nclass C { f = () => 1; }\nfoo(function x() { });\nexport default function () { }\nfunction sig(): void;\n"
    assert rows_of(scripts.spans(frame(spark, [("p", text)]))) == {"p": [("class", "C", 4, 0, 4, 24)]}


def test_long_text(spark):
    text = "".join(f"function f{k}() {{ return '{'x' * 50}'; }} /* {'y' * 3000} */\n" for k in range(300)) + "`" + "z${1}" * 2000 + "`"
    got = rows_of(scripts.spans(frame(spark, [("p", text)])))["p"]
    assert len(got) == 300 and {g[0] for g in got} == {"function"}


def test_samples(spark):
    files = spark.createDataFrame([("r", "c", "app.ts", BOOK), ("r", "c", "win.ts", BOOK.replace("\n", "\r\n")), ("r", "c", "long.ts", "function a() {\n" + "x;\n" * 400 + "}\nfunction b() {\n" + "x;\n" * 398 + "}")], "repo string, commit string, path string, text string")
    got = {(r.filepath, r.name): r for r in scripts.code_samples(files, scripts.spans(files), "ts", 1).collect()}
    for p in ("app.ts", "win.ts"):
        r = got[p, "bar"]
        assert (r.code_snippet, r.context_before, r.context_after, r.n_lines) == ("const bar = () => {\n  return 2;\n};", "}", "class Baz {", 11)
        assert got[p, "Baz"].context_after == "" and got[p, "foo"].context_before == "" and got[p, "method"].kind == "method"
    assert ("long.ts", "a") not in got and got["long.ts", "b"].code_snippet.count("\n") == 399
    from hashlib import sha256

    assert got["app.ts", "foo"].sample_id == sha256(b"ts|r|c|app.ts|1|3").hexdigest()


def plain_graph(code):
    nodes = []
    for pattern, kind in scripts.NODES:
        for m in re.finditer(pattern, code, re.ASCII):
            nodes.append((len(nodes), kind, m.group(1), code[: m.start()].count("\n") + 1))
    return nodes


@pytest.mark.parametrize("seed", [0])
def test_script_graphs(spark, seed):
    rows = [x[:2] for x in written(20)] + [("e", ""), ("n", None), ("c", "a\n(b\n\n (c(d")]
    nodes, edges = scripts.script_graph(frame(spark, rows))
    got = {}
    for r in nodes.orderBy("path", "node").collect():
        got.setdefault(r.path, []).append((r.node, r.type, r.name, r.line))
    assert got == {p: plain_graph(t) for p, t in rows if t}
    assert {(r.path, r.src + 1) for r in edges.collect()} == {(p, n) for p, ns in got.items() for n in range(1, len(ns))}
