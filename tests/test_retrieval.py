"""Retrieval and Markdown pieces by the book, on small tables."""

import math
import random
import re
from collections import Counter
from hashlib import sha1

import pytest

from wardspark.functions import size
from wardspark.operators import labelling, retrieval
from wardspark.sources import readers

CHUNKS = [
    ("a", "SQL injection: use parameterized queries CWE-89", ["injection", "sqli"], ["89"], [], "fix_patterns", "kb/a.md"),
    ("b", "sql query example CWE-89 CWE-79 cwe-79", ["xss"], ["89", "79"], ["B608", "B602"], "code_examples", "kb/b.md"),
    ("c", "innerHTML and textContent", ["innerHTML"], [], [], None, "kb/fix_patterns.md"),
    ("d", "nothing of this", [], ["7"], ["B101"], "fix_patterns", None), ("e", "", [], [], [], "playbook", "kb/e.md"), ("f", "sql sql sql query", ["injection"], [], [], "playbook", "kb/f.md"),
]
QUERIES = [
    (1, "sql query CWE-89 CWE-79", None), (2, "sql query", None), (3, "how to fix sql injection b608 B602 cwe79", None), (4, "innerHTML secure", "fix_patterns"), (5, "cwe-7 patch", "fix_patterns"), (6, "", ""),
    (7, "password hash bcrypt secret credential eval", None), (8, "eval code injection remote execution", None), (9, "Implement eval", "play"),
]


def tokens(t):
    return re.findall(r"[a-z_][a-z0-9_]+", t.lower())


def want(k=5, first=30):
    def vector(t):
        return Counter(int(sha1(x.encode()).hexdigest()[:8], 16) % 256 for x in tokens(t))

    def cosine(a, b):
        d = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
        return round(sum(a[x] * b[x] for x in a) / d, 6) if d else 0.0

    out = []
    for q, text, kind in QUERIES:
        low, more = text.lower(), text
        for term, terms in labelling.EXPANSIONS:
            if term in low and terms not in low:
                more = f"{text} {terms}"
                break
        hits = sorted(((-cosine(vector(more), vector(c[1])), c[0], c) for c in CHUNKS), key=lambda x: x[:2])[:first]
        found = []
        for score, i, (_, t, words, cwe, rules, own, path) in hits:
            if kind and own != kind and kind not in (path or ""):
                continue
            n = Counter(tokens(t))
            s = sum(2.2 * n[x] / (n[x] + 1.2) for x in tokens(text))
            s += 0.1 * sum(w in low for w in words) + 0.3 * sum(f"cwe-{w}" in low or f"cwe{w}" in low for w in cwe) + 0.3 * sum(r.lower() in low for r in rules)
            if own == "fix_patterns" and any(w in low for w in ("fix", "patch", "secure", "safe")) or own == "code_examples" and any(w in low for w in ("example", "how", "implement")):
                s += 0.2
            found.append((round(s, 6), -score, i))
        out += [(q, i, score, s, place + 1) for place, (s, score, i) in enumerate(sorted(found, reverse=True)[:k])]
    return sorted(out)


def frames(spark):
    c = spark.createDataFrame(CHUNKS, "chunk_id string, text string, keywords array<string>, cwe array<string>, rules array<string>, doc_type string, path string")
    return spark.createDataFrame(QUERIES, "query_id long, text string, doc_type string"), c


@pytest.mark.parametrize("first", [30, 2])
def test_retrieve(spark, first):
    q, c = frames(spark)
    got = sorted(tuple(r) for r in retrieval.retrieve(q, c, 5, first).collect())
    assert got == want(first=first)
    if first == 30:
        scores = {(r[0], r[1]): r[3] for r in got}
        assert scores[1, "b"] == pytest.approx(2 + 0.6 + 1.375 + 1 + 0.375 - 0.375, abs=2) and scores[3, "b"] > scores[3, "f"]


def test_queries_in_blocks(spark, monkeypatch):
    q, c = frames(spark)
    monkeypatch.setattr(retrieval, "MAX_BYTES", 5000)
    r = random.Random(1)
    d = spark.createDataFrame([(k, [r.random() for _ in range(8)]) for k in range(60)], "item_id long, embedding array<double>")
    whole = retrieval.nearest(d.withColumnRenamed("item_id", "query_id"), d, 3)
    parts = retrieval.nearest(d.withColumnRenamed("item_id", "query_id"), d, 3, 2000)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) and whole.count() == 180


def test_fixes_and_rules(spark):
    _, c = frames(spark)
    asked = spark.createDataFrame([(1, "sql injection", "Python")], "query_id long, category string, language string")
    assert {r.chunk_id for r in retrieval.retrieve_fixes(asked, c).collect()} == {"a", "c", "d"}
    rules = spark.createDataFrame([(1, "CWE-89"), (2, "b608"), (3, "other")], "query_id long, rule string")
    best = {r.query_id: r.chunk_id for r in retrieval.retrieve_by_rule(rules, c, 1).collect()}
    assert best[1] in "ab" and set(best) == {1, 2, 3}


def pieces(text):
    out = []
    for s in re.split(r"(?=^##[^#])", text, flags=re.MULTILINE):
        s = s.strip()
        for p in [s] if len(s) <= 1200 else re.split(r"(?=^###)", s, flags=re.MULTILINE):
            p = p.strip()
            at = 0
            while p:
                out.append(p if len(p) <= 1200 else p[at : at + 800])
                if len(p) <= 1200 or at + 800 >= len(p):
                    break
                at += 700
    return out


def test_markdown_pieces(spark):
    line = lambda n: "x" * n
    texts = [
        "", " \n", "# T\nintro\n## A\n" + line(900) + "\n### a\nb\n## B\n" + line(1195) + "\n### c\nd", "## A\n" + line(1194), "## A\n" + line(1195), "## A\n" + line(1196), "## A\n" + line(1300),
        "##\nno text\n####x\n" + line(1300) + "\n### y\n" + line(799) + "\n### z\n" + line(1201), "a ## b\n##c\n  ## d\n \n## é" + "é" * 2500, "## A\r\n" + line(5) + " ## no\x85## no\n### s", "##", "\n\n## A\x1f\n\n\n##  \n",
    ]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "document_id long, text string")
    got = {}
    for r in readers.markdown_sections(d).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append(r.text)
    assert got == {k: pieces(t) for k, t in enumerate(texts) if pieces(t)}


def test_sizes_are_bytes(spark):
    few = spark.createDataFrame([(1, "x" * 1000, [1.0] * 100)], "k long, t string, v array<double>")
    assert 2600 < size.counted(few) < 3200 and size.counted(few.limit(0)) == 0
    assert "ResolvedHint" in size.small(few)._jdf.queryExecution().analyzed().toString() and "ResolvedHint" not in size.small(few, 2000)._jdf.queryExecution().analyzed().toString()
    nested = spark.sql("SELECT map('a', array('bb', NULL)) AS m, named_struct('x', 'yy', 'z', CAST(NULL AS array<string>)) AS s, X'0102' AS b")
    assert 100 < size.counted(nested) < 400


def test_nearest_of_odd_vectors(spark):
    """Null, empty, zero, ragged and equal vectors, and those that hold a null; by blocks of matrices, as pair by pair before."""
    r = random.Random(2)
    v = [(n, [r.choice([0.0, 1.0, r.random()]) for _ in range(r.choice([3, 8]))]) for n in range(120)]
    v += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None, 2.0]), *[(300 + n, [1.0, 1.0, 1.0]) for n in range(40)]]

    def cos(a, b):
        if a is None or b is None or None in a or None in b:
            return None
        d = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=False)) / d, 6) if d else 0.0

    d = spark.createDataFrame(v, "item_id long, embedding array<double>")
    nearest = retrieval.nearest(d.withColumnRenamed("item_id", "query_id"), d, 5)
    got = {(x.query_id, x.place): (x.item_id, x.score) for x in nearest.collect()}
    for q, a in v:
        best = sorted(((cos(a, b), i) for i, b in v), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:5]
        assert [got[q, p + 1] for p in range(5)] == [(i, s) for s, i in best]
    assert "MapInArrow" in nearest._jdf.queryExecution().executedPlan().toString()
