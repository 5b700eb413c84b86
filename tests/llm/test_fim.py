import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspark.llm import fim


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def cut(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def order(rows):
    return sorted(rows, key=repr)


def test_bits_against_lists():
    r = np.random.default_rng(3)
    for n, share in [(0, 0.5), (1, 1), (63, 0.3), (64, 0), (512, 1), (513, 0.01), (5000, 0.5), (70_000, 0.001)]:
        bits = r.random(n) < share
        b, places = fim.Bits(bits), np.arange(n + 1)
        assert (b.rank(places) == np.r_[0, np.cumsum(bits)]).all()
        ones = np.flatnonzero(bits)
        assert (b.select(np.arange(len(ones))) == ones).all()


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_outputs(which, request, rows):
    d = fim.fill_in_middle(request.getfixturevalue(which))
    assert d.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = d.select("*", fim.restore(F.col("output"), F.col("form")).alias("restored")).collect()
    assert order([tuple(r)[:6] for r in got]) == order([cut(i, t) for i, t, *_ in rows])
    texts = {i: t or "" for i, t, *_ in rows}
    assert all(r.restored == texts[r.doc_id] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_odd_texts(spark):
    odd = ["", None, "<P>", "a<M>b", "<", "<P", ">S<M", "é", "ééé", "aé b\n\nc", "\U0001f600\U0001f600x", "\n", "a" * 100_000, "é1" * 100_000, "x<S", "M>y", "\0\0", "<<<>>>SPM", "S>S>S>", "a\r\nb"]
    data = [(k * 37 + j, t) for j, t in enumerate(odd) for k in range(8)] + [(None, "a b c"), (None, None), (5, "twice"), (5, "twice")]
    got = fim.fill_in_middle(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    got = got.select("*", fim.restore(F.col("output"), F.col("form")).alias("restored")).collect()
    assert order([tuple(r)[:6] for r in got]) == order([cut(i, t) for i, t in data])
    assert order([(r.doc_id, r.restored) for r in got]) == order([(i, t or "") for i, t in data])


def test_rates_and_seed(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    forms = lambda **k: {r.form: r["count"] for r in fim.fill_in_middle(d, **k).groupBy("form").count().collect()}
    assert forms(plain=0, suffix_first=0) == {"psm": 3000} and forms(plain=0, suffix_first=100) == {"spm": 3000} and forms(plain=100) == {"plain": 3000}
    assert abs(forms()["plain"] - 300) < 90
    assert fim.fill_in_middle(d, seed="2").exceptAll(fim.fill_in_middle(d)).count() > 1000


def test_nothing(empty):
    assert fim.fill_in_middle(empty).count() == 0
