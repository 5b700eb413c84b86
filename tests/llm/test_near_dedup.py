"""Near-dedup of the pipeline against all pairs."""

import random

import pytest

import corpus_pipeline
from wardspark.llm import similar, simhash


def cases():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    some = lambda n: [word() for _ in range(n)]
    boiler = some(25)
    out = [(900 - k, t) for k, t in enumerate([None, "", " ", "one", "One", "a b c", "a b c d e f", "a " * 99])]
    k = 0
    for n in (12, 60, 200, 600):
        for changes in (1, 2, 3, 4, 6, 8, 12):
            base = some(n)
            for _ in range(4):
                copy = list(base)
                for at in r.sample(range(n), min(changes, n // 4)):
                    copy[at] = word()
                out.append((k := k + 1, " ".join(copy + (boiler if r.random() < 0.5 else []))))
    big = some(100)
    out += [(1000 + i, " ".join(big[: 50 + i % 50] + some(3))) for i in range(60)]
    out += [(2000 + i, " ".join(boiler + some(1 + i % 6))) for i in range(40)]
    return out


def brute(rows):
    def of(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    s = {i: of(t) for i, t in rows}
    near = {i: [j for j in s if 9 * len(s[i] & s[j]) >= 4 * (len(s[i]) + len(s[j]))] for i in s}
    name = {i: i for i in s}
    while True:
        new = {i: min(name[j] for j in near[i]) for i in s}
        if new == name:
            return name
        name = new


@pytest.mark.parametrize(("first", "block"), [(4, 2048), (1, 16)])
def test_links_are_true_and_hardly_any_is_missed(spark, monkeypatch, first, block):
    monkeypatch.setattr(similar, "FIRST", first)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = cases() if block > 100 else cases()[-108:]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(d).collect()}
    want = brute(rows)
    assert set(got) == set(want) and len(set(want.values())) < len(rows) - 10
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is joined that should not be
    members = [i for i in want if want[i] != i]
    assert sum(got[i] == want[i] for i in members) >= 0.95 * len(members)


def test_a_group_of_copies_confirms_few_pairs(spark, monkeypatch):
    """200 texts with a word changed each: all pairs are near, and a pair for each text joins most of them."""
    r = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(200):
        words = list(base)
        for at in r.sample(range(150), 1):
            words[at] = f"x{k}"
        rows.append((k, " ".join(words)))
    asked = []
    confirmed = similar._confirmed

    def counted(docs, first, pairs, similarity):
        asked.append(pairs.count())
        return confirmed(docs, first, pairs, similarity)

    monkeypatch.setattr(similar, "_confirmed", counted)
    got = {x.doc_id: x.component_id for x in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and set(got.values()) == {0}
    assert sum(asked) < 2 * len(rows)


def test_empty_tables_and_columns_with_the_same_names(spark):
    assert similar.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    d = spark.createDataFrame([(1, "a b c d e f", 0, "x"), (None, "a b c d e f", 0, "x"), (2, "A b c d e f", 1, "y"), (2, None, 1, "y")], "doc_id long, text string, cls long, keys string")
    assert sorted((r.doc_id, r.component_id) for r in similar.near_duplicates(d).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_stage_finds_copies_beyond_the_radius(spark):
    """Similarity 0.84, fingerprints more than 4 bits apart."""
    words = [f"w{k}" for k in range(120)]
    other = [w if k not in (30, 90) else "x" for k, w in enumerate(words)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[::-1])), (4, " ".join(words))], "doc_id long, text string")
    fp = {r.doc_id: r.fp for r in simhash.fingerprints(d).collect()}
    assert ((fp[1] ^ fp[2]) & (1 << 64) - 1).bit_count() > 4
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, d, "").collect()} == {1, 3}
