"""The operators on whole texts against brute force; nulls, empty and long texts, ties, repeats, empty tables and
columns with the operators' own names."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import SCHEMA
from wardspark.llm import bpe, decontam, encode, licenses, pretoken, quality, repair, sharding, simhash, substring, tokencount, transducer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def space_words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def plain_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- decontamination


def contamination(rows, items):
    out = {}
    for i, t, *_ in rows:
        w = plain_words(t)
        hit, ids = set(), set()
        for item, text in items:
            p = plain_words(text)
            n = min(13, len(p))
            for s in range(len(p) - n + 1 if p else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == p[s : s + n]:
                        hit |= set(range(k, k + n))
                        ids.add(str(item))
        out[i] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_decontamination(which, request, rows, benchmark):
    docs = request.getfixturevalue(which)
    items = [(r.item_id, r.text) for r in benchmark.collect() if r.item_id is not None]
    got = {i: (r.n_words, r.n_hit, r.item_ids) for i, r in by_id(decontam.decontaminate(docs, benchmark)).items()}
    assert got == contamination(rows, items)


def test_decontamination_of_nothing(spark, docs, empty, benchmark):
    assert decontam.decontaminate(empty, benchmark).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(docs, benchmark.where("false")).collect()} == {0}
    assert decontam.decontaminate(spark.createDataFrame([(None, "a")], "doc_id long, text string"), benchmark).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red fox over the lazy dog"), (2, "dog x x fox red"), (3, "fox")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "fox dog")], "item_id long, text string")
    got = {(r.doc_id, r.first, r.last) for r in decontam.proximity(d, q, 2).collect()}
    assert got == {(2, 0, 3)}
    assert {r.doc_id for r in decontam.proximity(d, q, 3).collect()} == {1, 2}


# --- substring dedup


def deduped(rows):
    first, words = {}, {i: space_words(t) for i, t, *_ in rows if i is not None}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_substring_dedup(which, request, rows):
    docs = request.getfixturevalue(which)
    got = {i: (r.n_words, r.n_removed, r.text) for i, r in by_id(substring.substring_dedup(docs)).items()}
    assert got == deduped(rows)


def test_substring_dedup_with_shuffled_joins(docs, rows, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(substring, "FLUSH", 500)
    monkeypatch.setattr(substring, "PLACES", 300)
    got = {i: (r.n_words, r.n_removed, r.text) for i, r in by_id(substring.substring_dedup(docs)).items()}
    assert got == deduped(rows)


def test_substring_dedup_of_repeated_ids(spark):
    """Rows of one id: each loses what a smaller id has, at its own places; what they share with each other stays."""
    a, b = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    d = spark.createDataFrame([(1, a), (2, "x y " + a), (2, b + " " + a), (2, b), (2, None), (3, b + " z"), (3, b + " z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.substring_dedup(d).collect())
    assert got == sorted([(1, 20, 0, a), (2, 22, 20, "x y"), (2, 40, 20, b), (2, 20, 0, b), (2, 0, 0, ""), (3, 21, 20, "z"), (3, 21, 20, "z")])


def test_substring_dedup_keeps_white_space(spark, empty):
    shared = " ".join(f"w{k}" for k in range(13))
    d = spark.createDataFrame([(1, shared), (2, f"\n a\tb\n{shared} c\n")], "doc_id long, text string")
    assert by_id(substring.substring_dedup(d, joined=False))[2].text == "\n a\tb\nc\n"
    assert substring.substring_dedup(empty).count() == 0


# --- quality


def counted(t):
    w, lines = space_words(t), [x for x in (t or "").split("\n") if space_words(x)]
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many = {x for x in tri if tri.count(x) > 1} if len(tri) < 3000 else {x for x, n in zip(*np.unique(np.array([" ".join(x) for x in tri]), return_counts=True), strict=True) if n > 1}
    rep = {p for k, x in enumerate(tri) if (x in many or " ".join(x) in many) for p in range(k, k + 3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>") if t else 0, len(lines) - len(set(lines)), len(rep)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_quality_counts(which, request, rows):
    got = by_id(quality.features(request.getfixturevalue(which)))
    for i, t, *_ in rows:
        n = counted(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == n, t
        assert got[i].base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_quality_cutoffs(spark):
    import math

    n, alpha, delta = 3000, 0.02, 0.05
    good = [("en", True, 0.0 if k else 0.3, 0.0, 0.0) for k in range(n)]
    bad = [("en", False, 0.4, 0.0, 0.0) for _ in range(50)]
    few = [("fr", True, 0.0, 0.0, 0.0)] * 20 + [("fr", False, 0.9, 0.0, 0.0)] * 20
    d = spark.createDataFrame(good + bad + few, "stratum string, good boolean, symbols double, dup_lines double, repeats double")
    got = {r.stratum: r for r in quality.cutoffs(d, alpha, delta).collect()}
    assert "fr" not in got  # too few labels to be sure of anything
    tail = lambda k: sum(math.comb(n, i) * (alpha / 3) ** i * (1 - alpha / 3) ** (n - i) for i in range(k + 1))
    assert tail(0) <= delta / 6
    assert got["en"].cut_symbols == 20 and got["en"].cut_repeats is None


def test_cutoffs_hold_on_documents_not_used_for_them(spark):
    """Three strata with labels enough, one with too few. Of good documents a known share has a large ratio; the cutoffs
    are those of an exact test in integers, and on other documents false rejections stay below alpha."""
    import math
    from fractions import Fraction

    alpha, delta, rng = 0.02, 0.05, np.random.default_rng(7)
    planted = {"en": (4000, 0.001), "fr": (3000, 0.0), "de": (5000, 0.004), "xx": (60, 0.0)}

    def rows(n, rate):
        bad = np.minimum(rng.random(n // 8) * 0.5 + 0.3, 0.99)
        high = rng.random(n) < rate
        return [(True, float(x)) for x in np.where(high, 0.9, rng.random(n) * 0.2)] + [(False, float(x)) for x in bad]

    drawn = {s: rows(*p) for s, p in planted.items()}
    labelled = [(s, g, x, 0.0, 0.0) for s, r in drawn.items() for g, x in r]
    got = {r.stratum: r.cut_symbols for r in quality.cutoffs(spark.createDataFrame(labelled, "stratum string, good boolean, symbols double, dup_lines double, repeats double"), alpha, delta).collect()}
    each, chains = Fraction(1, 150), 3 * len(planted)  # alpha / 3
    want = {}
    for s, r in drawn.items():
        bins = [(g, min(50, math.floor(x * 50))) for g, x in r]
        n, best = sum(g for g, _ in bins), None
        for cut in range(50, 0, -1):
            k, hits = sum(g and b >= cut for g, b in bins), sum(not g and b >= cut for g, b in bins)
            tail = sum(math.comb(n, i) * each**i * (1 - each) ** (n - i) for i in range(k + 1))
            if k >= n * each or tail > Fraction(1, 20) / chains:
                break
            if hits > k and (best is None or (hits - k, cut) > best):
                best = hits - k, cut
        if best:
            want[s] = best[1]
    assert got == want and set(got) == {"en", "fr", "de"}
    for s, cut in got.items():
        fresh = [x for g, x in rows(20000, planted[s][1]) if g]
        assert sum(x * 50 >= cut for x in fresh) <= alpha * len(fresh), s


def test_binomial_tail(spark):
    import math

    d = spark.createDataFrame([(500, k) for k in range(12)], "good_n long, bad_k long")
    for r in d.select("*", quality.binomial_tail(F.col("good_n"), F.col("bad_k"), 0.02).alias("log")).collect():
        want = sum(math.comb(500, i) * 0.02**i * 0.98 ** (500 - i) for i in range(r.bad_k + 1))
        assert math.exp(r.log) == pytest.approx(want if r.bad_k < 10 else 1.0)


def test_quality_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(empty, none).count() == 0
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, odd).collect()
    assert len(got) == docs.count() and all(r.kept == (not r.base_failed) for r in got)


# --- near duplicates


def components(rows, radius=4):
    fp = {}
    for i, t, *_ in rows:
        w = space_words((t or "").translate(LOWER))
        s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], np.uint64)
        fp[i] = sum(int((2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(s))) << b for b in range(64))
    name = {i: i for i in fp}
    while True:
        new = {i: min(name[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= radius) for i in fp}
        if new == name:
            return {i: (fp[i], name[i]) for i in fp}
        name = new


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_near_duplicates(which, request, rows):
    got = {i: (r.fp & (1 << 64) - 1, r.component_id) for i, r in by_id(simhash.near_duplicates(request.getfixturevalue(which))).items()}
    assert got == components(rows)


def test_links_of_a_large_bucket(spark, monkeypatch):
    """Many fingerprints in a few buckets, dealt into small blocks, against all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 3)
    fps = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(60, rng.integers(0, 9), replace=False)) for b in base for _ in range(150)})
    d = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, rep long")
    from wardspark.llm.components import components as connected

    got = {r.node: r.component for r in connected(simhash.links(d)).collect()}
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert {k: int(x) for k, x in enumerate(label) if near[k].sum() > 1} == got


def test_within_by_all_radii():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, 100).astype(np.uint64), rng.integers(0, 1 << 63, 100).astype(np.uint64)
    b[:50] = a[:50] ^ np.array([(1 << int(k % 9)) - 1 for k in range(50)], np.uint64)
    for radius in range(9):
        got = simhash._lanes(simhash.within(simhash.planes_of(a), simhash.planes_of(b), radius), 100)
        assert (got == (np.bitwise_count(a ^ b) <= radius)).all()


def test_blocks_far_away_are_given_up():
    """Planes that are read, however many lanes the last block lacks; one near pair keeps its own block only."""
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 640):
        a, read = rng.integers(0, 1 << 63, n).astype(np.uint64), []
        assert not simhash.within(simhash.planes_of(a), simhash.planes_of(~a), 4, simhash.filling(n), read).any()
        assert len(read) == simhash.STEP
    b, read = ~a, []
    b[100] = a[100] ^ np.uint64(5)
    near = simhash.within(simhash.planes_of(a), simhash.planes_of(b), 4, simhash.filling(640), read)
    assert np.flatnonzero(simhash._lanes(near, 640)).tolist() == [100]
    assert read == [10] * simhash.STEP + [1] * (64 - simhash.STEP)


def test_more_blocks_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40)
    fps = sorted({int(x) ^ sum(1 << int(y) for y in rng.choice(60, rng.integers(0, 7), replace=False)) for x in base for _ in range(10)})
    d = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, rep long")
    from wardspark.llm.components import components as connected

    want = sorted(connected(simhash.links(d)).collect())
    for bucket, blocks in ((1, 6), (1e-6, 7), (1e-9, 8)):
        monkeypatch.setattr(simhash, "blocks_for", lambda radius, classes, blocks=blocks: blocks)
        assert sorted(connected(simhash.links(d)).collect()) == want, bucket
    monkeypatch.undo()
    assert simhash.blocks_for(4, 10**6) == 6 and simhash.blocks_for(4, 10**9) > 6


def test_near_duplicates_of_nothing(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    d = spark.createDataFrame([(None, "a b"), (None, "c"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(d).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]


# --- tokenizers


def test_counts_against_the_library(docs, rows, clashing, empty):
    lib = Tokenizer.from_file(BYTE)
    for d in (docs, clashing):
        got = by_id(tokencount.token_counts(d, BYTE))
        for i, t, *_ in rows:
            n = len(lib.encode(t or "", add_special_tokens=False).ids)
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024), t
    assert tokencount.token_counts(empty, BYTE).count() == 0


def test_encoding_against_the_library(docs, rows, clashing, empty):
    lib = Tokenizer.from_file(WORD)
    for d in (docs, clashing):
        got = by_id(encode.encode_decode(d, WORD))
        for i, t, *_ in rows:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            assert (got[i].n_tokens, bytes(got[i].ids), got[i].decoded) == (len(ids), bpe.packed(ids), lib.decode(ids, skip_special_tokens=False)), t
    assert encode.encode_decode(empty, WORD).count() == 0


def test_small_caches_change_nothing(rows, monkeypatch):
    texts = [r[1] or "" for r in rows]
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(transducer, "STATES", 2000)
    c = tokencount.Counter(BYTE)
    assert [int(c.texts([t])[0]) for t in texts] == want
    monkeypatch.setattr(encode, "KEPT", 10)
    e = encode.Encoder(WORD)
    lib = Tokenizer.from_file(WORD)
    assert [e.texts([t])[0][0] for t in texts] == [bpe.packed(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_transducer_emits_what_the_encoding_has(monkeypatch):
    """Transitions along a word, whatever chunks it lies in and however often the table starts anew."""
    b = bpe.loaded(BYTE, "byte")
    words = ["the", "then", "thens", " there", "a", "ab", "abc" * 90, " " * 700, "\n\n", "é字" * 40, "x"] * 3
    raw = "".join(w.encode().decode("latin-1") for w in words).encode("latin-1")
    begins = np.cumsum([0, *(len(w.encode()) for w in words)])[:-1]
    encoded = b.encode_words(list({w.encode().decode("latin-1") for w in words}))
    want = np.cumsum([0, *(len(encoded[w.encode().decode("latin-1")]) for w in words)])
    for states, chunk in ((1 << 18, 256), (1 << 18, 7), (1 << 18, 1), (300, 256), (90, 64)):
        monkeypatch.setattr(transducer, "STATES", states)
        t = transducer.Transducer(b)
        assert (t.counts(np.frombuffer(raw, np.uint8), begins, chunk) == want).all(), (states, chunk)
    monkeypatch.setattr(transducer, "STATES", 1 << 18)
    t = transducer.Transducer(b)
    t.counts(np.frombuffer(raw, np.uint8), begins)
    made = t.made
    assert (t.counts(np.frombuffer(raw, np.uint8), begins) == want).all() and t.made == made  # compiled once


def test_other_kinds_of_tokenizer_files_are_refused():
    for path, kind in ((BYTE, "word"), (WORD, "byte")):
        with pytest.raises(ValueError, match="otherwise"):
            bpe.loaded(path, kind)


def test_pretokens_by_stretches():
    import random

    r = random.Random(3)
    lib = Tokenizer.from_file(BYTE).pre_tokenizer
    texts = ["".join(r.choice(["'", "s", "re", "ll", " ", "  ", "\n", "a", "1", "!", "é", "字", "　"]) for _ in range(r.randint(0, 40))) for _ in range(500)]
    joined, start, end, bounds, _ = pretoken.pretokens(texts)
    at = 0
    for k, t in enumerate(texts):
        got = [(int(a) - at, int(b) - at) for a, b in zip(start[bounds[k] : bounds[k + 1]], end[bounds[k] : bounds[k + 1]], strict=True)]
        assert got == [p[1] for p in lib.pre_tokenize_str(t)], t
        at += len(t) + 1


# --- token files


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_token_files(spark, which, request, rows):
    lib = Tokenizer.from_file(BYTE)
    got = by_id(repair.read(spark, repair.write(request.getfixturevalue(which), BYTE)))
    start = 0
    for i, t, *_ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids), bpe.packed(ids)), t
        start += len(ids)


def test_token_files_of_nothing(spark, empty):
    assert repair.read(spark, repair.write(empty, BYTE)).count() == 0


def test_repair_round_trip():
    rng = np.random.default_rng(4)
    for n, kinds in ((0, 3), (1, 3), (5000, 3), (20000, 50), (4000, 1)):
        ids = rng.integers(0, kinds, n).astype(np.int32)
        edges = np.unique(np.r_[0, rng.integers(0, n + 1, 9), n])
        if len(edges) == 1:
            edges = np.r_[edges, edges]
        b = repair.Block(repair.pack(ids, edges, 60))
        got, at = b.all()
        assert (got == ids).all() and (at == edges).all()
        for k in range(len(edges) - 1):
            size = int(edges[k + 1] - edges[k])
            for x, y in ((0, size), (size // 3, size // 2), (max(size - 1, 0), size)):
                assert (b.read_slice(k, x, y) == ids[edges[k] + x : edges[k] + y]).all()
    assert len(b.symbols) < 60  # one id over and over in ten documents: halved again and again


@pytest.mark.parametrize("least", [2, 8])
def test_repair_goes_on_until_no_pair_repeats(least):
    """A Zipf stream, a long passage many times and one id over and over: no pair is left that stands least times."""
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 60, 3000)
    for ids in (np.minimum(rng.zipf(1.3, 20000), 59), np.concatenate([np.r_[passage, rng.integers(0, 60, 5)] for _ in range(12)]), np.full(100_000, 7)):
        edges = np.array([0, len(ids) // 3, len(ids)])
        rules, seq, at = repair.compress(ids.astype(np.int32), edges, 60, least)
        found: dict[tuple[int, int], list[int]] = {}
        for k, pair in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)):
            if k + 1 not in at and (pair not in found or found[pair][-1] < k - 1):
                found.setdefault(pair, []).append(k)
        assert max(map(len, found.values()), default=0) < least
        size = repair.lengths(rules, 60)
        assert sum(size[x - 60] if x >= 60 else 1 for x in seq.tolist()) == len(ids)


# --- licences


def test_licenses(docs, clashing, rows, empty):
    for d in (docs, clashing):
        got = by_id(licenses.license_scan(d))
        for i, t, *_ in rows:
            w = plain_words(t)
            at = [(k, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
            found = {label for _, label in at}
            score = 1.0 if at else 0.0
            for line in (t or "").split("\n"):
                block = set(plain_words(line))
                for label, text in licenses.TEMPLATES:
                    s = set(plain_words(text))
                    if len(s & block) / len(s) >= 0.8 - 1e-9:
                        found.add(label)
                        score = max(score, len(s & block) / len(s))
            r = got[i]
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
            assert (r.base_labels, r.labels) == (",".join(sorted({x for _, x in at})), ",".join(sorted(found)))
            assert r.score == pytest.approx(score)
    assert licenses.license_scan(empty).count() == 0


# --- shards


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_shards(which, request, rows):
    got = sharding.assign(request.getfixturevalue(which), 5).collect()
    text = {r[0]: r[1] for r in rows}
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    slots = [sorted(r.slot for r in got if r.shard == s) for s in range(5)]
    assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_shards_keep_groups_together(spark, empty):
    d = spark.createDataFrame([(k, f"t{k // 4}" if k < 400 else f"u{k}") for k in range(1000)], "doc_id long, text string")
    a = sharding.assign(d, 8)
    assert sharding.cut_edges(a).first().cut == 0
    assert sharding.assign(empty, 8).count() == 0


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_shards_cut_few_links_of_skewed_groups(spark, monkeypatch, most):
    """A third of all rows is one group, and there are groups of all sizes below a shard's capacity: most links are whole."""
    monkeypatch.setattr(sharding, "BROADCAST_BYTES", most)
    monkeypatch.setattr(sharding, "LARGE", 20)
    text = lambda k: "same" if k < 700 else f"g{int((k - 700) ** 0.6)}" if k < 1700 else f"u{k}"
    d = spark.createDataFrame([(k, text(k)) for k in range(2100)], "doc_id long, text string")
    a = sharding.assign(d, 12)
    got = a.toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 2100 and sizes.max() - sizes.min() <= 1
    parts = got[got.grp.notna()].groupby("grp").size()
    assert parts.max() <= sizes.max() and (parts > 20).sum() >= 5  # the large group is cut into parts a shard can hold
    cut = sharding.cut_edges(a).first()
    assert cut.cut <= 0.2 * cut.links


def test_shards_of_one_large_group(spark):
    d = spark.createDataFrame([(k, "same" if k < 600 else f"u{k}") for k in range(1000)] + [(7, "same"), (7, "same")], "doc_id long, text string")
    got = sharding.assign(d, 8).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 1002 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_repeated_and_null_ids(spark):
    """Each operator gives each row, or leaves out rows without an id, as its docstring says; none fails."""
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (2, None)], SCHEMA.split(", lang")[0])
    d = d.withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(d, labels).count() == 4
    assert tokencount.token_counts(d, BYTE).count() == 4 and encode.encode_decode(d, WORD).count() == 4
    assert licenses.license_scan(d).count() == 4
    assert substring.substring_dedup(d).count() == 3 and sharding.assign(d, 3).count() == 3
    assert repair.read(spark, repair.write(d, BYTE)).count() == 3


