"""op6's encoder: words are encoded once and kept, pairs are numbered without a sort of places."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wardspark.llm import pretoken, repair, wordids

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "'", "'", "s", "re", "ll", "l", "ve", "d", "S", " ", "  ", "\n", "\t", "a", "Ab", "1", "12", "²", "!", "#", "é", "字", "ß", "ſ", "́", "\U0001f600",
    "　", "\xa0", "\x85", " ", "\x00", "\x00\x00", "the", " there", "x" * 14, "x" * 15, "x" * 16, "abc" * 17, "é" * 30, "the" * 9, "q" * 200,
]
RARE = ["\U0010ffff", "͸", "<|endoftext|>"]


def some_texts(seed: int, n: int) -> list:
    r = random.Random(seed)
    texts = ["".join(r.choice(RARE if r.random() < 0.003 else PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return [None, "", "'s", "x's", " 's", "  's", "\n's", "''s", "'s's", "'", " '", "a'", *RARE, *texts, ""]


def wrong(encoder, texts: list) -> list:
    lib = Tokenizer.from_file(BYTE)
    ids, edges = encoder.texts(pa.array(texts, pa.string()), 7)
    assert len(edges) == len(texts) + 1 and edges[-1] == len(ids)
    return [t for k, t in enumerate(texts) if ids[edges[k] : edges[k + 1]].tolist() != [*lib.encode(t or "", add_special_tokens=False).ids, 7]]


def test_ids_are_those_of_the_library():
    e = repair.TextEncoder(BYTE)
    texts = some_texts(1, 1500)
    assert wrong(e, texts) == [] and wrong(e, texts) == [] and wrong(e, some_texts(2, 1500)) == []
    assert wrong(e, [None]) == [] and wrong(e, ["", ""]) == []
    sliced = pa.array(["zero", "one two", None, "three"]).slice(1, 2)
    ids, edges = e.texts(sliced, 0)
    assert ids[: edges[1]].tolist() == [*Tokenizer.from_file(BYTE).encode("one two").ids, 0] and ids[edges[1] :].tolist() == [0]


@pytest.mark.parametrize("words", [1, 40, 700])
def test_a_full_table_starts_anew(monkeypatch, words):
    monkeypatch.setattr(wordids, "WORDS", words)
    monkeypatch.setattr(wordids, "SLOTS", 2 * words)
    monkeypatch.setattr(wordids, "TOGETHER", 50)
    e = repair.TextEncoder(BYTE)
    for seed in (1, 2, 1):
        assert wrong(e, some_texts(seed, 300)) == []
        assert e.words.n <= words


def test_words_are_encoded_once(monkeypatch):
    """Failed before: every word of every text ran through the transducer again."""
    e = repair.TextEncoder(BYTE)
    asked = []
    ids = e.words.merges.ids
    monkeypatch.setattr(e.words.merges, "ids", lambda data, start, size: asked.append(len(start)) or ids(data, start, size))
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12))) for _ in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(200)) for _ in range(60)]
    assert wrong(e, texts[:30]) == [] and wrong(e, texts[30:]) == []
    assert sum(asked) <= 2 * len(vocabulary) + 1  # with a space before it or none; and the line feed
    assert "transducer" not in vars(e.words)  # compiled only where a word is longer than the merges take


def test_byte_beginnings_are_those_of_the_automaton():
    texts = [t or "" for t in some_texts(5, 800) if t is None or not any(x in t for x in RARE)]
    joined, start, _, _, odd = pretoken.pretokens(texts)
    assert not odd.any()
    at = np.r_[0, np.cumsum([len(c.encode()) for c in joined])]
    ends = np.cumsum([len(t.encode()) + 1 for t in texts]) - 1
    begin, unknown = pretoken.byte_beginnings(np.frombuffer(joined.encode(), np.uint8), ends)
    assert np.flatnonzero(begin).tolist() == sorted({*at[start].tolist(), *ends.tolist()}) and not len(unknown)


@pytest.mark.parametrize("rare", [False, True])
def test_counts_of_pairs(rare):
    rng = np.random.default_rng(6)
    for k in range(150):
        ids = np.repeat(rng.integers(0, (1, 2, 3, 8)[k % 4], 120), rng.integers(1, 1 + (1, 5)[k % 2] + 1, 120))
        cut = np.unique(rng.integers(0, len(ids) - 1, 5))
        want: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True)):
            if i not in cut and want.setdefault(pair, [])[-1:] != [i - 1]:
                want[pair].append(i)
        code, found, n = repair._counted(ids.astype(np.int64), cut, 8, rare)
        got: dict[tuple[int, int], list[int]] = {}
        for i in np.flatnonzero(code >= 0).tolist():
            got.setdefault((int(found[code[i]] >> 32), int(found[code[i]] & 0xFFFFFFFF)), []).append(i)
            assert n[code[i]] >= 8
        assert got == {p: w for p, w in want.items() if len(w) >= 8}
