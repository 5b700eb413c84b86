"""Byte-pair encoding over a trie of distinct words.

A sequence of tokens is what the merges yield just if each two neighbours are: so the last token of every prefix of a
word follows from the last tokens of its shorter prefixes. Words are visited in sorted order, which is depth first
through their trie; the states along a shared prefix stay and are computed once.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

_NEVER = 1 << 60
#: So many answers about pairs of tokens are kept.
FITS = 250_000


def byte_letters() -> dict[str, str]:
    """The printable stand-ins of byte-level vocabularies, to the byte as a character of the same number."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + k): chr(b) for k, b in enumerate(other)}


#: The kinds of tokenizer files that are known: how texts are normalised, cut and put together again.
BYTE_LEVEL = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
}
WORD_LEVEL = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = {k: v for k, v in {**model, "vocab": None, "merges": None, "end_of_word_suffix": None}.items() if v not in (None, False, "BPE")}
        if odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"not a plain byte-pair model: {odd or 'added tokens with rules'}")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.shown = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.mid: dict[str, int] = {}
        self.end: dict[str, int] = {}
        self.length: dict[int, int] = {}
        for token, i in model["vocab"].items():
            if token in self.special:
                continue
            ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            raw = token[: -len(self.suffix)] if ends else token
            if all(c in letters for c in raw):
                raw = "".join(letters[c] for c in raw)
                (self.end if ends else self.mid)[raw] = i
                self.length[i] = len(raw)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # left, right, rank of the merge that makes it
        for r, (a, b) in enumerate(model["merges"]):
            pair = model["vocab"][a], model["vocab"][b]
            self.rank.setdefault(pair, r)
            self.parts.setdefault(model["vocab"][a + b], (*pair, r))
        self._fit: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        self.mid = {t: i for t, i in self.mid.items() if self.whole(i)}
        self.end = {t: i for t, i in self.end.items() if self.whole(i)} if self.suffix else self.mid
        self.mid_reach, self.end_reach = self._reach(self.mid), self._reach(self.end)

    def _apart(self, a: int, b: int, until: int) -> bool:
        """No merge joins a piece at the end of a with one at the start of b before ``until``, nor before these pieces
        go into larger ones of their own side. Looks back from the whole tokens to their bytes, undoing the later merge
        each time; of merges of one rank the left one comes first."""
        dies_a = dies_b = until
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < dies_a and r <= dies_b and r < until:
                return False
            pa, pb = self.parts.get(a), self.parts.get(b)
            if pa is None and pb is None:
                return True
            if pb is None or (pa is not None and pa[2] > pb[2]):
                a, dies_a = pa[1], pa[2]
            else:
                b, dies_b = pb[0], pb[2]

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a."""
        if len(self._fit) > FITS:
            self._fit.clear()
        found = self._fit[a << 20 | b] = self._apart(a, b, _NEVER)
        return found

    def whole(self, t: int) -> bool:
        """Whether the merges make the token from its bytes when these stand alone."""
        found = self._own.get(t)
        if found is None:
            p = self.parts.get(t)
            found = self._own[t] = p is None or (self.whole(p[0]) and self.whole(p[1]) and self._apart(p[0], p[1], p[2]))
        return found

    def _reach(self, vocab: dict[str, int]) -> dict[str, int]:
        """Length of the longest token by its last three bytes."""
        found: dict[str, int] = {}
        for t in vocab:
            if len(t) >= 3 and len(t) > found.get(t[-3:], 0):
                found[t[-3:]] = len(t)
        return found

    def _last(self, word: str, n: int, vocab: dict[str, int], reach: dict[str, int], last: list[int]) -> int:
        """Last token of word[:n]; last: those of the shorter prefixes, by length."""
        get, known = vocab.get, self._fit.get
        low = n - reach.get(word[n - 3 : n], 2) if n >= 3 else 0
        for k in range(low if low > 0 else 0, n):
            t = get(word[k:n])
            if t is not None:
                if not k:
                    return t
                before = last[k]
                fit = known(before << 20 | t)
                if fit or (fit is None and self.fits(before, t)):
                    return t
        raise ValueError(f"no token ends {word[:n]!r}")

    def _visit(self, words: list[str]):
        """For each of the sorted words itself, its last token and the last tokens of its shorter prefixes by length."""
        before, last = "", [-1]
        find, mid, mid_reach, end, end_reach = self._last, self.mid, self.mid_reach, self.end, self.end_reach
        for w in words:
            n = len(w)
            most = min(n, len(before))
            shared = 0
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for m in range(len(last), n):
                last.append(find(w, m, mid, mid_reach, last))
            yield w, find(w, n, end, end_reach, last), last
            before = w

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words; a word is its bytes as characters of the same number."""
        out: dict[str, list[int]] = {}
        for w, t, last in self._visit(sorted(words)):
            ids, n = [t], len(w) - self.length[t]
            while n:
                ids.append(last[n])
                n -= self.length[last[n]]
            out[w] = ids[::-1]
        return out


@lru_cache(maxsize=8)
def checked(path: str, kind: str) -> None:
    """Refuses a tokenizer file that is not of this kind ("byte" or "word"), as its ids would be wrong."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if {k: spec.get(k) for k in BYTE_LEVEL} != {"byte": BYTE_LEVEL, "word": WORD_LEVEL}[kind]:
        raise ValueError(f"{path} normalises, cuts or decodes texts otherwise than the {kind}-level tokenizers known here")


@lru_cache(maxsize=4)
def loaded(path: str, kind: str) -> Bpe:
    """The model of a tokenizer file of this kind."""
    checked(path, kind)
    return Bpe(path)


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()
