"""Where the pre-tokens of byte-level BPE begin, by a finite automaton over character classes.

The automaton is run over many equal stretches of a text at once. A stretch yields a map from the state before it to the
state after it; the maps are composed by a parallel prefix scan, which gives the state before each stretch, and then all
stretches mark the beginnings with their right states.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Classes of characters. The letters of the English contractions 's 't 'm 'd 're 've 'll have classes of their own.
LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER, ONE, RV, E, L, STOP = range(11)
#: A code point that this Python's tables do not know: whoever meets it asks the library.
UNKNOWN = 255
_STATES = START, WORD, DIGITS, SIGNS, SP1, BL1, SPN, BLN, QUO, QUO_RV, QUO_L = range(11)
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point."""
    kind = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k[0] == "L":
            kind[c] = LETTER
        elif k[0] == "N":
            kind[c] = NUMBER
        elif k == "Cn":
            kind[c] = UNKNOWN
    kind[_WHITE] = BLANK
    kind[0x20], kind[ord("'")] = SPACE, QUOTE
    for letters, c in (("stmd", ONE), ("rv", RV), ("e", E), ("l", L)):
        kind[[ord(x) for x in letters]] = c
    return kind


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by state and class. Marks: 1 if a pre-token begins at this character, 2 at the one before."""
    step, mark = np.zeros((11, 11), np.uint8), np.zeros((11, 11), np.uint8)
    letters = {LETTER, ONE, RV, E, L}

    def begin(c: int) -> tuple[int, int]:
        if c in letters:
            return WORD, 1
        return {NUMBER: DIGITS, SPACE: SP1, BLANK: BL1, QUOTE: QUO, OTHER: SIGNS, STOP: START}[c], 1

    def word(c: int) -> tuple[int, int]:
        return (WORD, 0) if c in letters else begin(c)

    def joined(c: int) -> int:
        return WORD if c in letters else DIGITS if c == NUMBER else SIGNS

    def go(s: int, c: int) -> tuple[int, int]:
        blank = c in (SPACE, BLANK)
        if s == WORD:
            return word(c)
        if s == DIGITS and c == NUMBER:
            return DIGITS, 0
        if s == SIGNS and c in (OTHER, QUOTE):
            return SIGNS, 0
        if s in (SP1, BL1, SPN, BLN):
            if blank:
                return (SPN if c == SPACE else BLN), 0
            if c == STOP:  # white space at the end of a text stays whole
                return begin(c)
            last = 2 if s in (SPN, BLN) else 0  # else its last character goes apart
            if s in (SP1, SPN):
                return joined(c), last
            state, here = begin(c)
            return state, here | last
        if s == QUO:
            if c in (QUOTE, OTHER):
                return SIGNS, 0
            if c == ONE:
                return START, 0
            if c in (RV, L):
                return (QUO_RV if c == RV else QUO_L), 0
            return begin(c)
        if s in (QUO_RV, QUO_L):
            if c == (E if s == QUO_RV else L):
                return START, 0
            state, here = word(c)
            return state, here | 2
        return begin(c)

    for s in _STATES:
        for c in range(11):
            step[s, c], mark[s, c] = go(s, c)
    return step, mark


def scan(maps: np.ndarray) -> np.ndarray:
    """maps: one map of states per row. The composition of all rows up to each, in log2(rows) steps."""
    maps, k = maps.copy(), 1
    while k < len(maps):
        maps[k:] = np.take_along_axis(maps[k:], maps[:-k].astype(np.intp), axis=1)
        k *= 2
    return maps


def beginnings(kind: np.ndarray, stretch: int = 512) -> np.ndarray:
    """Where pre-tokens begin in a sequence of classes; texts in it are ended by STOP, itself a beginning."""
    step, mark = automaton()
    flat, flat_mark = step.ravel(), mark.ravel()
    n = len(kind)
    rows = -(-n // stretch)
    c = np.full(rows * stretch, STOP, np.uint8)
    c[:n] = kind
    c = np.ascontiguousarray(c.reshape(rows, stretch).T).astype(np.intp)
    # from every state at once, until all of a stretch are in one state
    at = np.broadcast_to(np.arange(11), (rows, 11)).astype(np.intp)
    k = 0
    while k < stretch and not (k % 16 == 0 and k and (at == at[:, :1]).all()):
        at = flat[at * 11 + c[k][:, None]].astype(np.intp)
        k += 1
    if k < stretch:
        one = at[:, 0]
        for k in range(k, stretch):
            one = flat[one * 11 + c[k]].astype(np.intp)
        at = np.broadcast_to(one[:, None], (rows, 11))
    before = np.r_[START, scan(at)[:-1, START]].astype(np.intp)
    marks = np.zeros((stretch, rows), np.uint8)
    for k in range(stretch):
        x = before * 11 + c[k]
        marks[k] = flat_mark[x]
        before = flat[x].astype(np.intp)
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    found = (marks & 1).astype(bool)
    found[:-1] |= (marks[1:] & 2).astype(bool)
    return found


def pretokens(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by line feeds, the beginnings and ends of their pre-tokens in it, how many pre-tokens there are
    before each text (and in all), and which texts hold unknown code points (their pre-tokens mean nothing). A text
    should not hold special tokens."""
    joined = "\n".join(texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[cps]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    unknown = np.flatnonzero(kind == UNKNOWN)
    odd = np.zeros(len(texts), bool)
    odd[np.searchsorted(ends, unknown)] = True
    kind[unknown] = OTHER
    kind[ends] = STOP
    start = np.flatnonzero(beginnings(kind))
    end = np.r_[start[1:], len(kind)]
    inner = kind[start] != STOP
    bounds = np.searchsorted(start[inner], np.r_[0, ends[:-1] + 1, len(kind)])
    return joined, start[inner], end[inner], bounds, odd


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Class of each class where contractions are looked for apart and white space is one class."""
    f = np.full(256, OTHER, np.uint8)
    f[[LETTER, ONE, RV, E, L]], f[NUMBER], f[[SPACE, BLANK]] = LETTER, NUMBER, BLANK
    return f


def byte_beginnings(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same on UTF-8 bytes, by rules that look at neighbours only: whether a pre-token begins at each byte of texts that
    are each ended by a line feed (places in ends, themselves beginnings), and where unknown code points begin."""
    folded = _folded()
    kind = folded[classes()[:256]][data]
    lead = np.flatnonzero(data >= 0xC0)
    b = data[lead].astype(np.int32)
    cps, wide = (b & 0x1F) << 6 | data[lead + 1] & 0x3F, [np.flatnonzero(b >= first) for first in (0xE0, 0xF0)]
    for k, w in zip(wide, (2, 3), strict=True):
        cps[k] = cps[k] << 6 | data[lead[k] + w] & 0x3F
    c = classes()[cps & 0x1FFFFF]
    unknown, c = lead[c == UNKNOWN], folded[c]
    kind[lead] = kind[lead + 1] = c
    for k, w in zip(wide, (2, 3), strict=True):
        kind[lead[k] + w] = c[k]
    kind[ends] = STOP
    begin = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    # of white space before something else the last character goes apart, a space with what follows; at the end of a text
    # white space stays whole
    last = np.flatnonzero(begin[1:] & (kind[:-1] == BLANK) & (kind[1:] != STOP))
    begin[last[data[last] == 0x20] + 1] = False
    while len(inner := np.flatnonzero(data[last] & 0xC0 == 0x80)):
        last[inner] -= 1
    begin[last] = True
    # a quote at a beginning and the letters of a contraction are one
    quote = np.flatnonzero((data == 0x27) & begin)
    one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
    size = np.where(np.isin(one, list(b"stmd")), 2, np.where(np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 3, 0))
    quote, size = quote[size > 0], size[size > 0]
    begin[quote + 1] = False
    begin[quote + size] = begin[ends] = True
    return begin, unknown
