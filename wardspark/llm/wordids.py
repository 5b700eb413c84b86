"""Ids of words that were met before, kept in a table.

A word of up to 15 bytes is two numbers of 64 bits (its bytes, and its length in the highest one), so that words are equal
just if these are: nothing is taken for known by a hash alone. Words that the table does not know, each once, are put
together from their bytes by the merges of the vocabulary, all words side by side; so are words of up to 48 bytes, which
are not kept, and what is longer the transducer reads (``transducer``). When there is no room for more words the table
starts anew, which changes nothing but time.
"""

from __future__ import annotations

from functools import cached_property
from itertools import pairwise

import numpy as np

from wardspark.llm.bpe import Bpe
from wardspark.llm.transducer import Transducer

#: Words that are kept, and places of the table. A word takes about 50 bytes.
WORDS, SLOTS = 1 << 20, 1 << 21
#: Longest word that is kept, longest that is put together by merges, and how many at once.
LONGEST, MERGED, TOGETHER = 15, 48, 1 << 16
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A pair that is not merged, with room for a place below it; what stands behind a word.
_NEVER, _NOTHING, _BITS = np.iinfo(np.int32).max, np.iinfo(np.int32).max, 6
_PAIRS = 1 << 18


class Merges:
    """The merges of a vocabulary, applied to many short words at once: in each word the first of the pairs of least rank
    is joined, until no pair is left that merges."""

    def __init__(self, model: Bpe):
        if len(model.rank) > _PAIRS // 2:
            raise ValueError(f"more than {_PAIRS // 2} merges")
        self.byte = np.array([model.mid.get(chr(b), -1) for b in range(256)], np.int32)
        token = {t: i for i, t in model.shown.items()}
        pairs = np.array(list(model.rank), np.int64)
        self.key, self.rank = np.full(_PAIRS, -1, np.int64), np.zeros(_PAIRS, np.int32)
        self.made = np.zeros(max(model.rank.values(), default=0) + 1, np.int32)
        ranks = np.fromiter(model.rank.values(), np.int32, len(pairs))
        self.made[ranks] = [token[model.shown[a] + model.shown[b]] for a, b in model.rank]
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        at, todo = self._places(keys), np.arange(len(keys))
        while len(todo):
            free = self.key[at[todo]] < 0
            self.key[at[todo[free]]] = keys[todo[free]]  # of several that want a place one has it
            todo = todo[self.key[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) % _PAIRS
        self.rank[at] = ranks
        two = np.arange(1 << 16)
        self.of_bytes = self.order(self.byte[two >> 8], self.byte[two & 255], 0)  # what most words begin with

    @staticmethod
    def _places(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MUL[0]) >> np.uint64(46)).view(np.int64)

    def order(self, left: np.ndarray, right: np.ndarray, place) -> np.ndarray:
        """Rank of each pair above its place, ``_NEVER`` where it is not merged."""
        key = left.astype(np.int64) << 32 | right
        at = self._places(key)
        there = self.key[at]
        on = np.flatnonzero((there != key) & (there >= 0))
        while len(on):
            at[on] = (at[on] + 1) % _PAIRS
            there[on] = self.key[at[on]]
            on = on[(there[on] != key[on]) & (there[on] >= 0)]
        return np.where(there == key, self.rank[at] << _BITS | place, _NEVER)

    def ids(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of up to ``MERGED`` bytes, one after the other, and how many each has."""
        n, last = len(start), int(size.max(initial=0))
        place = np.arange(last + 1, dtype=np.int32)[:, None]
        alive = place < size
        raw = data[np.minimum(place + start, len(data) - 1)]
        token = np.where(alive, self.byte[raw], np.int32(_NOTHING))
        if token.min(initial=0) < 0:
            raise ValueError("no token for a byte")
        # a column is a word, its last row stands for what is before and behind it
        ahead = np.where(place < size - 1, place + 1, last).astype(np.int8)
        back = np.repeat(np.r_[last, np.arange(last)].astype(np.int8)[:, None], n, axis=1)
        order = np.full((last + 1, n), _NEVER, np.int32)
        order[:-1] = np.where(alive[1:], self.of_bytes[raw[:-1].astype(np.uint16) << 8 | raw[1:]], _NEVER)
        order[:-1] |= place[:-1]  # all bits of _NEVER are set, so it stays
        columns = np.arange(n)  # the words that order is of
        while len(columns):
            least = order.min(axis=0)
            live = np.flatnonzero(least < _NEVER)
            least, words = least[live], columns[live]
            if 2 * len(live) < len(columns) or not len(live):
                order, columns, live = order[:, live], words, np.arange(len(live))
            i = least & (1 << _BITS) - 1
            j, before = ahead[i, words], back[i, words]
            after = ahead[j, words]
            token[i, words] = made = self.made[least >> _BITS]
            alive[j, words], order[j, live] = False, _NEVER
            ahead[i, words], back[after, words] = after, i
            order[i, live] = self.order(made, token[after, words], i)
            order[before, live] = self.order(token[before, words], made, before)
        return token.T[alive.T], alive.sum(axis=0)


class WordIds:
    def __init__(self, model: Bpe):
        self.model, self.merges = model, Merges(model)
        self.clear()

    @cached_property
    def transducer(self) -> Transducer:
        return Transducer(self.model)

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.slot = np.full(SLOTS, -1, np.int32)  # the word's number
        self.key = np.zeros((1 << 10, 2), np.uint64)
        self.place = np.zeros((1 << 10, 2), np.int64)  # where its ids begin, and how many there are
        self.flat = np.zeros(1 << 12, np.int32)

    def _grown(self, x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), x.dtype)])

    @staticmethod
    def _slots(key: np.ndarray) -> np.ndarray:
        h = (key[:, 0] ^ (key[:, 1] * _MUL[1])) * _MUL[0]
        h ^= h >> np.uint64(29)
        return ((h * _MUL[1]) >> np.uint64(40)).view(np.int64) % SLOTS

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 of those not there."""
        at = self._slots(key)
        found = self.slot[at].astype(np.int64)
        known = self.key[found]
        on = np.flatnonzero((found >= 0) & ((known[:, 0] != key[:, 0]) | (known[:, 1] != key[:, 1])))
        while len(on):
            at[on] = (at[on] + 1) % SLOTS
            found[on] = self.slot[at[on]]
            on = on[(found[on] >= 0) & (self.key[found[on]] != key[on]).any(axis=1)]
        return found

    def _keep(self, key: np.ndarray) -> None:
        """New words, each once, get the next numbers."""
        self.key = self._grown(self.key, self.n + len(key))
        self.key[self.n : self.n + len(key)] = key
        at, todo = self._slots(key), np.arange(len(key))
        while len(todo):
            free = self.slot[at[todo]] < 0
            self.slot[at[todo[free]]] = self.n + todo[free]  # of several that want a place one has it
            todo = todo[self.slot[at[todo]] != self.n + todo]
            at[todo] = (at[todo] + 1) % SLOTS
        self.n += len(key)

    def places(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word, ``size`` bytes from ``start`` on, begin in ``flat``, and how many there are. They
        stand there until the next call. Eight bytes and more follow ``data``'s last word."""
        eight = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))  # the bytes from each place on
        key = np.empty((len(start), 2), np.uint64)
        key[:, 0] = eight[start] & _MASK[np.minimum(size, 8)]
        key[:, 1] = size.astype(np.uint64) << np.uint64(56)
        more = np.flatnonzero((size > 8) & (size <= LONGEST))
        key[more, 1] |= eight[start[more] + 8] & _MASK[size[more] - 8]
        found = self._find(key)
        found[size > LONGEST] = -1
        missing = np.flatnonzero(found < 0)
        if len(missing):
            first, own = self._distinct(key[missing], size[missing])
            if self.n + len(first) > WORDS and self.n:
                self.clear()
                return self.places(data, start, size)
            # distinct short words are kept as long as there is room; what is behind them stands for this call only
            short = first[size[missing[first]] <= LONGEST][:WORDS]
            asked = np.r_[short, first[len(short) :]]
            self._encode(data, start[missing[asked]], size[missing[asked]], len(short), key[missing[short]])
            found[missing] = self.n - len(short) + own
        at = self.place[found]
        return at[:, 0], at[:, 1]

    @staticmethod
    def _distinct(key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct short word, then all longer ones by their sizes; and which of these each word is."""
        short, longer = np.flatnonzero(size <= LONGEST), np.flatnonzero(size > LONGEST)
        order, longer = short[np.lexsort((key[short, 0], key[short, 1]))], longer[np.argsort(size[longer], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]).any(axis=1)
        own = np.empty(len(key), np.int64)
        own[order], own[longer] = np.cumsum(new) - 1, new.sum() + np.arange(len(longer))
        return np.r_[order[new], longer], own

    def _encode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, keep: int, key: np.ndarray) -> None:
        """Ids of these words, of which those beyond ``MERGED`` bytes come last; the first ``keep`` of them stay."""
        most = int((size <= MERGED).sum())
        cuts = [*range(0, keep, TOGETHER), *range(keep, most, TOGETHER), most]
        parts = [self.merges.ids(data, start[a:b], size[a:b]) for a, b in pairwise(cuts)]
        if most < len(start):
            begin = np.r_[0, np.cumsum(size[most:])]
            ids, total = self.transducer.ids(data[np.repeat(start[most:] - begin[:-1], size[most:]) + np.arange(begin[-1])], begin[:-1])
            parts.append((ids, np.diff(total)))
        ids, total = np.concatenate([x for x, _ in parts]), np.r_[0, np.cumsum(np.concatenate([x for _, x in parts]))]
        self.flat = self._grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.place = self._grown(self.place, self.n + len(size))
        self.place[self.n : self.n + len(size)] = np.stack([self.used + total[:-1], np.diff(total)], 1)
        self.used += int(total[keep])
        self._keep(key)
