"""A byte-pair vocabulary as a deterministic transducer whose transitions carry how many tokens they emit.

A prefix of a pre-token is encoded as the encoding of a shorter prefix and its last token, which is the longest token at
its end that may follow there (``bpe``). So reading on needs no more of what was read than the places where a token may
still be going on: for each of them the node of the vocabulary's trie that was reached, the token before it, and how many
tokens lie between it and the present place. Such a set is a state; the next byte takes it to another one and the number
of tokens grows by what the transition emits (less than nothing where a merge joins what was apart).

States are made from the vocabulary when a byte first leads to them, as lazy automata do, and are interned; they do not
depend on the texts in hand. When there is no room for more of them the table starts anew, which changes nothing but time.
"""

from __future__ import annotations

import numpy as np

from wardspark.llm.bpe import Bpe

#: States and transitions that are kept; a state takes about 300 bytes, a place in the table 8.
STATES, PLACES = 1 << 19, 1 << 22
#: A transition is its next state, shifted, and what it emits above ``ZERO``.
_SHIFT, ZERO = 9, 256
#: A going token: its node, the token before it (0: none) and the tokens since, in one number.
_NODE, _BEFORE, _SINCE = 32, 12, 1024
_START = _SINCE


class Full(Exception):
    """There is no room for another state or transition."""


class Transducer:
    def __init__(self, model: Bpe):
        if model.suffix:
            raise ValueError("tokens that depend on the end of a word are not compiled")
        self.model = model
        self.length = np.zeros(max(model.length) + 1, np.int64)
        self.length[list(model.length)] = list(model.length.values())
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for raw, t in model.mid.items():
            node = 0
            for c in raw.encode("latin-1"):
                found = self.child[node].get(c)
                if found is None:
                    found = self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = found
            self.token[node] = t
        self.clear()

    def clear(self) -> None:
        """Only the start is left: nothing read, one place, no token before it."""
        self.states: list[tuple[int, ...]] = [(_START,)]
        self.known = {self.states[0]: 0}
        self.last = np.zeros(1 << 10, np.int32)  # of each state the last token
        self.made = 0
        self.table = np.full(PLACES, -1, np.int64)  # state and byte above bit 32, the transition below

    def _state(self, going: tuple[int, ...]) -> int:
        found = self.known.get(going)
        if found is None:
            if len(self.states) >= STATES:
                raise Full
            found = self.known[going] = len(self.states)
            self.states.append(going)
            if found >= len(self.last):
                self.last = np.concatenate([self.last, np.zeros_like(self.last)])
            self.last[found] = (going[-1] >> _BEFORE & 0xFFFFF) - 1
        return found

    def make(self, state: int, byte: int) -> int:
        """The transition from a state by a byte. Places come in order, so the first token that fits is the longest."""
        if 3 * self.made > PLACES:
            raise Full
        fit, fits, child, token = self.model._fit.get, self.model.fits, self.child, self.token
        last, grown, going = -1, 0, []
        for x in self.states[state]:
            node = child[x >> _NODE].get(byte)
            if node is None:
                continue
            if last < 0 and token[node] >= 0:
                before, t = (x >> _BEFORE & 0xFFFFF) - 1, token[node]
                ok = before < 0 or fit(before << 20 | t)
                if ok is None:
                    ok = fits(before, t)
                if ok:
                    last, grown = t, 1 + _SINCE - (x & 4095)
            if child[node]:
                going.append(node << _NODE | x & 0xFFFFFFFF)
        if last < 0:
            raise ValueError(f"no token ends in byte {byte}")
        next_ = self._state((*[x + grown for x in going], (last + 1) << _BEFORE | _SINCE))
        found, key = next_ << _SHIFT | grown + ZERO, state << 8 | byte
        at = self._places(key)
        while self.table[at] >= 0:
            at = (at + 1) % PLACES
        self.table[at] = key << 32 | found
        self.made += 1
        return found

    @staticmethod
    def _places(key):
        return (key * 0x9E3779B1 >> 7) % PLACES

    def find(self, key: np.ndarray) -> np.ndarray:
        """The transitions of these keys (state and byte), -1 where there is none."""
        at = self._places(key)
        entry = self.table[at]
        found = np.where(entry >> 32 == key, entry & 0xFFFFFFFF, -1)
        on = np.flatnonzero((found < 0) & (entry >= 0))
        while len(on):
            at[on] = (at[on] + 1) % PLACES
            entry = self.table[at[on]]
            same = entry >> 32 == key[on]
            found[on[same]] = entry[same] & 0xFFFFFFFF
            on = on[~same & (entry >= 0)]
        return found

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Transitions of many states at once."""
        key = state << 8 | byte
        found = self.find(key)
        missing = found < 0
        if missing.any():
            made: dict[int, int] = {}
            for x in key[missing].tolist():
                if x not in made:
                    made[x] = self.make(x >> 8, x & 255)
            found[missing] = [made[x] for x in key[missing].tolist()]
        return found

    def counts(self, data: np.ndarray, begins: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Tokens emitted up to each place where a pre-token begins, and in all: data is a sequence of bytes, begins the
        sorted places where pre-tokens begin, 0 among them."""
        _, emitted = self.run(data, begins, chunk)
        return np.r_[0, np.cumsum(emitted, dtype=np.int64)][np.r_[begins, len(data)]]

    def ids(self, data: np.ndarray, begins: np.ndarray, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """The tokens themselves, and how many there are before each pre-token (and in all): from the end of each back."""
        last, emitted = self.run(data, begins, chunk)
        total = np.r_[0, np.cumsum(emitted, dtype=np.int64)][np.r_[begins, len(data)]]
        out = np.zeros(total[-1], np.int32)
        place, slot = np.r_[begins[1:], len(data)] - 1, total[1:] - 1
        first = begins
        while len(place):
            t = last[place]
            out[slot] = t
            place, slot = place - self.length[t], slot - 1
            on = place >= first
            place, slot, first = place[on], slot[on], first[on]
        return out, total

    def run(self, data: np.ndarray, begins: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """After each byte the last token of what was read of its pre-token, and what the byte emitted.

        The data are read in chunks side by side. Behind the first beginning in it a chunk's map from the state before it
        to the state after it, and to the tokens emitted, is constant, so a composition of maps is the last constant one;
        the scan brings every chunk that state, from which the bytes before its first beginning are read."""
        try:
            return self._run(data, begins, chunk)
        except Full:
            self.clear()
        k = int(np.searchsorted(begins, len(data) // 2, "right"))
        k = k if k < len(begins) else k - 1
        if k:  # half as many bytes need fewer states at once
            a, b = self.run(data[: begins[k]], begins[:k], chunk), self.run(data[begins[k] :], begins[k:] - begins[k], chunk)
            return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        return self._alone(data)

    def _alone(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One pre-token, starting anew whenever the table is full."""
        going, last, emitted = self.states[0], np.zeros(len(data), np.int32), np.zeros(len(data), np.int16)
        for k, byte in enumerate(data.tolist()):
            try:
                found = self.make(self._state(going), byte)
            except Full:
                self.clear()
                found = self.make(self._state(going), byte)
            state = found >> _SHIFT
            going, last[k], emitted[k] = self.states[state], self.last[state], (found & 511) - ZERO
        return last, emitted

    def _run(self, data: np.ndarray, begins: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        rows = -(-n // chunk)
        bytes_ = np.zeros(rows * chunk, np.uint8)
        bytes_[:n] = data
        bytes_ = np.ascontiguousarray(bytes_.reshape(rows, chunk).T)
        start = np.zeros(rows * chunk, bool)
        start[begins] = True
        start[n:] = True  # what fills up the last chunk is read by itself
        start = np.ascontiguousarray(start.reshape(rows, chunk).T)
        constant = start.any(axis=0)
        head = np.where(constant, start.argmax(axis=0), chunk)
        out = np.zeros((chunk, rows), np.int32)
        # behind the first beginning of each chunk, where the state before it does not matter
        state, live = np.zeros(rows, np.int64), np.zeros(0, np.int64)
        for k in range(chunk):
            state[start[k]] = 0
            if len(live) < rows:
                live = np.flatnonzero(head <= k)
            if len(live) < rows:
                found = out[k, live] = self.step(state[live], bytes_[k][live])
                state[live] = found >> _SHIFT
            else:
                found = out[k] = self.step(state, bytes_[k])
                state = found >> _SHIFT
        # the scan: the state before a chunk is that behind the last constant map; chunks without a beginning hand on theirs
        order = np.flatnonzero(head > 0)
        before = np.zeros(rows, np.int64)
        before[1:] = state[:-1]
        ready = np.r_[True, constant[:-1]]
        while len(order):
            now = order[ready[order]]
            at = before[now]
            for k in range(int(head[now].max())):
                go = np.flatnonzero(head[now] > k)
                found = out[k, now[go]] = self.step(at[go], bytes_[k, now[go]])
                at[go] = found >> _SHIFT
            open_ = ~constant[now]
            after = now[open_] + 1
            before[after[after < rows]] = at[open_][after < rows]
            order = order[~ready[order]]
            ready[after[after < rows]] = True
        found = out.T.ravel()[:n]
        return self.last[found >> _SHIFT], ((found & 511) - ZERO).astype(np.int16)
