"""Words and window hashes of many texts at once, on the bytes of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Odd multipliers of the polynomial hashes: of bytes in a word, and of words in a window, two of each.
_BYTE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: What stands between lower-cased words of letters, digits and bytes beyond ASCII.
PLAIN_GAP = np.ones(256, bool)
PLAIN_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) in 64 bits."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if n <= 1 << 23:  # a table for a very long text isn't kept
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _ranged(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end], the same wherever the stretch lies."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[end] - total[start]) * powers(inverse(base), len(values) + 1)[start]


class Words:
    """The words of a stretch of texts: data holds all bytes, word i is data[start[i]:end[i]], and text k has the words
    bounds[k] to bounds[k + 1]."""

    def __init__(self, texts: pa.Array, gap: np.ndarray = SPACE, lower: bool = False):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        body = texts.buffers()[2]
        whole = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        data = whole[offsets[0] : offsets[-1]]
        self.data = data = LOWER[data] if lower else data
        self.offsets = offsets = offsets - offsets[0]
        full = ~gap[data]
        first, last = full.copy(), full.copy()
        first[1:] &= ~full[:-1]
        last[:-1] &= ~full[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        first[inner] = full[inner]
        last[inner - 1] = full[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)

    def hashes(self, k: int = 0) -> np.ndarray:
        h = _ranged(self.data.astype(np.uint64) + np.uint64(1), _BYTE[k], self.start, self.end)
        return mixed(h + (self.end - self.start).astype(np.uint64) * np.uint64(_WORD[k]))

    def places(self) -> np.ndarray:
        """Each word's place in its text."""
        return np.arange(len(self.start)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def left(self) -> np.ndarray:
        """How many words of its text there are from each word on, itself included."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.start))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def windows(hashes: np.ndarray, at: np.ndarray, length: int, k: int = 0) -> np.ndarray:
    """Hash of the ``length`` words from each of the places ``at`` on."""
    return mixed(_ranged(hashes, _WORD[k], at, at + length))


def stretches(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of text; a longer text is a slice by itself."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // most
    edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def planes(x: np.ndarray) -> bytes:
    """Fixed-width integers, all first bytes, then all second bytes and so on: what is small then shrinks well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() if len(x) else b""


class Recent:
    """A map that keeps what was asked for lately: beyond ``most`` entries the older half goes, but for what is asked
    for again."""

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def missing(self, keys: list) -> list:
        """Those not there; the others move to the young ones."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = [k for k in keys if k not in young]
        again = [k for k in out if k in old] if old else []
        if again:
            young.update((k, old[k]) for k in again)
            out = [k for k in out if k not in old]
        return out


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel() if raw else np.zeros(0, dtype)


def hash_of(words: list[bytes], k: int = 0) -> np.ndarray:
    """The hashes that ``Words`` has for these words."""
    w = Words(pa.array(words, pa.binary()), np.zeros(256, bool))
    return w.hashes(k)
