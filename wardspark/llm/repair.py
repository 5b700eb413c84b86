"""Token-id files with Re-Pair grammar compression.

Documents are put in order of their ids (a range partitioning; each partition is a shard of blocks), encoded, and each
block of token ids is compressed: frequent neighbouring pairs are counted exactly, get nonterminals and are replaced,
until no pair stands ``LEAST`` times; no rule reaches over the end of a document. A block holds its rules,
the expansion length of each, the replaced sequence and where its documents begin in it, so a document, or a stretch of
it, is read without expanding the rest (``read_slice``).

Block format, all integers little-endian: magic ``RP01``; number of rules, of symbols and of documents, terminals (each
unsigned 32 bits); rules (left and right, 32 bits each); expansion lengths of the rules (32 bits); first symbol of each
document (32 bits); the symbols as 32-bit numbers in byte planes. The blocks are rows of a Parquet table in the shared
folder: shard, block, first_doc, doc_ids, n_ids, body; the table is what is written and what is read back.

Defined cases: a null or empty text has the end id only; strings of special tokens become their ids, as the library takes
them; a text of more ids than a block is a block by itself; rows without an id are left out; repeated ids follow each
other, ordered by their text; an empty table gives an empty file and no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardspark.llm import bpe, pretoken
from wardspark.llm.arrays import planes, stretches, unplanes
from wardspark.llm.stage import new_path, texts
from wardspark.llm.tokencount import STRETCH, library
from wardspark.llm.wordids import WordIds

MAGIC = b"RP01"
#: Token ids in a block.
BLOCK = 1 << 20
#: How often a pair must stand to be replaced. A rule takes 12 bytes and a symbol 1 to 2 where it is stored, so that rules
#: for rarer pairs make files larger; 2 goes on until no pair repeats.
LEAST = 8
#: Up to so many blocks their offsets are broadcast.
MAX_BROADCAST_BLOCKS = 500_000
#: Ids of a rule that are kept ready for reading.
_SHORT = 256
_TABLE = 1 << 20


class TextEncoder:
    """Ids of whole texts: words that were met before come from a table, others are put together by the merges
    (``wordids``). Texts that hold special tokens, or code points that this Python does not know, go to the library."""

    def __init__(self, path: str):
        self.library = library(path)
        model = bpe.loaded(path, "byte")
        self.words, self.special = WordIds(model), [t.encode() for t in model.special]

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other and the end id behind each, and where each text begins (and the last ends)."""
        raw = texts.cast(pa.binary()).fill_null(b"").to_pylist()
        joined = b"\n".join([*raw, bytes(8)])
        data = np.frombuffer(joined, np.uint8)
        inner = data[: len(data) - 8]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
        begin, unknown = pretoken.byte_beginnings(inner, ends)
        start = np.flatnonzero(begin)
        place, n = self.words.places(data, start, np.diff(start, append=len(inner)))
        feeds = np.searchsorted(start, ends)  # the end id stands for the line feed behind each text
        n = n.copy()
        n[feeds] = 1
        after = np.cumsum(n)
        out = self.words.flat[np.repeat(place - after + n, n) + np.arange(after[-1])]
        out[after[feeds] - 1] = end_id
        edges = np.r_[0, after[feeds]]
        redo = {k for k, t in enumerate(raw) if any(x in t for x in self.special)} if any(x in joined for x in self.special) else set()
        redo |= set(np.searchsorted(ends, unknown).tolist())
        if redo:
            parts = [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            for k in redo:
                parts[k] = np.array([*self.library.encode(raw[k].decode(), add_special_tokens=False).ids, end_id], np.int32)
            out, edges = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return out, edges


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def _numbered(pair: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of the distinct pairs ``found`` each pair is, -1 if none. A table has one of them at each slot; those that lost
    their slot, and the pairs that meet it, go to another table."""
    out, keys, factor = np.full(len(pair), -1, np.int32), np.arange(len(found), dtype=np.int32), 0x9E3779B97F4A7C15
    todo, here = slice(None), pair
    while len(keys):
        bits = max(6, (3 * len(keys)).bit_length())
        places = lambda x: ((x.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)).view(np.int64)  # noqa: B023, E731
        own, slot = places(found[keys]), places(here)
        table = np.full(1 << bits, keys[0], np.int32)
        table[own] = keys
        code = table[slot]
        same = found[code] == here
        out[todo] = np.where(same, code, np.int32(-1))
        lost = table[own] != keys
        met = np.zeros(1 << bits, bool)
        met[own[lost]] = True
        again = np.flatnonzero(met[slot] & ~same)
        todo, here, keys = (again if isinstance(todo, slice) else todo[again]), here[again], keys[lost]
        factor = (factor * 5 + 2) % (1 << 64)
    return out


def _counted(seq: np.ndarray, cut: np.ndarray, least: int, rare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of the pair at each place among those that stand ``least`` times or more, -1 where it is none of them or
    would reach over a cut; these pairs, and how often they stand. Of equal pairs that overlap every second one counts. If
    such pairs are rare, a table of hashed counts drops most others first."""
    pair, at = seq[:-1] << 32 | seq[1:], slice(None)
    pair[cut] = -1
    if rare:
        slot = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)
        at = np.flatnonzero((np.bincount(slot, minlength=_TABLE) >= least)[slot])
        pair = pair[at]
    by_pair = np.sort(pair)
    first = np.flatnonzero(np.r_[len(pair) > 0, by_pair[1:] != by_pair[:-1]][: len(pair)])
    n = np.diff(first, append=len(pair))
    often = (n >= least) & (by_pair[first] >= 0)
    found, n = by_pair[first[often]], n[often]
    code = np.full(len(seq) - 1, -1, np.int32)
    code[at] = _numbered(pair, found)
    again = np.flatnonzero((code[1:] == code[:-1]) & (code[1:] >= 0)) + 1
    if len(again):
        # places one after the other are a run; its first place is one before, so the odd ones of it go
        run = np.flatnonzero(np.diff(again, prepend=-1) > 1)
        second = (np.arange(len(again)) - np.repeat(run, np.diff(run, append=len(again)))) % 2 == 0
        n = n - np.bincount(code[again[second]], minlength=len(found))
        code[again[second]] = -1
        code[(n < least)[code] & (code >= 0)] = -1
    return code, found, n


def _in_rounds(seq: np.ndarray, edges: np.ndarray, made: int, least: int, rules: list) -> tuple[np.ndarray, np.ndarray, int]:
    """All pairs that stand ``least`` times are replaced at once where they are the more frequent of the pairs that overlap,
    until a round hardly shortens the sequence."""
    rare = False
    while len(seq) > 1:
        cut = edges[1:-1]
        code, found, n = _counted(seq, cut[(cut > 0) & (cut < len(seq))] - 1, least, rare)
        rare = 2 * n.sum() < len(seq)
        order = np.zeros(len(found) + 1, np.int32)  # the last one is that of no pair
        order[np.argsort(n, kind="stable")] = np.arange(1, len(found) + 1, dtype=np.int32)
        rank = np.zeros(len(seq) + 1, np.int32)
        rank[1:-1] = order[code]
        at = np.flatnonzero((rank[1:-1] > rank[:-2]) & (rank[1:-1] > rank[2:]))
        codes = code[at]
        good = np.bincount(codes, minlength=len(found)) >= least
        take = good[codes]
        at, codes = at[take], codes[take]
        if not len(at):
            break
        keys = found[good]
        rules.append(np.stack([keys >> 32, keys & 0xFFFFFFFF], 1))
        seq[at] = made + (np.cumsum(good) - 1)[codes]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        edges = edges - np.searchsorted(at + 1, edges)
        made += len(keys)
        few = 25 * len(at) < len(seq)
        seq = seq[keep]
        if few:
            break
    return seq, edges, made


def _one_by_one(seq: np.ndarray, edges: np.ndarray, made: int, least: int, rules: list) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pair is replaced, again and again, until none stands ``least`` times."""
    cut = edges[1:-1]
    cut = cut[(cut > 0) & (cut < len(seq))] - 1
    code, found, _ = _counted(seq, cut, least, rare=True)
    at = np.flatnonzero(code >= 0)
    codes = code[at]
    if not len(at):
        return seq, edges
    last = len(seq)
    order = np.argsort(codes, kind="stable")
    at, codes = at[order].tolist(), codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    places = {key: at[a:b] for key, a, b in zip(found[codes[first]].tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True)}
    heap = [(-len(g), key) for key, g in places.items()]
    heapify(heap)
    symbol = seq.tolist()
    # what follows and what precedes, where it is not the next place; no pair reaches over the end of a document
    ahead, back = dict.fromkeys(cut.tolist(), last), dict.fromkeys((cut + 1).tolist(), -1)
    ahead[last - 1] = last
    new: list[tuple[int, int]] = []
    at_end: dict[int, int] = {}  # places that changed
    gone: list[int] = []
    while heap:
        count, key = heappop(heap)
        a, b = key >> 32, key & 0xFFFFFFFF
        valid, after = [], -1
        for i in places[key]:
            if symbol[i] == a and i >= after:
                j = ahead.get(i, i + 1)
                if j < last and symbol[j] == b:
                    valid.append((i, j))
                    after = j + 1
        if len(valid) < least:
            continue
        if len(valid) < -count:  # fewer than when it was counted
            places[key] = [i for i, _ in valid]
            heappush(heap, (-len(valid), key))
            continue
        new.append((a, b))
        for i, j in valid:
            after = ahead.get(j, j + 1)
            symbol[i], symbol[j], ahead[i] = made, -1, after
            if after < last:
                back[after] = i
            at_end[i] = made
            gone.append(j)
        near: dict[int, list[int]] = {}
        for i, _ in valid:
            before, after = back.get(i, i - 1), ahead[i]
            if before >= 0:
                near.setdefault(symbol[before] << 32 | made, []).append(before)
            if after < last and symbol[after] != made:
                near.setdefault(made << 32 | symbol[after], []).append(i)
        made += 1
        for k, x in near.items():
            if len(x) >= least:
                places[k] = x
                heappush(heap, (-len(x), k))
    rules.append(np.array(new, np.int64).reshape(-1, 2))
    seq[np.fromiter(at_end, np.int64, len(at_end))] = np.fromiter(at_end.values(), np.int64, len(at_end))
    keep = np.ones(last, bool)
    keep[gone] = False
    return seq[keep], edges - np.searchsorted(np.sort(np.array(gone, np.int64)), edges)


def compress(ids: np.ndarray, edges: np.ndarray, terminals: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right) and the replaced sequence with its edges. In the end no pair stands ``least`` times without
    overlaps; most of the way is gone in rounds, the rest pair by pair."""
    rules: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    seq, edges, made = _in_rounds(ids.astype(np.int64), edges, terminals, least, rules)
    if len(seq) > 1:
        seq, edges = _one_by_one(seq, edges, made, least, rules)
    return np.concatenate(rules).astype(np.uint32), seq.astype(np.uint32), edges


def lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for; a rule uses earlier ones only."""
    size = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        size[k] = (size[a - terminals] if a >= terminals else 1) + (size[b - terminals] if b >= terminals else 1)
    return size


def pack(ids: np.ndarray, edges: np.ndarray, terminals: int) -> bytes:
    rules, seq, at = compress(ids, edges, terminals)
    head = np.array([len(rules), len(seq), len(edges) - 1, terminals], "<u4").tobytes()
    return MAGIC + head + rules.astype("<u4").tobytes() + lengths(rules, terminals).astype("<u4").tobytes() + at[:-1].astype("<u4").tobytes() + planes(seq.astype("<u4"))


class Block:
    def __init__(self, body: bytes):
        if body[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        n, symbols, docs, self.terminals = (int(x) for x in np.frombuffer(body, "<u4", 4, 4))
        u4 = lambda count, at: np.frombuffer(body, "<u4", count, at)
        self.rules, self.size = u4(2 * n, 20).reshape(-1, 2), u4(n, 20 + 8 * n).astype(np.int64)
        self.first = np.r_[u4(docs, 20 + 12 * n), symbols].astype(np.int64)
        self.symbols = unplanes(body[20 + 12 * n + 4 * docs :], "<u4").astype(np.int64)
        expanded: list[list[int]] = []  # of rules that stand for few ids; others are taken apart first
        t = self.terminals
        for (a, b), n in zip(self.rules.tolist(), self.size.tolist(), strict=True):
            expanded.append([*(expanded[a - t] if a >= t else (a,)), *(expanded[b - t] if b >= t else (b,))] if n <= _SHORT else [])
        # the ids that each symbol stands for, terminals first, so that one lookup serves both kinds
        ends = t + np.cumsum([len(x) for x in expanded], dtype=np.int64)
        self._from = np.concatenate([np.arange(t + 1), ends])[: t + len(expanded)]
        self._flat = np.concatenate([np.arange(t, dtype=np.uint32), np.fromiter(chain.from_iterable(expanded), np.uint32)])
        self._size = np.concatenate([np.ones(t, np.int64), self.size])

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each of these symbols stands for."""
        return self._size[symbols]

    def _apart(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that stand for few ids each instead of these, and how many for each of these."""
        owner, n = np.arange(len(symbols)), len(symbols)
        while (long := self.sizes(symbols) > _SHORT).any():
            first = (np.arange(len(symbols)) + np.cumsum(long) - long)[long]
            left, right = self.rules[symbols[long] - self.terminals].T
            symbols, owner = np.repeat(symbols, 1 + long), np.repeat(owner, 1 + long)
            symbols[first], symbols[first + 1] = left, right
        return symbols, np.bincount(owner, minlength=n)

    def expand(self, symbols: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
        """The ids that these symbols stand for; size: how many each stands for, if that is known."""
        size = self.sizes(symbols) if size is None else size
        long = size > _SHORT
        if long.any():
            parts, times = self._apart(symbols[long])
            count = np.ones(len(symbols), np.int64)
            count[long] = times
            symbols = np.repeat(symbols, count)
            symbols[np.repeat(long, count)] = parts
            size = self.sizes(symbols)
        begin = np.r_[0, np.cumsum(size)]
        at = np.repeat(self._from[symbols] - begin[:-1], size)
        at += np.arange(begin[-1])
        return self._flat[at]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document begins (and the last ends)."""
        size = self.sizes(self.symbols)
        return self.expand(self.symbols, size), np.r_[0, np.cumsum(size)][self.first]

    def read_slice(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of a document: only the symbols that reach into them are expanded."""
        s = self.symbols[self.first[doc] : self.first[doc + 1]]
        ends = np.cumsum(self.sizes(s))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = ends[a - 1] if a else 0
        return self.expand(s[a:b])[start - before : stop - before]


def write(docs: DataFrame, path: str, end_id: int = 0, out: str | None = None) -> str:
    """Encode all documents with the tokenizer file and write them to ``out`` (a new folder if none). The folder."""
    spark = docs.sparkSession
    bpe.checked(path, "byte")
    out = out or new_path(spark, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = text_encoder(path)
        terminals = e.library.get_vocab_size(with_added_tokens=True)
        held: list[tuple[list[int], np.ndarray, np.ndarray]] = []  # ids of documents, of tokens, and their sizes
        count, block = 0, 0

        def flush() -> pa.RecordBatch:
            names, ids, sizes = sum((x for x, _, _ in held), []), *(np.concatenate([h[k] for h in held]) for k in (1, 2))
            values = [[block], [names[0]], [names], [sizes], [pack(ids, np.r_[0, np.cumsum(sizes)], terminals)]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["block", "first_doc", "doc_ids", "n_ids", "body"])

        for batch in batches:
            for b in stretches(batch, 1, STRETCH):
                names = b.column(0).to_pylist()
                ids, edges = e.texts(b.column(1), end_id)
                k = 0
                while k < len(names):  # as many as the block has room for, one at least
                    z = int(np.searchsorted(edges, edges[k] + BLOCK - count, "right")) - 1
                    if z == k and held:
                        yield flush()
                        held, count, block = [], 0, block + 1
                        continue
                    z = max(z, k + 1)
                    held.append((names[k:z], ids[edges[k] : edges[z]], np.diff(edges[k : z + 1])))
                    count += int(edges[z] - edges[k])
                    k = z
        if held:
            yield flush()

    schema = "block long, first_doc long, doc_ids array<long>, n_ids array<long>, body binary"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    d = d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    texts(d).mapInArrow(run, schema).withColumn("shard", F.spark_partition_id()).write.option("compression", "zstd").parquet(out)
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (unsigned 32 bits, little-endian) of every
    document of a written folder."""
    t = spark.read.parquet(folder)
    # the ids before a document are those of earlier shards, of earlier blocks of its shard and of earlier documents there
    sizes = t.select("shard", "block", F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    past = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", past(Window.orderBy("shard")).alias("all"))  # a row for each file
    blocks = sizes.select("shard", "block", past(Window.partitionBy("shard").orderBy("block")).alias("own"))
    starts = blocks.join(F.broadcast(shards), "shard").select("shard", "block", (F.col("all") + F.col("own")).alias("base"))
    if sizes.count() <= MAX_BROADCAST_BLOCKS:
        starts = F.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, names, body in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                ids, edges = Block(body.as_py()).all()
                raw, at = ids.astype("<u4").tobytes(), (edges * 4).tolist()
                own = pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([names.values, pa.array(base + edges[:-1]), pa.array(np.diff(edges)), own], ["doc_id", "start", "n_tokens", "ids"])

    return t.join(starts, ["shard", "block"]).select("base", "doc_ids", "body").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
