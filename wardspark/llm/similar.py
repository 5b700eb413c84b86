"""Near-duplicates by SimHash, confirmed by the exact Jaccard similarity of word shingles.

Sets of shingles that are equal form a class. A class gets a fingerprint of ``BITS`` bits by majority vote, of whose
first half ``BANDS`` bands of ``BAND`` bits are keys of buckets. Votes are close where similar sets differ, so a class goes to the
buckets of its bands with the ``FLIPS`` closest votes turned either way too, and two classes meet if they differ only
in bits that are close on one side; of the buckets of a band where they meet as both turned the same bit, only that one
counts where neither did. Classes of a bucket are compared bit-sliced over all bits (``simhash.within``), and
pairs within ``RADIUS`` are confirmed on the sets themselves, so no link is false. Of pairs of similarity 0.8 about 95 in
100 are found, of 0.83 and more 99 (as simulated, see README). A bucket's key has 24 bits of which two may be turned, so
unrelated classes meet about once for each 2 ** 20 of them and band.

Of its matches in a meeting a class first takes the ``FIRST`` smallest, which joins a group of copies without emitting
all its pairs. Only meetings that have more matches, and components that are not joined yet, come again, for the next
ones, ``MORE`` times as many each time, until none are left; pairs that are joined already are not emitted. Of the pairs
of a round each class first confirms the one that most meetings have found; of the others only those are confirmed that
components do not join by then (where pairs are few, all at once).

Defined cases: null and empty texts are equal; a text of fewer words than a shingle is one shingle; texts are taken
whole; rows with a null id take no part; rows that share an id are judged each; A-Z are lower-cased; shingles are
compared by 64-bit hashes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.arrays import SPACE, Words, mixed, stretches, windows
from wardspark.llm.components import components
from wardspark.llm.simhash import _CHUNK, _lanes, blocks_of, filling, planes_of, within
from wardspark.llm.stage import done, staged, texts

SHINGLE = 5
BITS, BAND, FLIPS = 1024, 24, 2
BANDS = BITS // 2 // BAND
#: Bits of BITS in which two classes may differ to be confirmed: at similarity 0.8 they differ in 155, give or take 11, at
#: 0.7 in 197.
RADIUS = 190
#: Matches of a class in a meeting that are taken at first, and how many times as many in each next round.
FIRST, MORE = 1, 16
#: Document ids are broadcast if they take at most so many bytes, at so many an id.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 48
_SEEDS = mixed(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted, and where those of each text begin (and the last end)."""
    w = Words(column, SPACE, True)
    h, n = w.hashes(), np.diff(w.bounds)
    at = np.flatnonzero(w.left() >= SHINGLE)
    value, owner = [windows(h, at, SHINGLE)], [w.owner()[at]]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n == k)
        value.append(mixed(windows(h, w.bounds[short], k) + np.uint64(k)))
        owner.append(short)
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
        value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(column) + 1))


def classes_of(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[np.uint64(0), np.cumsum(mixed(value ^ _SEEDS[0]), dtype=np.uint64)]
    return mixed(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def votes(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, BITS): shingles whose bit is set less those whose isn't."""
    out = np.zeros((len(bounds) - 1, BITS), np.int32)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for x in range(a, b, 8192):
            part = value[x : min(b, x + 8192)]
            raw = mixed(part[:, None] + _SEEDS[None, :]).view(np.uint8).reshape(len(part), -1)
            out[k] += 2 * np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int32) - len(part)
    return out


def keys_of(v: np.ndarray) -> np.ndarray:
    """(texts, BANDS * 2 ** FLIPS): band and its bits, as they are and with close ones turned."""
    v = v[:, : BANDS * BAND].reshape(len(v), BANDS, BAND)
    bit = np.int64(1) << np.arange(BAND, dtype=np.int64)
    base = ((v > 0) * bit).sum(axis=2) + (np.arange(BANDS, dtype=np.int64) << BAND)
    close = bit[np.argsort(np.abs(v), axis=2, kind="stable")[:, :, :FLIPS]]
    keys = base[:, :, None]
    for k in range(FLIPS):
        keys = np.concatenate([keys, keys ^ close[:, :, k : k + 1]], axis=2)
    return keys.reshape(len(v), -1).astype(np.int32)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in stretches(batch, 1):
            value, bounds = shingle_sets(b.column(1))
            v = votes(value, bounds)
            bits = pa.array([x.tobytes() for x in np.packbits(v > 0, axis=1)], pa.binary())
            keys = keys_of(v)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classes_of(value, bounds)), bits, lists], ["doc_id", "cls", "bits", "keys"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in stretches(batch, 1):
            value, bounds = shingle_sets(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(classes_of(value, bounds)), lists], ["cls", "items"])


def _pairs_of(cls: np.ndarray, bits: np.ndarray, side: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows i and j of one meeting each that are within the radius, i of the smaller class. bits: (rows, BITS / 64)."""
    left, right = [], []
    of = lambda at: planes_of(*bits[at].T)

    def near(p: np.ndarray, q: np.ndarray) -> None:
        for k in range(0, len(p), _CHUNK):
            x, y = p[k : k + _CHUNK], q[k : k + _CHUNK]
            ok = _lanes(within(of(x), of(y), RADIUS, filling(len(x))), len(x))
            left.append(x[ok])
            right.append(y[ok])

    small = (size > 1) & (size <= 48)
    for n in np.unique(size[small]):  # all their pairs side by side in the lanes
        at = first[small & (size == n)]
        x, y = np.triu_indices(n, 1)
        p, q = (at[:, None] + x).ravel(), (at[:, None] + y).ravel()
        apart = (side[p] != side[q]) | (np.repeat(np.maximum.reduceat(side, first)[small & (size == n)], len(x)) == 0)
        near(p[apart], q[apart])
    for at, n in zip(first[size > 48].tolist(), size[size > 48].tolist(), strict=True):
        two = side[at : at + n].max() > 0
        a, b = (at + np.flatnonzero(side[at : at + n] == 0), at + np.flatnonzero(side[at : at + n] == 1)) if two else (np.arange(at, at + n),) * 2
        planes = of(b)
        lanes = _lanes(of(a), len(a))
        for k in range(0, len(a), 64):
            own = np.where(lanes[:, k : k + 64, None], ~np.uint64(0), np.uint64(0))
            x, y = np.nonzero(_lanes(within(own, planes[:, None, :], RADIUS, filling(len(b))), len(b)))
            x, y = a[k + x], b[y]
            keep = cls[x] < cls[y] if not two else np.ones(len(x), bool)
            left.append(x[keep])
            right.append(y[keep])
    p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    swap = cls[p] > cls[q]
    return np.where(swap, q, p), np.where(swap, p, q)


def _meet(low: int, high: int):
    """Of the smaller matches of each class in a meeting those from low to high; and the meetings that have more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            meeting, cls, mask, side, component = (t.column(k).to_numpy() for k in ("meeting", "cls", "mask", "side", "component"))
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), ">u8").reshape(-1, BITS // 64).astype(np.uint64)
            first = np.flatnonzero(np.r_[True, meeting[1:] != meeting[:-1]])
            i, j = _pairs_of(cls, bits, side, first, np.diff(np.r_[first, len(meeting)]))
            alone = mask[i] & mask[j] == 0  # if both turned a bit, they meet without turning it as well
            i, j = i[alone], j[alone]
            order = np.lexsort((cls[i], j))
            i, j = i[order], j[order]
            head = np.flatnonzero(np.r_[True, j[1:] != j[:-1]]) if len(j) else np.zeros(0, np.int64)
            rank = np.arange(len(j)) - np.repeat(head, np.diff(np.r_[head, len(j)]))
            more = np.unique(meeting[j[(rank >= high) & (component[i] != component[j])]])
            take = (rank >= low) & (rank < high) & (component[i] != component[j])
            u, v = np.r_[cls[i[take]], np.zeros(len(more), np.int64)], np.r_[cls[j[take]], np.zeros(len(more), np.int64)]
            m = pa.array(np.r_[np.zeros(take.sum(), np.int64), more], mask=np.arange(len(u)) < take.sum())
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), m], ["u", "v", "meeting"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column("meeting").to_numpy()
            cut = int(np.searchsorted(key == key[-1], True))  # the rows before the last meeting
            if cut:
                yield pairs(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield pairs(rest)

    return run


def _confirmed(docs: DataFrame, first: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs u, v whose sets have this similarity."""
    cls = pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct()
    ids = staged(first.select("cls", "doc_id").join(cls, "cls").select("doc_id").distinct(), "asked")
    few = BROADCAST_BYTES // ID_BYTES
    near = docs.join(F.broadcast(ids) if ids.count() <= few else ids, "doc_id", "left_semi")
    sets = staged(near.mapInArrow(_whole, "cls long, items array<long>").dropDuplicates(["cls"]), "sets")
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("items").alias(f"items_{c}"))
    d = pairs.join(side("u"), "u").join(side("v"), "v")
    same = F.size(F.array_intersect("items_u", "items_v"))
    out = staged(d.where(same >= similarity * (F.size("items_u") + F.size("items_v") - same) - 1e-9).select("u", "v"), "links")
    done(ids, sets)
    return out


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs u, v whose ends no component joins."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    named = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return named.where(F.coalesce("u_component", "u") != F.coalesce("v_component", "v")).select("u", "v")


def _merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """node, component after more links u, v: these link components that are known already, so only what changes is
    gone through again."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    named = more.join(of("u"), "u", "left").join(of("v"), "v", "left")
    named = staged(named.select("u", "v", F.coalesce("u_component", "u").alias("p"), F.coalesce("v_component", "v").alias("q")), "named")
    moved = components(named.select(F.col("p").alias("u"), F.col("q").alias("v"))).select(F.col("node").alias("component"), F.col("component").alias("to"))
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("p").alias("component")), F.struct(F.col("v").alias("node"), F.col("q").alias("component"))))
    known = found.unionByName(named.select(ends.alias("e")).select("e.*")).distinct()
    out = staged(known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "found")
    done(named, found)
    return out


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component with these links too."""
    if found is None:
        found = staged(components(links), "found")
    elif not links.isEmpty():
        found = _merged(found, links)
    done(links)
    return found


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that is reached over links, the own one included."""
    docs = texts(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text"))
    marks = staged(docs.mapInArrow(_marks, "doc_id long, cls long, bits binary, keys array<int>"), "marks")
    named = marks.select("doc_id", "cls")
    one = F.min_by(F.struct("bits", "keys"), "doc_id").alias("one")
    first = staged(marks.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), one).select("cls", "doc_id", "one.*"), "first")
    # mask: the close bits that were turned for a key; the first of a band's keys has none
    rows = first.select("cls", "keys", F.posexplode("keys").alias("at", "key"))
    rows = rows.select(F.col("key").cast("long").alias("bucket"), "cls", F.col("key").bitwiseXOR(F.get("keys", F.col("at") - F.col("at") % 2**FLIPS)).alias("mask"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # only classes that meet others go on with their bits; counted in the shuffle that brings a bucket together
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy("bucket"))).where("size > 1")
    rows, found = staged(blocks_of(rows, "cls", "mask").join(first.select("cls", "bits"), "cls").withColumn("component", F.col("cls")), "meetings"), None
    judged: DataFrame | None = None
    low, high = 0, FIRST
    while True:
        met = staged(rows.repartition(n, "meeting").sortWithinPartitions("meeting").mapInArrow(_meet(low, high), "u long, v long, meeting long"), "met")
        pairs = met.where("meeting IS NULL").groupBy("u", "v").count()
        pairs = staged(pairs if judged is None else pairs.join(judged, ["u", "v"], "left_anti"), "pairs")
        judged = pairs.select("u", "v") if judged is None else judged.unionByName(pairs.select("u", "v"))  # no pair is confirmed twice
        best = staged(pairs.groupBy("v").agg(F.max(F.struct("count", "u")).alias("m")).select("m.u", "v"), "best")
        if pairs.count() <= 2 * best.count():  # a second pass over the texts would cost more than the others do
            found = _joined(found, _confirmed(docs, first, pairs.select("u", "v"), similarity))
        else:
            found = _joined(found, _confirmed(docs, first, best, similarity))
            others = staged(_apart(pairs.join(best, ["u", "v"], "left_anti"), found), "others")
            if not others.isEmpty():
                found = _joined(found, _confirmed(docs, first, others, similarity))
            done(others)
        done(best)
        open_ = met.where("meeting IS NOT NULL").select("meeting").distinct()
        now = rows.drop("component").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        apart = now.groupBy("meeting").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("meeting").join(open_, "meeting")
        left = staged(now.join(apart, "meeting", "left_semi").select("meeting", "bits", "cls", "mask", "side", "component"), "meetings")
        done(met, rows)
        rows = left
        if rows.isEmpty():
            break
        low, high = high, high * MORE
    d = staged(named.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", F.coalesce("component", "cls").alias("component")), "members")
    return d.join(d.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "component_id")
