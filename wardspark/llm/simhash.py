"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made in Python over Arrow batches, equal ones form a class, and classes meet in buckets: 64 bits are
cut into radius + 2 blocks, and two fingerprints within the radius agree in two blocks at least, so one bucket for each
pair of blocks finds every link (with more classes: more blocks, of which all but ``radius`` agree). A bucket is compared
bit-sliced: bit b of all its fingerprints is one plane of machine words, differences are added into vertical counters
with carry-save steps, and a block of 64 lanes is given up as soon as all its counters are over the radius. A bucket beyond ``BLOCK`` rows is dealt into blocks which meet in pairs, so no
task gets more than two blocks at once; each meeting returns a spanning set of links, not all pairs.

Defined cases: null and empty texts have fingerprint 0; a text of fewer words than a shingle is one shingle; texts are
taken whole; equal texts and repeated rows share a class; rows with a null id take part, without giving their component
a name (null where a component has no id at all); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm.components import components
from wardspark.llm.stage import staged, texts

BITS = 64
BLOCK = 2048
#: Rows of unrelated fingerprints that a bucket may have before more bits have to agree.
BUCKET = 64
#: Planes that are read before blocks are given up.
STEP = 8
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> bytes:
    """8 bytes, the most significant first."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    shingles = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
    raw = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(raw), _CHUNK):
        ones += np.unpackbits(raw[k : k + _CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(raw)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp, the 64 bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.frombuffer(b"".join([fingerprint(x.as_py(), shingle, seed) for x in b.column(1)]), ">i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.astype(np.int64))], ["doc_id", "fp"])

    return texts(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, fp long")


def planes_of(*fp: np.ndarray) -> np.ndarray:
    """(64 for each array, words) machine words: lane j of plane b is bit b of fp[j]; the lanes are filled up with zeros."""
    planes = []
    for part in fp:
        bits = np.unpackbits(np.ascontiguousarray(part.astype(">u8")).view(np.uint8).reshape(-1, 8), axis=1)
        lanes = np.zeros((BITS, -(-len(part) // 64) * 64), np.uint8)
        lanes[:, : len(part)] = bits.T
        planes.append(np.packbits(lanes, axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(planes)


def filling(n: int) -> np.ndarray:
    """Machine words with the lanes beyond the first n set."""
    words = np.zeros(-(-n // 64), np.uint64)
    if n % 64:
        words[-1] = ~np.uint64((1 << n % 64) - 1)
    return words


def within(left: np.ndarray, right: np.ndarray, radius: int, spare: np.ndarray | None = None, read: list[int] | None = None) -> np.ndarray:
    """Lanes whose distance is at most the radius, as machine words. left and right: a plane along the first axis; spare:
    lanes that hold nothing. A machine word is a block of 64 lanes: after every ``STEP`` planes those go of which all
    lanes are beyond the radius. read gets the number of blocks for each plane that was read."""
    shape = np.broadcast_shapes(left.shape[1:], right.shape[1:])
    out = np.zeros(shape, np.uint64)
    live = [x.ravel() for x in np.indices(shape, sparse=False)] if len(shape) > 1 else [np.arange(shape[0])]
    pick = lambda p, axes: p[tuple(a if n > 1 else 0 for a, n in zip(axes, p.shape, strict=True))] if p.shape != shape else p[tuple(axes)]
    size = len(live[0])
    count = [np.zeros(size, np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(size, np.uint64) if spare is None else np.broadcast_to(spare, shape)[tuple(live)].copy()
    whole = True
    for b in range(len(left)):
        if read is not None:
            read.append(len(over))
        carry = np.broadcast_to(left[b] ^ right[b], shape).ravel() if whole else pick(left[b], live) ^ pick(right[b], live)
        for k, c in enumerate(count):
            count[k], carry = c ^ carry, c & carry
        over |= carry
        if (b + 1) % STEP == 0 or b + 1 == len(left):  # a counter beyond the radius, by comparing its bits with the radius from the highest on
            more, equal = over.copy(), np.full(len(over), ~np.uint64(0))
            for k in range(len(count) - 1, -1, -1):
                if radius >> k & 1:
                    equal &= count[k]
                else:
                    more |= equal & count[k]
                    equal &= ~count[k]
            stay = ~more != 0
            if b + 1 == len(left):
                out[tuple(live)] = ~more
            elif not stay.any():
                break
            elif stay.mean() < 0.7:
                live, over, whole = [a[stay] for a in live], more[stay], False
                count = [c[stay] for c in count]
    return out


def _spanning(match: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix the smallest index that each row reaches."""
    label = np.arange(len(match))
    while True:
        near = np.where(match, label[None, :], len(match)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def block_links(fp: np.ndarray, rep: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one meeting: of rows of side 0 with those of side 1, or among all where there is one side."""
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.min() != side.max() else (np.arange(len(fp)),) * 2
    planes = planes_of(fp[b])
    bits = planes_of(fp[a])
    rows = _lanes(bits, len(a))  # (64, a)
    match = np.zeros((len(fp), len(fp)), bool)
    for k in range(0, len(a), 256):
        left = np.where(rows[:, k : k + 256, None], ~np.uint64(0), np.uint64(0))
        near = _lanes(within(left, planes[:, None, :], radius, filling(len(b))), len(b))
        match[np.ix_(a[k : k + 256], b)] = near
    match |= match.T
    label = _spanning(match)
    at = np.flatnonzero(label != np.arange(len(fp)))
    return rep[at], rep[label[at]]


def _meet(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by meeting; a meeting may go on in the next batch."""
        rest: pa.Table | None = None

        def links(t: pa.Table) -> pa.RecordBatch:
            key, fp, rep, side = (t.column(k).to_numpy() for k in ("meeting", "fp", "rep", "side"))
            fp = fp.view(np.uint64)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            u, v = [], []
            # small meetings: all their pairs side by side in the lanes
            small = (size > 1) & (size <= 48)
            i, j = [], []
            for n in np.unique(size[small]):
                at = first[small & (size == n)]
                x, y = np.triu_indices(n, 1)
                i.append((at[:, None] + x).ravel())
                j.append((at[:, None] + y).ravel())
            if i:
                i, j = np.concatenate(i), np.concatenate(j)
                for k in range(0, len(i), _CHUNK):
                    p, q = i[k : k + _CHUNK], j[k : k + _CHUNK]
                    near = _lanes(within(planes_of(fp[p]), planes_of(fp[q]), radius, filling(len(p))), len(p))
                    u.append(rep[p[near]])
                    v.append(rep[q[near]])
            for at, n in zip(first[size > 48], size[size > 48], strict=True):
                x, y = block_links(fp[at : at + n], rep[at : at + n], side[at : at + n], radius)
                u.append(x)
                v.append(y)
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            return pa.RecordBatch.from_arrays([cat(u), cat(v)], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column("meeting").to_numpy()
            cut = int(np.searchsorted(key == key[-1], True))  # the rows before the last meeting
            if cut:
                yield links(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield links(rest)

    return run


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """rows: bucket and the columns, the first of them a fingerprint. Buckets of one row go, the others are dealt as
    ``blocks_of`` says."""
    sizes = staged(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    return blocks_of(rows.join(sizes, "bucket"), *columns)  # rows that meet no other go


def blocks_of(rows: DataFrame, *columns: str) -> DataFrame:
    """rows: bucket, size (rows of the bucket) and the columns, the first of them a fingerprint. meeting, the columns and
    side: buckets beyond ``BLOCK`` rows are dealt into blocks that meet in pairs (side 0 with side 1)."""
    rows = rows.withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    part = F.pmod(F.xxhash64(F.col(columns[0]), F.lit(1)), F.col("parts")).cast("int")
    rows = rows.select("bucket", *columns, part.alias("part"), "parts")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    meeting = F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", lo, hi))
    return rows.select(meeting.alias("meeting"), *columns, F.when(F.col("part") == hi, (lo != hi).cast("int")).otherwise(0).alias("side"))


def blocks_for(radius: int, classes: int) -> int:
    """Into how many blocks fingerprints are cut: two within the radius agree in all but ``radius`` of them, and the more
    blocks, the more bits agree. The fewest for which a bucket of unrelated ones has ``BUCKET`` rows at most."""
    blocks = radius + 2
    while blocks < 2 * radius and classes > BUCKET << BITS * (blocks - radius) // blocks:
        blocks += 1
    return blocks


def links(classes: DataFrame, radius: int = 4) -> DataFrame:
    """classes: fp, rep (one row per fingerprint). u, v: links of representatives that join all classes within the
    radius, maybe through others; repeated links may occur."""
    if not 0 <= radius <= 14:
        raise ValueError("the radius must be from 0 to 14")
    blocks = blocks_for(radius, classes.count())
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in some) for some in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)]))
    rows = dealt(classes.where("rep IS NOT NULL").select("fp", "rep", keys.alias("bucket")), "fp", "rep")
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return rows.repartition(int(n), "meeting").sortWithinPartitions("meeting").mapInArrow(_meet(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that is reached over links, the own one included."""
    f = staged(fingerprints(docs, shingle, seed), "fingerprints")
    classes = staged(f.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    # a class is named by its fingerprint, as its documents may have no id
    found = components(links(classes.select("fp", F.col("fp").alias("rep")), radius))
    named = staged(classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return f.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
