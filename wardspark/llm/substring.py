"""Substring dedup with difference-cover anchors.

A word goes if a window of ``WINDOW`` words covers it whose words also start in a document with a smaller id. The cover
{0, 1, 3} modulo 7 holds two places for every difference, so two equal windows, wherever they start, have both a cover
place at the same offset of at most 6; the ``WINDOW`` - 6 words from there are their anchor. So

1. anchors are hashed at cover places only (3 of 7) and those that stand in two documents are marked,
2. marked anchors are extended: the windows around them are hashed as a whole, in 128 bits, and meet again by hash, where
   those of all but the smallest document are to go,
3. documents that lose words are cut.

Windows are the same if two independent 64-bit hashes of their words are; words themselves are not shipped.

Hashes travel packed: a task sorts them and deals them to buckets, a row of byte planes for each. There are as many
buckets as the bytes of text ask for (``BUCKET_BYTES``), and a task gathers entries in proportion to the buckets before
it sends. What a task knows to be shared already is not sent for comparison: of each hash only the smallest document goes
on, so a hash that fills a third of all rows takes one entry per task. Found places go on packed for shelves of documents.
So a pack holds what a task has for one place, as a shuffle block does; with more text, larger buckets keep packs large.

Defined cases: a null text has no words; texts are taken whole; rows without an id are left out; rows of one id and
different texts are cut each at its own places (told apart by 31 bits of a hash of the text) and never against each
other, equal ones alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.llm.arrays import Words, mixed, planes, stretches, unplanes, windows
from wardspark.llm.stage import done, staged, texts

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Entries that a task gathers before it sends them: so many for each bucket, within these bounds.
PER_BUCKET, FLUSH, MOST = 1 << 10, 1 << 18, 1 << 21
#: Bytes of text that are hashed at once.
STRETCH = 1 << 18
#: A bucket of hashes, and a shelf of documents, for so many bytes of text; a task holds one of them at a time. There is
#: one for each shuffle partition too, down to ``LEAST_BYTES``.
BUCKET_BYTES, SHELF_BYTES, LEAST_BYTES = 16 << 20, 64 << 20, 1 << 20
#: Found places that a task gathers before it sends them to their documents.
PLACES = 1 << 20
#: Document ids are broadcast to tell which documents take part if they take at most so many bytes, at so many an id;
#: beyond, they are joined by a shuffle.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 48
_SENT = "bucket long, h binary, h2 binary, doc binary, pos binary"
_FOUND = "shelf long, doc binary, pos binary"
#: Mark of an entry whose hash its task knows to be shared; places lie below, the tag of the text above bit 32.
_KNOWN = np.int64(-1 << 63)


def _groups(h: np.ndarray, h2: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and where each hash begins in that order."""
    order = np.argsort(h, kind="stable") if h2 is None else np.lexsort((h2, h))
    s = h[order]
    new = s[1:] != s[:-1]
    if h2 is not None:
        new |= h2[order][1:] != h2[order][:-1]
    return order, np.flatnonzero(np.r_[True, new]) if len(s) else np.zeros(0, np.int64)


def _told(doc: np.ndarray, first: np.ndarray, n: int, any_shared: bool, multi: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For entries in hash order: found (shared by two documents, or not of the smallest one), of the smallest, shared."""
    size = np.diff(np.r_[first, n])
    low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
    shared = low != high
    if multi is not None:
        shared |= np.logical_or.reduceat(multi, first)
    least, shared = np.repeat(low, size), np.repeat(shared, size)
    return (shared if any_shared else doc != least), doc == least, shared


def _packs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "h", "h2", "doc", "pos"])


def _send(parts: list, buckets: int, any_shared: bool) -> Iterator[pa.RecordBatch]:
    h, h2, doc, pos = (None if x[0] is None else np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(h):
        return
    order, first = _groups(h, h2)
    h, doc, pos = h[order], doc[order], pos[order]
    h2 = None if h2 is None else h2[order]
    found, least, shared = _told(doc, first, len(h), any_shared, None)
    go = least
    if any_shared:  # of a hash that is shared here one entry of the smallest document will do: all are found already
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))
        head = np.flatnonzero(shared & least)
        go = least & ~shared
        go[head[np.r_[True, group[head][1:] != group[head][:-1]]] if len(head) else head] = True
    at = np.flatnonzero(go)
    if len(at):
        mark = np.where(shared[at], _KNOWN, np.int64(0)) if any_shared else np.int64(0)
        x, bucket = h[at], ((h[at] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(at)].tolist()
        y, d, p = None if h2 is None else h2[at], doc[at], pos[at] | mark
        pack = lambda a, b: (int(bucket[a]), planes(np.diff(x[a:b], prepend=np.uint64(0))), None if y is None else planes(y[a:b]), planes(d[a:b]), planes(p[a:b]))
        yield _packs([pack(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    here = np.flatnonzero(found)
    here = here[np.argsort(doc[here], kind="stable")]
    for k in range(0, len(here), FLUSH // 8):  # found already: on their way to the documents, through any bucket
        part = here[k : k + FLUSH // 8]
        yield _packs([(int(h[part[0]] % np.uint64(buckets)), None, None, planes(doc[part]), planes(pos[part]))])


def _dealt(doc: np.ndarray, pos: np.ndarray, shelves: int) -> pa.RecordBatch:
    """Places packed for the shelves of their documents, a row for each shelf that gets any."""
    shelf = ((mixed(doc.view(np.uint64)) >> np.uint64(32)) * np.uint64(shelves)) >> np.uint64(32)
    order = np.lexsort((doc, shelf))
    doc, pos, shelf = doc[order], pos[order], shelf[order]
    first = np.flatnonzero(np.r_[True, shelf[1:] != shelf[:-1]])
    edges = list(zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True))
    columns = [pa.array(shelf[first].astype(np.int64)), pa.array([planes(doc[x:y]) for x, y in edges], pa.binary()), pa.array([planes(pos[x:y]) for x, y in edges], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["shelf", "doc", "pos"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs sorted by shelf; doc_id, tag and the places of each, sorted, once each."""
    now, packs = None, []

    def listed() -> Iterator[pa.RecordBatch]:
        if not packs:
            return
        doc, pos = np.concatenate([unplanes(r[0], np.int64) for r in packs]), np.concatenate([unplanes(r[1], np.int64) for r in packs])
        packs.clear()
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]
        doc, pos = doc[new], pos[new]
        tag, pos = (pos >> 32).astype(np.int32), (pos & 0xFFFFFFFF).astype(np.int32)
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(doc)].astype(np.int32)), pa.array(pos))
        whole = pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(tag[first]), lists], ["doc_id", "tag", "pos"])
        for k in range(0, whole.num_rows, 1 << 12):
            yield whole.slice(k, 1 << 12)

    for b in batches:
        for shelf, *r in _rows(b):
            if shelf != now:
                yield from listed()
                now = shelf
            packs.append(r)
    yield from listed()


def _rows(batch: pa.RecordBatch) -> Iterator[list]:
    """One row after the other, so that a batch of large rows is not copied as a whole."""
    for k in range(batch.num_rows):
        yield [c[k].as_py() for c in batch.columns]


def _meet(any_shared: bool, shelves: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs sorted by bucket; the places that are found, packed for the shelves of their documents."""
        now, packs, docs, places, held = None, [], [], [], 0

        def judged() -> None:
            nonlocal held
            if not packs:
                return
            h = np.concatenate([np.cumsum(unplanes(r[0], np.uint64), dtype=np.uint64) for r in packs])
            h2 = np.concatenate([unplanes(r[1], np.uint64) for r in packs]) if packs[0][1] else None
            doc = np.concatenate([unplanes(r[2], np.int64) for r in packs])
            pos = np.concatenate([unplanes(r[3], np.int64) for r in packs])
            packs.clear()
            order, first = _groups(h, h2)
            found, _, _ = _told(doc[order], first, len(h), any_shared, (pos < 0)[order])
            at = order[found]
            docs.append(doc[at])
            places.append(pos[at] & ~_KNOWN)
            held += len(at)

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held:
                yield _dealt(np.concatenate(docs), np.concatenate(places), shelves)
            docs.clear()
            places.clear()
            held = 0

        for b in batches:
            for bucket, h, *r in _rows(b):
                if bucket != now:
                    judged()
                    now = bucket
                if h is None:
                    docs.append(unplanes(r[1], np.int64))
                    places.append(unplanes(r[2], np.int64))
                    held += len(docs[-1])
                else:
                    packs.append((h, *r))
                if held >= PLACES:
                    yield from flushed()
        judged()
        yield from flushed()

    return run


def _exchange(sent: DataFrame, any_shared: bool, buckets: int, shelves: int) -> DataFrame:
    """doc_id, tag and the found places of each."""
    met = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(any_shared, shelves), _FOUND)
    return met.repartition(shelves, "shelf").sortWithinPartitions("shelf").mapInArrow(_gather, "doc_id long, tag int, pos array<int>")


def _sending(entries, buckets: int, any_shared: bool):
    """entries: a batch to hashes, second hashes, documents and places."""
    flush = min(max(FLUSH, PER_BUCKET * buckets), MOST) if FLUSH >= 1 << 16 else FLUSH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for b in stretches(batch, 1, STRETCH):
                parts.append(entries(b))
                held += len(parts[-1][0])
                if held >= flush:
                    yield from _send(parts, buckets, any_shared)
                    parts, held = [], 0
        if parts:
            yield from _send(parts, buckets, any_shared)

    return run


def _located(b: pa.RecordBatch, w: Words, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = w.owner()[at]
    return b.column(0).to_numpy()[owner], b.column(2).to_numpy()[owner].astype(np.int64) << 32 | place[at]


def _anchors(b: pa.RecordBatch) -> tuple:
    w = Words(b.column(1))
    place = w.places()
    at = np.flatnonzero((w.left() >= ANCHOR) & np.isin(place % PERIOD, COVER))
    return windows(w.hashes(), at, ANCHOR) >> np.uint64(16) << np.uint64(16), None, *_located(b, w, at, place)


def _windows(b: pa.RecordBatch) -> tuple:
    """Of the windows around marked anchors."""
    w, marked = Words(b.column(1)), b.column(3)
    at = np.repeat(w.bounds[:-1], pc.list_value_length(marked).to_numpy()) + marked.flatten().to_numpy()
    around = np.zeros(len(w.start) + 1, bool)
    place, left = w.places(), w.left()
    at = at[at < len(w.start)]
    for k in range(PERIOD):  # windows that start up to PERIOD - 1 words before the anchor
        around[at[place[at] >= k] - k] = True
    at = np.flatnonzero(around[:-1] & (left >= WINDOW))
    return windows(w.hashes(0), at, WINDOW, 0), windows(w.hashes(1), at, WINDOW, 1), *_located(b, w, at, place)


def _cut(joined: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text, pos (null: nothing goes), rest to doc_id, n_words, n_removed, text, rest."""
        for batch in batches:
            for b in stretches(batch, 1, STRETCH):
                ids, n, gone, cut = b.column(0), [], [], []
                for text, pos in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2), strict=True):
                    words = (text or b"").split()
                    n.append(len(words))
                    starts = np.asarray(pos.values, np.int64) if pos.is_valid else np.zeros(0, np.int64)
                    if not len(starts):
                        gone.append(0)
                        cut.append(b" ".join(words) if joined else text)
                        continue
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + WINDOW, -1)
                    out = np.cumsum(step[:-1]) > 0
                    gone.append(int(out.sum()))
                    if joined:
                        cut.append(b" ".join([x for x, o in zip(words, out.tolist(), strict=True) if not o]))
                    else:  # each kept word with the white space after it, and what stands before the first word
                        w = Words(pa.array([text], pa.binary()))
                        edges = np.r_[w.start, len(text)]
                        keep = np.flatnonzero(~out)
                        cut.append(text[: w.start[0]] + b"".join([text[edges[i] : edges[i + 1]] for i in keep.tolist()]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(cut, pa.binary()).cast(pa.string()), b.column(3)], ["doc_id", "n_words", "n_removed", "text", "rest"])

    return run


def _few(ids: DataFrame) -> bool:
    most = BROADCAST_BYTES // ID_BYTES
    return ids.limit(most + 1).count() <= most


def _tagged(d: DataFrame) -> DataFrame:
    """Adds tag: 0, or for an id that is given more than once a positive hash of the row's text."""
    repeated = staged(d.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return d.withColumn("tag", F.lit(0))
    own = F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    ids = repeated.withColumn("again", F.lit(True))
    return d.join(F.broadcast(ids) if _few(ids) else ids, "doc_id", "left").withColumn("tag", F.when(F.col("again"), own).otherwise(0)).drop("again")


def substring_dedup(docs: DataFrame, joined: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, text: the kept words with one space between them (joined) or their own white space;
    and rest, a struct of the columns in keep (true if there are none)."""
    rest = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(True)
    d = texts(docs).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text"), rest.alias("rest"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    spread = min(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // LEAST_BYTES + 1)
    buckets, shelves = max(spread, -(-size // BUCKET_BYTES)), max(spread, -(-size // SHELF_BYTES))
    d = _tagged(d)

    def among(marks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The documents with their marks, and the others where these can be told apart without a shuffle."""
        if _few(marks):
            ids = F.broadcast(marks.select("doc_id").distinct())
            mine = d.join(ids, "doc_id", "left_semi").join(marks, ["doc_id", "tag"], "left")
            return mine, d.join(ids, "doc_id", "left_anti")
        return d.join(marks, ["doc_id", "tag"], "left"), None

    anchors = d.select("doc_id", "text", "tag").mapInArrow(_sending(_anchors, buckets, True), _SENT)
    marked = staged(_exchange(anchors, True, buckets, shelves), "anchors")
    near = among(marked)[0].where("pos IS NOT NULL").select("doc_id", "text", "tag", "pos")
    starts = staged(_exchange(near.mapInArrow(_sending(_windows, buckets, False), _SENT), False, buckets, shelves), "windows")
    done(marked)
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, text string").add("rest", d.schema["rest"].dataType)
    cut, others = among(starts)
    out = cut.select("doc_id", "text", "pos", "rest").mapInArrow(_cut(joined), schema)
    if others is not None:
        out = out.unionByName(others.select("doc_id", "text", F.lit(None).cast("array<int>").alias("pos"), "rest").mapInArrow(_cut(joined), schema))
    return out
