"""Exact top-k by inner product, over vectors sorted by length.

Vectors of whole numbers are written once, in ranges of descending length. A rotation to their right singular vectors
puts what they have in common into the first coordinates. A query's score with a vector is summed coordinate block by
coordinate block; what is still to come is at most the product of the two residual lengths (Cauchy-Schwarz), so a pair is
given up as soon as its sum and that product stay below the query's k-th best score so far. Before any coordinate is
touched the same holds for the whole lengths: the shorter vectors of a batch are cut off. Pairs that remain are scored
anew in whole numbers, so the rotation's rounding never decides.

Every query starts from its k-th best score among the ``SEEDS`` longest vectors, a lower bound of the true one; those
vectors take part in the scan like all others. Queries go over all vectors in blocks of bounded bytes, each broadcast to
one scan, in which a task hands on at most k rows for a query and, with the bound, mostly none. Memory of a task: a
block of queries and one batch. What passes the driver: one block of queries at a time, the seeds and the rotation, whose
sizes are bounded by BLOCK_BYTES and by the square of the dimension.

Defined cases: null vectors, vectors that hold null or non-finite numbers, and rows without an id take no part; vectors
are as if padded with zeros to one length, an empty one scores 0; an id names a vector: a query's candidates are all rows
of other ids, repeated rows of an id count each, and of query rows that share an id the least vector (by array order) is
asked for; ties go to the smaller id; with fewer than k candidates all are returned; scores beyond a long are cut to its
ends before they are ranked; an empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.stage import done, new_path, staged, texts

#: Bytes of queries (whole and rotated) in a block, rows that give the first bounds, and rows and queries of a tile.
BLOCK_BYTES, SEEDS, TILE, QUERIES = 32 << 20, 4096, 1024, 1024
#: A tile whose open pairs are fewer than one in so many is scored pair by pair.
SPARSE = 50
#: Coordinate blocks: residual bounds are looked at after each.
STEPS = 8
#: What rounding may change of a score, as a share of the product of two lengths.
ROUNDING = 1e-9
LONG = (1 << 63) - 1
HIT = "query_id long, vec_id long, score long"


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every number, in double precision; null if a number is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of one length, filled up with zeros."""
    size, flat = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def exact(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of whole numbers; ``most`` bounds them."""
    if most < 2**62:
        return np.einsum("ij,ij->i", a, b)
    found = (a.astype(object) * b.astype(object)).sum(1)
    return np.array([min(max(int(x), -LONG - 1), LONG) for x in found], np.int64)


def residuals(rotated: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Length of what lies beyond each cut."""
    square = np.cumsum((rotated**2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.c_[square, np.zeros(len(rotated))][:, cuts])


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, those of the largest singular values first: sums of products leave the tasks,
    and are added up in a tree of 16 to a group."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            v = matrix(b.column(0), dim).astype(float)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["k", "g"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(dim * dim)
        for x in t.column("g"):
            total += np.frombuffer(x.as_buffer())
        return pa.table({"k": t.column("k").slice(0, 1), "g": pa.array([total.tobytes()], pa.binary())})

    sums = staged(rows.select("v").mapInArrow(partial, "k long, g binary"), "products")
    while (n := sums.count()) > 16:
        fewer = staged(sums.select((F.col("k") % -(-n // 16)).alias("k"), "g").groupBy("k").applyInArrow(add, "k long, g binary"), "products")
        done(sums)
        sums = fewer
    total = np.zeros((dim, dim))
    for r in sums.select("g").toLocalIterator():
        total += np.frombuffer(r.g).reshape(dim, dim)
    done(sums)
    peak = np.abs(total).max(initial=0)
    return np.linalg.eigh(total / peak)[1][:, ::-1] if peak > 0 else np.eye(dim)


class Block:
    """Queries, and what was found for each so far."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, least: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.v, self.turn, self.k = ids, v, turn, k
        dim = v.shape[1]
        self.cuts = sorted({round(dim * s / STEPS) for s in range(STEPS + 1)})
        self.rotated = v.astype(float) @ turn
        self.rest = residuals(self.rotated, self.cuts)
        self.norm = np.sqrt((v.astype(float) ** 2).sum(1))
        self.least = least  # no score below it is among the k best
        self.score, self.vec = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.found = np.zeros(len(ids), np.int64)
        self.summed = self.scored = 0  # pairs whose sums were begun, and pairs scored in whole numbers

    def scan(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Take part of the vectors into account; they are put in order of descending length."""
        norm = np.sqrt((v.astype(float) ** 2).sum(1))
        order = np.argsort(-norm, kind="stable")
        for at in range(0, len(ids), TILE):
            some = order[at : at + TILE]
            rotated = v[some].astype(float) @ self.turn
            rest = residuals(rotated, self.cuts)
            for first in range(0, len(self.ids), QUERIES):
                self._tile(np.arange(first, min(first + QUERIES, len(self.ids))), ids[some], v[some], norm[some], rotated, rest)

    def _tile(self, q: np.ndarray, ids: np.ndarray, v: np.ndarray, norm: np.ndarray, rotated: np.ndarray, rest: np.ndarray) -> None:
        rounding = ROUNDING * norm[0] * self.norm[q].max(initial=0)
        least = self.least - rounding
        q = q[self.norm[q] * norm[0] >= least[q]]
        if not len(q):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(self.norm[q] > 0, least[q] / self.norm[q], -np.inf).min()
        c = np.arange(np.searchsorted(-norm, -need, side="right")) if need > 0 else np.arange(len(ids))
        total, left = np.zeros((len(q), len(c))), np.ones((len(q), len(c)), bool)
        self.summed += total.size
        for step, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            total += self.rotated[q, a:b] @ rotated[c, a:b].T
            left = total + np.outer(self.rest[q, step + 1], rest[c, step + 1]) >= least[q, None]
            n = np.count_nonzero(left)
            if not n:
                return
            if n * SPARSE <= left.size:
                break
            rows, cols = left.any(1), left.any(0)
            if rows.sum() * cols.sum() * 2 <= left.size:
                q, c, total, left = q[rows], c[cols], total[np.ix_(rows, cols)], left[np.ix_(rows, cols)]
        i, j = np.nonzero(left)
        i, j = q[i], c[j]
        self.scored += len(i)
        most, rows = norm[0] * self.norm.max(initial=0), (4 << 20) // max(v.shape[1], 1) + 1
        scores = np.concatenate([exact(self.v[i[s : s + rows]], v[j[s : s + rows]], most) for s in range(0, len(i), rows)] or [np.zeros(0, np.int64)])
        good = (scores >= self.least[i]) & (ids[j] != self.ids[i])
        self._merge(i[good], scores[good], ids[j[good]])

    def _merge(self, i: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        if not len(i):
            return
        touched = np.unique(i)
        old, slot = np.nonzero(np.arange(self.k) < self.found[touched, None])
        old = touched[old]
        i, score, vec = np.r_[i, old], np.r_[score, self.score[old, slot]], np.r_[vec, self.vec[old, slot]]
        order = np.lexsort((vec, ~score, i))  # ~ turns the order of whole numbers round without an overflow
        i, score, vec = i[order], score[order], vec[order]
        begins = np.searchsorted(i, touched)
        place = np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)]))
        keep = place < self.k
        self.score[i[keep], place[keep]], self.vec[i[keep], place[keep]] = score[keep], vec[keep]
        self.found[touched] = np.minimum(np.diff(np.r_[begins, len(i)]), self.k)
        full = touched[self.found[touched] == self.k]
        self.least[full] = np.maximum(self.least[full], self.score[full, self.k - 1])

    def hits(self) -> pa.RecordBatch:
        i, slot = np.nonzero(np.arange(self.k) < self.found[:, None])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[i], self.vec[i, slot], self.score[i, slot])], ["query_id", "vec_id", "score"])


def _bounds(queries: DataFrame, seeds, dim: int, k: int) -> DataFrame:
    """query_id, v, least: the k-th best score among the seeds, less what rounding may add; minus infinity without k of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = seeds.value
        s = v.astype(float).T
        top = np.sqrt((s**2).sum(0)).max(initial=0)
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                b = batch.slice(at, QUERIES)
                own, q = b.column(0).to_numpy(), matrix(b.column(1), dim).astype(float)
                scores = q @ s
                scores[own[:, None] == ids[None, :]] = -np.inf
                least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.full(len(own), -np.inf)
                slack = np.sqrt((q**2).sum(1)) * top
                least = np.clip(least - np.where(slack < 2.0**52, 0, slack * ROUNDING), -np.inf, float(1 << 62))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least)], ["query_id", "v", "least"])

    return queries.mapInArrow(run, "query_id long, v array<long>, least double")


def top_inner(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each vec_id of queries its k best among vectors; both have vec_id and
    embedding, of which floor(scale * x) is taken."""
    spark = vectors.sparkSession
    taken = lambda d: d.select(F.col("vec_id").cast("long"), whole(F.col("embedding"), scale).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    d = taken(vectors).withColumn("length", length).repartitionByRange(F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    rows = staged(d.withColumn("part", F.spark_partition_id()), "vectors")
    asked = taken(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumnRenamed("vec_id", "query_id")
    first = rows.agg(F.max(F.size("v")).alias("dim"), F.min("part").alias("part")).first()
    if first.dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(first.dim, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    sc = spark.sparkContext
    most = max(k + 1, min(SEEDS, BLOCK_BYTES // (8 * max(dim, 1))))
    longest = rows.where(F.col("part") == first.part).orderBy(F.desc("length"), "vec_id").limit(most).select("vec_id", "v").toArrow().combine_chunks().to_batches()[0]
    seeds = sc.broadcast((longest.column(0).to_numpy(), matrix(longest.column(1), dim)))
    turn = sc.broadcast(rotation(rows, dim))
    bounded = _bounds(texts(asked), seeds, dim, k)
    count = asked.count()
    blocks = max(1, -(-count * (dim * 24 + 64 * k) // BLOCK_BYTES))
    bounded = staged(bounded.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "queries")
    path = new_path(spark, "hits")
    spark.createDataFrame([], HIT).write.parquet(path)
    for block in range(blocks):
        got = bounded.where(F.col("block") == block).select("query_id", "v", "least").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        b = got.to_batches()[0]
        sent = sc.broadcast((b.column(0).to_numpy(), matrix(b.column(1), dim), b.column(2).to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, v, least = sent.value
            found = Block(ids, v, least.copy(), turn.value, k)
            for x in batches:
                found.scan(x.column(0).to_numpy(), matrix(x.column(1), dim))
            yield found.hits()

        rows.select("vec_id", "v").mapInArrow(run, HIT).write.mode("append").parquet(path)
        sent.unpersist()
    done(rows, bounded)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return spark.read.schema(HIT).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
