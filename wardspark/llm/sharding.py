"""Sharding by balanced label propagation.

Documents with equal text are linked. Labels are shards: in each round the documents of a group move towards the shard
in which most of the group is, first among shards with room for all of it, as far as that shard has room for linked
documents (others give way in the end); the moves that are let in are drawn by a hash, so that no shard has to be
sorted. Rounds go on until hardly anything moves, ``ROUNDS`` at most. A group larger than a shard's capacity is cut into
parts of at most the capacity beforehand, by a hash of the document, and each part is a group of its own. What a shard
has over its share in the end goes to the shards that lack rows, documents without links first; then the numbers of rows
differ by one at most (law ``rows``).

Only counts per shard come to the driver: at most shards * shards numbers. What is known of a large group reaches its
documents by a broadcast, if all large groups together are counted to be small, so they do not meet in one task.

Defined cases: a null text has 0 bytes, checksum 0 and forms a group of its own kind; texts are only hashed, however long
they are; rows without an id are left out; repeated ids are rows of their own, told apart by their text, and by a number
where even that is equal; ties between shards are broken by a hash of group and shard; fewer documents than shards leave
shards empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.stage import done, staged

#: Rounds end when fewer than this share of the linked documents move, and after so many.
SETTLED, ROUNDS = 0.001, 8
#: Rows of a shard that are numbered in one window.
STRETCH = 20_000
#: Groups beyond so many rows are large; they are broadcast if they take at most so many bytes, at so many a group.
LARGE, BROADCAST_BYTES, GROUP_BYTES = 500, 32 << 20, 64
_DRAW = 1 << 30


def _hash(*cols, seed: int) -> Column:
    return F.xxhash64(*cols, F.lit(seed))


def told(d: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """d with the columns of its group, null where it has none. groups: key, members and more."""
    large, small = groups.where(F.col("members") > LARGE), groups.where(F.col("members") <= LARGE)
    if large.count() * GROUP_BYTES > BROADCAST_BYTES:
        return d.join(groups, key, "left")
    of_large = d.join(F.broadcast(large), key)
    rest = d.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key, "left")
    return of_large.unionByName(rest)


def nodes(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, n (number among equal rows), size, text_crc32, grp (null without links) of every document."""
    text = F.col("text")
    d = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("key"),
    )
    d = staged(d, "shard-nodes")
    capacity = max(1, -(-d.count() // shards))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("size")) - 1)
    groups = staged(d.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shard-groups")
    parts = F.ceil(F.col("members") * 1.25 / capacity).cast("int")  # parts by hash are uneven
    j = told(d, groups.select("key", "members", F.when(F.col("members") > capacity, parts).otherwise(1).alias("parts")), "key")
    return j.select("doc_id", "n", "size", "text_crc32", F.when(F.col("parts").isNotNull(), _hash("key", F.pmod(_hash("doc_id", "n", seed=1), F.col("parts")), seed=2)).alias("grp"))


def propagate(d: DataFrame, shards: int, rounds: int) -> DataFrame:
    """nodes with shard. Balanced up to the draws."""
    all_ = staged(d.withColumn("shard", F.pmod(_hash("doc_id", "n", seed=3), F.lit(shards)).cast("int")), "shard-0")
    capacity = -(-all_.count() // shards)
    # documents without links stay where they are
    d, rest = all_.where("grp IS NOT NULL"), all_.where("grp IS NULL")
    load = [0] * shards
    for r in d.groupBy("shard").count().collect():
        load[r.shard] = r["count"]
    table, last = None, None
    for r in range(1, rounds + 1):
        votes = d.groupBy("grp", "shard").count()
        members = votes.groupBy("grp").agg(F.sum("count").alias("members"), F.collect_list(F.struct("shard", "count")).alias("votes"))  # at most one for each shard
        room = F.element_at(F.array(*[F.lit(max(0, capacity - x)).cast("long") for x in load]), F.col("v.shard") + 1)
        choice = F.struct(room >= F.col("members") - F.col("v.count"), F.col("v.count"), _hash("grp", "v.shard", seed=r))
        best = members.select("grp", "members", F.explode("votes").alias("v")).groupBy("grp", "members").agg(F.max_by("v.shard", choice).alias("best"))
        best = staged(best, f"shard-best-{r}")
        wish = staged(told(d, best, "grp"), f"shard-wish-{r}")
        flow = wish.groupBy("shard", "best").count().collect()
        load, into = [0] * shards, [0] * shards
        for f in flow:
            load[f.shard] += f["count"]
            if f.best != f.shard:
                into[f.best] += f["count"]
        if sum(into) <= SETTLED * sum(load):
            done(wish, best)
            break
        # what leaves makes room; a shard that does not let all in keeps the others where they are
        share = [1.0] * shards
        for _ in range(20):
            leaves = [0.0] * shards
            for f in flow:
                if f.best != f.shard:
                    leaves[f.shard] += f["count"] * share[f.best]
            share = [min(1.0, max(0.0, capacity - load[s] + leaves[s]) / into[s]) if into[s] else 1.0 for s in range(shards)]
        let = F.element_at(F.array(*[F.lit(int(x * _DRAW)) for x in share]), F.col("best") + 1)
        move = F.pmod(_hash("doc_id", "n", seed=100 + r), F.lit(_DRAW)) < let
        before, table = table, staged(wish.select("doc_id", "n", "size", "text_crc32", "grp", F.when(move, F.col("best")).otherwise(F.col("shard")).alias("shard")), f"shard-{r}")
        d = table
        done(before, wish, best)
        moved = sum(f["count"] * share[f.best] for f in flow if f.best != f.shard)
        load = [load[s] + into[s] * share[s] - sum(f["count"] * share[f.best] for f in flow if f.shard == s and f.best != s) for s in range(shards)]
        if moved <= SETTLED * sum(load) or (last is not None and sum(into) >= 0.98 * last):  # what still wants to move finds no room
            break
        last = sum(into)
    return d.unionByName(rest)


def numbered(d: DataFrame, stretches: int, *order: Column) -> DataFrame:
    """Adds rank: gapless from 0 in each shard, in order of the order columns' stretches. Stretches are numbered apart
    and offset by the counts of those before."""
    d = d.withColumn("_stretch", F.concat_ws("-", *[F.lpad(o.cast("string"), 6, "0") for o in order], F.lpad(F.pmod(_hash("doc_id", "n", seed=4), F.lit(stretches)).cast("string"), 9, "0")))
    counts = d.groupBy("shard", "_stretch").count()
    before = Window.partitionBy("shard").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_stretch", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("shard", "_stretch").orderBy("doc_id", "n", "text_crc32")
    d = d.withColumn("_at", F.row_number().over(within) - 1)
    return d.join(offsets, ["shard", "_stretch"]).withColumn("rank", F.col("_from") + F.col("_at")).drop("_stretch", "_from", "_at")


def settle(d: DataFrame, shards: int) -> DataFrame:
    """Gives every shard its exact share: shard and slot (gapless from 0) of every row."""
    load = [0] * shards
    for r in d.groupBy("shard").count().collect():
        load[r.shard] = r["count"]
    each, more = divmod(sum(load), shards)
    quota = [each] * shards
    for s in sorted(range(shards), key=lambda s: (-load[s], s))[:more]:
        quota[s] += 1
    over = [max(0, load[s] - quota[s]) for s in range(shards)]
    lack = [max(0, quota[s] - load[s]) for s in range(shards)]
    before = lambda xs: [sum(xs[:s]) for s in range(shards)]
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), c + 1)
    linked = F.when(F.col("grp").isNotNull(), 0).otherwise(1)  # documents without links come last, and go first
    d = numbered(d, max(load) // STRETCH + 1, linked)
    spare = F.col("rank") - pick(quota, F.col("shard"))
    ordinal = pick(before(over), F.col("shard")) + spare
    d = d.withColumn("ordinal", F.when(spare >= 0, ordinal))
    start = before(lack)
    to = sum((F.when(F.col("ordinal") >= start[s] + lack[s], 1).otherwise(0) for s in range(shards)), F.lit(0))
    d = d.withColumn("to", F.when(F.col("ordinal").isNotNull(), to))
    slot = F.when(F.col("to").isNotNull(), pick(load, F.col("to")) + F.col("ordinal") - pick(start, F.col("to"))).otherwise(F.col("rank"))
    return d.select("doc_id", "size", "text_crc32", F.coalesce("to", "shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), "grp")


def assign(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``) and grp."""
    d = settle(staged(propagate(nodes(docs, shards), shards, rounds), "shard-labels"), shards)
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "grp")


def cut_edges(assigned: DataFrame) -> DataFrame:
    """links (a chain through each group) and how many of them have their ends in different shards, at least."""
    g = assigned.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("s"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("s") - 1), F.lit(0)).alias("cut"))
