"""Building datasets: splits, balancing, windows, labelling rules, selection, statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.functions.size import small
from wardspark.functions.vector import split_of


def draw(seed: str, key: Column) -> Column:
    """An order that is random but the same everywhere."""
    return F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)


def hash_split(df: DataFrame, key: str, seed: str = "42", train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Each row's split follows from its key alone."""
    return df.withColumn("split", split_of(seed, F.col(key), train, val))


def numbered(df: DataFrame, by: list[str], key: str, seed: str = "42") -> DataFrame:
    """Adds _k, a row's number (from 1) among those of its values of ``by`` in hashed order, and _n, how many these are.
    Rows are numbered within 4,096 stretches of the hash, and stretches by their counts, so no task sorts a whole label."""
    d = df.withColumn("_d", draw(seed, F.col(key))).withColumn("_s", F.substring("_d", 1, 3))
    counts = d.groupBy(*by, "_s").agg(F.count("*").alias("_c"))
    all_ = Window.partitionBy(*by)
    counts = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_s").alias("_t"), (F.sum("_c").over(all_.orderBy("_s")) - F.col("_c")).alias("_from"), F.sum("_c").over(all_).alias("_n"))
    same = F.col("_s") == F.col("_t")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    k = F.row_number().over(Window.partitionBy(*by, "_s").orderBy("_d", key))
    return d.withColumn("_k", k).join(small(counts), same).withColumn("_k", F.col("_k") + F.col("_from")).drop("_d", "_s", "_t", "_from", *[f"_by{i}" for i in range(len(by))])


def stratified_split(df: DataFrame, key: str, label: str, seed: str = "42") -> DataFrame:
    """Per label 8 of 10 rows to train, 1 to val, the rest to test; one at least where there are three rows, and from
    two rows one goes to test. Rows are numbered within a label by a hash."""
    d = numbered(df, [label], key, seed)
    train = F.greatest(F.lit(1), F.floor(F.col("_n") * 8 / 10))
    val = F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    test = F.col("_n") - train - val
    val, train = F.when((test < 1) & (val > 1), val - 1).otherwise(val), F.when((test < 1) & (val <= 1), train - 1).otherwise(train)
    pick = F.when(F.col("_n") == 1, "train").when(F.col("_n") == 2, F.when(F.col("_k") == 1, "train").otherwise("test"))
    pick = pick.when(F.col("_k") <= train, "train").when(F.col("_k") <= train + val, "val").otherwise("test")
    return d.withColumn("split", pick).drop("_k", "_n")


def ratio_split(df: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: str = "42") -> DataFrame:
    """Rows in hashed order, the first int(n * train) to train, the next int(n * val) to val, the rest to test."""
    return floor_split(df.withColumn("_all", F.lit(0)), key, "_all", train, val, seed).drop("_all")


def floor_split(df: DataFrame, key: str, label: str, train: float = 0.8, val: float = 0.1, seed: str = "42") -> DataFrame:
    """As stratified_split, rounded down without minima. Only the two rows where the splits meet are looked for in each
    label: rows are first counted in stretches of the hash, and only two stretches are numbered row by row."""
    d = df.withColumn("_d", draw(seed, F.col(key)))
    d = d.withColumn("_s", F.substring("_d", 1, 3))
    counts = d.groupBy(label, "_s").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(label).orderBy("_s")
    counts = counts.select(label, "_s", "_c", (F.sum("_c").over(upto) - F.col("_c")).alias("_from"), F.sum("_c").over(Window.partitionBy(label)).alias("_n"))
    counts = counts.withColumn("_a", F.floor(F.col("_n") * train)).withColumn("_b", F.col("_a") + F.floor(F.col("_n") * val))
    meets = lambda c: (F.col("_from") < F.col(c)) & (F.col("_from") + F.col("_c") > F.col(c))
    j = d.join(small(counts), [label, "_s"])
    split = lambda k: F.when(k < F.col("_a"), "train").when(k < F.col("_b"), "val").otherwise("test")
    whole = j.where(~meets("_a") & ~meets("_b")).withColumn("split", split(F.col("_from")))
    order = Window.partitionBy(label, "_s").orderBy("_d", key)
    parts = j.where(meets("_a") | meets("_b")).withColumn("_k", F.col("_from") + F.row_number().over(order) - 1).withColumn("split", split(F.col("_k")))
    return whole.unionByName(parts.drop("_k")).drop("_d", "_s", "_c", "_from", "_n", "_a", "_b")


def with_every_class(df: DataFrame, key: str, label: str, splits: tuple[str, ...] = ("val", "test"), seed: str = "42") -> DataFrame:
    """A split that lacks a label gets one row of it from train, if two of it at least stay there: the first in hashed
    order to the first split that lacks it, the second to the next."""
    have = df.groupBy(label).agg(F.count_if(F.col("split") == "train").alias("_t"), *[F.count_if(F.col("split") == s).alias(f"_{s}") for s in splits])
    lack = have.select(label, "_t", F.filter(F.array(*[F.when(F.col(f"_{s}") == 0, s) for s in splits]), lambda x: x.isNotNull()).alias("_lack")).where(F.size("_lack") > 0)
    w = Window.partitionBy(label).orderBy(draw(seed, F.col(key)), key)
    rows = df.where("split = 'train'").join(small(lack), label)
    near = rows.groupBy(label).agg(F.min(draw(seed, F.col(key))).alias("_min")).select(label)  # labels that have any
    moved = rows.join(small(near), label).withColumn("_k", F.row_number().over(w)).where((F.col("_k") <= F.size("_lack")) & (F.col("_t") - F.col("_k") >= 1))
    moved = moved.select(key, F.element_at("_lack", F.col("_k").cast("int")).alias("_to"))
    return df.join(small(moved), key, "left").withColumn("split", F.coalesce("_to", "split")).drop("_to")


def triples(chunks: DataFrame, negatives: int = 3, most: int = 1000, words: int = 12, seed: str = "1337") -> DataFrame:
    """chunks: chunk_id, text. A query of each chunk's first words, the chunk, and other chunks as negatives: those that
    follow it in an order drawn by a hash, the first ones after the last. So each is drawn from all others, and no pairs are
    made that are not used. At most ``most`` triples, in hashed order; 0 for all."""
    c = chunks.select("chunk_id", "text", draw(seed, F.col("chunk_id")).alias("_d"))
    n = c.count()
    stretch = F.substring("_d", 1, 4)
    counts = c.groupBy(stretch.alias("_s")).agg(F.count("*").alias("_c"))
    offsets = counts.select("_s", (F.sum("_c").over(Window.orderBy("_s")) - F.col("_c")).alias("_from"))  # 65,536 rows at most
    w = Window.partitionBy("_s").orderBy("_d", "chunk_id")
    c = c.withColumn("_s", stretch).withColumn("_r", F.row_number().over(w)).join(F.broadcast(offsets), "_s").withColumn("_r", F.col("_from") + F.col("_r") - 1)
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z_][a-z0-9_]+"), 0)
    q = c.withColumn("query", F.array_join(F.slice(tokens, 1, words), " ")).where("query <> ''")
    if most:
        q = q.orderBy(draw(seed + ":", F.col("chunk_id")), "chunk_id").limit(most)
    k = min(negatives, max(0, n - 1))
    wanted = q.select("chunk_id", "query", F.col("text").alias("positive"), "_r", F.explode_outer(F.sequence(F.lit(1), F.lit(k)) if k else F.array().cast("array<int>")).alias("_k"))
    wanted = wanted.withColumn("_at", (F.col("_r") + F.col("_k")) % max(n, 1))
    other = c.select(F.col("_r").alias("_at"), F.col("chunk_id").alias("negative_id"))
    j = wanted.join(other, "_at", "left").groupBy("chunk_id", "query", "positive").agg(F.array_sort(F.collect_list(F.struct("_k", "negative_id"))).alias("_l"))
    return j.select(F.left(F.sha1(F.concat("query", "chunk_id")), F.lit(12)).alias("triple_id"), "chunk_id", "query", "positive", F.transform("_l", lambda x: x["negative_id"]).alias("negatives"))


def ood_split(df: DataFrame, key: str, group: str, share: float = 0.1, seed: str = "42") -> DataFrame:
    """Whole groups are held out (one at least), the rest is split by hash."""
    groups = df.select(group).distinct().withColumn("_d", draw(seed, F.col(group)))
    n = groups.count()
    held = groups.orderBy("_d", group).limit(max(1, int(n * share))).select(group)
    rest = hash_split(df.join(held, group, "left_anti"), key, seed)
    return rest.unionByName(df.join(held, group, "left_semi").withColumn("split", F.lit("ood")))


def ood_split_of(df: DataFrame, key: str, group: str, train: float = 0.7, val: float = 0.15, ood: float = 0.05, seed: str = "42") -> DataFrame:
    """Whole groups (rows without one are the group unknown) are held out, int(groups * ood) of them and one at least; the
    shares of the rest are of all rows, so they grow by 1 / (1 - ood), rounded down, and test takes what is left."""
    d = df.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("unknown")))
    groups = d.groupBy("_group").count().select("_group").withColumn("_d", draw(seed, F.col("_group")))
    held = groups.orderBy("_d", "_group").limit(max(1, int(groups.count() * ood))).select("_group")
    rest = ratio_split(d.join(small(held), "_group", "left_anti"), key, train / (1 - ood), val / (1 - ood), seed)
    return rest.unionByName(d.join(small(held), "_group", "left_semi").withColumn("split", F.lit("ood_test"))).drop("_group")


def with_overlap(selected: DataFrame, key: str, target: int, share: float, seed: str = "42") -> DataFrame:
    """The selected rows, and round(target * share) of them (half to even) once more for a second annotator, drawn without
    replacement; both rows of a pair have its duplicate_group."""
    n = round(target * share)
    drawn = selected.select(key).orderBy(draw(f"{seed}:overlap", F.col(key)), key).limit(max(n, 0)).select(F.col(key).alias("_key"))
    group = F.left(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed), F.lit("overlap")), 256), F.lit(12))
    d = selected.join(small(drawn), F.col(key) == F.col("_key"), "left").withColumn("duplicate_group", F.when(F.col("_key").isNotNull(), group))
    return d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_key").isNotNull().cast("int")))).drop("_key")


def balance_ratio(df: DataFrame, key: str, positive: Column, ratio: int = 10, seed: str = "42") -> DataFrame:
    """All positives, and of the others ``ratio`` for each positive; all of them where that would leave none."""
    d = numbered(df.withColumn("_p", positive), ["_p"], key, seed)
    most = d.agg(F.floor(F.count_if("_p") * ratio).alias("_most"))
    return d.join(F.broadcast(most)).where("_p OR _k <= _most OR _most = 0").drop("_p", "_k", "_n", "_most")


def balance_categories(df: DataFrame, key: str, positive: Column, category: str, least: int = 0, most: int = 0, ratio: float = 10, seed: str = "42") -> DataFrame:
    """Of each category's positives at most ``most`` (0: all), and where they are fewer than ``least``, so many more of them,
    drawn with replacement; then of the others ``ratio`` for each positive, or all where that would leave none. Adds copy, 0
    for a row itself."""
    d = numbered(df.withColumn("_p", positive).withColumn("_g", F.when(F.col("_p"), F.col(category))), ["_p", "_g"], key, seed)
    kept = d.where("_p").where(F.lit(most <= 0) | (F.col("_k") <= most)).withColumn("_n", F.least("_n", F.lit(most if most > 0 else 1 << 62)))
    n = kept.groupBy("_g").agg(F.first("_n").alias("_n")).where(F.col("_n") < least)
    pick = F.conv(F.substring(draw(seed, F.concat_ws(":", F.coalesce("_g", F.lit("")), "_j")), 1, 8), 16, 10).cast("long") % F.col("_n") + 1
    more = n.select("_g", "_n", F.explode(F.sequence(F.lit(1), F.lit(least) - F.col("_n"))).alias("_j")).select(F.col("_g").alias("_h"), pick.alias("_l"), F.col("_j").alias("copy"))
    again = kept.join(small(more), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_k") == F.col("_l"))).drop("_h", "_l")
    good = kept.withColumn("copy", F.lit(0)).unionByName(again.withColumn("copy", F.col("copy").cast("int")))
    total = good.agg(F.floor(F.count("*") * F.lit(ratio)).alias("_most"), F.count("*").alias("_all"))
    rest = d.where("NOT coalesce(_p, false)").join(F.broadcast(total)).where("_k <= _most OR _most = 0").drop("_most", "_all").withColumn("copy", F.lit(0))
    return good.unionByName(rest).drop("_p", "_g", "_k", "_n")


def balance_oversample(df: DataFrame, key: str, label: str, seed: str = "42") -> DataFrame:
    """Every label up to the size of the largest: rows are repeated in turn, in hashed order."""
    d = numbered(df, [label], key, seed)
    top = df.groupBy(label).count().agg(F.max("count").alias("_top"))
    d = d.join(F.broadcast(top))
    times = (F.floor(F.col("_top") / F.col("_n")) + F.when(F.col("_k") <= F.col("_top") % F.col("_n"), 1).otherwise(0)).cast("int")
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_k", "_n", "_top")


def cap_per(df: DataFrame, by: str, most: int, *order) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse frequencies with mean 1."""
    inverse = df.groupBy(label).agg((1.0 / F.count("*")).alias("inverse"))
    return inverse.join(F.broadcast(inverse.agg(F.avg("inverse").alias("mean")))).select(label, (F.col("inverse") / F.col("mean")).alias("weight"))


def vocabulary(df: DataFrame, tokens: Column, most: int, least: int = 2, offset: int = 2) -> DataFrame:
    """token, n, index: most frequent first, ties by token. Only the top of the counts is sorted."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "token").limit(most)
    return top.withColumn("index", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + offset - 1)


def agreement(labels: DataFrame) -> DataFrame:
    """labels: duplicate_group, verdict. Groups of two labels or more, and the percentage of them that agree."""
    g = labels.where("duplicate_group <> ''").groupBy("duplicate_group").agg(F.count("*").alias("n"), F.count_distinct("verdict").alias("v")).where("n >= 2")
    return g.agg(F.count("*").alias("groups"), F.round(100 * F.count_if(F.col("v") == 1) / F.greatest(F.count("*"), F.lit(1)), 4).alias("agreement"))


def any_of(text: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns))


SELECTED = "item_id string, source string, rule_id string, place int, tier string"


def select_round_robin(items: DataFrame, target: int, cap: int, hard_share: float = 0.35) -> DataFrame:
    """items: item_id, source, rule_id, weight, hardness. In turn over the sources, at most ``cap`` items of a rule (0:
    no limit), in three passes that share the counts: hard ones up to their share, the others, then whatever is left.
    As a count of one source changes what another may take, the choice is sequential. Only what can be chosen gets
    there: of each (source, rule, hard or not) the first ``cap`` or ``target`` rows in the order of the turns."""
    items = items.withColumns({"source": F.when(F.coalesce("source", F.lit("")) == "", "unknown").otherwise(F.col("source")), "rule_id": F.coalesce("rule_id", F.lit(""))})
    target = min(target, items.count())
    hard = F.col("hardness") > 0
    keep = min(cap, target) if cap else target
    order = [F.desc(F.col("weight") + F.col("hardness")), draw("select", F.col("item_id")), F.col("item_id")]
    d = items.withColumn("hard", hard).withColumn("draw", draw("select", F.col("item_id")))
    by_hardness = Window.partitionBy("source", "rule_id", "hard").orderBy(F.desc("hardness"), "item_id")
    by_turn = Window.partitionBy("source", "rule_id", "hard").orderBy(*order)
    d = d.withColumn("_a", F.row_number().over(by_turn)).withColumn("_b", F.row_number().over(by_hardness)).where((F.col("_a") <= max(keep, 1)) | (F.col("hard") & (F.col("_b") <= target)))
    quota = round(target * hard_share)
    first = d.where("hard").orderBy(F.desc("hardness"), "item_id").limit(quota).select("item_id", F.lit(True).alias("chosen_hard"))
    d = d.join(F.broadcast(first), "item_id", "left")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(score=-(rows.weight + rows.hardness)).sort_values(["score", "draw", "item_id"], kind="stable")
        counts: dict[str, int] = {}
        taken: list[tuple] = []
        seen: set[str] = set()

        def robin(pool: pd.DataFrame, limit: int, tier: str) -> None:
            queues = {s: list(g.to_dict("records")) for s, g in pool.groupby("source", sort=True)}
            n = 0
            while n < limit and any(queues.values()):
                for s in sorted(queues):
                    while queues[s] and n < limit:
                        r = queues[s].pop(0)
                        if r["item_id"] not in seen and (not cap or counts.get(r["rule_id"], 0) < cap):
                            counts[r["rule_id"]] = counts.get(r["rule_id"], 0) + 1
                            seen.add(r["item_id"])
                            taken.append((r["item_id"], s, r["rule_id"], len(taken) + 1, tier))
                            n += 1
                            break

        is_hard = rows.chosen_hard.eq(True)
        robin(rows[is_hard], quota, "hard")
        robin(rows[~is_hard], target - len(taken), "easy")
        robin(rows[~rows.item_id.isin(seen)], target - len(taken), "fallback")
        return pd.DataFrame(taken, columns=[c.split(" ")[0] for c in SELECTED.split(", ")])

    return d.drop("_a", "_b").withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda pdf: choose(pdf), SELECTED)


def count_splits(df: DataFrame, label: str) -> DataFrame:
    return df.cube("split", label).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def code_features(df: DataFrame, text: str) -> DataFrame:
    """Counts and flags of a text, all in one projection."""
    t, lines = F.col(text), F.split(text, "\n")
    return df.select(
        "*",
        F.char_length(t).alias("n_chars_"),
        F.size(lines).alias("n_lines"),
        F.coalesce(F.array_max(F.transform(lines, F.char_length)), F.lit(0)).alias("longest_line"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, "[0-9]", ""))).alias("n_digits"),
        F.regexp_count(t, F.lit("\\b(?:if|for|while|and|or)\\b")).alias("n_branches"),
        F.lower(t).contains("select ").alias("has_sql"),
        t.rlike("https?://").alias("has_url"),
        t.rlike("\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b").alias("has_ip"),
        F.lower(t).rlike("password|secret|token").alias("has_secret_word"),
    )
