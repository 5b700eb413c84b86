"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base counts are computed within each row, without a shuffle. Beyond the fixed base rule, each rule compares a ratio with
a cutoff per stratum (language). The cutoffs come from the labelled documents: with n good ones in a stratum, of which a
cutoff rejects k, the cutoff is certified if P(Bin(n, alpha) <= k) <= delta / chains, the exact binomial test that the
false rejection rate is below alpha. Cutoffs of a chain (stratum, rule) are tested from the loosest on and the first
failure ends the chain (fixed sequence), so only the chains need the Bonferroni correction; alpha is shared out among
the rules. Of the certified cutoffs the one with the most rejected bad minus rejected good documents is taken, the
loosest at a tie, and none where there is no gain.

Defined cases: null text has no words, and fails the base rule; a null language is the stratum ''; a label of a document
that is given twice counts as the worst one; null labels count for nothing; without certified cutoffs only the base rule
rejects; documents with repeated ids are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.stage import staged
from wardspark.llm.words import space_words

#: Rule name and its ratio; each is 0 for a text without words.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}
#: Cutoffs are i / GRID; a document is rejected by cutoff i if floor(ratio * GRID) >= i.
GRID = 50
#: Up to so many strata their cutoffs are broadcast.
MAX_BROADCAST_STRATA = 10_000


def _repeat_words(d: DataFrame) -> DataFrame:
    """Adds n_repeat_words to a table with words: sort the hashed windows with their places packed below, take those
    whose neighbour has the same hash bits, and compare these by their words."""
    n = F.size("words")
    d = d.withColumn("bits", F.greatest(F.ceil(F.log2(n + F.lit(2))), F.lit(1)).cast("int"))
    # one array, used again and again below: Catalyst keeps it as a column of its own
    d = d.withColumn("packed", F.expr("sort_array(transform(sequence(0, size(words) - 3), i -> shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), bits) | i))"))
    d = d.withColumn("packed", F.when(n >= 3, F.col("packed")))
    same = "shiftrightunsigned(x, bits) = shiftrightunsigned(packed[{}], bits)"
    found = f"filter(packed, (x, i) -> (i > 0 AND {same.format('i - 1')}) OR (i + 1 < size(packed) AND {same.format('i + 1')}))"
    d = d.withColumn("found", F.when(n >= 3, F.expr(found)))
    d = d.withColumn("exact", F.when(F.size("found") > 0, F.expr("sort_array(transform(found, x -> named_struct('w', concat_ws(' ', slice(words, cast(x & (shiftleft(1L, bits) - 1) AS int) + 1, 3)), 'p', cast(x & (shiftleft(1L, bits) - 1) AS int))))")))
    places = "array_sort(transform(filter(exact, (x, i) -> (i > 0 AND x.w = exact[i - 1].w) OR (i + 1 < size(exact) AND x.w = exact[i + 1].w)), x -> x.p))"
    covered = f"aggregate({places}, named_struct('last', -3, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)"
    return d.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long"))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", *keep, space_words(F.col("text")).alias("words"), text.alias("_text"))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "doc_id",
        *keep,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    d = _repeat_words(d)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def binomial_tail(n: Column, k: Column, alpha: float) -> Column:
    """log P(Bin(n, alpha) <= k), exactly summed; 0 where k is at or beyond the mean."""
    log = "greatest({a}, {b}) + ln(1 + exp(-abs({a} - {b})))"
    e = f"""aggregate(sequence(1, _k), named_struct('p', _n * ln(1 - {alpha}D), 's', _n * ln(1 - {alpha}D)),
      (a, i) -> named_struct('p', a.p + ln((_n - i + 1) / i * {alpha}D / (1 - {alpha}D)),
        's', {log.format(a="a.s", b=f"(a.p + ln((_n - i + 1) / i * {alpha}D / (1 - {alpha}D)))")}), a -> a.s)"""
    return F.when(k >= n * alpha, F.lit(0.0)).when(k == 0, n * F.log(F.lit(1 - alpha))).otherwise(F.expr(e.replace("_k", "cast(bad_k AS int)").replace("_n", "cast(good_n AS double)")))


def cutoffs(labelled: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """labelled: stratum, good (boolean) and the ratio of each rule in [0, 1] or beyond. Gives stratum and, for each
    rule, its cutoff (1 to GRID), null where none is certified or none helps. alpha bounds the false rejections of all
    rules together, with confidence 1 - delta over all strata and rules."""
    each = alpha / len(RULES)
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.least(F.floor(F.col(k) * GRID), F.lit(GRID)).cast("int").alias("bin")) for k in RULES]))
    counts = labelled.select("stratum", "good", rules.alias("r")).groupBy("stratum", "r.rule", "r.bin").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    grid = counts.select("stratum").distinct().select("stratum", F.explode(F.array(*map(F.lit, RULES))).alias("rule")).select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("bin"))
    counts = grid.join(counts, ["stratum", "rule", "bin"], "left").fillna(0, ["g", "b"])
    chain = Window.partitionBy("stratum", "rule")
    above = chain.orderBy(F.desc("bin"))
    c = counts.select("stratum", "rule", "bin", F.sum("g").over(chain).alias("good_n"), F.sum("g").over(above).alias("bad_k"), F.sum("b").over(above).alias("hits")).where("bin > 0")
    m = c.select("stratum", "rule").distinct().select(F.count("*").alias("m"))
    c = c.join(F.broadcast(m)).withColumn("ok", binomial_tail(F.col("good_n"), F.col("bad_k"), each) <= F.log(F.lit(delta) / F.col("m")))
    c = c.withColumn("ok", F.min("ok").over(above)).where("ok AND hits > bad_k")
    best = c.groupBy("stratum", "rule").agg(F.max_by("bin", F.struct(F.col("hits") - F.col("bad_k"), "bin")).alias("cut"))
    cuts = [F.max(F.when(F.col("rule") == k, F.col("cut"))).alias(f"cut_{k}") for k in RULES]
    return best.groupBy("stratum").agg(*cuts)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """features() of every document and kept. The features are staged once, then used for cutoffs and verdicts."""
    f = staged(features(docs.withColumn("stratum", F.coalesce("lang", F.lit(""))), "stratum"), "quality")
    f = f.select("*", *[F.expr(e).alias(k) for k, e in RULES.items()])
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    labelled = f.where("NOT base_failed").join(known, "doc_id").select("stratum", "good", *RULES)
    cuts = staged(cutoffs(labelled, alpha, delta), "cutoffs")
    if cuts.limit(MAX_BROADCAST_STRATA + 1).count() <= MAX_BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    j = f.join(cuts, "stratum", "left")
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.least(F.floor(F.col(k) * GRID), F.lit(GRID)) >= F.col(f"cut_{k}"), F.lit(False)) for k in RULES])
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~hit).alias("kept"))
