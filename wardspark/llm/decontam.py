"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

The index is a table (term, doc_id, pos) of the training tokens, with a record of term '' per document whose pos is the
number of its words. Windows of the test items are looked up by their rarest terms, as counted over all documents: of
every window the two rarest words are its anchors, and the lists of both, each less the word's offset in the item, are
intersected, which leaves (document, item, diagonal). The index holds the postings of anchor terms only; along a
diagonal all words are then compared with the text of the document.

Defined cases: a null text has no words; rows without an id, documents and items alike, are left out; a document id that
is given twice gets a row each time, with the hits of all its texts; items of equal text are all reported; an empty
benchmark or document table gives no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.llm.stage import staged
from wardspark.llm.words import plain_words

WINDOW = 13
#: A table is broadcast if its rows are counted to take at most so many bytes; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def _bytes(name: str, kind: T.DataType) -> Column:
    """About what a value takes in memory."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 24
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.coalesce(F.octet_length(F.array_join(c, "")), F.lit(0)) + 16 * F.greatest(F.size(c), F.lit(0)) + 24
    return F.lit(16)


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to be small. Its columns are numbers, strings or arrays of strings."""
    row = sum((_bytes(f.name, f.dataType) for f in df.schema.fields), F.lit(16))
    total = df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def tokenised(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select("doc_id", plain_words(F.col("text")).alias("words"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a key of its own), item_id, iwords and w, the length of its windows; items without words are left out."""
    b = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), plain_words(F.col("text")).alias("iwords")).distinct()
    b = b.where(F.size("iwords") > 0)
    key = F.concat_ws(":", "item_id", F.md5(F.array_join("iwords", " ")))
    return b.select(key.alias("item"), "item_id", "iwords", F.least(F.size("iwords"), F.lit(WINDOW)).alias("w"))


def term_counts(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms stands in all documents."""
    return tokens.select(F.explode("words").alias("term")).join(terms, "term", "left_semi").groupBy("term").count()


def postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """The index of these terms: term, doc_id, pos; with the length record of every document."""
    t = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    places = tokens.select("doc_id", F.posexplode(F.array_append("words", F.lit(""))).alias("pos", "term"))
    return places.join(small(t), "term", "left_semi").select("term", "doc_id", "pos")


def anchors(items: DataFrame, counts: DataFrame) -> DataFrame:
    """item, qa, ta, qb, tb: of each window the places and terms of its two rarest words, once for all windows that
    share them; a window of one word has it twice."""
    places = items.select("item", "w", F.posexplode("iwords").alias("q", "term")).join(small(counts), "term", "left")
    ranked = F.sort_array(F.collect_list(F.struct("q", F.coalesce("count", F.lit(0)).alias("n"), "term")))
    p = places.groupBy("item", "w").agg(ranked.alias("p"))
    window = "slice(transform(array_sort(transform(slice(p, s + 1, w), x -> named_struct('n', x.n, 'q', x.q, 'term', x.term))), x -> named_struct('q', x.q, 'term', x.term)), 1, 2)"
    p = p.select("item", F.explode(F.expr(f"array_distinct(transform(sequence(0, size(p) - w), s -> {window}))")).alias("a"))
    last = F.element_at("a", -1)
    return p.select("item", F.col("a")[0]["q"].alias("qa"), F.col("a")[0]["term"].alias("ta"), last["q"].alias("qb"), last["term"].alias("tb"))


def diagonals(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, item, diag (document place less item place) at which both anchors of some window stand."""
    sides = pairs.select("item", "qa", "qb", F.explode(F.array(F.struct(F.col("ta").alias("term"), F.col("qa").alias("q"), F.lit(1).alias("side")), F.struct(F.col("tb").alias("term"), F.col("qb").alias("q"), F.lit(2).alias("side")))).alias("s"))
    sides = sides.select("item", "qa", "qb", "s.term", "s.q", "s.side")
    found = index.where("term <> ''").join(small(sides), "term").select("doc_id", "item", "qa", "qb", (F.col("pos") - F.col("q")).alias("diag"), "side")
    both = found.groupBy("doc_id", "item", "qa", "qb", "diag").agg(F.bit_or("side").alias("sides")).where("sides = 3")
    return both.select("doc_id", "item", "diag").distinct()


def verified(tokens: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, item_id, runs: the stretches [start, end) of a document that whole windows of the item cover there."""
    lengths = items.select("item", F.size("iwords").alias("len"))
    per = candidates.join(small(lengths), "item").groupBy("doc_id").agg(F.collect_list(F.struct("item", "diag", "len")).alias("c"))
    texts = tokens.join(small(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
    # of the text only what lies beside the item goes on
    cut = "transform(c, x -> named_struct('item', x.item, 'lo', greatest(x.diag, 0), 'skip', greatest(-x.diag, 0), 'text', slice(words, greatest(x.diag, 0) + 1, x.len - greatest(-x.diag, 0))))"
    e = texts.join(per, "doc_id").select("doc_id", F.explode(F.expr(cut)).alias("x")).select("doc_id", "x.*").join(small(items), "item")
    e = e.select("doc_id", "item_id", "lo", "w", "text", F.expr("slice(iwords, skip + 1, size(iwords))").alias("own"))
    # lengths of the matching stretches, ended at each place: a run of at least w words is made of windows
    runs = """filter(aggregate(zip_with(own, text, (a, b) -> coalesce(a = b, false)), named_struct('i', 0, 'from', 0, 'runs', array(named_struct('s', 0, 'e', 0))),
      (z, m) -> CASE WHEN m THEN named_struct('i', z.i + 1, 'from', z.from, 'runs', z.runs)
        ELSE named_struct('i', z.i + 1, 'from', z.i + 1, 'runs', IF(z.i > z.from, array_append(z.runs, named_struct('s', z.from, 'e', z.i)), z.runs)) END,
      z -> IF(z.i > z.from, array_append(z.runs, named_struct('s', z.from, 'e', z.i)), z.runs)), r -> r.e - r.s >= w AND r.e > r.s)"""
    e = e.select("doc_id", "item_id", "lo", F.expr(runs).alias("runs")).where(F.size("runs") > 0)
    return e.select("doc_id", "item_id", F.expr("transform(runs, r -> named_struct('s', r.s + lo, 'e', r.e + lo))").alias("runs"))


def covered(intervals: Column) -> Column:
    """How many places sorted intervals (s, e) cover."""
    step = lambda z, r: F.struct(F.greatest(z["e"], r["e"]).alias("e"), (z["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(z["e"], r["s"]))).alias("n"))
    return F.aggregate(intervals, F.struct(F.lit(0).alias("e"), F.lit(0).alias("n")), step, lambda z: z["n"].cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated: share * n_hit >= n_words > 0."""
    tokens, items = tokenised(docs), staged(items_of(benchmark), "items")
    vocabulary = items.select(F.explode("iwords").alias("term")).distinct()
    counts = staged(term_counts(tokens, small(vocabulary)), "counts")
    pairs = staged(anchors(items, counts), "anchors")
    terms = pairs.select(F.explode(F.array("ta", "tb")).alias("term")).distinct()
    index = staged(postings(tokens, terms), "index")
    hits = verified(tokens, items, staged(diagonals(index, pairs), "diagonals"))
    found = hits.groupBy("doc_id").agg(covered(F.array_sort(F.flatten(F.collect_list("runs")))).alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    lengths = index.where("term = ''").select("doc_id", F.col("pos").cast("long").alias("n_words"))
    out = lengths.join(found, "doc_id", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.select("*", F.size("item_ids").cast("long").alias("n_items"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def proximity(docs: DataFrame, phrases: DataFrame, slack: int) -> DataFrame:
    """doc_id, item, first, last: the closest places where all words of a phrase (item_id, text) stand within its length
    plus slack words of each other, in any order, once for each place of its rarest word. The lists of the other words
    are intersected with those places, distance instead of offset."""
    tokens, items = tokenised(docs), staged(items_of(phrases), "items")
    words = items.select("item", F.size("iwords").alias("len"), F.explode(F.array_distinct("iwords")).alias("term"))
    index = staged(postings(tokens, words.select("term").distinct()), "index").where("term <> ''")
    counts = index.groupBy("term").count()
    ranked = words.join(counts, "term", "left").groupBy("item", "len").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "term"))).alias("t"))
    rare = ranked.select("item", "len", F.col("t")[0]["term"].alias("term"))
    rest = ranked.select("item", F.size("t").alias("terms"), F.posexplode("t").alias("k", "x")).select("item", "terms", "k", F.col("x.term").alias("term"))
    reach = F.col("len") + slack - 1
    seeds = index.join(small(rare), "term").select("doc_id", "item", F.col("pos").alias("seed"), reach.alias("reach"))
    # a seed meets only places of its own or the next blocks of `reach` words
    block = lambda p: F.floor(F.col(p) / F.greatest("reach", F.lit(1)))
    seeds = seeds.select("*", F.explode(F.array(*[block("seed") + k for k in (-1, 0, 1)])).alias("block"))
    other = index.join(small(rest.join(rare.select("item", reach.alias("reach")), "item")), "term").select("doc_id", "item", "pos", "k", "terms", block("pos").alias("block"))
    near = seeds.join(other, ["doc_id", "item", "block"]).where("abs(pos - seed) <= reach")
    best = near.groupBy("doc_id", "item", "seed", "reach", "terms", "k").agg(F.min_by("pos", F.struct(F.abs(F.col("pos") - F.col("seed")), "pos")).alias("pos"))
    g = best.groupBy("doc_id", "item", "seed", "reach", "terms").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return g.where("n = terms AND last - first <= reach").select("doc_id", "item", "first", "last")
