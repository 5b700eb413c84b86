"""Classification metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are ranked in so many stretches of their range.
STRETCHES = 1000


def confusion(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """One row; labels other than 0 and 1 don't count."""
    d = df.select(label.alias("y"), predicted.alias("p")).where("y IN (0, 1)")
    n = lambda e: F.count_if(F.expr(e))
    c = d.agg(n("y = 1 AND p = 1").alias("tp"), n("y = 0 AND p = 1").alias("fp"), n("y = 1 AND p = 0").alias("fn"), n("y = 0 AND p = 0").alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.select("*", ratio(F.col("tp") + F.col("tn"), F.expr("tp + fp + fn + tn")).alias("accuracy"), ratio(F.col("tp"), F.expr("tp + fp")).alias("precision"), ratio(F.col("tp"), F.expr("tp + fn")).alias("recall"))
    return c.select("*", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def auroc(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """One row: the area under the curve by ranks, null with one class. Scores are counted per value first; the running
    count goes over distinct values, in stretches, so no task sorts all rows."""
    d = df.select(label.alias("y"), score.alias("s")).where("y IN (0, 1) AND s IS NOT NULL")
    values = d.groupBy("s").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n1"))
    ends = values.agg(F.min("s").cast("double").alias("lo"), F.max("s").cast("double").alias("hi"))
    stretch = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * STRETCHES)).otherwise(0)
    values = values.join(F.broadcast(ends)).withColumn("stretch", stretch).drop("lo", "hi")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = values.groupBy("stretch").agg(F.sum("n").alias("n")).select("stretch", before(Window.orderBy("stretch")).alias("ahead"))
    within = before(Window.partitionBy("stretch").orderBy("s"))
    ranked = values.withColumn("within", within).join(F.broadcast(ahead), "stretch").select("n", "n1", (F.col("ahead") + F.col("within") + (F.col("n") + 1) / 2).alias("rank"))
    t = ranked.agg(F.sum(F.col("n1") * F.col("rank")).alias("r"), F.sum("n1").cast("double").alias("a"), F.sum(F.col("n") - F.col("n1")).cast("double").alias("b"))
    return t.select(F.try_divide(F.col("r") - F.col("a") * (F.col("a") + 1) / 2, F.col("a") * F.col("b")).alias("auroc"))


def per_class(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support of single labels; 0 where undefined."""
    pairs = df.groupBy(label, predicted).agg(F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(F.struct(F.col(label).alias("class"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("told")), F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("told")))).alias("x")).select("x.*")
    c = each.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("told").alias("told"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return c.select("class", ratio(F.col("tp"), F.col("told")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("told") + F.col("support")).alias("f1"), "support")


def averages(classes: DataFrame) -> DataFrame:
    return classes.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"))


def label_set(scores: Column, classes: list[str], least: float = 0.5) -> Column:
    """The classes whose score (by place) is high enough."""
    each = F.transform(scores, lambda x, i: F.when(x >= least, F.element_at(F.array(*map(F.lit, classes)), i + 1)))
    return F.filter(each, lambda c: c.isNotNull())


def label_counts(df: DataFrame, label: str, predicted: str, classes: list[str]) -> DataFrame:
    """class, tp, fp, fn of label sets (arrays; null is empty, repeats count once), for each of the classes; other labels
    don't count. One pass: a row gives one small record for each class that it has on either side."""
    empty = F.array().cast("array<string>")
    y, p = F.coalesce(label, empty), F.coalesce(predicted, empty)
    known = F.array(*map(F.lit, classes)) if classes else empty
    each = df.select(F.explode(F.transform(F.array_intersect(F.array_union(y, p), known), lambda c: F.struct(c.alias("class"), F.array_contains(y, c).alias("y"), F.array_contains(p, c).alias("p")))).alias("x")).select("x.*")
    n = lambda e: F.count_if(F.expr(e))
    found = each.groupBy("class").agg(n("y AND p").alias("tp"), n("p AND NOT y").alias("fp"), n("y AND NOT p").alias("fn"))
    names = df.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(classes)], "class string")
    return names.join(found, "class", "left").na.fill(0)


def label_scores(counts: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support of each class; 0 where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(0.0))
    return counts.select("class", ratio("tp", "tp + fp").alias("precision"), ratio("tp", "tp + fn").alias("recall"), ratio("2 * tp", "2 * tp + fp + fn").alias("f1"), F.expr("tp + fn").alias("support"))


def label_averages(counts: DataFrame) -> DataFrame:
    """One row: macro_f1 over all classes, absent ones with 0, and micro_f1 over all their decisions."""
    f1 = F.coalesce(F.try_divide(F.expr("2 * tp"), F.expr("2 * tp + fp + fn")), F.lit(0.0))
    return counts.agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"), F.coalesce(F.try_divide(F.sum(F.expr("2 * tp")), F.sum(F.expr("2 * tp + fp + fn"))), F.lit(0.0)).alias("micro_f1"))


def weighted_average(scores: list[Column], weights: list[float]) -> Column:
    """The plain mean where the weights are no use."""
    total = sum(weights)
    if total <= 0:
        return sum(scores[1:], scores[0]) / len(scores)
    return sum((s * w for s, w in zip(scores[1:], weights[1:], strict=True)), scores[0] * weights[0]) / total
