"""Temperature scaling: one number that makes the logits of a model say how sure it is.

The loss of scaled logits is convex in 1 / temperature, so its minimum is where the derivative changes its sign. Each round
is one pass that brings two sums to the driver, the derivative and the one after it; Newton's step is taken where it stays
between the ends that are known to lie on either side, else their middle.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions.shared import delete, new_folder


class Fit(NamedTuple):
    temperature: float
    loss: float | None
    rows: int
    rounds: int


def loss(logit: Column, label: Column) -> Column:
    """Cross-entropy of a logit, without overflow."""
    return F.greatest(logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit))) - logit * label


def fit_temperature(rows: DataFrame, logit: str, label: str, least: float = 1e-3, most: float = 1e3, close: float = 1e-10) -> Fit:
    """Rows whose logit is null or not finite, or whose label is neither 0 nor 1, don't count; without rows it is 1. The
    temperature stays between least and most: least if more certainty would always be better (labels that the logits
    part), most if none would be. The rows are staged, so what makes them runs once."""
    spark = rows.sparkSession
    path = new_folder(spark, "logits")
    d = rows.select(F.col(logit).cast("double").alias("x"), F.col(label).cast("double").alias("y"))
    d.where("y IN (0, 1) AND abs(x) < double('infinity')").write.parquet(path)
    d = spark.read.parquet(path)
    z = lambda b: F.col("x") * F.lit(b)

    def slopes(b: float) -> tuple[float, float]:
        p = 1 / (1 + F.exp(-z(b)))
        r = d.agg(F.sum(F.col("x") * (p - F.col("y"))), F.sum(F.col("x") * F.col("x") * p * (1 - p))).first()
        return r[0], r[1]

    try:
        n = d.count()
        if not n:
            return Fit(1.0, None, 0, 0)
        low, high, rounds = 1 / most, 1 / least, 2
        if slopes(low)[0] >= 0:
            b = low
        elif slopes(high)[0] <= 0:
            b = high
        else:
            b = 1.0
            while high - low > close * high:
                slope, curve = slopes(b)
                rounds += 1
                if slope == 0:
                    break
                low, high = (b, high) if slope < 0 else (low, b)
                step = b - slope / curve if curve > 0 else math.nan
                if abs(step - b) <= close * b:
                    b = step
                    break
                b = step if low < step < high else math.sqrt(low * high)
        return Fit(1 / b, d.agg(F.avg(loss(z(b), F.col("y")))).first()[0], n, rounds)
    finally:
        delete(spark, path)
