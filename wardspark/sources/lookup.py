"""Tables laid out for lookups by key, and lookups that read little of them.

``by_range`` sorts rows by key over all files, with small row groups and Bloom filters: minima and maxima leave one row
group for a key in most cases, the filter leaves none where the key isn't there. ``by_bucket`` hashes rows to files, so a
lookup opens one file, and a join by key needs no shuffle of the table. Keys that many rows share are spread over files
by ``by_range``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions.shared import new_folder
from wardspark.functions.size import small

#: Bytes of a row group before compression, and distinct keys that its Bloom filter is made for.
GROUP_BYTES, GROUP_KEYS = 1 << 20, 20_000
#: Keys of a list that are looked up by their values; Parquet takes so many in one filter.
LISTED = 10


def by_range(rows: DataFrame, path: str, key: str, mode: str = "error") -> DataFrame:
    """Writes rows sorted by key; returns them as read back."""
    d = rows.repartitionByRange(key, F.xxhash64(*rows.columns)).sortWithinPartitions(key)
    w = d.write.mode(mode).option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", 2000)
    w.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", GROUP_KEYS).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def by_bucket(rows: DataFrame, key: str, buckets: int, name: str | None = None) -> DataFrame:
    """Writes rows into buckets by key, a table of this name (or one of its own, in the shared folder)."""
    spark = rows.sparkSession
    w = rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    if name is None:
        name = f"lookup_{uuid.uuid4().hex}"
        w = w.option("path", new_folder(spark, name))
    w.saveAsTable(name)
    return spark.table(name)


def get(table: DataFrame, key: str, *values) -> DataFrame:
    """The rows with one of these keys. The values are in the plan, so files, row groups or buckets are pruned by them."""
    found = None
    for k in range(0, len(values), LISTED):
        some = table.where(F.col(key).isin(*values[k : k + LISTED]))
        found = some if found is None else found.unionByName(some)
    return table.limit(0) if found is None else found


def get_all(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is among keys, once each: by broadcast where they are few; else a bucketed table is joined where
    it lies, and only the keys are shuffled."""
    return table.join(small(keys.select(key).where(F.col(key).isNotNull()).distinct()), key, "left_semi")


def scanned(df: DataFrame, metric: str = "numOutputRows") -> int:
    """A figure of the scans of a query that has no shuffle, once it has run: rows that they gave out, or ``numFiles``."""
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if p.children().isEmpty() and p.metrics().contains(metric):
            total += p.metrics().apply(metric).value()
        plans += [p.children().apply(k) for k in range(p.children().size())]
    return total


def job(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """The one job of this id under a path that ``by_range`` wrote by ``id``."""
    return get(spark.read.parquet(path), "id", job_id)
