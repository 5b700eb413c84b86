"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table, never by a local checkpoint: a lost executor then costs its own tasks only.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wardspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/wardspark/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    out._staged = path
    return out


def done(*tables: DataFrame | None) -> None:
    """Delete what ``staged`` wrote for these; nothing may read them any more."""
    for t in tables:
        path = getattr(t, "_staged", None)
        if path in _written:
            dropped(path, _written.pop(path))


def dropped(path: str, spark: SparkSession) -> None:
    """Delete a table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            if spark.sparkContext._jsc is not None:
                dropped(path, spark)
        except Exception:  # the session may be gone already
            return


#: Rows of a batch that goes to Python: whole texts, some of them long, and a few batches are in memory at a time.
BATCH_ROWS = 1000


def texts(docs: DataFrame) -> DataFrame:
    """docs, to be handed to Python in small batches (a setting of the session, lowered where it is larger; plans read
    it when they run, so it stays)."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
