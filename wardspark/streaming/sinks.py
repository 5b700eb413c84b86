"""A sink for events that takes each batch once.

``foreachBatch`` may hand over a batch again after a failure. A batch is worked on in three steps, each of which can be
done again: its outcomes (masked, checked, sent) are written under its id and not made anew once they are there complete;
good rows replace the partition of the batch in the table, failed ones that in the second sink; an empty file marks it as
done. A batch with that mark is left alone, and rows of a half-written one are replaced, so readers see each event once,
as long as they read through ``table``, which takes marked batches only.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.functions import shared
from wardspark.functions.text import masked_json


def fault(id: str, ts: str, payload: str) -> Column:
    """Why a row is no event; null if it is one."""
    bad = F.col(payload).isNotNull() & F.try_parse_json(F.col(payload)).isNull()
    return F.when(F.col(id).isNull(), "no id").when(F.col(ts).isNull(), "no time").when(bad, "arguments are not JSON")


class EventSink:
    """For ``writeStream.foreachBatch``. Rows have event_id, ts and props (JSON), and whatever else.

    send: takes a series of whole events as JSON and returns for each null or what went wrong; null: dry run, nothing is
    sent. It may be called again for rows of a task that is run again, as any remote effect of a task. Rows that failed
    stay in the second sink as they came, with ``failure``; to try again, give them to a sink of another name."""

    def __init__(self, path: str, failures: str, name: str = "events", send: Callable[[pd.Series], pd.Series] | None = None):
        self.path, self.failures, self.name, self.send = path, failures, name, send

    def mark(self, batch_id: int) -> str:
        return f"{self.path}/_done/{self.name}/{batch_id}"

    def outcomes(self, batch: DataFrame) -> DataFrame:
        """The rows with props masked, and ``failure``; failed rows keep their props as they came."""
        masked = batch.select("*", fault("event_id", "ts", "props").alias("failure")).withColumn("masked", masked_json(F.col("props")))
        if self.send is not None:
            whole = F.to_json(F.struct(*[F.col("masked").alias("props") if c == "props" else F.col(c) for c in batch.columns]))
            sent = F.pandas_udf(self.send, "string")(whole)
            masked = masked.withColumn("failure", F.coalesce("failure", sent))
        return masked.withColumn("props", F.when(F.col("failure").isNull(), F.col("masked")).otherwise(F.col("props"))).drop("masked")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if shared.exists(spark, self.mark(batch_id)):
            return
        here = f"{self.path}/_outcomes/{self.name}/{batch_id}"
        if not shared.exists(spark, f"{here}/_SUCCESS"):
            self.outcomes(batch).write.mode("overwrite").parquet(here)
        found = spark.read.parquet(here)
        part = f"stream={self.name}/batch={batch_id}"
        self._store(found.where("failure IS NULL").drop("failure"), f"{self.path}/{part}")
        self._store(found.where("failure IS NOT NULL"), f"{self.failures}/{part}")
        shared.touch(spark, self.mark(batch_id))
        shared.delete(spark, here)

    def _store(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").parquet(path)


def table(spark: SparkSession, path: str, name: str = "events") -> DataFrame:
    """All rows of batches that are done. path: of the events or of the failures, whose marks lie with the events
    (``marks``)."""
    return _marked(spark, path, path, name)


def failed(spark: SparkSession, path: str, failures: str, name: str = "events") -> DataFrame:
    return _marked(spark, failures, path, name)


def _marked(spark: SparkSession, path: str, marks: str, name: str) -> DataFrame:
    done = shared.names(spark, f"{marks}/_done/{name}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/stream={name}/batch={b}" for b in done]).drop("stream", "batch")


def run(stream: DataFrame, sink: EventSink, checkpoint: str) -> None:
    """Everything there is by now, from where the checkpoint stands."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
