"""Folds of ``wardspark.operators.replays`` over streams.

An event waits in its key's state until the watermark has passed it, as no earlier one can come then; so events that are
late or out of order, across batches too, give what the table operator gives. Each key has a timer for its first waiting
event, and one for when its state can't matter any more; then it is cleared. (Time to live exists for processing time
only, which would clear what event time still needs.) Spark drops events that come behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardspark.operators import replays

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Replay(StatefulProcessor):
    def __init__(self, fold, out: list[str], waiting: str, fields: list[str]):
        self.fold, self.out, self.schema, self.fields = fold, out, waiting, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.held = handle.getValueState("held", self.fold.state)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        values = [initialState[f].iloc[0] for f in self.fields]
        self._hold(tuple(None if pd.api.types.is_scalar(v) and pd.isna(v) else int(v) if isinstance(v, float) else v for v in values))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for r in rows:
            r = r[["micros", "seq", *self.fold.reads]].astype(object)
            self.waiting.appendList([tuple(x) for x in r.where(r.notna(), None).itertuples(index=False, name=None)])
            earliest = min(r.micros.min(), r.micros.min() if earliest is None else earliest)
        if earliest is not None:
            self._wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())
        due, later = sorted((x for x in rows if x[0] <= past), key=lambda x: x[:2]), [x for x in rows if x[0] > past]
        state, given = (self.held.get() if self.held.exists() else None), []
        if state is not None:
            state = tuple(list(v) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") else v for v in state)
        for micros, seq, *read in due:
            if state is not None and (until := self.fold.until(state)) is not None and micros >= until:
                state = None
            state, out = self.fold.step(state, int(micros), *read)
            given.append((key[0], seq, *out))
        if due:
            if later:
                self.waiting.put(later)
                self._wake(min(x[0] for x in later))
            else:
                self.waiting.clear()
        until = self.fold.until(state) if state is not None else None
        if state is None or until is not None and until <= past:
            self.held.clear()
        else:
            self._hold(state)
        if given:
            yield pd.DataFrame(given, columns=self.out).astype({c: "Int64" for c in self.out if c.endswith(("_at", "lines"))})

    def _hold(self, state: tuple) -> None:
        self.held.update(state)
        if (until := self.fold.until(state)) is not None:
            self._wake(until)

    def _wake(self, micros: int) -> None:
        """A timer that goes off once the watermark is past this time (timers have milliseconds)."""
        self.handle.registerTimer(int(micros) // 1000 + 1)

    def close(self) -> None:
        pass


def replayed(events: DataFrame, fold, late: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """events: a stream of key, ts, seq and what the fold reads; key, seq and what it gives come out once the watermark has
    passed an event. initial: a table of key and the fold's state. The session keeps state in RocksDB from here on."""
    _rocks(events.sparkSession)
    kind = events.schema["key"].dataType.simpleString()
    out, first = replays.schemas(f"key {kind}", fold)
    read = {f.name: f.dataType.simpleString() for f in events.schema}
    waiting = ", ".join(["micros bigint", "seq bigint", *[f"{c} {read[c]}" for c in fold.reads]])
    d = events.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("micros"), "seq", *fold.reads)
    begun = None if initial is None else initial.select(*first.names).groupBy("key")
    return d.groupBy("key").transformWithStateInPandas(Replay(fold, out.names, waiting, first.names[1:]), out, "append", "eventTime", begun)


def _rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def job_steps(log: DataFrame, late: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """As the table operator, over a stream of job_id, ts, seq, asked, line."""
    d = log.select(F.col("job_id").alias("key"), "ts", "seq", "asked", "line")
    return replays.jobs_out(replayed(d, replays.Jobs(), late, None if initial is None else initial.withColumnRenamed("job_id", "key")))
