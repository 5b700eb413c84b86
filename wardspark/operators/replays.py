"""Steps that depend on all steps before: logs of a key's events, replayed in the order of their times.

A fold says what one event does to a key's state. ``replayed`` runs it over a table, one sorted partition after the other,
with one state in memory at a time; ``wardspark.streaming.replay`` runs the same fold over a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a batch that leaves Python.
ROWS = 10_000


class Limiter:
    """An event passes if fewer than ``most`` of its key passed within the window up to it; what is turned away doesn't
    count. The state is the times of those that passed and still count, at most ``most``."""

    reads: list[str] = []
    state = "log array<bigint>"
    gives = "accepted boolean"

    def __init__(self, most: int, seconds: int):
        self.most, self.window = most, seconds * 1_000_000

    def step(self, state: tuple | None, micros: int) -> tuple[tuple, tuple]:
        log = [t for t in state[0] if t > micros - self.window] if state else []
        passes = len(log) < self.most
        return (log + [micros] if passes else log,), (passes,)

    def until(self, state: tuple) -> int | None:
        """From when on no event can see this state any more; None: that time doesn't come."""
        return state[0][-1] + self.window if state[0] else 0


# fixed values: the steps that a job's status may take, from none at first, and those it ends in
STEPS = {None: ["queued"], "queued": ["running", "failed"], "running": ["pending_pr", "completed", "failed"], "pending_pr": ["completed", "failed"], "completed": [], "failed": []}
STARTED, FINISHED = ("running", "pending_pr"), ("completed", "failed")


class Jobs:
    """A job's status, as far as its steps are allowed; lines of its log are counted. What isn't allowed changes nothing
    and is given out as such. A job that has ended is forgotten after ``kept`` seconds."""

    reads = ["asked", "line"]
    state = "status string, started_at bigint, finished_at bigint, lines bigint"
    gives = "before string, asked string, legal boolean, status string, started_at bigint, finished_at bigint, lines bigint"

    def __init__(self, steps: dict | None = None, kept: int = 7 * 86400):
        self.steps, self.kept = steps or STEPS, kept * 1_000_000

    def step(self, state: tuple | None, micros: int, asked: str | None, line: str | None) -> tuple[tuple | None, tuple]:
        before, started, finished, lines = state or (None, None, None, 0)
        legal = before is not None if asked is None else asked in self.steps.get(before, ())
        now = before
        if legal and asked is not None:
            now = asked
            started = micros if now in STARTED else started
            finished = micros if now in FINISHED else finished
        if legal and line is not None:
            lines += 1
        state = None if now is None else (now, started, finished, lines)
        return state, (before, asked, legal, now, started, finished, lines)

    def until(self, state: tuple) -> int | None:
        return state[2] + self.kept if state[2] is not None and not self.steps.get(state[0]) else None


def schemas(key: str, fold) -> tuple[StructType, StructType]:
    """Of the rows that come out, and of a key's first state."""
    return StructType.fromDDL(f"{key}, seq bigint, {fold.gives}"), StructType.fromDDL(f"{key}, {fold.state}")


def replayed(rows: DataFrame, fold, initial: DataFrame | None = None) -> DataFrame:
    """rows: key, micros, seq and what the fold reads; key, seq and what it gives come out, a row for each. Events without
    a time take no part; of one time the smaller seq comes first. initial: key and the fold's state, where a key has one
    already. A key's events pass through one task, in order; its state alone is kept."""
    kind = rows.schema["key"].dataType.simpleString()
    out, first = schemas(f"key {kind}", fold)
    fields = first.names[1:]
    d = rows.where("micros IS NOT NULL").select("key", "micros", "seq", *fold.reads)
    if initial is not None:
        d = d.unionByName(initial.select("key", F.struct(*fields).alias("first")), allowMissingColumns=True)
    else:
        d = d.withColumn("first", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, state, found = None, False, None, []
        forgotten: int | None = None
        types = [f.type for f in _arrow(out)]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], out.names)

        for b in batches:
            for key, micros, seq, begun, *read in zip(*[b.column(k).to_pylist() for k in range(b.num_columns)], strict=True):
                if not seen or key != own:
                    own, seen, state, forgotten = key, True, None, None
                if begun is not None:
                    state = tuple(begun[f] for f in fields)
                else:
                    if forgotten is not None and micros >= forgotten:
                        state = None
                    state, given = fold.step(state, micros, *read)
                    found.append((key, seq, *given))
                forgotten = fold.until(state) if state is not None else None
                if len(found) >= ROWS:
                    yield batch()
                    found = []
        if found:
            yield batch()

    d = d.repartition("key").sortWithinPartitions(F.col("key"), F.asc_nulls_first("micros"), "seq")
    return d.select("key", "micros", "seq", "first", *fold.reads).mapInArrow(run, out)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def job_steps(log: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """log: job_id, ts, seq, asked (a status or null), line (or null). A row for each: what it asked for, whether it was
    allowed, and the job's state behind it, times as instants."""
    return jobs_out(replayed(jobs_in(log), Jobs(), None if initial is None else initial.withColumnRenamed("job_id", "key")))


def jobs_in(log: DataFrame) -> DataFrame:
    return log.select(F.col("job_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "seq", "asked", "line")


def jobs_out(found: DataFrame) -> DataFrame:
    at = lambda c: F.timestamp_micros(c).alias(c)
    return found.select(F.col("key").alias("job_id"), "seq", "before", "asked", "legal", "status", at("started_at"), at("finished_at"), "lines")
