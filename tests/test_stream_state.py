"""Streams with state and sinks: against the table operators, brute force, and over restarts."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardspark.functions.text import masked_json
from wardspark.operators import gateway, replays
from wardspark.streaming import events, replay, sinks

START = dt.datetime(2024, 1, 1)
LOG = "user_id long, event_id long, ts timestamp"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


class Feed:
    """A folder that is filled batch by batch, and a stream that is run to its end after each."""

    def __init__(self, spark, folder, schema, build, start):
        self.spark, self.folder, self.schema, self.build, self.start = spark, str(folder), schema, build, start

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        s = self.build(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        self.start(s, self.folder)

    def state(self, name):
        return self.spark.read.format("statestore").option("path", f"{self.folder}/checkpoint").option("stateVarName", name).load()


def to_parquet(stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def batches(rows, sizes, disorder):
    """Rows in order of arrival, each at most ``disorder`` seconds behind the latest before it."""
    r = random.Random(4)
    late = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=r.random() * disorder))
    for n in sizes:
        yield late[:n]
        late = late[n:]
    yield late


def test_limiter_over_batches_that_are_late_and_out_of_order(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3]), k, at(r.randint(0, 3000))) for k in range(400)]
    f = Feed(spark, tmp_path, LOG, lambda s: events.rate_limited(s, 3, 60, "10 minutes"), to_parquet)
    for b in batches(rows, [150, 100, 50], 590):
        f.put(b)
        f.run()  # a new query each time, from its checkpoint
    f.put([(9, 10_000, at(90_000))])
    f.run()
    got = sorted((x.event_id, x.accepted) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == accepted(rows, 3, 60)
    b = spark.createDataFrame(rows, "client long, event_id long, ts timestamp")
    assert got == sorted((x.event_id, x.accepted) for x in gateway.rate_limit(b, 3, 60).collect())
    # the far event has set off every other timer: only its own key is left waiting
    assert [x.key[0] for x in f.state("waiting").collect()] == [9] and f.state("held").count() == 0


def accepted(rows, most, seconds):
    out = []
    for client in {x[0] for x in rows}:
        log = []
        for t, i in sorted((x[2], x[1]) for x in rows if x[0] == client):
            ok = sum(u > t - dt.timedelta(seconds=seconds) for u in log) < most
            log += [t] * ok
            out.append((i, ok))
    return sorted(out)


def test_limiter_batch(spark):
    rows = [(c, k * 10 + (c or 0), at(k % 7) if k else None) for c in (1, 2, None) for k in range(30)]
    got = gateway.rate_limit(spark.createDataFrame(rows, "client long, event_id long, ts timestamp").repartition(3), 2, 3)
    assert sorted((x.event_id, x.accepted) for x in got.collect()) == accepted([r for r in rows if r[2]], 2, 3)
    assert gateway.rate_limit(spark.createDataFrame([], "client long, event_id long, ts timestamp"), 2, 3).count() == 0


JOB = "job_id string, seq long, ts timestamp, asked string, line string"


def test_jobs_as_the_fold_of_their_log(spark, tmp_path):
    r = random.Random(3)
    good = ["queued", "running", "pending_pr", "completed"]
    rows = [(f"j{j}", j * 10 + k, at(j * 40 + k * 30 + r.randint(0, 9)), x, r.choice([None, f"line {k}"])) for j in range(30) for k, x in enumerate(good)]
    rows += [(f"j{r.randint(0, 29)}", 1000 + k, at(r.randint(0, 1500)), r.choice([*good, "failed", "odd", None]), r.choice([None, "more"])) for k in range(150)]
    begun = spark.createDataFrame([("j3", "pending_pr", 5, None, 2), ("j4", "failed", None, 7, 0), ("old", "running", 1, None, 1)], "job_id string, status string, started_at long, finished_at long, lines long")
    rows.append(("old", 5000, at(100), "completed", None))
    f = Feed(spark, tmp_path, JOB, lambda s: replay.job_steps(s, "10 minutes", begun), to_parquet)
    for b in batches(rows, [100, 60], 590):
        f.put(b)
        f.run()
    f.put([("end", 9999, at(5_000_000), "queued", None)])
    f.run()
    got = sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").select(*COLUMNS).collect())
    log = spark.createDataFrame(rows, JOB).repartition(3)
    assert got == sorted(tuple(x) for x in replays.job_steps(log, begun).select(*COLUMNS).collect())
    key = lambda x: (x[0], x[1])
    assert sorted(got, key=key) == sorted(fold(rows), key=key)
    assert any(not x[4] for x in got) and any(x[5] == "completed" for x in got)


COLUMNS = ["job_id", "seq", "before", "asked", "legal", "status", "lines"]


def fold(rows):
    """The rules over each job's log."""
    allowed = {(None, "queued"), ("queued", "running"), ("queued", "failed"), ("running", "pending_pr"), ("running", "completed"), ("running", "failed"), ("pending_pr", "completed"), ("pending_pr", "failed")}
    jobs = {"j3": ("pending_pr", 2), "j4": ("failed", 0), "old": ("running", 1)}
    dead = {"j4"}  # ended more than a week before all else
    for job, seq, _, asked, line in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        before, lines = (None, 0) if job in dead else jobs.get(job, (None, 0))
        legal = before is not None if asked is None else (before, asked) in allowed
        now, n = (asked if legal and asked else before), lines + (legal and line is not None)
        jobs[job] = now, n
        dead.discard(job)
        yield job, seq, before, asked, legal, now, n


def test_sink_writes_each_event_once(spark, tmp_path, monkeypatch):
    """A batch that breaks off half-written is handed over again after the restart; the rest follows."""
    schema = "event_id long, ts timestamp, props string"
    path, bad = f"{tmp_path}/table", f"{tmp_path}/bad"
    rows = [(k, at(k), json.dumps({"token": f"value-{k}", "n": k})) for k in range(40)] + [(None, at(1), "{}"), (50, None, "{}"), (51, at(1), "{"), (52, at(2), None)]

    def feed(send=None):
        return Feed(spark, tmp_path, schema, lambda s: s, lambda s, folder: sinks.run(s, sinks.EventSink(path, bad, send=send), f"{folder}/checkpoint"))

    f = feed()
    f.put(rows[:20])
    f.run()
    f.put(rows[20:])
    with monkeypatch.context() as m:
        m.setattr(sinks.shared, "touch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            f.run()
    assert spark.read.parquet(path).count() > 20  # written, not yet marked: readers of the table don't see it
    assert sinks.table(spark, path).count() == 20
    f.run()
    f.run()
    got = sinks.table(spark, path)
    assert sorted(r.event_id for r in got.collect()) == [*range(40), 52]
    assert got.where("event_id = 7").first().props == '{"token": "***REDACTED***", "n": 7}'
    assert got.where("event_id = 39").first().props == '{"token": "valu***e-39", "n": 39}'
    assert sorted(r.failure for r in sinks.failed(spark, path, bad).collect()) == ["arguments are not JSON", "no id", "no time"]
    sinks.EventSink(path, bad)(spark.createDataFrame(rows[:5], schema), 0)  # a batch that is marked stays as it is
    assert sinks.table(spark, path).count() == 41


def test_sink_sends_once_and_keeps_what_failed(spark, tmp_path):
    sent = tmp_path / "sent"
    sent.mkdir()

    def send(payloads: pd.Series) -> pd.Series:
        out = []
        for p in payloads:
            e = json.loads(p)
            assert "very-secret" not in p
            with open(sent / str(e["event_id"]), "a") as fh:
                fh.write("x")
            out.append("refused" if e["event_id"] % 5 == 0 else None)
        return pd.Series(out, dtype=object)

    d = spark.createDataFrame([(k, at(k), '{"a": {"Authorization": "very-secret-thing"}}') for k in range(20)], "event_id long, ts timestamp, props string")
    sink = sinks.EventSink(f"{tmp_path}/t", f"{tmp_path}/f", send=send)
    broken = sinks.EventSink(f"{tmp_path}/t", f"{tmp_path}/f", send=send)
    broken._store = lambda *a: (_ for _ in ()).throw(OSError("disk"))
    with pytest.raises(OSError):
        broken(d, 0)
    sink(d, 0)
    assert {p.read_text() for p in sent.iterdir()} == {"x"} and len(list(sent.iterdir())) == 20
    failed = sinks.failed(spark, f"{tmp_path}/t", f"{tmp_path}/f")
    assert sorted(r.event_id for r in failed.collect()) == [0, 5, 10, 15] and failed.first().props.count("very-secret") == 1
    again = sinks.EventSink(f"{tmp_path}/t", f"{tmp_path}/f2", name="again")
    again(failed.drop("failure"), 0)
    assert sinks.table(spark, f"{tmp_path}/t", "again").count() == 4 and sinks.table(spark, f"{tmp_path}/t").count() == 16


def redacted(value, secret=False):
    if isinstance(value, dict):
        return {k: redacted(v, any(x in k.lower() for x in ("token", "secret", "authorization", "apikey"))) for k, v in value.items()}
    if secret and isinstance(value, str):
        return "***REDACTED***" if len(value) < 8 else f"{value[:4]}***{value[-4:]}"
    return value


def test_masked_json(spark):
    cases = [
        {"token": "abcdefgh"}, {"TOKEN": "abcdefg", "n": 1}, {"x": {"my_secret_key": "long enough value", "y": {"apiKey": ""}}}, {"token": 5, "secret": None, "authorization": ["abcdefghij"]},
        {"note": 'say "token": "abcdefghij" aloud'}, {"a\"token": "q\"uo\\te\n" * 3}, {"token": "é" * 9}, {"tokens": {"a": "plain value here"}}, {}, {"k": "token"},
    ]
    d = spark.createDataFrame([(k, json.dumps(c, ensure_ascii=False)) for k, c in enumerate(cases)], "k int, j string").select("k", masked_json(F.col("j")).alias("j"))
    got = {r.k: r.j for r in d.collect()}
    for k, c in enumerate(cases):
        assert json.loads(got[k]) == redacted(c), c
    assert d.where(masked_json(F.col("j")) != F.col("j")).count() == 0
