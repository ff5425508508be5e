"""Streams decided in event time: equal to the batch forms whatever the order of arrival, through a restart, and without state of idle keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import limits as lm
from plumbline.streaming import ordered as od

START = dt.datetime(2024, 1, 1)
SCHEMA = "i long, k string, ts timestamp, o string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def folder(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    od.rocksdb_state(spark)
    yield tmp_path
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def drive(spark, folder, batches, job):
    """One file a micro-batch; stopped and started again from its checkpoint after each call."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    frame = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = (job(frame).writeStream.format("parquet").option("checkpointLocation", str(folder / "ck"))
             .trigger(availableNow=True).start(str(folder / "out")))
    query.awaitTermination()
    return spark.read.parquet(str(folder / "out")).collect()


def events(seed):
    """Events of three keys, a busy one among them, ties of time, arrivals up to 40 seconds late."""
    rnd = random.Random(seed)
    rows = [(i, "aab"[i % 3], at(rnd.randrange(600)), rnd.choice(["fail", "fail", "ok", "other"])) for i in range(150)]
    rows.append((150, None, at(300), "fail"))
    arrived = sorted(rows, key=lambda r: (r[2] - START).total_seconds() + rnd.uniform(0, 40))
    return rows, [arrived[:60], arrived[60:110], arrived[110:]]


END = [(999, "z", at(100_000), "other")]


def test_limiter_equals_batch_through_a_restart(spark, folder, frame):
    rows, parts = events(3)
    job = lambda d: od.ordered_limiter(d, "k", "ts", "i", 60, 4, "1 minute")
    drive(spark, folder, parts[:2], job)
    late = [(998, "a", at(1), "fail")]
    out = drive(spark, folder, [parts[2], END, [(1000, "z", at(100_001), "other")], late], job)
    batch = lm.limiter_decisions(frame(rows, SCHEMA), ["k"], "ts", 60, 4, ["i"])
    want = {(r["i"], r["k"], r["ts"], r["allowed"], r["retry_after"]) for r in batch.collect()}
    got = [(r["i"], r["k"], r["ts"], r["allowed"], r["retry_after"]) for r in out]
    assert len(got) == len(rows) and set(got) == want
    assert {r[3] for r in got} == {True, False}


def test_lockout_equals_batch_and_idle_keys_leave_no_state(spark, folder, frame):
    rows, parts = events(5)
    rows = [(i, k, at(i * 4) if k else ts, o) for i, k, ts, o in rows]  # the batch form counts ties together: times differ here
    parts = [rows[:50], rows[50:], END, [(1000, "z", at(200_000), "other")]]
    out = drive(spark, folder, parts, lambda d: od.ordered_lockout(d, "k", "ts", "i", "o", 3, 90.0, "1 minute"))
    batch = lm.lockouts(frame(rows, SCHEMA), ["k"], "ts", F.col("o") == "fail", F.col("o") == "ok", 3, 90.0)
    want = {r["i"]: (r["n_fails"], r["locked"]) for r in batch.collect()}
    got = {r["i"]: (r["n_fails"], r["locked"]) for r in out if r["i"] < 999}
    assert got == want and any(locked for _, locked in got.values())
    left = (spark.read.format("statestore").option("stateVarName", "counted").option("path", str(folder / "ck")).load())
    assert left.count() == 0
    waiting = (spark.read.format("statestore").option("stateVarName", "waiting").option("path", str(folder / "ck")).load())
    assert {r[0][0] for r in waiting.select("key").collect()} == {"z"}
