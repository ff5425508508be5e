"""Stream jobs: each is driven by files and compared with its batch form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import ledger as lg
from plumbline.streaming import limits as lm
from plumbline.streaming import quality as wq

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def stream(spark, tmp_path):
    """Write batches as files, run a streaming job over them one file at a time, return its rows."""
    counter = iter(range(1000))

    def run(batches, schema, job, mode="append"):
        folder = str(tmp_path / f"in{next(counter)}")
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        name = f"out{next(counter)}"
        query = (job(frame).writeStream.outputMode(mode).format("memory").queryName(name)
                 .option("checkpointLocation", str(tmp_path / f"ck{name}")).start())
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.table(name).collect()

    return run


def test_exact_limiter(stream):
    rows = [("a", at(s)) for s in (0, 10, 20, 30, 65, 75)] + [("b", at(5))]
    out = stream([rows], "k string, ts timestamp", lambda d: lm.exact_limiter(d, "k", "ts", 60, 3))
    got = {(r["k"], r["ts"]): (r["allowed"], r["retry_after"]) for r in out}
    assert [got[("a", at(s))][0] for s in (0, 10, 20, 30, 65, 75)] == [True, True, True, False, True, True]
    assert got[("a", at(30))][1] == 31 and got[("b", at(5))] == (True, 0)


def test_exact_lockout_over_batches(stream):
    first = [("a", at(s), "fail") for s in (0, 1, 2, 3)]
    second = [("a", at(4), "fail"), ("a", at(5), "ok"), ("a", at(6), "fail"), ("b", at(6), "fail")]
    out = stream([first, second], "k string, ts timestamp, o string",
                 lambda d: lm.exact_lockout(d, "k", "ts", "o"))
    got = {(r["k"], r["ts"]): (r["n_fails"], r["locked"]) for r in out}
    assert got[("a", at(3))] == (4, False) and got[("a", at(4))] == (5, True)
    assert got[("a", at(6))] == (1, False) and got[("b", at(6))] == (1, False)


def test_batch_lockout_matches_brute_force(frame):
    import random
    rnd = random.Random(2)
    times = sorted(rnd.sample(range(40_000), 300))
    rows = [(i, "ab"[i % 3 == 0], at(t), rnd.choice(["fail", "fail", "ok", "other"])) for i, t in enumerate(times)]
    df = frame(rows, "i int, k string, ts timestamp, o string")
    out = lm.lockouts(df, ["k"], "ts", F.col("o") == "fail", F.col("o") == "ok", 3, 900.0, chunk=3600.0)
    got = {r["i"]: r["n_fails"] for r in out.collect()}
    assert len(got) == 300
    for i, k, ts, _ in rows:
        past = [r for r in rows if r[1] == k and r[2] <= ts]
        last_ok = max((r[2] for r in past if r[3] == "ok"), default=None)
        want = sum(r[3] == "fail" and (ts - r[2]).total_seconds() <= 900 and (last_ok is None or r[2] > last_ok)
                   for r in past)
        assert got[i] == want


def test_trailing_count_matches_brute_force(frame):
    times = [0, 30, 59, 60, 61, 3599, 3600, 3650, 3659, 7200]
    df = frame([(i, "k", at(t)) for i, t in enumerate(times)], "i int, k string, ts timestamp")
    got = {r["i"]: r["n_in_window"] for r in lm.trailing_count(df, ["k"], "ts", 60, 2).collect()}
    assert got == {i: sum(t - 60 < u <= t for u in times) for i, t in enumerate(times)}


def test_sliding_rate_and_sessions_on_a_stream(stream, frame):
    rows = [("a", at(s)) for s in (0, 5, 12, 100, 20_000)]
    schema = "k string, ts timestamp"
    job = lambda d, delay=None: lm.sliding_rate(d, ["k"], "ts", "60 seconds", "10 seconds", 2, delay)
    streamed = {tuple(r) for r in stream([rows[:3], rows[3:], [("z", at(90_000))]], schema,
                                         lambda d: job(d, "10 seconds"))}
    batch = {tuple(r) for r in job(frame(rows, schema)).collect()}
    assert streamed == batch and any(r[4] for r in batch)
    sessions = lambda d, delay=None: lm.idle_sessions(d, ["k"], "ts", "4 hours", delay)
    streamed = {tuple(r) for r in stream([rows, [("z", at(200_000))]], schema, lambda d: sessions(d, "1 minute"))}
    assert streamed == {tuple(r) for r in sessions(frame(rows, schema)).collect()}


def test_windowed_quality_drops_late_rows(stream):
    schema = "ts timestamp, v double"
    on_time = [(at(s), 50.0 + s % 7) for s in range(0, 3000, 30)]
    later = [(at(9000), 1.0), (at(20_000), 1.0)]
    late = [(at(10), 999.0)]
    # rows are late against the watermark of the batch before the one that moved it
    out = stream([on_time, later, [(at(21_000), 1.0)], late], schema,
                 lambda d: wq.windowed_quality(d, "ts", "v", 0, 100, "1 hour", delay="10 minutes"))
    first = [r for r in out if r["start"] == START][0]
    assert first["n"] == len(on_time) and first["n_outside"] == 0


def test_window_issue_states(frame):
    rows = [(at(i), 7.0) for i in range(60)] + [(at(4000 + i), None if i % 2 else 5.0) for i in range(10)]
    out = wq.window_issues(wq.windowed_quality(frame(rows, "ts timestamp, v double"), "ts", "v", 0, 100))
    got = {(r["start"], r["check"]): r["state"] for r in out.collect()}
    assert got[(START, "constant")] == "flagged" and got[(START, "last_digit")] == "flagged"
    assert got[(at(3600), "missing")] == "flagged" and got[(at(3600), "last_digit")] == "abstained"


def ledger_rows():
    seen = lambda k, s, x="s": (k, at(s), "seen", x)
    return ([seen("a", i, f"s{i}") for i in range(7)] + [seen("b", 1), seen("b", 2)]
            + [seen("c", i) for i in range(3)] + [("c", at(9), "false_positive", None), ("c", at(10), "false_positive", None)]
            + [seen("d", 1), ("d", at(2), "false_positive", None), seen("d", 3), seen("d", 4), seen("d", 5)]
            + [seen("e", 1), seen("e", 2), ("e", at(3), "useful", None)])


def test_ledger_transitions(frame):
    df = frame(ledger_rows(), "key string, ts timestamp, action string, sample string")
    got = {r["key"]: r for r in lg.with_status(lg.aggregate_events(df)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "a": "confirmed", "b": "candidate", "c": "rejected", "d": "candidate", "e": "confirmed"}
    assert got["a"]["seen"] == 7 and len(got["a"]["samples"]) == 5
    issues = frame([("a", ["x"])], "category string, columns array<string>")
    assert lg.annotate(issues, lg.aggregate_events(df)).first()["muted"] is False


def test_ledger_stream_equals_batch_and_survives_replay(spark, frame, tmp_path):
    rows, schema = ledger_rows(), "key string, ts timestamp, action string, sample string"
    path = str(tmp_path / "ledger")
    write = lg.update(path)
    write(frame(rows[:9], schema), 0)
    write(frame(rows[9:], schema), 1)
    write(frame(rows[9:], schema), 1)  # the same micro-batch again
    columns = ["key", "seen", "false_pos", "useful", "status"]
    got = {tuple(r) for r in lg.with_status(lg.read(spark, path)).select(*columns).collect()}
    want = {tuple(r) for r in lg.with_status(lg.aggregate_events(frame(rows, schema))).select(*columns).collect()}
    assert got == want


def test_limiter_batch_equals_stream(stream, frame):
    import random
    rnd = random.Random(4)
    rows = [("abc"[k % 3], at(s)) for k, s in enumerate(sorted(rnd.sample(range(3000), 200)))]
    rows += [("d", at(s)) for s in (0, 10, 20, 30, 61)]
    out = stream([rows], "k string, ts timestamp", lambda d: lm.exact_limiter(d, "k", "ts", 60, 3))
    batch = lm.limiter_decisions(frame(rows, "k string, ts timestamp"), ["k"], "ts", 60, 3)
    pick = lambda rs: sorted((r["k"], r["ts"], r["allowed"], r["retry_after"]) for r in rs)
    got = pick(batch.collect())
    assert got == pick(out)
    assert [r[2] for r in got if r[0] == "d"] == [True, True, True, False, True]


def test_ledger_keeps_all_sources_and_the_latest_context(frame):
    rows = [("k", at(s), "seen", f"s{s:03d}", float(s), float(s + 1)) for s in range(100)]
    events = frame(rows, "key string, ts timestamp, action string, source string, low double, high double")
    early = F.col("ts") < at(50)
    got = lg.merge(lg.aggregate_events(events.where(early)), lg.aggregate_events(events.where(~early))).first()
    assert len(got["sources"]) == 100 and (got["context"]["low"], got["context"]["high"]) == (99.0, 100.0)
