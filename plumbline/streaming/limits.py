"""Rates, lockouts and idle sessions per key."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


# ---- batch form: trailing windows ------------------------------------------------------------

def _chunked(events: DataFrame, ts: str, seconds: float, chunk: float) -> DataFrame:
    """Copy the last ``seconds`` of every time chunk into the next one.

    A trailing window then needs only its own chunk, so one busy key is spread over the chunks.  Every
    row appears once as itself (``_own``) and at most once as context.
    """
    if chunk < seconds:
        raise ValueError("a chunk must be at least as long as the window")
    t = F.col(ts).cast("timestamp").cast("double")
    own = F.floor(t / chunk)
    both = F.array(F.struct(own.alias("_chunk"), F.lit(True).alias("_own")),
                   F.struct((own + 1).alias("_chunk"), F.lit(False).alias("_own")))
    kept = F.filter(both, lambda c: c["_own"] | (t >= c["_chunk"] * chunk - seconds))
    return events.withColumn("_t", t).select("*", F.inline(kept))


def trailing_count(
    events: DataFrame, keys: Sequence[str], ts: str, seconds: float, limit: int,
    chunk: float | None = None,
) -> DataFrame:
    """Offered rate: events of the same key in the last ``seconds`` (this one included), and whether they
    exceed ``limit``.  Every event counts; ``limiter_decisions`` is the limiter itself, where refused events use no slot.

    ``retry_after``: seconds until the oldest of them has left the window.
    """
    chunk = chunk or max(seconds * 16, 3600.0)
    frame = _chunked(events, ts, seconds, chunk)
    # microseconds keep the range exact; the lower end is open, as an event at the edge has left
    frame = frame.withColumn("_us", (F.col("_t") * 1_000_000).cast("long"))
    span = Window.partitionBy(*keys, "_chunk").orderBy("_us").rangeBetween(
        -int(seconds * 1_000_000) + 1, 0)
    counted = frame.withColumns({
        "n_in_window": F.count(F.lit(1)).over(span), "_oldest": F.min("_us").over(span)})
    over = F.col("n_in_window") > limit
    wait = F.greatest(F.lit(1), F.floor(
        seconds - (F.col("_us") - F.col("_oldest")) / 1_000_000) + 1).cast("long")
    return counted.where("_own").withColumns(
        {"over": over, "retry_after": F.when(over, wait)}
    ).drop("_t", "_us", "_chunk", "_own", "_oldest")


def lockouts(
    events: DataFrame, keys: Sequence[str], ts: str, failed: Column, succeeded: Column,
    max_fails: int = 5, seconds: float = 900.0, chunk: float | None = None,
) -> DataFrame:
    """Failures since the last success within ``seconds``, and whether the key is locked.

    Failures older than the window do not count, so the window also bounds how far back a success can
    matter.
    """
    chunk = chunk or max(seconds * 8, 3600.0)
    frame = _chunked(
        events.withColumns({"_fail": failed.cast("int"), "_ok": succeeded.cast("int")}), ts, seconds, chunk)
    frame = frame.withColumn("_us", (F.col("_t") * 1_000_000).cast("long"))
    order = Window.partitionBy(*keys, "_chunk").orderBy("_us").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    frame = frame.withColumn("_run", F.sum("_ok").over(order))
    span = Window.partitionBy(*keys, "_chunk", "_run").orderBy("_us").rangeBetween(
        -int(seconds * 1_000_000), 0)
    out = frame.withColumn("n_fails", F.sum("_fail").over(span)).where("_own")
    return out.withColumn("locked", F.col("n_fails") >= max_fails).drop(
        "_t", "_us", "_chunk", "_own", "_fail", "_ok", "_run")


# ---- stream and batch alike ------------------------------------------------------------------

def sliding_rate(
    events: DataFrame, keys: Sequence[str], ts: str, width: str = "60 seconds",
    slide: str = "10 seconds", limit: int = 60, delay: str | None = None,
) -> DataFrame:
    """Counts per key and sliding window; give ``delay`` on a stream."""
    frame = events.withWatermark(ts, delay) if delay else events
    out = frame.groupBy(*keys, F.window(ts, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n",
                      (F.col("n") > limit).alias("over"))


def idle_sessions(
    events: DataFrame, keys: Sequence[str], ts: str, idle: str = "4 hours", delay: str | None = None
) -> DataFrame:
    """Activity of a key until it is idle; give ``delay`` on a stream."""
    frame = events.withWatermark(ts, delay) if delay else events
    out = frame.groupBy(*keys, F.session_window(ts, idle).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


# ---- the limiter itself ----------------------------------------------------------------------

def _decide(stamps: Iterable[int], allowed: deque[int], window_us: int, limit: int) -> Iterator[tuple[bool, int]]:
    """Decision and wait for each time in order; ``allowed`` holds the admitted times inside the window, ``limit`` at most."""
    for now in stamps:
        while allowed and allowed[0] <= now - window_us:
            allowed.popleft()
        if len(allowed) >= limit:
            yield False, max(1, (window_us - (now - allowed[0])) // 1_000_000 + 1) if allowed else 1
        else:
            allowed.append(now)
            yield True, 0


def limiter_decisions(
    events: DataFrame, keys: Sequence[str], ts: str, seconds: float, limit: int, order: Sequence[str] = (),
) -> DataFrame:
    """Batch form of the limiter: ``allowed`` and ``retry_after`` for every event; refused events use no slot.

    Where a key pauses for at least the window, its state is empty, so the stretches between pauses are decided
    independently, each as a sorted run with ``limit`` numbers of state.  ``order`` breaks ties of time.  A
    stretch that never pauses is one run, read batch by batch.
    """
    window_us = int(seconds * 1_000_000)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    by = Window.partitionBy(*keys).orderBy("_us", *order)
    frame = events.withColumn("_us", us)
    fresh = F.coalesce(F.col("_us") - F.lag("_us").over(by) >= window_us, F.lit(True))
    stretches = frame.withColumn("_fresh", fresh.cast("int")).withColumn("_stretch", F.sum("_fresh").over(
        by.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
    # all rows of a stretch are neighbours in a sorted partition; state is one stretch's
    placed = stretches.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "_us", *order)
    schema = events.select("*").schema.add("allowed", "boolean").add("retry_after", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, allowed = None, deque()
        for pdf in batches:
            out = []
            for *key, now in pdf[[*keys, "_stretch", "_us"]].itertuples(index=False):
                if key != last:
                    last, allowed = key, deque()
                out.extend(_decide([now], allowed, window_us, limit))
            yield pdf.drop(columns=["_stretch", "_us"]).assign(
                allowed=[a for a, _ in out], retry_after=[w for _, w in out])

    return placed.select(*events.columns, "_stretch", "_us").mapInPandas(run, schema)


# ---- exact limiter on a stream ---------------------------------------------------------------

def exact_limiter(
    events: DataFrame, key: str, ts: str, seconds: float, limit: int, delay: str = "1 minute",
) -> DataFrame:
    """Sliding-window limiter: refused events do not use up the window.

    State per key is the list of allowed times inside the window, never more than ``limit`` of them; an
    idle key's state expires with the watermark.
    """
    schema = f"{key} string, {ts} timestamp, allowed boolean, retry_after long"
    window_us = int(seconds * 1_000_000)

    def step(group_key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        allowed = deque(state.get[0]) if state.exists else deque()
        for pdf in batches:
            stamps = pdf[ts].sort_values()
            decided = _decide((x.value // 1000 for x in stamps), allowed, window_us, limit)
            rows = [(group_key[0], stamp, *got) for stamp, got in zip(stamps, decided)]
            yield pd.DataFrame(rows, columns=[key, ts, "allowed", "retry_after"])
        allowed = list(allowed)
        state.update((allowed,))
        if allowed:
            after = allowed[-1] // 1000 + int(seconds * 1000)
            state.setTimeoutTimestamp(max(after, state.getCurrentWatermarkMs() + 1))

    keyed = events.select(F.col(key).cast("string").alias(key), ts).withWatermark(ts, delay)
    return keyed.groupBy(key).applyInPandasWithState(
        step, schema, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def exact_lockout(
    events: DataFrame, key: str, ts: str, outcome: str, max_fails: int = 5, seconds: float = 900.0,
    delay: str = "1 minute",
) -> DataFrame:
    """Lockout on a stream: ``outcome`` is ``fail`` or ``ok``; a success clears the failures."""
    schema = f"{key} string, {ts} timestamp, {outcome} string, n_fails long, locked boolean"
    window_us = int(seconds * 1_000_000)

    def step(group_key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fails = deque(state.get[0]) if state.exists else deque()
        for pdf in batches:
            rows = []
            for stamp, result in pdf.sort_values(ts)[[ts, outcome]].itertuples(index=False):
                now = stamp.value // 1000
                while fails and now - fails[0] > window_us:
                    fails.popleft()
                if result == "ok":
                    fails.clear()
                elif result == "fail":
                    fails.append(now)
                rows.append((group_key[0], stamp, result, len(fails), len(fails) >= max_fails))
            yield pd.DataFrame(rows, columns=[key, ts, outcome, "n_fails", "locked"])
        fails = list(fails)
        state.update((fails,))
        if fails:
            after = fails[-1] // 1000 + int(seconds * 1000)
            state.setTimeoutTimestamp(max(after, state.getCurrentWatermarkMs() + 1))

    keyed = events.select(F.col(key).cast("string").alias(key), ts, outcome).withWatermark(ts, delay)
    return keyed.groupBy(key).applyInPandasWithState(
        step, schema, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
