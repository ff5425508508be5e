"""Limiter and lockout on a stream, decided in the order of event time.

Rows of a key wait in a list state until the watermark has passed them, whatever micro-batch brought them; an event-time timer then decides
them in order.  So the decisions equal those of the batch forms on the same events, and do not hang on how files arrive.  Rows already behind
the watermark are dropped by Spark; the last ``delay`` of a stream stays undecided until later events come.

State of a key: its waiting rows, and the times that still count.  A timer set to when the last of these leaves the window empties the key.
The state store is RocksDB, which holds lists on disk and appends to one without rewriting it; ``rocksdb_state`` sets it.

Cases: a null key is a key of its own; a row with a null time is never passed by a watermark and is left out; rows of equal time are decided by
``order``, and null values of it come first; repeated rows are separate events; an empty stream gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.streaming.limits import _decide

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Stands for a null ``order`` in the state: the smallest long, so that nulls come first.
NO_ORDER = -2 ** 63

#: Rows ``(time, order, outcome)`` in order, and the times that count, which it changes: the two decided values of each row.
Rule = Callable[[list[tuple], deque], list[tuple]]


def rocksdb_state(spark: SparkSession) -> None:
    """Use the state store that the functions of this module need, for streams started afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _InOrder(StatefulProcessor):
    """Waiting rows decided by ``rule`` once the watermark has passed them; a counted time lives for ``window_us``."""

    def __init__(self, rule: Rule, window_us: int, names: list[str]) -> None:
        self._rule, self._window_us, self._names = rule, window_us, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "us long, ord long, outcome string")
        self._counted = handle.getListState("counted", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for pdf in rows:
            got = [(int(us), int(at), said) for us, at, said in pdf[["row_us", "row_order", "row_outcome"]].itertuples(index=False)]
            self._waiting.appendList(got)
            first = min(us for us, _, _ in got)
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(earliest, timerValues)
        return iter(())

    def _wake(self, us: int, timers) -> None:
        self._handle.registerTimer(max(-(-us // 1000), timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self._waiting.get()) if self._waiting.exists() else []
        due = sorted((r for r in waiting if r[0] <= passed), key=lambda r: r[:2])
        later = [r for r in waiting if r[0] > passed]
        counted = deque(us for us, in self._counted.get()) if self._counted.exists() else deque()
        if due:
            decided = self._rule(due, counted)
            self._waiting.put(later) if later else self._waiting.clear()
            yield pd.DataFrame([(key[0], *row, *got) for row, got in zip(due, decided)], columns=self._names)
        # a time leaves the window for good once nothing before its end can still come
        while counted and counted[0] + self._window_us < min([passed, *(r[0] for r in later)]):
            counted.popleft()
        self._counted.put([(us,) for us in counted]) if counted else self._counted.clear()
        if later:
            self._wake(min(r[0] for r in later), timerValues)
        elif counted:
            self._wake(counted[-1] + self._window_us + 1000, timerValues)

    def close(self) -> None:
        pass


def _in_order(events: DataFrame, key: str, ts: str, order: str, outcome: str | None, delay: str, rule: Rule, window_us: int,
              decided: str, names: list[str]) -> DataFrame:
    said = F.col(outcome).cast("string") if outcome else F.lit(None).cast("string")
    rows = events.where(F.col(ts).isNotNull()).select(
        F.col(key).cast("string").alias("row_key"), F.col(ts).cast("timestamp").alias("row_ts"),
        F.coalesce(F.col(order).cast("long"), F.lit(NO_ORDER)).alias("row_order"), said.alias("row_outcome")
    ).withWatermark("row_ts", delay).withColumn("row_us", F.unix_micros("row_ts"))
    inner = ["row_key", "row_us", "row_order", "row_outcome", *names]
    out = rows.groupBy("row_key").transformWithStateInPandas(
        _InOrder(rule, window_us, inner), f"row_key string, row_us long, row_order long, row_outcome string, {decided}", "Append",
        "EventTime")
    said_again = [F.col("row_outcome").alias(outcome)] if outcome else []
    return out.select(F.col("row_key").alias(key), F.timestamp_micros("row_us").alias(ts),
                      F.nullif("row_order", F.lit(NO_ORDER)).alias(order), *said_again, *names)


def ordered_limiter(
    events: DataFrame, key: str, ts: str, order: str, seconds: float, limit: int, delay: str = "1 minute",
) -> DataFrame:
    """``key, ts, order, allowed, retry_after``: the decisions of ``limits.limiter_decisions`` on a stream; refused events use no slot."""
    window_us = int(seconds * 1_000_000)

    def rule(due: list[tuple], allowed: deque) -> list[tuple]:
        return list(_decide((us for us, _, _ in due), allowed, window_us, limit))

    return _in_order(events, key, ts, order, None, delay, rule, window_us, "allowed boolean, retry_after long", ["allowed", "retry_after"])


def ordered_lockout(
    events: DataFrame, key: str, ts: str, order: str, outcome: str, max_fails: int = 5, seconds: float = 900.0, delay: str = "1 minute",
) -> DataFrame:
    """``key, ts, order, outcome, n_fails, locked``: failures (``fail``) within ``seconds`` since the last success (``ok``)."""
    window_us = int(seconds * 1_000_000)

    def rule(due: list[tuple], fails: deque) -> list[tuple]:
        out = []
        for now, _, said in due:
            while fails and now - fails[0] > window_us:
                fails.popleft()
            if said == "ok":
                fails.clear()
            elif said == "fail":
                fails.append(now)
            out.append((len(fails), len(fails) >= max_fails))
        return out

    return _in_order(events, key, ts, order, outcome, delay, rule, window_us, "n_fails long, locked boolean", ["n_fails", "locked"])
