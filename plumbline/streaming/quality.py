"""Data-quality counts per event-time window; all of them are mergeable, so a stream needs no more state
than one row per window and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.functions import numbers as num


def windowed_quality(
    events: DataFrame, ts: str, value: str, low: float, high: float, width: str = "1 hour",
    keys: Sequence[str] = (), scale: int = 2, delay: str | None = None,
) -> DataFrame:
    """Counts of rows, missing and out-of-range values, extremes and last and first digits per window.

    On a stream give ``delay``: rows later than the watermark are dropped.
    """
    frame = events.withWatermark(ts, delay) if delay else events
    x = F.col(value).cast("double")
    last, first = num.terminal_digit(x, scale), num.first_digit(x)
    out = frame.groupBy(*keys, F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("n_missing"),
        F.count_if(~x.between(low, high)).alias("n_outside"), F.min(x).alias("min"),
        F.max(x).alias("max"), *[F.count_if(last == d).alias(f"t{d}") for d in range(10)],
        *[F.count_if(first == d).alias(f"b{d}") for d in range(1, 10)])
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"),
                      *[c for c in out.columns if c not in (*keys, "w")])


def window_issues(windows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Checks that one window's counts are enough for; thin windows abstain."""
    n = (F.col("n") - F.col("n_missing")).cast("double")
    digits = [F.col(f"t{d}") for d in range(10)]
    terms = [F.pow(d - n / 10, F.lit(2)) / (n / 10) for d in digits]
    chi2 = F.when(n >= 50, sum(terms[1:], terms[0]))
    share = F.when(n >= 50, F.greatest(*digits) / n)
    law = {d: F.log10(F.lit(1.0) + F.lit(1.0) / d) for d in range(1, 10)}
    gaps = [F.abs(F.col(f"b{d}") / n - law[d]) for d in range(1, 10)]
    wide = (n >= 100) & (F.col("min") > 0) & (F.col("max") / F.col("min") >= 100)
    mad = F.when(wide, sum(gaps[1:], gaps[0]) / 9)
    checks = F.array(
        F.struct(F.lit("missing").alias("check"), F.when(F.col("n") >= 5, F.when(
            F.col("n_missing") >= 0.3 * F.col("n"), "flagged").otherwise("clear")).alias("state")),
        F.struct(F.lit("outside_range").alias("check"), F.when(n >= 5, F.when(
            (F.col("n_outside") > 0) & (2 * F.col("n_outside") <= n), "flagged").otherwise("clear"))
            .alias("state")),
        F.struct(F.lit("constant").alias("check"), F.when(n >= 5, F.when(
            F.col("min") == F.col("max"), "flagged").otherwise("clear")).alias("state")),
        F.struct(F.lit("last_digit").alias("check"), F.when(n >= 50, F.when(
            (chi2 > fv.CHI2_9_P001) & (share >= fv.TERMINAL_SHARE_LIMIT), "flagged")
            .otherwise("clear")).alias("state")),
        F.struct(F.lit("first_digit").alias("check"), F.when(wide, F.when(
            mad > fv.BENFORD_MAD_LIMIT, "flagged").otherwise("clear")).alias("state")))
    return windows.select(*keys, "start", F.inline(checks)).withColumn(
        "state", F.coalesce("state", F.lit("abstained")))
