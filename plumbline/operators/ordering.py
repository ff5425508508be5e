"""Ranks, order statistics and cumulative counts without a one-task window.

The frame is first reduced to distinct values with their counts.  Each group's values are then cut
into ordered buckets; only the running sum inside a bucket is a window, and the offset of a bucket
comes from the bucket totals.  A group that holds a third of all rows is spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import eq_join, small_side
from plumbline.session import pin, shuffle_width


def value_frequency(df: DataFrame, by: Sequence[str], value: str, **extra) -> DataFrame:
    """Distinct values per group with their row count ``n`` and any extra aggregates."""
    aggs = [F.count(F.lit(1)).alias("n")] + [c.alias(k) for k, c in extra.items()]
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggs)


#: Distinct values of a group that one window orders; larger groups are cut into buckets.
WINDOW_VALUES = 10_000


def cumulate(
    freq: DataFrame,
    by: Sequence[str],
    value: str,
    weight: str = "n",
    buckets: int | None = None,
) -> DataFrame:
    """Add ``before`` (weight of smaller values in the group) and ``total`` (weight of the group).

    Groups of up to ``WINDOW_VALUES`` values need no cut points, however many groups there are.
    """
    by = list(by)
    if not by or buckets:
        return _in_buckets(freq, by, value, weight, buckets)
    large = pin(freq.groupBy(*by).agg(F.count(F.lit(1)).alias("_values")).where(
        F.col("_values") > WINDOW_VALUES).select(*by))
    if large.isEmpty():
        return _in_windows(freq, by, value, weight)
    large = small_side(large)
    return _in_windows(eq_join(freq, large, by, "left_anti"), by, value, weight).unionByName(
        _in_buckets(eq_join(freq, large, by, "left_semi"), by, value, weight, None))


def _in_windows(freq: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    whole = Window.partitionBy(*by)
    smaller = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return freq.withColumn("before", F.coalesce(F.sum(weight).over(smaller), F.lit(0))).withColumn(
        "total", F.sum(weight).over(whole))


def _in_buckets(freq: DataFrame, by: list[str], value: str, weight: str, buckets: int | None) -> DataFrame:
    buckets = buckets or shuffle_width(freq)
    probs = [i / buckets for i in range(1, buckets)]
    # The cut points must be the same for every reader, hence pinned: a sketch merged in another
    # order after a lost executor could move them.
    cuts = pin(
        freq.groupBy(*by).agg(
            F.array_distinct(F.percentile_approx(F.col(value), probs, 1000)).alias("_cuts")
        )
    )
    placed = eq_join(freq, small_side(cuts), by).withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))
    ).drop("_cuts")
    placed = placed.repartition(*by, "_bucket")
    totals = placed.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_in_bucket"))
    # one row per group and bucket: at most ``buckets`` rows per window partition
    ordered = Window.partitionBy(*by).orderBy("_bucket")
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *by,
        "_bucket",
        F.coalesce(
            F.sum("_in_bucket").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        F.sum("_in_bucket").over(whole).alias("total"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        eq_join(
            placed.withColumn("_before", F.coalesce(F.sum(weight).over(inside), F.lit(0))),
            offsets,
            [*by, "_bucket"],
        )
        .withColumn("before", F.col("_before") + F.col("_offset"))
        .drop("_before", "_offset", "_bucket")
    )


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group; ``probs`` maps output name to probability."""
    by = list(by)
    ranked = cumulate(value_frequency(df, by, value), by, value)
    first, last = F.col("before"), F.col("before") + F.col("n") - 1
    aggs = []
    for name, prob in probs.items():
        position = (F.col("total") - 1) * F.lit(float(prob))
        low, high = F.floor(position), F.ceil(position)
        aggs += [
            F.max(F.when((first <= low) & (low <= last), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((first <= high) & (high <= last), F.col(value))).alias(f"_hi_{name}"),
        ]
    out = ranked.groupBy(*by).agg(F.max("total").alias("n"), *aggs)
    for name, prob in probs.items():
        position = (F.col("n") - 1) * F.lit(float(prob))
        part = position - F.floor(position)
        out = out.withColumn(
            name, F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * part
        )
    return out.select(*by, "n", *probs)


def average_ranks(freq: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Average rank of each distinct value, ties sharing one rank."""
    return cumulate(freq, by, value).withColumn(
        "avg_rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    )
