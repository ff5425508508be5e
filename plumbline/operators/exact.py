"""Exact null distributions of rank statistics without ties, as arrays of counts folded inside the JVM.

The number of ways to reach a rank sum obeys a short recurrence.  It is folded once for each distinct pair of sample sizes and joined to the
results, so its cost follows the sizes that occur and not the number of groups.

Cases: with ties, or beyond the sizes named below, ``p_exact`` is null and ``p_method`` says ``normal``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import small_side
from plumbline.session import pin

#: Largest smaller sample and largest number of pairs for which the exact distribution of U is counted.
SMALLER_SAMPLE, MOST_PAIRS = 8, 2000
#: Largest number of differences for which the exact distribution of W is counted.
MOST_DIFFERENCES = 50


def _unit(length: Column) -> Column:
    """1, 0, 0, ... of this length."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda k: F.when(k == 0, 1.0).otherwise(0.0))


def _shifted(counts: Column, k: Column) -> Column:
    return F.when(k >= 0, F.coalesce(F.get(counts, k), F.lit(0.0))).otherwise(0.0)


def rank_sum_counts(m: Column, n: Column) -> Column:
    """Samples of m among m + n for each U = 0 .. m n: the product over i of (1 - q^(n+i)) / (1 - q^i), factor by factor."""

    def step(counts: Column, s: Column) -> Column:
        i = F.floor((s + 1) / 2).cast("int")
        times = F.transform(counts, lambda x, k: x - _shifted(counts, k - (n + i)))
        over = F.transform(F.sequence(F.lit(0), F.size(counts) - 1), lambda k: F.aggregate(
            F.sequence(k, F.lit(0), -i), F.lit(0.0), lambda total, j: total + F.get(counts, j)))
        return F.when(s % 2 == 1, times).otherwise(over)

    return F.aggregate(F.sequence(F.lit(1), 2 * m), _unit(m * n + 1), step)


def signed_rank_counts(n: Column) -> Column:
    """Sign patterns of n ranks for each W = 0 .. n (n + 1) / 2: the product over i of (1 + q^i)."""
    return F.aggregate(F.sequence(F.lit(1), n), _unit((n * (n + 1) / 2).cast("int") + 1), lambda counts, i: F.transform(
        counts, lambda x, k: x + _shifted(counts, k - i)))


def _with_p(tests: DataFrame, keys: list[str], counts: Column, applies: Column, statistic: Column) -> DataFrame:
    tests = pin(tests)  # read for its sizes and again for the join
    sizes = tests.where(applies).select(*keys).distinct().withColumn("_counts", counts)
    small = small_side(sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], "_counts"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    joined = tests.join(small, [applies & on[0], *on[1:]], "left")
    total = F.aggregate("_counts", F.lit(0.0), lambda s, x: s + x)
    tail = F.aggregate(F.slice("_counts", F.lit(1), statistic.cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
    exact = F.when(F.col("_counts").isNotNull(), F.least(F.lit(1.0), 2 * tail / total))
    return joined.withColumn("p_exact", exact).withColumn(
        "p_method", F.when(F.col("p_exact").isNotNull(), "exact").otherwise("normal")).drop(*[f"_{k}" for k in keys], *keys, "_counts")


def with_exact_u(tests: DataFrame, u: Column, n1: Column, n2: Column, no_ties: Column) -> DataFrame:
    """``p_exact, p_method`` of a two-sided rank-sum test."""
    sized = tests.withColumn("m_size", F.least(n1, n2).cast("int")).withColumn("n_size", F.greatest(n1, n2).cast("int"))
    applies = no_ties & (F.col("m_size") <= SMALLER_SAMPLE) & (n1.cast("double") * n2 <= MOST_PAIRS)
    return _with_p(sized, ["m_size", "n_size"], rank_sum_counts(F.col("m_size"), F.col("n_size")), applies, F.least(u, n1 * n2 - u))


def with_exact_w(tests: DataFrame, w: Column, n: Column, no_ties: Column) -> DataFrame:
    """``p_exact, p_method`` of a two-sided signed-rank test."""
    sized = tests.withColumn("w_size", n.cast("int"))
    applies = no_ties & (F.col("w_size") <= MOST_DIFFERENCES)
    return _with_p(sized, ["w_size"], signed_rank_counts(F.col("w_size")), applies, w)
