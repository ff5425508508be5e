"""Rank tests and the normality screen, built on distributed ranks of distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import dist
from plumbline.operators import exact
from plumbline.operators.joins import eq_join
from plumbline.operators.moments import effect_label, listwise
from plumbline.operators.ordering import average_ranks, cumulate, quantiles, value_frequency


#: Ranks unfolded by one row at most when equal values are written out again.
RANK_BLOCK = 4096


def _tie_term(t: Column) -> Column:
    return t * t * t - t


def mann_whitney(
    df: DataFrame, group: str, value: str, by: Sequence[str] = (),
    groups: tuple[str, str] | None = None,
) -> DataFrame:
    """Mann-Whitney U with tie-corrected normal p (continuity-corrected), medians and r = z / sqrt(N).

    The first group is the one with the smaller label.  ``exact_p_applies`` marks small samples
    without ties, where an exact p would be the reader's choice; ``p_exact`` is that p, counted and not
    approximated, and ``p_method`` says which of the two holds for the row.
    """
    by = list(by)
    frame = listwise(df, [group, value], by).select(
        *by, F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("x"))
    if groups:
        frame = frame.where(F.col("g").isin(*groups))
    ends = frame.groupBy(*by).agg(
        F.min("g").alias("g1"), F.max("g").alias("g2"), F.count_distinct("g").alias("__labels"))
    marked = eq_join(frame, F.broadcast(ends) if not by else ends, by).where("__labels = 2")
    freq = marked.groupBy(*by, "g1", "g2", "x").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") == F.col("g1")).alias("c1"))
    ranked = average_ranks(freq, [*by, "g1", "g2"], "x")
    sums = ranked.groupBy(*by, "g1", "g2").agg(
        F.sum("c1").alias("n1"), F.sum(F.col("n") - F.col("c1")).alias("n2"),
        F.sum(F.col("c1") * F.col("avg_rank")).alias("r1"),
        F.sum(_tie_term(F.col("n").cast("double"))).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    larger = F.greatest(u1, n1 * n2 - u1)
    z = F.try_divide(larger - mu - 0.5, sigma)
    tests = sums.select(
        *by, "g1", "g2", "n1", "n2", u1.alias("u"), F.col("ties"), z.alias("z_corrected"),
        dist.p_norm(F.greatest(z, F.lit(0.0))).alias("p"),
        ((F.col("ties") == 0) & (F.least("n1", "n2") <= 8)).alias("exact_p_applies"))
    tests = tests.withColumn(
        "r", dist.q_norm(F.lit(1.0) - F.col("p") / 2) / F.sqrt(F.col("n1") + F.col("n2"))
    ).withColumn("effect", effect_label(F.col("r"), 0.1, 0.3))
    return exact.with_exact_u(tests, F.col("u"), F.col("n1"), F.col("n2"), F.col("ties") == 0)


def group_quartiles(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact median and quartiles per group: the location figures that go with a rank test."""
    frame = listwise(df, [group, value], by).select(
        *by, F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("x"))
    return quantiles(frame, [*by, "g"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75})


def wilcoxon(df: DataFrame, pre: str, post: str, by: Sequence[str] = ()) -> DataFrame:
    """Wilcoxon signed-rank test of post - pre; zero differences are dropped.  Without ties ``p_exact`` counts
    the sign patterns."""
    by = list(by)
    # differences of decimals are compared after rounding, so that equal changes tie
    d = F.round(F.col(post).cast("double") - F.col(pre).cast("double"), 10)
    frame = listwise(df, [pre, post], by).select(*by, d.alias("d"))
    freq = frame.groupBy(*by, F.abs("d").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("pos"))
    # zero differences rank below all others, so their number is taken off the ranks
    ranked = average_ranks(freq, by, "x")
    zeros = F.coalesce(F.sum(F.when(F.col("x") == 0, F.col("n"))), F.lit(0))
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("n_pairs"), (F.sum("n") - zeros).alias("n_used"),
        (F.sum(F.col("pos") * F.col("avg_rank")) - zeros * F.sum("pos")).alias("w_plus"),
        F.sum(F.when(F.col("x") != 0, _tie_term(F.col("n").cast("double"))).otherwise(0.0)).alias("ties"))
    n = F.col("n_used").cast("double")
    w_minus = n * (n + 1) / 2 - F.col("w_plus")
    w = F.least(F.col("w_plus"), w_minus)
    sigma = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    z = F.try_divide(w - n * (n + 1) / 4, sigma)
    out = sums.where("n_used > 0").select(
        *by, "n_pairs", "n_used", "w_plus", w_minus.alias("w_minus"), w.alias("w"), "ties",
        z.alias("z"), dist.p_norm(z).alias("p"),
        ((F.col("ties") == 0) & (F.col("n_used") <= 50)).alias("exact_p_applies"))
    out = out.withColumn(
        "r", dist.q_norm(F.lit(1.0) - F.col("p") / 2) / F.sqrt("n_pairs")
    ).withColumn("effect", effect_label(F.col("r"), 0.1, 0.3))
    return exact.with_exact_w(out, F.col("w"), F.col("n_used"), F.col("ties") == 0)


def _poly(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def shapiro(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Shapiro-Wilk W after Royston, from distributed ranks; p for n of 4 to 5000, W beyond.

    Every row needs its own rank here, so equal values are unfolded again after ranking.  The scores
    are plain Column math and the sums are grouped aggregates: no group is gathered anywhere.
    """
    by = list(by)
    frame = listwise(df, [value], by).select(*by, F.col(value).cast("double").alias("x"))
    ranked = cumulate(value_frequency(frame, by, "x"), by, "x")
    # a value shared by very many rows is cut into blocks of ranks, which are spread over the tasks
    last_rank = F.col("before") + F.col("n")
    blocks = ranked.select(
        *by, "x", "total", last_rank.alias("_end"),
        F.explode(F.sequence(F.col("before"), last_rank - 1, F.lit(RANK_BLOCK))).alias("_start"))
    rows = blocks.repartition(*by, "_start").select(
        *by, "x", "total",
        F.explode(F.sequence(
            F.col("_start") + 1, F.least(F.col("_start") + RANK_BLOCK, F.col("_end")))).alias("i"))
    n = F.col("total").cast("double")
    score = dist.norm_quantile_expr((F.col("i") - 0.375) / (n + 0.25))
    scored = rows.withColumn("m", score)
    sums = scored.groupBy(*by).agg(
        F.max("total").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.max("m").alias("m_last"),
        F.max(F.when(F.col("i") == F.col("total") - 1, F.col("m"))).alias("m_prev"),
        F.avg("x").alias("mean"), F.var_pop("x").alias("var")).where("n >= 4")
    k = F.col("n").cast("double")
    u = 1 / F.sqrt(k)
    root = F.sqrt("mm")
    # fixed values: published polynomial corrections for the two outer weights
    last = _poly([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0], u) \
        + F.col("m_last") / root
    prev = _poly([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u) \
        + F.col("m_prev") / root
    sums = sums.withColumns({"a_last": last, "a_prev": prev})
    five = F.col("n") > 5
    phi = F.when(
        five,
        (F.col("mm") - 2 * F.pow("m_last", F.lit(2)) - 2 * F.pow("m_prev", F.lit(2)))
        / (1 - 2 * F.pow("a_last", F.lit(2)) - 2 * F.pow("a_prev", F.lit(2))),
    ).otherwise(
        (F.col("mm") - 2 * F.pow("m_last", F.lit(2))) / (1 - 2 * F.pow("a_last", F.lit(2))))
    sums = sums.withColumn("phi", phi)
    weighted = eq_join(scored, F.broadcast(sums) if not by else sums, by)
    rank_from_end = F.least(F.col("i") - 1, F.col("total") - F.col("i"))
    sign = F.when(F.col("m") >= 0, 1.0).otherwise(-1.0)
    weight = (
        F.when(rank_from_end == 0, sign * F.col("a_last"))
        .when((rank_from_end == 1) & five, sign * F.col("a_prev"))
        .otherwise(F.col("m") / F.sqrt("phi"))
    )
    out = weighted.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("var").alias("var"),
        F.sum(weight * (F.col("x") - F.col("mean"))).alias("ax"))
    w = F.try_divide(F.col("ax") * F.col("ax"), F.col("var") * F.col("n"))
    ln_n = F.ln(k)
    # fixed values: published normalising polynomials, for 4 to 11 rows and from 12 rows on
    gamma = 0.459 * k - 2.273
    small_y = -F.ln(gamma - F.ln(1 - F.col("w")))
    small_mu = _poly([-0.0006714, 0.025054, -0.39978, 0.5440], k)
    small_sd = F.exp(_poly([-0.0020322, 0.062767, -0.77857, 1.3822], k))
    large_y = F.ln(1 - F.col("w"))
    large_mu = _poly([0.0038915, -0.083751, -0.31082, -1.5861], ln_n)
    large_sd = F.exp(_poly([0.0030302, -0.082676, -0.4803], ln_n))
    z = F.when(F.col("n") <= 11, (small_y - small_mu) / small_sd).otherwise(
        (large_y - large_mu) / large_sd)
    return out.where("var > 0").select(*by, "n", F.least(w, F.lit(1.0)).alias("w")) \
        .withColumn("p", F.when(F.col("n") <= 5000, dist.p_norm_upper(z))) \
        .withColumn("normal", F.col("p") > 0.05)


def moment_screen(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Skewness and excess kurtosis with a Jarque-Bera p: the cheap normality screen at any size."""
    x = F.col(value).cast("double")
    out = listwise(df, [value], by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.skewness(x).alias("skewness"),
        F.kurtosis(x).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    return out.withColumns({"jb": jb, "p": F.exp(-jb / 2)})
