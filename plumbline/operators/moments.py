"""Tests that need only group counts, means and variances.

Each test is one grouped aggregate (partial on the map side) followed by arithmetic on the few result
rows.  ``by`` runs the test for every key in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import dist
from plumbline.functions import numbers as num
from plumbline.operators.joins import eq_join, small_side
from plumbline.operators.ordering import quantiles
from plumbline.session import pin


def _value(column: str) -> Column:
    return F.col(column).cast("double")


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def listwise(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Only the used columns, rows complete in them."""
    return df.select(*dict.fromkeys([*by, *columns])).na.drop(subset=list(columns))


def describe(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sd per group."""
    return listwise(df, [group, value], by).groupBy(*by, group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(_value(value)).alias("mean"),
        F.stddev_samp(_value(value)).alias("sd"))


def group_stats(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    return listwise(df, [group, value], by).groupBy(
        *by, F.col(group).cast("string").alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(_value(value)).alias("m"),
        F.var_samp(_value(value)).alias("v"))


def two_groups(stats: DataFrame, by: Sequence[str] = (), least: int = 2) -> DataFrame:
    """Two-row group statistics to one row; keys with another number of groups, or groups of fewer than ``least`` rows, get
    a status.

    Groups are ordered by label, so the result does not depend on row order.
    """
    low = lambda c: F.min_by(c, "g")
    high = lambda c: F.max_by(c, "g")
    out = stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.min("g").alias("g1"), F.max("g").alias("g2"),
        *[low(c).alias(f"{c}1") for c in ("n", "m", "v")],
        *[high(c).alias(f"{c}2") for c in ("n", "m", "v")],
    )
    ok = (F.col("k") == 2) & (F.col("n1") >= least) & (F.col("n2") >= least) & (F.col("n1") + F.col("n2") > 2)
    return out.withColumn("status", F.when(ok, "ok").otherwise("abstained"))


def _between_within(stats: DataFrame, by: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Sums of squares between and within groups from group counts, means and variances."""
    n, m = F.col("n"), F.col("m")
    base = stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_total"),
        (F.sum(n * m) / F.sum("n")).alias("grand"),
        F.sum(F.coalesce(F.col("v"), F.lit(0.0)) * (n - 1)).alias("ss_within"), *extra)
    centred = eq_join(stats, base.select(*by, "grand"), by).groupBy(*by).agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("ss_between"))
    return eq_join(base, centred, by)


def levene(
    df: DataFrame, group: str, value: str, by: Sequence[str] = (), min_n: int = 1
) -> DataFrame:
    """Median-centred Levene test: an analysis of variance of distances from the group median.

    Groups with fewer than ``min_n`` rows are left out.
    """
    by = list(by)
    frame = listwise(df, [group, value], by).select(
        *by, F.col(group).cast("string").alias("g"), _value(value).alias("x"))
    # one row per group, needed by two aggregates below: materialised once
    medians = pin(quantiles(frame, [*by, "g"], "x", {"med": 0.5}).drop("n"))
    spread = eq_join(frame, small_side(medians), [*by, "g"]).withColumn(
        "x", F.abs(F.col("x") - F.col("med")))
    stats = spread.groupBy(*by, "g").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v")
    ).where(F.col("n") >= min_n)
    out = _between_within(stats, by)
    df1, df2 = F.col("k") - 1, F.col("n_total") - F.col("k")
    w = _div(_div(F.col("ss_between"), df1), _div(F.col("ss_within"), df2))
    return out.select(
        *by, "k", "n_total", df1.alias("df1"), df2.alias("df2"), w.alias("w"),
        dist.p_f(w, df1, df2).alias("p"))


def independent_t(
    df: DataFrame, group: str, value: str, by: Sequence[str] = (), equal_var: bool | None = None
) -> DataFrame:
    """Independent-samples t: Levene decides pooled or Welch unless ``equal_var`` is given.

    Statistic, degrees of freedom and interval all follow the variant that was chosen.  The pooled variance is defined
    where one group has a single row, so with ``equal_var=True`` that group is no reason to abstain.
    """
    by = list(by)
    out = two_groups(group_stats(df, group, value, by), by, least=1 if equal_var else 2)
    if equal_var is None:
        lev = levene(df, group, value, by).select(
            *by, F.col("w").alias("levene_w"), F.col("p").alias("levene_p"))
        out = eq_join(out, lev, by).withColumn("equal_var", F.col("levene_p") > 0.05)
    else:
        out = out.withColumns({
            "levene_w": F.lit(None).cast("double"), "levene_p": F.lit(None).cast("double"),
            "equal_var": F.lit(equal_var)})
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    squares = lambda n, v: F.when(n > 1, (n - 1) * v).otherwise(0.0)
    pooled_var = (squares(n1, v1) + squares(n2, v2)) / (n1 + n2 - 2)
    a, b = v1 / n1, v2 / n2
    welch_df = _div(F.pow(a + b, 2), a * a / (n1 - 1) + b * b / (n2 - 1))
    out = out.where("status = 'ok'").select(
        *by, "g1", "g2", "n1", "n2", F.col("m1").alias("mean1"), F.col("m2").alias("mean2"),
        F.sqrt(v1).alias("sd1"), F.sqrt(v2).alias("sd2"), "levene_w", "levene_p", "equal_var",
        (F.col("m1") - F.col("m2")).alias("diff"),
        F.when(F.col("equal_var"), F.sqrt(pooled_var * (1 / n1 + 1 / n2)))
        .otherwise(F.sqrt(a + b)).alias("se"),
        F.when(F.col("equal_var"), (n1 + n2 - 2).cast("double")).otherwise(welch_df).alias("df"),
        _div(F.col("m1") - F.col("m2"), F.sqrt(pooled_var)).alias("cohen_d"),
    )
    t = _div(F.col("diff"), F.col("se"))
    margin = dist.q_t(0.975, F.col("df")) * F.col("se")
    return out.withColumns({
        "t": t, "p": dist.p_t(t, F.col("df")),
        "ci_low": F.col("diff") - margin, "ci_high": F.col("diff") + margin,
        "effect": effect_label(F.col("cohen_d"), 0.2, 0.5),
    })


def effect_label(effect: Column, small: float, medium: float) -> Column:
    """Below ``small`` negligible-to-small, below ``medium`` medium, else large."""
    size = F.abs(effect)
    return F.when(size < small, "small").when(size < medium, "medium").when(
        size.isNotNull(), "large")


def eta_label(eta2: Column) -> Column:
    return effect_label(eta2, 0.06, 0.14)


def tost(
    df: DataFrame, group: str, value: str, margin: float, alpha: float = 0.05,
    by: Sequence[str] = (),
) -> DataFrame:
    """Welch two one-sided tests of equivalence within +-margin."""
    if not margin > 0 or not 0 < alpha < 0.5:
        raise ValueError("margin must be positive and alpha between 0 and 0.5")
    by = list(by)
    out = two_groups(group_stats(df, group, value, by), by).where("status = 'ok'")
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    a, b = v1 / n1, v2 / n2
    diff = F.col("m1") - F.col("m2")
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    out = out.select(
        *by, "g1", "g2", "n1", "n2", diff.alias("diff"), F.sqrt(a + b).alias("se"),
        _div(F.pow(a + b, 2), a * a / (n1 - 1) + b * b / (n2 - 1)).alias("df"),
        _div(diff, F.sqrt(pooled)).alias("cohen_d"))
    t_low = _div(F.col("diff") + margin, F.col("se"))
    t_high = _div(F.col("diff") - margin, F.col("se"))
    half = dist.q_t(1 - alpha, F.col("df")) * F.col("se")
    return out.withColumns({
        "t_lower": t_low, "t_upper": t_high,
        "p_lower": dist.p_t_upper(t_low, F.col("df")),
        "p_upper": dist.p_t_upper(-t_high, F.col("df")),
        "p_difference": dist.p_t(_div(F.col("diff"), F.col("se")), F.col("df")),
        "ci_low": F.col("diff") - half, "ci_high": F.col("diff") + half,
    }).withColumn("p", F.greatest("p_lower", "p_upper")).withColumn(
        "equivalent", F.col("p") < alpha)


def paired_t(df: DataFrame, pre: str, post: str, by: Sequence[str] = ()) -> DataFrame:
    """Paired t on post - pre with its interval and d_z."""
    change = _value(post) - _value(pre)
    out = listwise(df, [pre, post], by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(_value(pre)).alias("mean_pre"),
        F.avg(_value(post)).alias("mean_post"), F.stddev_samp(_value(pre)).alias("sd_pre"),
        F.stddev_samp(_value(post)).alias("sd_post"), F.avg(change).alias("mean_diff"),
        F.stddev_samp(change).alias("sd_diff"),
    ).where("n >= 2")
    se = F.col("sd_diff") / F.sqrt("n")
    dof = F.col("n") - 1
    t = _div(F.col("mean_diff"), se)
    half = dist.q_t(0.975, dof) * se
    d_z = _div(F.col("mean_diff"), F.col("sd_diff"))
    return out.withColumns({
        "df": dof, "t": t, "p": dist.p_t(t, dof), "ci_low": F.col("mean_diff") - half,
        "ci_high": F.col("mean_diff") + half, "d_z": d_z, "effect": effect_label(d_z, 0.2, 0.5)})


def anova(
    df: DataFrame, group: str, value: str, by: Sequence[str] = (), with_levene: bool = True
) -> DataFrame:
    """One-way analysis of variance with eta squared; needs three groups."""
    by = list(by)
    out = _between_within(group_stats(df, group, value, by), by).where("k >= 3")
    df1, df2 = F.col("k") - 1, F.col("n_total") - F.col("k")
    f = _div(_div(F.col("ss_between"), df1), _div(F.col("ss_within"), df2))
    eta2 = _div(F.col("ss_between"), F.col("ss_between") + F.col("ss_within"))
    out = out.select(
        *by, "k", "n_total", "ss_between", "ss_within", df1.alias("df1"), df2.alias("df2"),
        f.alias("f"), dist.p_f(f, df1, df2).alias("p"), eta2.alias("eta2"),
        eta_label(eta2).alias("effect"))
    if with_levene:
        lev = levene(df, group, value, by).select(
            *by, F.col("w").alias("levene_w"), F.col("p").alias("levene_p"))
        out = eq_join(out, lev, by)
    return out


def posthoc(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairwise comparisons on the pooled error, Bonferroni-adjusted.

    The pairs are of group statistics (one row per group), never of data rows.
    """
    by = list(by)
    stats = group_stats(df, group, value, by)
    pooled = _between_within(stats, by).select(
        *by, "k", (F.col("n_total") - F.col("k")).alias("df"),
        _div(F.col("ss_within"), F.col("n_total") - F.col("k")).alias("mse"))
    left = eq_join(stats, pooled, by)
    right = stats.select(*by, F.col("g").alias("group_b"), F.col("n").alias("nb"),
                         F.col("m").alias("mb"))
    pairs = eq_join(left, right, by).where("g < group_b")
    diff = F.col("m") - F.col("mb")
    se = F.sqrt(F.col("mse") * (1 / F.col("n") + 1 / F.col("nb")))
    t = _div(diff, se)
    n_pairs = F.col("k") * (F.col("k") - 1) / 2
    return pairs.where("mse > 0").select(
        *by, F.col("g").alias("group_a"), "group_b", diff.alias("mean_diff"), se.alias("se"),
        t.alias("t"), "df",
        F.least(F.lit(1.0), dist.p_t(t, F.col("df")) * n_pairs).alias("p_adj"),
    ).withColumn("significant", F.col("p_adj") < 0.05)


def pearson(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation with t, Fisher-z interval and size label."""
    out = listwise(df, [a, b], by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), num.safe_corr(_value(a), _value(b)).alias("r")
    ).where("n >= 3")
    r = F.col("r")
    dof = F.col("n") - 2
    t = F.when(F.abs(r) < 1, r * F.sqrt(dof / (1 - r * r)))
    z, half = F.atanh(r), 1.96 / F.sqrt(F.col("n") - 3)
    inner = (F.abs(r) < 0.9999) & (F.col("n") > 3)
    return out.withColumns({
        "df": dof, "t": t,
        "p": F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(dist.p_t(t, dof)),
        "ci_low": F.when(inner, F.tanh(z - half)), "ci_high": F.when(inner, F.tanh(z + half)),
        "effect": effect_label(r, 0.1, 0.5)})


def contingency(df: DataFrame, row: str, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Observed and expected counts of a two-way table, empty cells included.

    Cells are counted once; margins and the grid of levels come from the counted cells.
    """
    by = list(by)
    cells = listwise(df, [row, col], by).groupBy(
        *by, F.col(row).cast("string").alias("r"), F.col(col).cast("string").alias("c")
    ).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy(*by, "r").agg(F.sum("o").alias("nr"))
    cols = cells.groupBy(*by, "c").agg(F.sum("o").alias("nc"))
    total = cells.groupBy(*by).agg(
        F.sum("o").alias("n"), F.count_distinct("r").alias("n_rows"),
        F.count_distinct("c").alias("n_cols"))
    if by:
        grid = eq_join(eq_join(rows, cols, by), total, by)
    else:
        # levels x levels: the printed table itself, not data rows
        grid = rows.join(F.broadcast(cols), F.lit(True)).crossJoin(total)
    keys = [*by, "r", "c"]
    full = eq_join(grid, cells, keys, "left")
    return full.select(
        *keys, F.coalesce("o", F.lit(0)).alias("observed"),
        (F.col("nr") * F.col("nc") / F.col("n")).alias("expected"), "n", "n_rows", "n_cols")


def chi_square(df: DataFrame, row: str, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Chi-square independence with Cramer's V; Yates-corrected for one degree of freedom."""
    by = list(by)
    cells = contingency(df, row, col, by)
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    gap = F.abs(F.col("observed") - F.col("expected"))
    gap = F.when(dof == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = cells.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"),
        F.sum(gap * gap / F.col("expected")).alias("chi2"),
        F.count_if(F.col("expected") < 5).alias("n_low_expected"))
    smaller = F.least("n_rows", "n_cols")
    return out.where("n_rows >= 2 and n_cols >= 2").withColumns({
        "df": dof, "p": dist.p_chi2(F.col("chi2"), dof),
        "cramers_v": F.sqrt(F.col("chi2") / (F.col("n") * (smaller - 1)))})


# ---- chart feeds -----------------------------------------------------------------------------

def mean_error(df: DataFrame, group: str, value: str) -> DataFrame:
    """Group mean and standard error."""
    return describe(df, group, value).withColumn("se", F.col("sd") / F.sqrt("n"))


def fit_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return listwise(df, [x, y], by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(_value(y), _value(x)).alias("slope"),
        F.regr_intercept(_value(y), _value(x)).alias("intercept"),
        num.safe_corr(_value(x), _value(y)).alias("r"))


def crosstab(df: DataFrame, row: str, col: str, levels: Sequence[str]) -> DataFrame:
    """Counts with one column per given level."""
    wide = listwise(df, [row, col]).groupBy(row).pivot(col, list(levels)).count()
    return wide.na.fill(0)


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Five-number summary per group, exact."""
    frame = listwise(df, [group, value]).select(group, _value(value).alias("x"))
    mid = quantiles(frame, [group], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    ends = frame.groupBy(group).agg(F.min("x").alias("min"), F.max("x").alias("max"))
    return eq_join(mid, ends, [group])


def time_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and standard error per time column over rows complete in all of them."""
    long = df.select(*columns).na.drop().select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("time"), _value(c).alias("x")) for c in columns])))
    return long.groupBy("time").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")
    ).withColumn("se", F.col("sd") / F.sqrt("n"))


def share_within(df: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Share of a count within its keys, for already aggregated frames."""
    return df.withColumn("share", F.col(count) / F.sum(count).over(Window.partitionBy(*keys)))
