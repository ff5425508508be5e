"""Arithmetic possibility of reported means and standard deviations, as integer Column math.

Three answers: ``ok``, ``impossible`` and ``abstain``; abstaining means the test carries no
information, it is not a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import numbers as num
from plumbline.operators.joins import eq_join

#: Above this the reported digits outrun what a double can hold.
_EXACT = 2 ** 53


def _as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def grim_verdict(
    mean: Column, n: Column, decimals: Column | int = 2, items: Column | int = 1,
    lo: Column | float | None = None, hi: Column | float | None = None,
) -> Column:
    """Whether some integer total is compatible with a mean reported to ``decimals`` places.

    Everything is in units of the last reported digit: the total is ``S = m * n * items``, the
    rounding half-width is ``n * items / 2`` and whole totals are multiples of ``10 ** decimals``.
    The range of possible totals is tested first, because it stays informative for any n.
    """
    n, items = _as_col(n).cast("long"), F.greatest(_as_col(items).cast("long"), F.lit(1).cast("long"))
    decimals = F.greatest(_as_col(decimals).cast("int"), F.lit(0))
    lo = _as_col(lo).cast("double")
    hi = _as_col(hi).cast("double")
    unit = F.round(F.pow(F.lit(10.0), decimals)).cast("double")
    people = (n * items).cast("double")
    total = F.round(mean.cast("double") * unit) * people
    width = people / 2
    floor_total = F.floor(total / unit).cast("double")
    s_lo = people * F.coalesce(lo, F.lit(0.0))
    s_hi = people * hi
    outside = F.coalesce(
        (total + width < s_lo * unit) | (total - width > s_hi * unit), F.lit(False))

    def fits(k: Column) -> Column:
        near = F.abs(total - k * unit) * 2 <= people
        return near & F.coalesce((k >= s_lo) & (k <= s_hi), F.lit(True))

    usable = (n > 0) & mean.isNotNull() & ~F.isnan(mean.cast("double")) \
        & (F.abs(mean.cast("double")) < float("inf"))
    return (
        F.when(~F.coalesce(usable, F.lit(False)), "abstain")
        .when((items > 1) & hi.isNull(), "abstain")
        .when(hi.isNotNull() & outside, "impossible")
        .when(people >= unit, "abstain")
        .when((F.abs(total) >= _EXACT) | (decimals > 15), "abstain")
        .when(fits(floor_total) | fits(floor_total + 1), "ok")
        .otherwise("impossible")
    )


def sd_bounds(
    mean: Column, n: Column, items: Column | int = 1, lo: Column | float | None = None,
    hi: Column | float | None = None, ddof: int = 1,
) -> tuple[Column, Column]:
    """Smallest and largest standard deviation of whole scores with this mean.

    Smallest: all scores at the two integers next to the mean.  Largest: as many as fit at the upper
    end, one in between, the rest at the lower end; without an upper end one score takes everything.
    """
    n = F.nullif(_as_col(n).cast("double"), F.lit(0.0))
    g = F.greatest(_as_col(items).cast("double"), F.lit(1.0))
    low = F.coalesce(_as_col(lo).cast("double"), F.lit(0.0)) * g
    high = _as_col(hi).cast("double") * g
    total = F.round(mean.cast("double") * n * g)
    rem = total - F.floor(total / n) * n
    tight = rem * (n - rem) / (n * n)
    above = total - n * low
    span = high - low
    at_top = F.floor(F.try_divide(above, span))
    left = above - at_top * span
    second = at_top * span * span + left * left - above * above / n
    bounded = F.when((above >= 0) & (total <= n * high) & (span > 0), second / n)
    free = F.when(above >= 0, (above * above - above * above / n) / n)
    wide = F.coalesce(F.when(high.isNull(), free).otherwise(bounded), tight)
    factor = F.try_divide(n, n - ddof)
    scale = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)) * factor) / g
    return (
        F.when(n > 1, F.least(scale(tight), scale(wide))),
        F.when(n > 1, F.greatest(scale(tight), scale(wide))),
    )


def grimmer(
    df: DataFrame, mean: str, sd: str, n: str, decimals: str | int = 2, sd_decimals: str | int = 2,
    items: str | int = 1, lo: str | float | None = None, hi: str | float | None = None,
    ddof: int = 1,
) -> DataFrame:
    """Add ``grim``, ``sd_min``, ``sd_max`` and ``grimmer`` (ok / impossible / abstain).

    The reported standard deviation may itself be rounded, so the range is widened by half a unit of
    its last digit.
    """
    pick = lambda v: F.col(v) if isinstance(v, str) else F.lit(v)
    m, s, k = F.col(mean), F.col(sd).cast("double"), F.col(n)
    low, high = sd_bounds(m, k, pick(items), pick(lo), pick(hi), ddof)
    half = F.lit(0.5) * F.pow(F.lit(10.0), -pick(sd_decimals)) + 1e-9
    verdict = grim_verdict(m, k, pick(decimals), pick(items), pick(lo), pick(hi))
    return df.withColumns({"grim": verdict, "sd_min": low, "sd_max": high}).withColumn(
        "grimmer",
        F.when((k < 2) | (s < 0) | s.isNull() | m.isNull(), "abstain")
        .when(F.col("grim") == "impossible", "impossible")
        .when((s < F.col("sd_min") - half) | (s > F.col("sd_max") + half), "impossible")
        .otherwise("ok"))


def grim_claims(claims: DataFrame, counts: DataFrame, keys: list[str], items: int = 1) -> DataFrame:
    """Every claimed mean against the true row count of its table (``counts``: keys, n)."""
    means = claims.where("kind = 'mean'")
    joined = eq_join(means, counts.select(*keys, F.col("n").alias("true_n")), keys)
    decimals = last_decimals(F.col("raw"))
    return joined.withColumn(
        "grim", grim_verdict(F.col("value"), F.col("true_n"), decimals, items))


def last_decimals(raw: Column) -> Column:
    """Decimals of the last number in a claim such as ``t(28) = 2.31``."""
    return num.decimals_of(F.regexp_extract(raw, r"(-?\d*\.?\d+)\D*$", 1))


def pair_mean_sd(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Pair each claimed mean with a standard deviation: same context first, else by order.

    The fallback by order only applies where a document has as many of one as of the other.
    """
    means = claims.where("kind = 'mean'").select(
        *keys, "pos", "context", F.col("value").alias("mean"), F.col("raw").alias("mean_raw"))
    sds = claims.where("kind = 'sd'").select(
        *keys, "pos", "context", F.col("value").alias("sd"), F.col("raw").alias("sd_raw"))
    nearby = sds.groupBy(*keys, "context").agg(
        F.min_by(F.struct("sd", "sd_raw"), "pos").alias("near"))
    joined = eq_join(means, nearby.where("context <> ''"), [*keys, "context"], "left")
    order = Window.partitionBy(*keys).orderBy("pos")
    whole = Window.partitionBy(*keys)
    ranked = joined.withColumns({"_i": F.row_number().over(order), "_n": F.count(F.lit(1)).over(whole)})
    others = sds.withColumns(
        {"_i": F.row_number().over(order), "_n": F.count(F.lit(1)).over(whole)}
    ).select(*keys, "_i", "_n", F.struct("sd", "sd_raw").alias("by_order"))
    out = eq_join(ranked, others, [*keys, "_i", "_n"], "left")
    chosen = F.coalesce(F.col("near"), F.col("by_order"))
    return out.where(chosen.isNotNull()).select(
        *keys, "pos", "mean", "mean_raw", chosen["sd"].alias("sd"), chosen["sd_raw"].alias("sd_raw"))


def grimmer_claims(
    claims: DataFrame, counts: DataFrame, keys: list[str], lo: float | None = None,
    hi: float | None = None, ddof: int = 1,
) -> DataFrame:
    """Claimed (mean, sd) pairs against the true row count."""
    pairs = pair_mean_sd(claims, keys).withColumns({
        "_dm": last_decimals(F.col("mean_raw")), "_ds": last_decimals(F.col("sd_raw"))})
    joined = eq_join(pairs, counts.select(*keys, F.col("n").alias("true_n")), keys)
    return grimmer(joined, "mean", "sd", "true_n", "_dm", "_ds", lo=lo, hi=hi, ddof=ddof).drop(
        "_dm", "_ds")
