"""Rules over test results: advice codes, writable claims and short answer fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Result columns the rules look at; a frame may hold any of them.
FIELDS = ("n", "n_groups", "p", "cohen_d", "alpha", "levene_p", "p_ab", "mauchly_p", "n_low_expected")


def _have(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def advise(results: DataFrame, method: str = "method") -> DataFrame:
    """Add ``advice``: codes of what to report, check or change, from the numbers of each result.

    Only rules whose numbers are present speak.
    """
    n, groups, p = (_have(results, c) for c in ("n", "n_groups", "p"))
    alpha, lev, p_ab = (_have(results, c) for c in ("alpha", "levene_p", "p_ab"))
    mauchly, low = _have(results, "mauchly_p"), _have(results, "n_low_expected")
    m = F.col(method)
    rules = [
        ("small_sample", n < 30), ("report_effect_size", n.between(30, 99)),
        ("borderline_p", (p > 0.01) & (p < 0.05)),
        ("more_than_two_groups", (m == "independent_t") & (groups > 2)),
        ("report_cohen_d", (m == "independent_t") & _have(results, "cohen_d").isNotNull()),
        ("report_posthoc", (m == "anova") & (p < 0.05)),
        ("unequal_variances", lev < 0.05),
        ("correlation_is_no_cause", m == "correlation"),
        ("low_expected_counts", low > 0),
        ("report_paired_differences", m.isin("paired_t", "wilcoxon")),
        ("report_medians", m.isin("mann_whitney", "wilcoxon")),
        ("check_collinearity", m.isin("linear_regression", "logistic_regression")),
        ("report_odds_ratio", m == "logistic_regression"),
        ("low_reliability", alpha < 0.7), ("redundant_items", alpha > 0.95),
        ("simple_effects", p_ab < 0.05), ("main_effects", p_ab >= 0.05),
        ("report_corrected_p", mauchly < 0.05),
    ]
    codes = F.array_compact(F.array(*[
        F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules]))
    return results.withColumn(
        "advice", F.when(F.size(codes) == 0, F.array(F.lit("compare_with_source"))).otherwise(codes))


def significance(p: Column) -> Column:
    """Wording class of a p-value."""
    return (
        F.when(p < 0.001, "below_001").when(p < 0.05, "exact_significant")
        .when(p.isNotNull(), "exact_not_significant").otherwise("not_reported"))


def claim_inventory(
    results: DataFrame, source: str, keys: Sequence[str] = (), method: str = "method",
    metrics: Sequence[str] = ("p",),
) -> DataFrame:
    """One writable claim per result, with its metrics, wording class and confidence.

    A claim without a source is not writable; one without a p-value is of low confidence and stays out of
    an abstract.
    """
    p = _have(results, "p")
    pairs = [x for c in metrics if c in results.columns for x in (F.lit(c), F.col(c).cast("double"))]
    label = F.concat_ws("-", F.lit("claim"), *[F.col(k).cast("string") for k in keys], F.col(method))
    confidence = F.when(p.isNull(), "low").otherwise("high")
    writable = F.lit(bool(source))
    return results.select(
        *keys, label.alias("claim_id"), F.col(method), F.array(F.lit(source)).alias("source_files"),
        significance(p).alias("wording"), confidence.alias("confidence"),
        F.create_map(*pairs).alias("metrics"), writable.alias("writable"),
        (writable & (confidence == "high")).alias("abstract_ok"))


def _size(value: Column, small: float, medium: float, large: float) -> Column:
    a = F.abs(value)
    return F.when(a < small, "negligible").when(a < medium, "small").when(a < large, "medium").when(
        a.isNotNull(), "large")


def answer_fields(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Fields behind the usual questions about a result: effect size and its label, and the sample."""
    effects = F.array(*[
        F.struct(F.lit(k).alias("effect"), v.alias("value"), label.alias("size"))
        for k, v, label in (
            ("d", _have(results, "cohen_d"), _size(_have(results, "cohen_d"), 0.2, 0.5, 0.8)),
            ("eta2", _have(results, "eta2"), _size(_have(results, "eta2"), 0.01, 0.06, 0.14)),
            ("r", _have(results, "r"), _size(_have(results, "r"), 0.1, 0.3, 0.5)),
            ("cramers_v", _have(results, "cramers_v"), _size(_have(results, "cramers_v"), 0.1, 0.3, 0.5)),
        )])
    return results.select(*keys, F.inline(F.filter(effects, lambda e: e["value"].isNotNull())))


#: Which methods each design question leads to; candidates of the method proposal.
METHOD_GRAPH = (
    ("two_groups", "independent_t"), ("two_groups", "mann_whitney"), ("two_groups", "tost"),
    ("three_groups", "anova"), ("two_factors", "two_way_anova"), ("pre_post", "paired_t"),
    ("pre_post", "wilcoxon"), ("three_times", "repeated_measures_anova"),
    ("two_continuous", "correlation"), ("two_categorical", "chi_square"),
    ("continuous_outcome", "linear_regression"), ("binary_outcome", "logistic_regression"),
    ("scale_items", "cronbach_alpha"),
)


def method_candidates(proposals: DataFrame, method: str = "method") -> DataFrame:
    """Other methods that answer the same design question as a proposed one."""
    graph = proposals.sparkSession.createDataFrame(METHOD_GRAPH, "question string, candidate string")
    own = F.broadcast(graph.withColumnRenamed("candidate", method))
    others = F.broadcast(graph)
    return proposals.join(own, method).join(others, "question").where(
        F.col("candidate") != F.col(method)).select(method, "question", "candidate")
