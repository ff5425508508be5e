"""The audit of papers against their data: claims, the method each paper names, recomputation, comparison, summary.

One job covers all papers: every step is grouped by the paper's keys, and a method is run once for all papers that name it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_text as ft
from plumbline.operators import claims as cl
from plumbline.operators import compare as cp
from plumbline.operators import registry
from plumbline.operators.joins import eq_join

#: Which result column answers which reported quantity, by method.
RESULT_KINDS: dict[str, dict[str, str]] = {
    "independent_t": {"t": "t", "p": "p", "d": "cohen_d", "n": "n1 + n2"},
    "paired_t": {"t": "t", "p": "p", "n": "n"},
    "anova": {"f": "f", "p": "p", "n": "n_total"},
    "two_way_anova": {"f": "f", "p": "p"},
    "mann_whitney": {"p": "p"},
    "wilcoxon": {"p": "p"},
    "correlation": {"r": "r", "p": "p", "n": "n"},
    "chi_square": {"chi2": "chi2", "p": "p", "n": "n"},
    "linear_regression": {"r2": "r2", "f": "f", "p": "p", "n": "n"},
    "cronbach_alpha": {"alpha": "alpha", "n": "n"},
}


def results_by_kind(
    result: DataFrame, keys: Sequence[str], method: str, digits: Mapping[str, int] | None = None,
) -> DataFrame:
    """A method's result as ``(keys, kind, value)``, one row per reported quantity that it answers.

    ``digits`` rounds a kind to the precision it is reported with.
    """
    wanted = {}
    for kind, expression in RESULT_KINDS[method].items():
        if all(part.strip() in result.columns for part in expression.split("+")):
            value = F.expr(expression).cast("double")
            wanted[kind] = F.round(value, digits[kind]) if digits and kind in digits else value
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in wanted.items()])
    return result.select(*keys, F.inline(rows)).where("value IS NOT NULL")


def named_method(docs: DataFrame, keys: Sequence[str], text: str = "text", among: Sequence[str] | None = None) -> DataFrame:
    """The method of each paper: the first in the order of the method rules that any of its sentences names."""
    order = [m for m, _ in ft.METHOD_PATTERNS if among is None or m in among]
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    found = cl.method_mentions(docs, keys, text).where(F.col("method").isin(*order))
    return found.groupBy(*keys).agg(F.min_by("method", place).alias("method"))


def recompute(
    methods: DataFrame, data: DataFrame, keys: Sequence[str], columns: Mapping[str, Mapping[str, object]],
    value: str | None = None, digits: Mapping[str, int] | None = None,
) -> DataFrame:
    """``(keys, kind, value)`` of each paper's own method; ``columns`` holds the arguments of each runnable method.

    With ``value``, size, mean and standard deviation of that column answer claims that the method does not.
    """
    parts = []
    for method, arguments in columns.items():
        papers = methods.where(F.col("method") == method).select(*keys)
        own = eq_join(data, papers, keys, "left_semi")
        parts.append(results_by_kind(registry.run(method, own, by=keys, **arguments), keys, method, digits))
    if value is not None:
        x = F.col(value).cast("double")
        rows = data.groupBy(*keys).agg(
            F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
        described = rows.select(*keys, F.inline(F.array(*[
            F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("n", "mean", "sd")])))
        parts.append(described.where("value IS NOT NULL"))
    return _preferred(parts, keys)


def _preferred(parts: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One value per kind: a method's own figure comes before the plain description."""
    ranked = [p.withColumn("_place", F.lit(k)) for k, p in enumerate(parts)]
    out = ranked[0]
    for part in ranked[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keys, "kind").agg(F.min_by("value", "_place").alias("value"))


def audit_papers(
    docs: DataFrame, data: DataFrame, keys: Sequence[str], columns: Mapping[str, Mapping[str, object]],
    value: str | None = None, text: str = "text", digits: Mapping[str, int] | None = None,
) -> DataFrame:
    """Every claim of every paper with its recomputed value, ``status`` and ``verdict``.

    ``docs`` holds the texts and ``data`` the study data of all papers, both with the paper's ``keys``.
    """
    found = cl.unique_claims(cl.quantity_claims(docs, keys, text), keys)
    methods = named_method(docs, keys, text, list(columns))
    real = recompute(methods, data, keys, columns, value, digits)
    return cp.summarize_comparisons(cp.compare_claims(found, real, keys))


def audit_summary(audited: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per paper: claims, how many agree, need a look at rounding or at the source data, or had no counterpart."""
    v = F.col("verdict")
    out = audited.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(v == "agrees").alias("n_agree"),
        F.count_if(v == "check_rounding").alias("n_rounding"), F.count_if(v == "check_source_data").alias("n_mismatch"),
        F.count_if(v.isin("not_comparable", "recompute_failed")).alias("n_open"))
    return out.withColumn("verdict", F.when(F.col("n_mismatch") > 0, "check_source_data").when(
        F.col("n_rounding") > 0, "check_rounding").when(F.col("n_agree") > 0, "agrees").otherwise("not_comparable"))
