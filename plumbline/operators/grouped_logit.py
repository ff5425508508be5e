"""Binary logit of every group at once: Newton steps over one grouped aggregate of gradients and Hessians.

A step joins each group's coefficients to its rows and sums the gradient and the Hessian per group, combined before the shuffle,
so a large group is no large task.  The small systems are solved in Arrow batches of groups.  Groups that have converged leave the rows of the next step; the driver sees one
count a step.

Cases: rows with a null in the outcome, a predictor or a group are left out; a group without exactly two outcomes, or with fewer rows than
predictors + 5, is ``abstained`` with null figures; a group that still moves after ``max_steps`` is ``not converged``; an accuracy of 0.999 or more, or a coefficient beyond 15,
marks ``separation``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import dist
from plumbline.operators.joins import small_side
from plumbline.session import pin

_EPS = 1e-12


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x, np.float64).ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _hessians(upper: np.ndarray, k: int) -> np.ndarray:
    i, j = np.triu_indices(k)
    full = np.zeros((len(upper), k, k))
    full[:, i, j] = upper
    full[:, j, i] = upper
    return full


def _solve(k: int, tolerance: float):
    """``grp, beta, gradient, upper`` to the next coefficients and whether they have settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            beta, gradient = _matrix(batch.column(1), k), _matrix(batch.column(2), k)
            h = _hessians(_matrix(batch.column(3), k * (k + 1) // 2), k)
            delta = np.einsum("gij,gj->gi", np.linalg.pinv(h, hermitian=True), gradient)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(beta + delta), pa.array(np.abs(delta).max(1) < tolerance)], names=["grp", "beta", "settled"])

    return run


def _errors(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = _hessians(_matrix(batch.column(1), k * (k + 1) // 2), k)
            inverse = np.linalg.pinv(h, hermitian=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(np.sqrt(np.maximum(np.diagonal(inverse, axis1=1, axis2=2), 0)))], names=["grp", "se"])

    return run


def _sums(design: DataFrame, beta: DataFrame, k: int) -> DataFrame:
    """``grp, beta`` with gradient, upper Hessian, log likelihood and accuracy of each group at its coefficients."""
    rows = design.join(small_side(beta), "grp")
    x = [F.lit(1.0), *[F.col("x")[i] for i in range(k - 1)]]
    eta = sum((F.col("beta")[i] * x[i] for i in range(1, k)), F.col("beta")[0])
    at = rows.withColumn("mu", 1.0 / (1.0 + F.exp(-F.greatest(F.least(eta, F.lit(500.0)), F.lit(-500.0)))))
    w = F.greatest(F.col("mu") * (1 - F.col("mu")), F.lit(1e-10))
    return at.groupBy("grp").agg(
        F.first("beta").alias("beta"), F.array(*[F.sum(c * (F.col("y") - F.col("mu"))) for c in x]).alias("gradient"),
        F.array(*[F.sum(w * x[i] * x[j]) for i in range(k) for j in range(i, k)]).alias("upper"),
        F.sum(F.col("y") * F.ln(F.col("mu") + _EPS) + (1 - F.col("y")) * F.ln(1 - F.col("mu") + _EPS)).alias("ll"),
        F.avg(((F.col("mu") >= 0.5) == (F.col("y") == 1.0)).cast("double")).alias("accuracy"))


def grouped_logistic(
    df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], max_steps: int = 50, tolerance: float = 1e-8,
) -> tuple[DataFrame, DataFrame]:
    """``(model, coefficients)`` with one model for each value of ``by``; of a group's two outcomes the larger one is 1."""
    k = len(xs) + 1
    used = [y, *xs, *by]
    full = df.dropna(subset=used)
    rows = full.select(F.struct(*by).alias("grp"), F.col(y).alias("label"), F.array(*[F.col(c).cast("double") for c in xs]).alias("x"))
    ends = pin(rows.groupBy("grp").agg(
        F.min("label").alias("label0"), F.max("label").alias("label1"), F.count_distinct("label").alias("labels"), F.count(F.lit(1)).alias("n")))
    able = (F.col("labels") == 2) & (F.col("n") >= len(xs) + 5)
    usable = ends.where(able)
    design = pin(rows.join(small_side(usable.select("grp", "label1")), "grp").select(
        "grp", (F.col("label") == F.col("label1")).cast("double").alias("y"), "x"))
    schema = f"grp {rows.schema['grp'].dataType.simpleString()}"
    active = usable.select("grp", F.array(*[F.lit(0.0)] * k).alias("beta"))
    done = None
    for step in range(1, max_steps + 1):
        moved = pin(_sums(design, active, k).select("grp", "beta", "gradient", "upper").mapInArrow(
            _solve(k, tolerance), f"{schema}, beta array<double>, settled boolean"))
        last = step == max_steps
        ended = moved.where(F.lit(True) if last else F.col("settled")).select(
            "grp", "beta", F.col("settled").alias("converged"), F.lit(step).alias("steps"))
        done = ended if done is None else done.unionByName(ended)
        active = moved.where(~F.col("settled")).select("grp", "beta")
        if last or active.isEmpty():
            break
    done = pin(done)
    final = pin(_sums(design, done.select("grp", "beta"), k))
    ones = design.groupBy("grp").agg(F.sum("y").cast("long").alias("n1"))
    share = F.col("n1") / F.col("n")
    null = F.col("n") * (share * F.ln(share + _EPS) + (1 - share) * F.ln(1 - share + _EPS))
    far = F.exists("beta", lambda b: F.abs(b) > 15)
    model = ends.join(ones, "grp", "left").join(done.select("grp", "converged", "steps"), "grp", "left").join(
        final.select("grp", "beta", "ll", "accuracy"), "grp", "left").select(
        *[F.col(f"grp.{c}").alias(c) for c in by], "n", F.col("label0").cast("string").alias("label0"), F.col("label1").cast("string").alias("label1"),
        "n1", F.when(F.col("converged").isNull(), "abstained").when(F.col("converged"), "ok").otherwise("not converged").alias("status"), "steps",
        F.col("ll").alias("log_likelihood"), F.when(F.col("ll").isNotNull(), null).alias("null_log_likelihood"),
        (1 - F.try_divide(F.col("ll"), null)).alias("mcfadden_r2"), "accuracy", ((F.col("accuracy") >= 0.999) | far).alias("separation"))
    errors = final.select("grp", "upper").mapInArrow(_errors(k), f"{schema}, se array<double>")
    terms = final.select("grp", "beta").join(errors, "grp").select("grp", F.posexplode(F.arrays_zip(
        F.array(F.lit("(intercept)"), *[F.lit(c) for c in xs]).alias("term"), "beta", "se")))
    beta, se = F.col("beta"), F.col("se")
    z = F.try_divide(beta, se)
    limit = lambda c: F.exp(F.least(F.greatest(c, F.lit(-300.0)), F.lit(300.0)))
    half = F.lit(1.959963984540054) * se
    coefficients = terms.select(
        *[F.col(f"grp.{c}").alias(c) for c in by], F.col("pos").cast("long").alias("position"), F.col("col.term").alias("term"),
        F.col("col.beta").alias("beta"), F.col("col.se").alias("se")).withColumns({
            "z": z, "p": dist.p_norm(z), "odds_ratio": limit(beta), "or_low": limit(beta - half), "or_high": limit(beta + half)})
    return model, coefficients
