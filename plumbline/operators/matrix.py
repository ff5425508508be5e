"""Models that need a covariance matrix: regression, reliability, repeated measures, two-way layout.

The data is read by one aggregate of pairwise covariances (k x k numbers per key); the small linear
algebra then runs on those result rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import dist
from plumbline.functions import numbers as num
from plumbline.operators.joins import eq_join
from plumbline.operators.moments import eta_label, levene, listwise

_ARRAY = T.ArrayType(T.DoubleType())


def _value(column: str) -> Column:
    return F.col(f"`{column}`").cast("double")


def covariance(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per key: ``n``, ``means`` and the flattened k x k matrix ``cov``, complete rows only.

    ``covar_samp`` keeps centred sums, so large values do not cancel as raw cross products would.
    """
    k = len(columns)
    frame = listwise(df, list(columns), by)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(_value(c)).alias(f"_m{i}") for i, c in
                                        enumerate(columns)],
        *[F.covar_samp(_value(columns[i]), _value(columns[j])).alias(f"_c{i}_{j}")
          for i, j in pairs])
    flat = [F.col(f"_c{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)]
    return row.select(*by, "n", F.array(*[F.col(f"_m{i}") for i in range(k)]).alias("means"),
                      F.array(*flat).alias("cov"))


_OLS = T.StructType([
    T.StructField("rank_ok", T.BooleanType()), T.StructField("rss", T.DoubleType()),
    T.StructField("tss", T.DoubleType()), T.StructField("beta", _ARRAY),
    T.StructField("unit_se", _ARRAY), T.StructField("vif", _ARRAY),
])


@F.pandas_udf(_OLS)
def _solve_ols(cov: pd.Series, means: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Regression of the first column on the others, from their covariance matrix."""
    out = []
    for flat, centre, rows in zip(cov, means, n):
        k = len(centre) - 1
        s = np.asarray(flat, dtype=float).reshape(k + 1, k + 1)
        m = np.asarray(centre, dtype=float)
        sxx, sxy = s[1:, 1:], s[1:, 0]
        scale = np.sqrt(np.diag(sxx))
        usable = np.isfinite(s).all() and (scale > 0).all()
        if usable:
            usable = np.linalg.matrix_rank(sxx / np.outer(scale, scale), tol=1e-10) == k
        if not usable:
            out.append((False, None, None, None, None, None))
            continue
        inverse = np.linalg.inv(sxx / np.outer(scale, scale)) / np.outer(scale, scale)
        slope = inverse @ sxy
        beta = np.concatenate([[m[0] - slope @ m[1:]], slope])
        tss = (rows - 1) * s[0, 0]
        rss = max((rows - 1) * (s[0, 0] - sxy @ slope), 0.0)
        spread = np.diag(inverse) / (rows - 1)
        first = 1.0 / rows + m[1:] @ inverse @ m[1:] / (rows - 1)
        unit = np.sqrt(np.concatenate([[first], spread]))
        vif = np.concatenate([[np.nan], np.diag(inverse) * np.diag(sxx)])
        out.append((True, rss, tss, beta.tolist(), unit.tolist(),
                    [None if np.isnan(v) else float(v) for v in vif]))
    return pd.DataFrame(out, columns=[f.name for f in _OLS.fields])


def linear_regression(
    df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Least squares: ``(model, coefficients)`` frames, one model row per key.

    Keys with fewer than k + 2 rows or collinear predictors appear with status ``abstained``.
    """
    by, k = list(by), len(xs)
    stats = covariance(df, [y, *xs], by)
    enough = F.col("n") >= k + 2
    solved = stats.withColumn("fit", F.when(enough, _solve_ols("cov", "means", "n")))
    ok = F.coalesce(F.col("fit.rank_ok") & (F.col("fit.tss") > 0), F.lit(False))
    dof = F.col("n") - k - 1
    rss, tss = F.col("fit.rss"), F.col("fit.tss")
    r2 = 1 - rss / tss
    f = F.try_divide((tss - rss) / k, rss / dof)
    model = solved.select(
        *by, "n", F.lit(k).cast("long").alias("df1"), dof.alias("df2"),
        F.when(ok, "ok").otherwise("abstained").alias("status"),
        F.when(ok, r2).alias("r2"), F.when(ok, 1 - (1 - r2) * (F.col("n") - 1) / dof).alias("adj_r2"),
        F.when(ok, f).alias("f"), F.when(ok, rss).alias("rss"), F.when(ok, tss).alias("tss"),
    ).withColumn("p", dist.p_f(F.col("f"), F.col("df1"), F.col("df2")))
    names = F.array(F.lit("(intercept)"), *[F.lit(x) for x in xs])
    sigma = F.sqrt(rss / dof)
    rows = solved.where(ok).select(
        *by, dof.alias("df"), sigma.alias("sigma"),
        F.posexplode(F.arrays_zip(
            names.alias("term"), F.col("fit.beta").alias("beta"),
            F.col("fit.unit_se").alias("unit_se"), F.col("fit.vif").alias("vif"))))
    coefficient = rows.select(
        *by, F.col("pos").cast("long").alias("position"), F.col("col.term").alias("term"),
        F.col("col.beta").alias("beta"), (F.col("col.unit_se") * F.col("sigma")).alias("se"),
        F.col("col.vif").alias("vif"), "df")
    t = F.try_divide(F.col("beta"), F.col("se"))
    half = dist.q_t(0.975, F.col("df")) * F.col("se")
    return model, coefficient.withColumns({
        "t": t, "p": dist.p_t(t, F.col("df")), "ci_low": F.col("beta") - half,
        "ci_high": F.col("beta") + half})


# ---- logistic regression ---------------------------------------------------------------------

def logistic_regression(
    df: DataFrame, y: str, xs: Sequence[str], max_steps: int = 100, tolerance: float = 1e-8
) -> tuple[DataFrame, DataFrame]:
    """Binary logit by Newton steps; each step is one distributed aggregate of k x k sums.

    The two classes are ordered by value; the larger one is 1.  Returns ``(model, coefficients)``.
    """
    k = len(xs)
    frame = listwise(df, [y, *xs])
    labels = [r[0] for r in frame.select(y).distinct().orderBy(y).limit(3).collect()]
    if len(labels) != 2:
        raise ValueError(f"{y} has {len(labels)} classes (two are needed)")
    design = frame.select(
        (F.col(y) == F.lit(labels[1])).cast("double").alias("y"),
        *[_value(x).alias(f"x{i}") for i, x in enumerate(xs, 1)]).persist()
    try:
        n, ones = design.agg(F.count(F.lit(1)), F.sum("y")).first()
        if n < k + 5:
            raise ValueError(f"{n} rows are too few for {k} predictors")
        columns = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, k + 1)]]
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        beta, converged = np.zeros(k + 1), False

        def information(b: np.ndarray):
            eta = sum((F.lit(float(v)) * c for v, c in zip(b[1:], columns[1:])), F.lit(float(b[0])))
            mu = 1.0 / (1.0 + F.exp(-F.greatest(F.least(eta, F.lit(500.0)), F.lit(-500.0))))
            step = design.withColumn("mu", mu).withColumn(
                "w", F.greatest(F.col("mu") * (1 - F.col("mu")), F.lit(1e-10)))
            eps = 1e-12
            row = step.agg(
                *[F.sum(c * (F.col("y") - F.col("mu"))).alias(f"g{i}")
                  for i, c in enumerate(columns)],
                *[F.sum(F.col("w") * columns[i] * columns[j]).alias(f"h{i}_{j}") for i, j in pairs],
                F.sum(F.col("y") * F.ln(F.col("mu") + eps)
                      + (1 - F.col("y")) * F.ln(1 - F.col("mu") + eps)).alias("ll"),
                F.avg(((F.col("mu") >= 0.5) == (F.col("y") == 1.0)).cast("double")).alias("acc"),
            ).first()
            hessian = np.zeros((k + 1, k + 1))
            for i, j in pairs:
                hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"]
            return np.array([row[f"g{i}"] for i in range(k + 1)]), hessian, row["ll"], row["acc"]

        steps = 0
        while steps < max_steps and not converged:
            gradient, hessian, _, _ = information(beta)
            delta = np.linalg.pinv(hessian + 1e-10 * np.eye(k + 1)) @ gradient \
                if np.linalg.cond(hessian) > 1e15 else np.linalg.solve(hessian, gradient)
            beta = beta + delta
            steps += 1
            converged = bool(np.max(np.abs(delta)) < tolerance)
        _, hessian, ll, accuracy = information(beta)
    finally:
        design.unpersist()
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hessian)), 0.0))
    share = ones / n
    ll_null = n * (share * np.log(share + 1e-12) + (1 - share) * np.log(1 - share + 1e-12))
    separated = bool(accuracy >= 0.999 or np.max(np.abs(beta)) > 15)
    spark = df.sparkSession
    model = spark.createDataFrame(
        [(int(n), str(labels[0]), str(labels[1]), int(ones), steps, converged, float(ll),
          float(ll_null), float(1 - ll / ll_null), float(accuracy), separated)],
        "n long, label0 string, label1 string, n1 long, steps int, converged boolean, "
        "log_likelihood double, null_log_likelihood double, mcfadden_r2 double, accuracy double, "
        "separation boolean")
    rows = [(i, t, float(b), float(s)) for i, (t, b, s) in
            enumerate(zip(["(intercept)", *xs], beta, se))]
    coefficient = spark.createDataFrame(rows, "position long, term string, beta double, se double")
    z = F.try_divide(F.col("beta"), F.col("se"))
    limit = lambda c: F.exp(F.least(F.greatest(c, F.lit(-300.0)), F.lit(300.0)))
    half = F.lit(1.959963984540054) * F.col("se")
    return model, coefficient.withColumns({
        "z": z, "p": dist.p_norm(z), "odds_ratio": limit(F.col("beta")),
        "or_low": limit(F.col("beta") - half), "or_high": limit(F.col("beta") + half)})


# ---- reliability -----------------------------------------------------------------------------

def alpha_grade(alpha: Column) -> Column:
    return (
        F.when(alpha >= 0.9, "excellent").when(alpha >= 0.8, "good")
        .when(alpha >= 0.7, "acceptable").when(alpha.isNotNull(), "low"))


def _sum_of(items: Sequence[str]) -> Column:
    return sum((_value(c) for c in items[1:]), _value(items[0]))


def _alpha(items: Sequence[str], tag: str) -> tuple[list[Column], Column]:
    """Aggregates and final expression of alpha over rows complete in ``items``."""
    full = F.lit(True)
    for c in items:
        full = full & _value(c).isNotNull()
    k = len(items)
    aggs = [F.count_if(full).alias(f"{tag}_n"),
            F.var_samp(F.when(full, _sum_of(items))).alias(f"{tag}_t")]
    aggs += [F.var_samp(F.when(full, _value(c))).alias(f"{tag}_v{i}") for i, c in enumerate(items)]
    parts = sum((F.col(f"{tag}_v{i}") for i in range(1, k)), F.col(f"{tag}_v0"))
    value = F.lit(k / (k - 1.0)) * (1 - F.try_divide(parts, F.col(f"{tag}_t")))
    return aggs, F.when((F.col(f"{tag}_n") >= 3) & (F.col(f"{tag}_t") > 0), value)


def cronbach_alpha(
    df: DataFrame, items: Sequence[str], by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Cronbach's alpha, and per item the corrected item-total r and alpha without the item.

    Alpha without an item uses all rows complete in the remaining items.
    """
    by, items = list(by), list(items)
    if len(items) < 2:
        raise ValueError("reliability needs at least two items")
    aggs, alpha = _alpha(items, "all")
    full = F.lit(True)
    for c in items:
        full = full & _value(c).isNotNull()
    deleted = []
    for i, c in enumerate(items):
        rest = [o for o in items if o != c]
        aggs.append(num.safe_corr(F.when(full, _value(c)), F.when(full, _sum_of(rest))).alias(f"_r{i}"))
        if len(rest) >= 2:
            more, value = _alpha(rest, f"del{i}")
            aggs += more
        else:
            value = F.lit(None).cast("double")
        deleted.append(value)
    row = df.select(*by, *items).groupBy(*by).agg(*aggs)
    overall = row.select(*by, F.lit(len(items)).cast("long").alias("k"),
                         F.col("all_n").alias("n"), alpha.alias("alpha"),
                         alpha_grade(alpha).alias("grade"))
    per_item = row.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("item"), F.col(f"_r{i}").alias("item_total_r"),
                 deleted[i].alias("alpha_if_deleted"))
        for i, c in enumerate(items)])))
    return overall, per_item


# ---- repeated measures -----------------------------------------------------------------------

_SPHERICITY = T.StructType([
    T.StructField("w", T.DoubleType()), T.StructField("epsilon", T.DoubleType())])


@F.pandas_udf(_SPHERICITY)
def _sphericity(cov: pd.Series) -> pd.DataFrame:
    """Mauchly's W and the Greenhouse-Geisser epsilon of a flattened covariance matrix."""
    out = []
    for flat in cov:
        k = int(round(len(flat) ** 0.5))
        s = np.asarray(flat, dtype=float).reshape(k, k)
        if not np.isfinite(s).all():
            out.append((None, None))
            continue
        # orthonormal contrasts: what is left of the identity once the constant is removed
        basis = np.linalg.svd(np.eye(k) - 1.0 / k)[0][:, : k - 1]
        c = basis.T @ s @ basis
        trace, m = np.trace(c), k - 1
        if trace <= 0:
            out.append((None, 1.0))
            continue
        w = np.linalg.det(c / (trace / m))
        eps = trace ** 2 / (m * (c ** 2).sum())
        out.append((float(w), float(min(max(eps, 1.0 / m), 1.0))))
    return pd.DataFrame(out, columns=["w", "epsilon"])


def repeated_measures_anova(
    df: DataFrame, times: Sequence[str], by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Repeated-measures analysis of a wide frame: ``(model, pairs)``.

    All sums of squares follow from the covariance matrix of the time columns.  Mauchly's chi-square
    uses the textbook factor (n - 1) - (2m^2 + m + 2) / (6m).
    """
    by, k = list(by), len(times)
    if k < 3:
        raise ValueError("repeated measures need at least three time columns")
    stats = covariance(df, times, by).where("n >= 3")
    n, m = F.col("n"), k - 1
    means = [F.col("means")[j] for j in range(k)]
    grand = sum(means[1:], means[0]) / k
    at = lambda i, j: F.col("cov")[i * k + j]
    trace = sum((at(i, i) for i in range(1, k)), at(0, 0))
    whole = sum((at(i, j) for i in range(k) for j in range(k) if i or j), at(0, 0))
    terms = [F.pow(x - grand, F.lit(2)) for x in means]
    model = stats.withColumns({
        "ss_time": n * sum(terms[1:], terms[0]),
        "ss_subject": (n - 1) * whole / k,
        "ss_error": F.greatest((n - 1) * (trace - whole / k), F.lit(0.0)),
        "df_time": F.lit(m).cast("long"), "df_subject": n - 1, "df_error": (n - 1) * m,
        "_s": _sphericity("cov"),
    })
    f = F.try_divide(F.col("ss_time") / m, F.col("ss_error") / F.col("df_error"))
    w = F.least(F.greatest(F.col("_s.w"), F.lit(1e-12)), F.lit(1.0))
    factor = (n - 1) - (2.0 * m * m + m + 2) / (6.0 * m)
    df_w = k * (k - 1) // 2 - 1
    model = model.select(
        *by, "n", "ss_time", "ss_subject", "ss_error", "df_time", "df_subject", "df_error",
        f.alias("f"),
        F.try_divide(F.col("ss_time"), F.col("ss_time") + F.col("ss_error")).alias("partial_eta2"),
        F.col("_s.w").alias("mauchly_w"), (-factor * F.ln(w)).alias("mauchly_chi2"),
        F.lit(df_w).cast("long").alias("mauchly_df"), F.col("_s.epsilon").alias("epsilon_gg"),
    ).withColumns({
        "p": dist.p_f(F.col("f"), F.col("df_time"), F.col("df_error")),
        "p_gg": dist.p_f(F.col("f"), F.col("df_time") * F.col("epsilon_gg"),
                         F.col("df_error") * F.col("epsilon_gg")),
        "mauchly_p": dist.p_chi2(F.col("mauchly_chi2"), F.col("mauchly_df")),
        "effect": eta_label(F.col("partial_eta2")),
    })
    n_pairs = k * (k - 1) // 2
    structs = []
    for i, j in combinations(range(k), 2):
        diff = means[i] - means[j]
        sd = F.sqrt(F.greatest(at(i, i) + at(j, j) - 2 * at(i, j), F.lit(0.0)))
        structs.append(F.struct(
            F.lit(times[i]).alias("a"), F.lit(times[j]).alias("b"), diff.alias("mean_diff"),
            sd.alias("sd_diff")))
    pairs = stats.select(*by, (n - 1).alias("df"), n.alias("n"), F.inline(F.array(*structs)))
    t = F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt("n"))
    pairs = pairs.withColumns({
        "t": t, "p": F.least(F.lit(1.0), dist.p_t(t, F.col("df")) * n_pairs),
        "d_z": F.try_divide(F.col("mean_diff"), F.col("sd_diff"))})
    return model, pairs


# ---- two-way layout --------------------------------------------------------------------------

def cell_stats(df: DataFrame, a: str, b: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return listwise(df, [a, b, y], by).groupBy(
        *by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(_value(y)).alias("m"), F.var_samp(_value(y)).alias("v"))


def marginal_means(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Cell, marginal and overall means in one grouping-sets aggregate."""
    frame = listwise(df, [a, b, y])
    return frame.cube(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"),
        F.avg(_value(y)).alias("mean"))


def _coding(levels: Sequence[str], labels: np.ndarray, coding: str) -> np.ndarray:
    """Columns of one factor: all levels but one, in sum-to-zero or treatment coding."""
    base = levels[-1] if coding == "sum" else levels[0]
    used = [lv for lv in levels if lv != base]
    x = np.stack([(labels == lv).astype(float) for lv in used], axis=1)
    return x - (labels == base).astype(float)[:, None] if coding == "sum" else x


def _two_way_solver(keys: Sequence[str], coding: str):
    """Sums of squares of A, B and A x B from the cell table of one key."""

    def residual(x: np.ndarray, root: np.ndarray, target: np.ndarray) -> float:
        fit = np.linalg.lstsq(x * root[:, None], target, rcond=None)[0]
        return float(((target - (x * root[:, None]) @ fit) ** 2).sum())

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        key = [cells[k].iloc[0] for k in keys]
        la, lb = sorted(cells["a"].unique()), sorted(cells["b"].unique())
        n = cells["n"].to_numpy(dtype=float)
        mean = cells["m"].to_numpy(dtype=float)
        within = float((np.nan_to_num(cells["v"].to_numpy(dtype=float)) * (n - 1)).sum())
        grand = (n * mean).sum() / n.sum()
        total = within + float((n * (mean - grand) ** 2).sum())
        rows = []
        if len(la) >= 2 and len(lb) >= 2:
            xa = _coding(la, cells["a"].to_numpy(), coding)
            xb = _coding(lb, cells["b"].to_numpy(), coding)
            xab = (xa[:, :, None] * xb[:, None, :]).reshape(len(cells), -1)
            one = np.ones((len(cells), 1))
            root = np.sqrt(n)
            # means are centred first: only differences between cells matter
            target = root * (mean - grand)
            full = residual(np.hstack([one, xa, xb, xab]), root, target)
            dof = n.sum() - (1 + xa.shape[1] + xb.shape[1] + xab.shape[1])
            error = within + full
            for term, parts, df_term in (
                ("a", [one, xb, xab], xa.shape[1]), ("b", [one, xa, xab], xb.shape[1]),
                ("ab", [one, xa, xb], xab.shape[1]),
            ):
                ss = max(residual(np.hstack(parts), root, target) - full, 0.0)
                rows.append((*key, term, ss, float(df_term), error, float(dof), total,
                             len(cells) == len(la) * len(lb)))
        names = [*keys, "term", "ss", "df", "ss_error", "df_error", "ss_total", "complete"]
        return pd.DataFrame(rows, columns=names)

    return solve


def two_way_anova(
    df: DataFrame, a: str, b: str, y: str, by: Sequence[str] = (), coding: str = "sum",
    with_levene: bool = True,
) -> DataFrame:
    """Two-way analysis of variance, one row per term (a, b, ab).

    The data is reduced to cell counts, means and variances; the normal equations see only cells.
    ``coding='treatment'`` tests the main effects at the first level of the other factor.
    """
    if coding not in ("sum", "treatment"):
        raise ValueError("coding is 'sum' or 'treatment'")
    by = list(by)
    cells = cell_stats(df, a, b, y, by)
    fields = [f for f in cells.schema.fields if f.name in by]
    schema = T.StructType(fields + [
        T.StructField("term", T.StringType()), T.StructField("ss", T.DoubleType()),
        T.StructField("df", T.DoubleType()), T.StructField("ss_error", T.DoubleType()),
        T.StructField("df_error", T.DoubleType()), T.StructField("ss_total", T.DoubleType()),
        T.StructField("complete", T.BooleanType())])
    terms = cells.groupBy(*by).applyInPandas(_two_way_solver(by, coding), schema)
    f = F.try_divide(F.col("ss") / F.col("df"), F.col("ss_error") / F.col("df_error"))
    eta2 = F.try_divide(F.col("ss"), F.col("ss_total"))
    out = terms.where("df_error > 0").withColumns({
        "f": f, "p": dist.p_f(f, F.col("df"), F.col("df_error")), "eta2": eta2,
        "effect": eta_label(eta2)})
    if with_levene:
        cell = F.concat_ws("\u0001", F.col(a).cast("string"), F.col(b).cast("string"))
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        frame = df.select(*by, F.when(both, cell).alias("cell"), y)
        # a cell with a single row carries no spread
        lev = levene(frame, "cell", y, by, min_n=2).select(
            *by, F.col("w").alias("levene_w"), F.col("p").alias("levene_p"))
        out = eq_join(out, lev, by)
    return out
