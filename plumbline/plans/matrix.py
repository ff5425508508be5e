"""Covariance-based models over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import matrix as mx
from plumbline.operators.grouped_logit import grouped_logistic
from plumbline.plans import oracle_math as om
from plumbline.plans.catalog import Tables, query, rounded
from plumbline.plans.quality import FACTOR_SQL, factor_items

# two-predictor least squares by determinants of centred cross products
_OLS2 = """
s AS (SELECT {key} count(*) AS n, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb,
             covar_pop({a}, {a}) * count(*) AS saa, covar_pop({b}, {b}) * count(*) AS sbb,
             covar_pop({a}, {b}) * count(*) AS sab, covar_pop({a}, {y}) * count(*) AS say,
             covar_pop({b}, {y}) * count(*) AS sby, covar_pop({y}, {y}) * count(*) AS syy
      FROM {table} {group}),
c AS (SELECT *, saa * sbb - sab * sab AS det, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS b1,
             (sby * saa - say * sab) / (saa * sbb - sab * sab) AS b2 FROM s),
m AS (SELECT *, syy - b1 * say - b2 * sby AS rss, n - 3 AS dof, my - b1 * ma - b2 * mb AS b0 FROM c)"""

_LINE = _OLS2.format(key="", y="l_extendedprice", a="l_quantity", b="l_discount", table="lineitem",
                     group="")
_PER = _OLS2.format(key="l_suppkey,", y="l_extendedprice", a="l_quantity", b="l_discount",
                    table="lineitem", group="GROUP BY l_suppkey")


@query("ols_price", f"""
WITH {_LINE},
r AS (SELECT 0 AS position, '(intercept)' AS term, b0 AS beta,
        sqrt(rss / dof * (1.0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)) AS se, NULL AS vif, dof FROM m
      UNION ALL SELECT 1, 'l_quantity', b1, sqrt(rss / dof * sbb / det), saa * sbb / det, dof FROM m
      UNION ALL SELECT 2, 'l_discount', b2, sqrt(rss / dof * saa / det), saa * sbb / det, dof FROM m)
SELECT position::BIGINT AS position, term, round(beta, 3) AS beta, round(se, 3) AS se, round(vif, 6) AS vif,
       round(beta / se, 4) AS t, round({om.t_two_sided("beta / se", "dof")}, 5) AS p FROM r""")
def ols_price(t: Tables):
    _, coef = mx.linear_regression(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return rounded(coef.select("position", "term", "beta", "se", "vif", "t", "p"), 5,
                   beta=3, se=3, vif=6, t=4)


@query("ols_model_per_supplier", f"""
WITH {_PER}
SELECT l_suppkey, n, 2::BIGINT AS df1, dof AS df2, 'ok' AS status, round(1 - rss / syy, 6) AS r2,
       round(1 - (rss / syy) * (n - 1) / dof, 6) AS adj_r2,
       round(((syy - rss) / 2) / (rss / dof), 3) AS f FROM m""")
def ols_model_per_supplier(t: Tables):
    model, _ = mx.linear_regression(
        t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], by=["l_suppkey"])
    return rounded(model.select("l_suppkey", "n", "df1", "df2", "status", "r2", "adj_r2", "f"), 6, f=3)


@query("ols_abstains_on_collinear", """
SELECT count(*) AS n, 'abstained' AS status, NULL::DOUBLE AS r2 FROM part""")
def ols_abstains_on_collinear(t: Tables):
    twice = t("part").withColumn("double_size", F.col("p_size") * 2)
    model, _ = mx.linear_regression(twice, "p_retailprice", ["p_size", "double_size"])
    return rounded(model.select("n", "status", "r2"))


@query("logit_toxic")
def logit_toxic(t: Tables):
    """Newton steps are iterative; the tests compare with a direct solution."""
    frame = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").withColumn(
        "log_chars", F.ln(F.col("n_chars").cast("double")))
    _, coef = mx.logistic_regression(frame, "toxic", ["log_chars"])
    return rounded(coef.select("position", "term", "beta", "se", "odds_ratio"), 5)


@query("logit_per_priority", """
WITH RECURSIVE d AS (SELECT o_orderpriority AS g, (o_orderstatus = 'O')::INT::DOUBLE AS y, o_totalprice::DOUBLE / 100000.0 AS x
  FROM orders WHERE o_orderstatus IN ('F', 'O')),
it(g, step, b0, b1) AS (SELECT DISTINCT g, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM d
  UNION ALL SELECT g, step + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT g, step, b0, b1, sum(y - mu) AS g0, sum(x * (y - mu)) AS g1, sum(mu * (1 - mu)) AS h00,
          sum(mu * (1 - mu) * x) AS h01, sum(mu * (1 - mu) * x * x) AS h11
        FROM (SELECT it.*, d.x, d.y, 1 / (1 + exp(-(b0 + b1 * d.x))) AS mu FROM it JOIN d ON d.g = it.g WHERE step < 12) GROUP BY g, step, b0, b1)),
e AS (SELECT it.g, b0, b1, sum(mu * (1 - mu)) AS h00, sum(mu * (1 - mu) * x) AS h01, sum(mu * (1 - mu) * x * x) AS h11
  FROM (SELECT it.*, d.x, 1 / (1 + exp(-(b0 + b1 * d.x))) AS mu FROM it JOIN d ON d.g = it.g WHERE step = 12) AS it GROUP BY it.g, b0, b1)
SELECT g AS o_orderpriority, 0::BIGINT AS position, '(intercept)' AS term, round(b0, 6) AS beta, round(sqrt(h11 / (h00 * h11 - h01 * h01)), 6) AS se FROM e
UNION ALL SELECT g, 1, 'price', round(b1, 6), round(sqrt(h00 / (h00 * h11 - h01 * h01)), 6) FROM e""")
def logit_per_priority(t: Tables):
    """One model for each priority: whether an order is open, by its price."""
    rows = t("orders").where(F.col("o_orderstatus").isin("F", "O")).withColumn("price", F.col("o_totalprice").cast("double") / 100000.0)
    _, coef = grouped_logistic(rows, "o_orderstatus", ["price"], ["o_orderpriority"])
    return rounded(coef.select("o_orderpriority", "position", "term", "beta", "se"), 6)


@query("logit_single_class_effect", """
WITH c AS (SELECT count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'A')::DOUBLE AS a1,
                  count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'A')::DOUBLE AS a0,
                  count(*) FILTER (l_linestatus = 'O' AND l_returnflag <> 'A')::DOUBLE AS b1,
                  count(*) FILTER (l_linestatus = 'F' AND l_returnflag <> 'A')::DOUBLE AS b0 FROM lineitem)
SELECT 0::BIGINT AS position, '(intercept)' AS term, round(ln(b1 / b0), 6) AS beta,
       round(sqrt(1 / b1 + 1 / b0), 6) AS se FROM c
UNION ALL SELECT 1, 'is_a', round(ln((a1 / a0) / (b1 / b0)), 6),
       round(sqrt(1 / a1 + 1 / a0 + 1 / b1 + 1 / b0), 6) FROM c""")
def logit_single_class_effect(t: Tables):
    """With one binary predictor the maximum-likelihood fit has a closed form to compare with."""
    frame = t("lineitem").select("l_linestatus", (F.col("l_returnflag") == "A").cast("int").alias("is_a"))
    _, coef = mx.logistic_regression(frame, "l_linestatus", ["is_a"])
    return rounded(coef.select("position", "term", "beta", "se"), 6)


_K = 5
_VARS = " + ".join(f"var_samp(q{i})" for i in range(1, _K + 1))
_TOTAL = " + ".join(f"q{i}" for i in range(1, _K + 1))


def _rest(i: int) -> list[str]:
    return [f"q{j}" for j in range(1, _K + 1) if j != i]


_ITEM_ROWS = " UNION ALL ".join(
    f"SELECT 'q{i}' AS item, round(corr(q{i}, {' + '.join(_rest(i))}), 6) AS item_total_r, "
    f"round(4 / 3.0 * (1 - ({' + '.join(f'var_samp({c})' for c in _rest(i))}) / "
    f"var_samp({' + '.join(_rest(i))})), 6) AS alpha_if_deleted FROM w" for i in range(1, _K + 1))


@query("cronbach", f"""
WITH w AS ({FACTOR_SQL})
SELECT 5::BIGINT AS k, count(*) AS n, round(5 / 4.0 * (1 - ({_VARS}) / var_samp({_TOTAL})), 6) AS alpha
FROM w WHERE {_TOTAL} IS NOT NULL""")
def cronbach(t: Tables):
    overall, _ = mx.cronbach_alpha(factor_items(t), [f"q{i}" for i in range(1, _K + 1)])
    return rounded(overall.drop("grade"))


@query("cronbach_items", f"WITH w AS ({FACTOR_SQL}) {_ITEM_ROWS}")
def cronbach_items(t: Tables):
    _, per = mx.cronbach_alpha(factor_items(t), [f"q{i}" for i in range(1, _K + 1)])
    return rounded(per)


# ---- repeated measures -----------------------------------------------------------------------

_TIMES = ("click", "purchase", "signup", "view")
_RM_WIDE = f"""
w AS (SELECT user_id, {", ".join(f"avg(value) FILTER (event_type = '{e}') AS {e}" for e in _TIMES)}
      FROM events GROUP BY user_id),
l AS (SELECT * FROM w WHERE {" AND ".join(f"{e} IS NOT NULL" for e in _TIMES)}),
u AS (SELECT user_id, unnest(['{"', '".join(_TIMES)}']) AS tm, unnest([{", ".join(_TIMES)}]) AS x FROM l),
g AS (SELECT avg(x) AS grand, count(DISTINCT user_id) AS n FROM u),
st AS (SELECT sum((x - grand) ** 2) AS v FROM u, g),
ss AS (SELECT 4 * sum((m - grand) ** 2) AS v FROM (SELECT user_id, avg(x) AS m FROM u GROUP BY user_id), g),
sm AS (SELECT max(n) * sum((m - grand) ** 2) AS v FROM (SELECT tm, avg(x) AS m FROM u GROUP BY tm), g),
a AS (SELECT n, sm.v AS ss_time, ss.v AS ss_subject, st.v - ss.v - sm.v AS ss_error FROM g, st, ss, sm),
f AS (SELECT *, (ss_time / 3) / (ss_error / ((n - 1) * 3)) AS f FROM a)"""


def _wide(t: Tables):
    return t("events").groupBy("user_id").pivot("event_type", list(_TIMES)).agg(F.avg("value"))


@query("rm_anova", f"""
WITH {_RM_WIDE}
SELECT n, round(ss_time, 4) AS ss_time, round(ss_subject, 3) AS ss_subject, round(ss_error, 3) AS ss_error,
       3::BIGINT AS df_time, (n - 1) * 3 AS df_error, round(f, 5) AS f,
       round({om.f_upper("f", "3", "(n - 1) * 3")}, 5) AS p,
       round(ss_time / (ss_time + ss_error), 6) AS partial_eta2 FROM f""")
def rm_anova(t: Tables):
    model, _ = mx.repeated_measures_anova(_wide(t), list(_TIMES))
    return rounded(model.select("n", "ss_time", "ss_subject", "ss_error", "df_time", "df_error", "f",
                                "p", "partial_eta2"), 5, ss_time=4, ss_subject=3, ss_error=3,
                   partial_eta2=6)


@query("rm_anova_pairs", f"""
WITH {_RM_WIDE},
p AS (SELECT a, b, count(*) AS n, avg(xa - xb) AS d, stddev_samp(xa - xb) AS sd FROM (
        SELECT x.tm AS a, y.tm AS b, x.x AS xa, y.x AS xb FROM u x JOIN u y ON x.user_id = y.user_id AND x.tm < y.tm)
      GROUP BY a, b)
SELECT a, b, n, n - 1 AS df, round(d, 5) AS mean_diff, round(sd, 5) AS sd_diff,
       round(d / (sd / sqrt(n)), 5) AS t,
       round(least(1, 6 * {om.t_two_sided("d / (sd / sqrt(n))", "n - 1")}), 5) AS p,
       round(d / sd, 6) AS d_z FROM p""")
def rm_anova_pairs(t: Tables):
    _, pairs = mx.repeated_measures_anova(_wide(t), list(_TIMES))
    return rounded(pairs.select("a", "b", "n", "df", "mean_diff", "sd_diff", "t", "p", "d_z"), 5, d_z=6)


@query("rm_sphericity")
def rm_sphericity(t: Tables):
    """Determinant and trace of a contrast covariance; checked against numpy in the tests."""
    model, _ = mx.repeated_measures_anova(_wide(t), list(_TIMES))
    return rounded(model.select("n", "mauchly_w", "mauchly_chi2", "mauchly_df", "epsilon_gg"), 5)


# ---- two-way layout --------------------------------------------------------------------------
# sum-to-zero coding on a complete 3 x 2 table, by contrasts of unweighted cell means

_CELLS = """
c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m,
             coalesce(var_samp(l_extendedprice), 0) AS v FROM lineitem GROUP BY ALL),
e AS (SELECT sum((n - 1) * v) AS ss_error, sum(n) - count(*) AS df_error FROM c)"""


@query("two_way_b_effect", f"""
WITH {_CELLS},
d AS (SELECT sum(CASE WHEN b = 'F' THEN m ELSE -m END) AS diff, sum(1 / n) AS inv FROM c)
SELECT 'b' AS term, round(diff * diff / inv / 1000000, 3) AS ss_millions, 1::DOUBLE AS df, df_error, round((diff * diff / inv) / (ss_error / df_error), 5) AS f FROM d, e""")
def two_way_b_effect(t: Tables):
    out = mx.two_way_anova(t("lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice",
                           with_levene=False).where("term = 'b'")
    return rounded(out.select("term", (F.col("ss") / 1e6).alias("ss_millions"), "df", "df_error", "f"),
                   5, ss_millions=3)


# a second independent route: with effects fitted by hand on two contrasts of the first factor
_W = ("w AS (SELECT a, arg_max(m, b = 'F') - arg_max(m, b = 'O') AS d, sum(1 / n) AS q, "
      "avg(m) AS mm, sum(1 / n) / 4 AS qm FROM c GROUP BY a)")


@query("two_way_terms", f"""
WITH {_CELLS}, {_W},
ab AS (SELECT sum(d * d / q) - sum(d / q) ** 2 / sum(1 / q) AS ss FROM w),
aa AS (SELECT sum(mm * mm / qm) - sum(mm / qm) ** 2 / sum(1 / qm) AS ss FROM w)
SELECT 'a' AS term, round(ss / 1000000, 3) AS ss_millions, 2::DOUBLE AS df,
       round((ss / 2) / (ss_error / df_error), 5) AS f FROM aa, e
UNION ALL SELECT 'ab', round(ss / 1000000, 3), 2, round((ss / 2) / (ss_error / df_error), 5) FROM ab, e""")
def two_way_terms(t: Tables):
    out = mx.two_way_anova(t("lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice",
                           with_levene=False).where("term <> 'b'")
    return rounded(out.select("term", (F.col("ss") / 1e6).alias("ss_millions"), "df", "f"), 5,
                   ss_millions=3)


@query("two_way_means", """
SELECT l_returnflag AS a, l_linestatus AS b, grouping(l_returnflag, l_linestatus)::BIGINT AS level,
       count(*) AS n, round(avg(l_quantity), 5) AS mean FROM lineitem
GROUP BY CUBE (l_returnflag, l_linestatus)""")
def two_way_means(t: Tables):
    return rounded(mx.marginal_means(t("lineitem"), "l_returnflag", "l_linestatus", "l_quantity"), 5)
