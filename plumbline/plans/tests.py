"""Hypothesis tests over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import moments as mo
from plumbline.operators import ranks
from plumbline.plans import oracle_math as om
from plumbline.plans.catalog import Tables, query, rounded


def _two_group_sql(table: str, group: str, value: str, by: str = "") -> str:
    """CTEs ``w``: one row per key with n, mean and variance of both groups, labels in order."""
    keys = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
s AS (SELECT {keys}{group}::VARCHAR AS g, count(*) AS n, avg({value})::DOUBLE AS m,
             var_samp({value})::DOUBLE AS v FROM {table} GROUP BY {keys}{group}),
w AS (SELECT {keys}min(g) AS g1, max(g) AS g2, count(*) AS k, arg_min(n, g) AS n1, arg_max(n, g) AS n2,
             arg_min(m, g) AS m1, arg_max(m, g) AS m2, arg_min(v, g) AS v1, arg_max(v, g) AS v2
      FROM s {grp})"""


def _levene_sql(table: str, group: str, value: str, by: str = "") -> str:
    """CTEs ``lev``: Levene statistic and degrees of freedom per key."""
    keys = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    return f"""
med AS (SELECT {keys}{group} AS g, median({value}) AS md FROM {table} GROUP BY {keys}{group}),
z AS (SELECT {", ".join(f"t.{k.strip()}" for k in by.split(",")) + ", " if by else ""}t.{group} AS g, abs(t.{value} - med.md) AS z FROM {table} t
      JOIN med ON t.{group} = med.g {" ".join(f"AND t.{k.strip()} = med.{k.strip()}" for k in by.split(",")) if by else ""}),
zg AS (SELECT {keys}g, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM z GROUP BY {keys}g),
zt AS (SELECT {keys}avg(z) AS grand FROM z {grp}),
lev AS (SELECT {keys}count(*) AS k, sum(n)::BIGINT AS n_total,
               (sum(n * (m - grand) ** 2) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS w
        FROM zg JOIN zt {on} {grp})"""


_T = "((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)))"
_WELCH_T = "((m1 - m2) / sqrt(v1 / n1 + v2 / n2))"
_WELCH_DF = ("((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)))")


@query("ttest_by_status", f"""
WITH {_two_group_sql("lineitem", "l_linestatus", "l_extendedprice")},
{_levene_sql("lineitem", "l_linestatus", "l_extendedprice")},
e AS (SELECT *, {om.f_upper("w", "1", "n_total - 2")} AS levene_p FROM lev),
r AS (SELECT w.*, e.w AS lw, e.levene_p,
             CASE WHEN levene_p > 0.05 THEN {_T} ELSE {_WELCH_T} END AS t,
             CASE WHEN levene_p > 0.05 THEN n1 + n2 - 2 ELSE {_WELCH_DF} END AS df
      FROM w, e)
SELECT g1, g2, n1, n2, round(m1, 4) AS mean1, round(m2, 4) AS mean2, round(lw, 4) AS levene_w,
       round(levene_p, 4) AS levene_p, (levene_p > 0.05)::BIGINT AS equal_var,
       round(df, 4) AS df, round(t, 4) AS t, round({om.t_two_sided("t", "df")}, 4) AS p,
       round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 4) AS cohen_d
FROM r""")
def ttest_by_status(t: Tables):
    out = mo.independent_t(t("lineitem"), "l_linestatus", "l_extendedprice")
    return rounded(out.select("g1", "g2", "n1", "n2", "mean1", "mean2", "levene_w", "levene_p",
                              "equal_var", "df", "t", "p", "cohen_d"), 4)


@query("ttest_per_supplier", f"""
WITH {_two_group_sql("lineitem", "l_linestatus", "l_quantity", "l_suppkey")},
r AS (SELECT *, {_WELCH_T} AS t, {_WELCH_DF} AS df FROM w WHERE k = 2 AND n1 >= 2 AND n2 >= 2)
SELECT l_suppkey, n1, n2, round(m1 - m2, 4) AS diff, round(t, 4) AS t, round(df, 3) AS df,
       round({om.t_two_sided("t", "df").replace("4000", "1000").replace("4001", "1001").replace("12000", "3000")}, 4) AS p FROM r""")
def ttest_per_supplier(t: Tables):
    out = mo.independent_t(t("lineitem"), "l_linestatus", "l_quantity", by=["l_suppkey"],
                           equal_var=False)
    return rounded(out.select("l_suppkey", "n1", "n2", "diff", "t", "df", "p"), 4, df=3)


@query("levene_by_flag", f"""
WITH {_levene_sql("lineitem", "l_returnflag", "l_extendedprice")}
SELECT k, n_total, k - 1 AS df1, n_total - k AS df2, round(w, 5) AS w,
       round({om.f_upper("w", "k - 1", "n_total - k")}, 5) AS p FROM lev""")
def levene_by_flag(t: Tables):
    return rounded(mo.levene(t("lineitem"), "l_returnflag", "l_extendedprice"), 5)


@query("levene_per_brand", f"""
WITH {_levene_sql("part", "p_type", "p_retailprice", "p_brand")}
SELECT p_brand, k, n_total, round(w, 5) AS w FROM lev""")
def levene_per_brand(t: Tables):
    out = mo.levene(t("part"), "p_type", "p_retailprice", by=["p_brand"])
    return rounded(out.select("p_brand", "k", "n_total", "w"), 5)


@query("tost_price", f"""
WITH {_two_group_sql("lineitem", "l_linestatus", "l_quantity")},
r AS (SELECT *, m1 - m2 AS diff, sqrt(v1 / n1 + v2 / n2) AS se, {_WELCH_DF} AS df FROM w),
q AS (SELECT *, (diff + 0.5) / se AS tl, (diff - 0.5) / se AS tu FROM r),
p AS (SELECT *, {om.t_upper("tl", "df")} AS pl, {om.t_upper("-tu", "df")} AS pu FROM q)
SELECT n1, n2, round(diff, 5) AS diff, round(se, 5) AS se, round(df, 2) AS df,
       round(tl, 4) AS t_lower, round(tu, 4) AS t_upper, round(greatest(pl, pu), 5) AS p,
       (greatest(pl, pu) < 0.05)::BIGINT AS equivalent FROM p""")
def tost_price(t: Tables):
    out = mo.tost(t("lineitem"), "l_linestatus", "l_quantity", margin=0.5)
    return rounded(out.select("n1", "n2", "diff", "se", "df", "t_lower", "t_upper", "p",
                              "equivalent"), 5, df=2, t_lower=4, t_upper=4)


def _anova_sql(table: str, group: str, value: str) -> str:
    return f"""
s AS (SELECT {group}::VARCHAR AS g, count(*) AS n, avg({value}) AS m, var_samp({value}) AS v FROM {table} GROUP BY {group}),
o AS (SELECT avg({value}) AS grand FROM {table}),
a AS (SELECT count(*) AS k, sum(n)::BIGINT AS n_total, sum(n * (m - grand) ** 2) AS ssb,
             sum((n - 1) * v) AS ssw FROM s, o),
f AS (SELECT *, (ssb / (k - 1)) / (ssw / (n_total - k)) AS f FROM a)"""


@query("anova_flag", f"""
WITH {_anova_sql("lineitem", "l_returnflag", "l_quantity")}
SELECT k, n_total, round(ssb, 2) AS ss_between, round(ssw, 1) AS ss_within, k - 1 AS df1,
       n_total - k AS df2, round(f, 5) AS f, round({om.f_upper("f", "k - 1", "n_total - k")}, 5) AS p,
       round(ssb / (ssb + ssw), 7) AS eta2 FROM f""")
def anova_flag(t: Tables):
    out = mo.anova(t("lineitem"), "l_returnflag", "l_quantity", with_levene=False)
    return rounded(out.drop("effect"), 5, ss_between=2, ss_within=1, eta2=7)


@query("posthoc_priority", f"""
WITH {_anova_sql("orders", "o_orderpriority", "o_totalprice")},
p AS (SELECT x.g AS group_a, y.g AS group_b, x.m - y.m AS mean_diff,
             sqrt(ssw / (n_total - k) * (1.0 / x.n + 1.0 / y.n)) AS se, n_total - k AS df, k
      FROM s x JOIN s y ON x.g < y.g, a)
SELECT group_a, group_b, round(mean_diff, 3) AS mean_diff, round(se, 3) AS se,
       round(mean_diff / se, 5) AS t, df,
       round(least(1, k * (k - 1) / 2 * {om.t_two_sided("mean_diff / se", "df")}), 4) AS p_adj FROM p""")
def posthoc_priority(t: Tables):
    out = mo.posthoc(t("orders"), "o_orderpriority", "o_totalprice")
    return rounded(out.drop("significant"), 4, mean_diff=3, se=3, t=5)


@query("describe_segment", """
SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean,
       round(stddev_samp(c_acctbal), 4) AS sd FROM customer GROUP BY c_mktsegment""")
def describe_segment(t: Tables):
    return rounded(mo.describe(t("customer"), "c_mktsegment", "c_acctbal"), 4)


@query("paired_t_lines", f"""
WITH w AS (SELECT l_orderkey, avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS pre,
                  avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS post
           FROM lineitem GROUP BY l_orderkey),
s AS (SELECT count(*) AS n, avg(post - pre) AS d, stddev_samp(post - pre) AS sd FROM w
      WHERE pre IS NOT NULL AND post IS NOT NULL)
SELECT n, round(d, 5) AS mean_diff, round(sd, 5) AS sd_diff, n - 1 AS df,
       round(d / (sd / sqrt(n)), 5) AS t, round({om.t_two_sided("d / (sd / sqrt(n))", "n - 1")}, 5) AS p,
       round(d / sd, 6) AS d_z FROM s""")
def paired_t_lines(t: Tables):
    wide = t("lineitem").groupBy("l_orderkey").agg(
        F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("pre"),
        F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("post"))
    out = mo.paired_t(wide, "pre", "post")
    return rounded(out.select("n", "mean_diff", "sd_diff", "df", "t", "p", "d_z"), 5, d_z=6)


@query("corr_price_quantity", f"""
WITH s AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT n, n - 2 AS df, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 3) AS t,
       round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS ci_low,
       round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) AS ci_high FROM s""")
def corr_price_quantity(t: Tables):
    out = mo.pearson(t("lineitem"), "l_quantity", "l_extendedprice")
    return rounded(out.select("n", "df", "r", "t", "ci_low", "ci_high"), 6, t=3)


@query("corr_per_supplier", f"""
WITH s AS (SELECT l_suppkey, count(*) AS n, corr(l_discount, l_tax) AS r FROM lineitem
           GROUP BY l_suppkey HAVING count(*) >= 3),
t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM s)
SELECT l_suppkey, n, round(r, 6) AS r, round(t, 5) AS t FROM t""")
def corr_per_supplier(t: Tables):
    out = mo.pearson(t("lineitem"), "l_discount", "l_tax", by=["l_suppkey"])
    return rounded(out.select("l_suppkey", "n", "r", "t"), 6, t=5)


def _chi_sql(table: str, row: str, col: str, yates: bool) -> str:
    gap = "greatest(abs(o - e) - 0.5, 0)" if yates else "abs(o - e)"
    return f"""
cell AS (SELECT {row} AS r, {col} AS c, count(*) AS o FROM {table} GROUP BY ALL),
nr AS (SELECT r, sum(o) AS nr FROM cell GROUP BY r), nc AS (SELECT c, sum(o) AS nc FROM cell GROUP BY c),
g AS (SELECT r, c, coalesce(o, 0) AS o, nr * nc / (SELECT sum(o) FROM cell) AS e
      FROM nr CROSS JOIN nc LEFT JOIN cell USING (r, c)),
x AS (SELECT sum(o)::BIGINT AS n, count(DISTINCT r) AS n_rows, count(DISTINCT c) AS n_cols,
             sum({gap} ** 2 / e) AS chi2, count(*) FILTER (e < 5) AS n_low_expected FROM g)"""


@query("chi2_status_priority", f"""
WITH {_chi_sql("orders", "o_orderstatus", "o_orderpriority", False)}
SELECT n, n_rows, n_cols, round(chi2, 5) AS chi2, n_low_expected, (n_rows - 1) * (n_cols - 1) AS df,
       round({om.chi2_upper("chi2", "(n_rows - 1) * (n_cols - 1)")}, 5) AS p,
       round(sqrt(chi2 / (n * (least(n_rows, n_cols) - 1))), 6) AS cramers_v FROM x""")
def chi2_status_priority(t: Tables):
    return rounded(mo.chi_square(t("orders"), "o_orderstatus", "o_orderpriority"), 5, cramers_v=6)


@query("chi2_yates_labels", f"""
WITH {_chi_sql("labels", "quality", "toxic", True)}
SELECT n, n_rows, n_cols, round(chi2, 5) AS chi2, n_low_expected, (n_rows - 1) * (n_cols - 1) AS df,
       round({om.chi2_upper("chi2", "1")}, 5) AS p, round(sqrt(chi2 / n), 6) AS cramers_v FROM x""")
def chi2_yates_labels(t: Tables):
    return rounded(mo.chi_square(t("labels"), "quality", "toxic"), 5, cramers_v=6)


@query("contingency_cells", """
WITH cell AS (SELECT lang AS r, source AS c, count(*) AS o FROM documents GROUP BY ALL),
nr AS (SELECT r, sum(o) AS nr FROM cell GROUP BY r), nc AS (SELECT c, sum(o) AS nc FROM cell GROUP BY c)
SELECT r, c, coalesce(o, 0) AS observed, round(nr * nc / (SELECT sum(o) FROM cell), 5) AS expected
FROM nr CROSS JOIN nc LEFT JOIN cell USING (r, c)""")
def contingency_cells(t: Tables):
    out = mo.contingency(t("documents"), "lang", "source")
    return rounded(out.select("r", "c", "observed", "expected"), 5)


# ---- rank tests ------------------------------------------------------------------------------

@query("mann_whitney_status", f"""
WITH v AS (SELECT o_orderstatus AS g, o_totalprice AS x FROM orders WHERE o_orderstatus IN ('F', 'O')),
r AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM v),
ties AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM v GROUP BY x)),
s AS (SELECT count(*) FILTER (g = 'F') AS n1, count(*) FILTER (g = 'O') AS n2,
             sum(rk) FILTER (g = 'F') AS r1 FROM r),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, n1 + n2 AS n,
             sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sg FROM s, ties),
z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sg AS z FROM u)
SELECT 'F' AS g1, 'O' AS g2, n1, n2, round(u, 1) AS u, round(ties, 1) AS ties,
       round(z, 5) AS z_corrected, round({om.norm_two_sided("greatest(z, 0)")}, 5) AS p FROM z""")
def mann_whitney_status(t: Tables):
    out = ranks.mann_whitney(t("orders"), "o_orderstatus", "o_totalprice", groups=("F", "O"))
    return rounded(out.select("g1", "g2", "n1", "n2", "u", "ties", "z_corrected", "p"), 5,
                   u=1, ties=1)


@query("mann_whitney_per_flag", """
WITH r AS (SELECT l_returnflag, l_linestatus AS g, l_quantity AS x,
                  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
                  + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rk FROM lineitem),
s AS (SELECT l_returnflag, count(*) FILTER (g = 'F') AS n1, count(*) FILTER (g = 'O') AS n2,
             sum(rk) FILTER (g = 'F') AS r1 FROM r GROUP BY l_returnflag)
SELECT l_returnflag, n1, n2, round(r1 - n1 * (n1 + 1) / 2.0, 1) AS u FROM s""")
def mann_whitney_per_flag(t: Tables):
    out = ranks.mann_whitney(t("lineitem"), "l_linestatus", "l_quantity", by=["l_returnflag"])
    return rounded(out.select("l_returnflag", "n1", "n2", "u"), 1)


@query("group_quartiles", """
SELECT l_returnflag AS g, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
       round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY l_returnflag""")
def group_quartiles(t: Tables):
    return rounded(ranks.group_quartiles(t("lineitem"), "l_returnflag", "l_extendedprice"), 4)


@query("wilcoxon_nation_balance", f"""
WITH w AS (SELECT l_orderkey, avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS pre,
                  avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS post
           FROM lineitem GROUP BY l_orderkey),
d AS (SELECT round(post - pre, 10) AS d FROM w WHERE pre IS NOT NULL AND post IS NOT NULL),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk
      FROM d WHERE d <> 0),
ties AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (
           SELECT count(*)::DOUBLE AS c FROM d WHERE d <> 0 GROUP BY abs(d))),
s AS (SELECT (SELECT count(*) FROM d) AS n_pairs, count(*) AS n, sum(rk) FILTER (d > 0) AS wp FROM r),
z AS (SELECT *, n * (n + 1) / 2.0 - wp AS wm,
             (least(wp, n * (n + 1) / 2.0 - wp) - n * (n + 1) / 4.0)
             / sqrt((n * (n + 1.0) * (2 * n + 1) - ties / 2) / 24) AS z FROM s, ties)
SELECT n_pairs, n AS n_used, round(wp, 1) AS w_plus, round(wm, 1) AS w_minus, round(ties, 1) AS ties,
       round(z, 5) AS z, round({om.norm_two_sided("z")}, 5) AS p FROM z""")
def wilcoxon_lines(t: Tables):
    wide = t("lineitem").groupBy("l_orderkey").agg(
        F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("pre"),
        F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("post"))
    out = ranks.wilcoxon(wide, "pre", "post")
    return rounded(out.select("n_pairs", "n_used", "w_plus", "w_minus", "ties", "z", "p"), 5,
                   w_plus=1, w_minus=1, ties=1)


@query("mann_whitney_small", """
WITH RECURSIVE v AS (SELECT o_custkey, o_orderstatus AS g, o_totalprice AS x FROM orders WHERE o_orderstatus IN ('F', 'O')),
k AS (SELECT o_custkey, count(*) FILTER (g = 'F') AS n1, count(*) FILTER (g = 'O') AS n2, count(DISTINCT x) < count(*) AS tied FROM v GROUP BY o_custkey),
r AS (SELECT o_custkey, g, rank() OVER (PARTITION BY o_custkey ORDER BY x) + (count(*) OVER (PARTITION BY o_custkey, x) - 1) / 2.0 AS rk FROM v),
u AS (SELECT k.*, least(n1, n2) AS m, n1 + n2 AS n, s - n1 * (n1 + 1) / 2.0 AS u FROM k
  JOIN (SELECT o_custkey, sum(rk) AS s FROM r WHERE g = 'F' GROUP BY o_custkey) USING (o_custkey) WHERE n1 > 0 AND n2 > 0),
c(n, j, s, ways) AS (SELECT 0, 0, 0, 1.0::DOUBLE
  UNION ALL SELECT n + 1, j + t, s + t * (n + 1), sum(ways) FROM c, (SELECT unnest([0, 1]) AS t)
    WHERE n < (SELECT max(n) FROM u) AND j + t <= 8 GROUP BY n + 1, j + t, s + t * (n + 1)),
p AS (SELECT o_custkey, least(1.0, 2 * sum(ways) FILTER (s - m * (m + 1) // 2 <= least(u, n1 * n2 - u)) / sum(ways)) AS p_exact
  FROM u JOIN c ON c.n = u.n AND c.j = u.m WHERE NOT tied AND n1 * n2 <= 2000 GROUP BY o_custkey)
SELECT o_custkey, n1, n2, round(u, 1) AS u, round(p_exact, 8) AS p_exact, CASE WHEN p_exact IS NULL THEN 'normal' ELSE 'exact' END AS p_method
FROM u LEFT JOIN p USING (o_custkey)""")
def mann_whitney_small(t: Tables):
    """Every customer's prices of finished against open orders: small samples, counted exactly."""
    out = ranks.mann_whitney(t("orders"), "o_orderstatus", "o_totalprice", by=["o_custkey"], groups=("F", "O"))
    return rounded(out.select("o_custkey", "n1", "n2", "u", "p_exact", "p_method"), 8, u=1)


@query("wilcoxon_small", """
WITH RECURSIVE d AS (SELECT l_orderkey, round(l_quantity * 1000.0 - l_extendedprice, 10) AS d FROM lineitem),
e AS (SELECT *, abs(d) AS x FROM d WHERE d <> 0),
r AS (SELECT l_orderkey, d, rank() OVER (PARTITION BY l_orderkey ORDER BY x) + (count(*) OVER (PARTITION BY l_orderkey, x) - 1) / 2.0 AS rk,
  count(*) OVER (PARTITION BY l_orderkey, x) AS same FROM e),
w AS (SELECT l_orderkey, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS wp, max(same) > 1 AS tied FROM r GROUP BY l_orderkey),
c(n, s, ways) AS (SELECT 0, 0, 1.0::DOUBLE
  UNION ALL SELECT n + 1, s + t * (n + 1), sum(ways) FROM c, (SELECT unnest([0, 1]) AS t)
    WHERE n < (SELECT max(n) FROM w) AND n < 50 GROUP BY n + 1, s + t * (n + 1)),
p AS (SELECT l_orderkey, least(1.0, 2 * sum(ways) FILTER (s <= least(wp, w.n * (w.n + 1) / 2.0 - wp)) / sum(ways)) AS p_exact
  FROM w JOIN c ON c.n = w.n WHERE NOT tied GROUP BY l_orderkey)
SELECT l_orderkey, n AS n_used, round(wp, 1) AS w_plus, round(p_exact, 8) AS p_exact, CASE WHEN p_exact IS NULL THEN 'normal' ELSE 'exact' END AS p_method
FROM w LEFT JOIN p USING (l_orderkey)""")
def wilcoxon_small(t: Tables):
    """Every order's list value against a flat thousand a unit."""
    rows = t("lineitem").select("l_orderkey", F.col("l_extendedprice").alias("pre"), (F.col("l_quantity") * 1000.0).alias("post"))
    out = ranks.wilcoxon(rows, "pre", "post", by=["l_orderkey"])
    return rounded(out.select("l_orderkey", "n_used", "w_plus", "p_exact", "p_method"), 8, w_plus=1)


@query("shapiro_balance")
def shapiro_balance(t: Tables):
    """W needs normal scores of every rank; checked against published values in the tests."""
    out = ranks.shapiro(t("supplier").unionByName(t("supplier")), "s_acctbal")
    per = ranks.shapiro(t("customer"), "c_acctbal", by=["c_mktsegment"])
    return rounded(out.select(F.lit("supplier").alias("key"), "n", "w").unionByName(
        per.select(F.col("c_mktsegment").alias("key"), "n", "w")), 5)


@query("moment_screen", """
WITH m AS (SELECT c_mktsegment, count(*)::DOUBLE AS n, avg(c_acctbal) AS a FROM customer GROUP BY ALL),
c AS (SELECT c_mktsegment, any_value(n) AS n, sum((c_acctbal - a) ** 2) AS s2, sum((c_acctbal - a) ** 3) AS s3,
             sum((c_acctbal - a) ** 4) AS s4 FROM customer JOIN m USING (c_mktsegment) GROUP BY ALL),
k AS (SELECT c_mktsegment, n, sqrt(n) * s3 / s2 ** 1.5 AS sk, n * s4 / (s2 * s2) - 3 AS ku FROM c)
SELECT c_mktsegment, n::BIGINT AS n, round(sk, 5) AS skewness, round(ku, 5) AS kurtosis,
       round(n / 6 * (sk ** 2 + ku ** 2 / 4), 4) AS jb,
       round(exp(-n / 12 * (sk ** 2 + ku ** 2 / 4)), 6) AS p FROM k""")
def moment_screen(t: Tables):
    return rounded(ranks.moment_screen(t("customer"), "c_acctbal", by=["c_mktsegment"]), 5, jb=4, p=6)


# ---- chart feeds -----------------------------------------------------------------------------

@query("chart_mean_error", """
SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd,
       round(stddev_samp(value) / sqrt(count(*)), 6) AS se FROM events GROUP BY event_type""")
def chart_mean_error(t: Tables):
    return rounded(mo.mean_error(t("events"), "event_type", "value"), 5, se=6)


@query("chart_fit_line", """
SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
       round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem""")
def chart_fit_line(t: Tables):
    return rounded(mo.fit_line(t("lineitem"), "l_quantity", "l_extendedprice"), 6, slope=4,
                   intercept=3)


@query("chart_crosstab", """
SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F",
       count(*) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY l_returnflag""")
def chart_crosstab(t: Tables):
    return mo.crosstab(t("lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("chart_box", """
SELECT lang, count(*) AS n, quantile_cont(n_chars::DOUBLE, 0.25) AS q1, median(n_chars)::DOUBLE AS median,
       quantile_cont(n_chars::DOUBLE, 0.75) AS q3, min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max
FROM documents GROUP BY lang""")
def chart_box(t: Tables):
    return rounded(mo.box_stats(t("documents"), "lang", "n_chars"), 4)


@query("chart_time_means", """
WITH w AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS click,
                  avg(value) FILTER (event_type = 'view') AS view,
                  avg(value) FILTER (event_type = 'signup') AS signup FROM events GROUP BY user_id),
l AS (SELECT * FROM w WHERE click IS NOT NULL AND view IS NOT NULL AND signup IS NOT NULL),
u AS (SELECT 'click' AS time, click AS x FROM l UNION ALL SELECT 'view', view FROM l
      UNION ALL SELECT 'signup', signup FROM l)
SELECT time, count(*) AS n, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS sd,
       round(stddev_samp(x) / sqrt(count(*)), 5) AS se FROM u GROUP BY time""")
def chart_time_means(t: Tables):
    types = ["click", "view", "signup"]
    wide = t("events").groupBy("user_id").pivot("event_type", types).agg(F.avg("value"))
    return rounded(mo.time_means(wide, types), 5)
