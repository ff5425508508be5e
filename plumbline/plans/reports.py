"""Short study reports rendered from the line items of each part, with known mistakes.

They stand in for a corpus of papers whose true numbers are known: the text is built by Spark from the
tables, and the oracle builds the same figures in SQL.  Figures are rounded to whole hundredths or
thousandths first, so both engines print the same digits.

Planted: mean off by 0.01 (part % 11 = 3), sample size of the abstract off by 7 (% 13 = 5), p too small
by a factor of ten (% 7 = 2), wording reversed (% 9 = 4), estimate off its interval (% 17 = 6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import dist
from plumbline.plans import oracle_math as om
from plumbline.plans.catalog import Tables
from plumbline.session import shuffle_width


def fixed(value: Column, digits: int) -> Column:
    """Whole number of 10^-digits units as decimal text."""
    unit = 10 ** digits
    size = F.abs(value)
    return F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(size / unit).cast("long").cast("string"), F.lit("."),
        F.lpad((size % unit).cast("string"), digits, "0"))


def fixed_sql(value: str, digits: int) -> str:
    unit = 10 ** digits
    return (f"(CASE WHEN {value} < 0 THEN '-' ELSE '' END || (abs({value}) // {unit})::VARCHAR || '.' "
            f"|| lpad((abs({value}) % {unit})::VARCHAR, {digits}, '0'))")


def figures(t: Tables) -> DataFrame:
    """One row of report figures per part."""
    f, o = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
    q = F.col("l_quantity").cast("long")
    s = t("lineitem").groupBy(F.col("l_partkey").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(q).alias("s"), F.sum(q * q).alias("q"),
        F.count_if(f).alias("n1"), F.count_if(o).alias("n2"),
        F.sum(F.when(f, q)).alias("s1"), F.sum(F.when(o, q)).alias("s2"),
        F.sum(F.when(f, q * q)).alias("q1"), F.sum(F.when(o, q * q)).alias("q2"),
    ).where("n1 >= 1 and n2 >= 1 and n1 + n2 > 2")
    # few bytes but much work a row: small shuffles are read by few tasks, a fixed number of partitions is not.  By a hash
    # of the key, as Spark drops a shuffle by the key itself here
    tasks = max(t.spark.sparkContext.defaultParallelism, shuffle_width(s))
    s = s.repartition(tasks, F.xxhash64("doc_id"))
    d = lambda c: F.col(c).cast("double")
    ss1, ss2 = d("q1") - d("s1") * d("s1") / d("n1"), d("q2") - d("s2") * d("s2") / d("n2")
    dof = F.col("n1") + F.col("n2") - 2
    diff = d("s1") / d("n1") - d("s2") / d("n2")
    se = F.sqrt((ss1 + ss2) / dof * (1 / d("n1") + 1 / d("n2")))
    k = F.col("doc_id")
    hit = lambda m, r: (k % m == r).cast("long")
    out = s.where(ss1 + ss2 > 0).select(
        "doc_id", "n",
        F.floor((F.col("s") * 200 + F.col("n")) / (F.col("n") * 2)).cast("long").alias("true_mean100"),
        F.round(F.sqrt((d("q") - d("s") * d("s") / d("n")) / (d("n") - 1)) * 100).cast("long")
        .alias("sd100"),
        dof.alias("df"), F.round(diff / se * 100).cast("long").alias("t100"),
        F.round(diff * 100).cast("long").alias("diff100"),
        F.round(se * 200).cast("long").alias("half100"),
        dist.p_t(diff / se, dof).alias("p"))
    true_p = F.round(F.col("p") * 1000).cast("long")
    return out.withColumns({
        "mean100": F.col("true_mean100") + hit(11, 3), "abs_n": F.col("n") + 7 * hit(13, 5),
        "p1000": F.when(k % 7 == 2, F.floor(true_p / 10).cast("long")).otherwise(true_p),
        "estimate100": F.col("diff100") + 100 * hit(17, 6)}).withColumn(
        "says_significant", (F.col("p1000") < 50) != (k % 9 == 4))


FIGURES_SQL = f"""
g AS (SELECT l_partkey AS doc_id, count(*) AS n, sum(l_quantity)::BIGINT AS s,
        sum(l_quantity * l_quantity)::BIGINT AS q,
        count(*) FILTER (l_linestatus = 'F') AS n1, count(*) FILTER (l_linestatus = 'O') AS n2,
        sum(l_quantity) FILTER (l_linestatus = 'F') AS s1, sum(l_quantity) FILTER (l_linestatus = 'O') AS s2,
        sum(l_quantity * l_quantity) FILTER (l_linestatus = 'F') AS q1,
        sum(l_quantity * l_quantity) FILTER (l_linestatus = 'O') AS q2
      FROM lineitem GROUP BY l_partkey),
h AS (SELECT *, (q1 - s1 * s1 / n1) + (q2 - s2 * s2 / n2) AS ss, n1 + n2 - 2 AS df, s1 / n1 - s2 / n2 AS diff
      FROM g WHERE n1 >= 1 AND n2 >= 1 AND n1 + n2 > 2),
e AS (SELECT *, sqrt(ss / df * (1.0 / n1 + 1.0 / n2)) AS se FROM h WHERE ss > 0),
i AS (SELECT doc_id, n, df, ((s * 200 + n) // (n * 2)) AS true_mean100,
        round(sqrt((q - s::DOUBLE * s / n) / (n - 1)) * 100)::BIGINT AS sd100,
        round(diff / se * 100)::BIGINT AS t100, round(diff * 100)::BIGINT AS diff100,
        round(se * 200)::BIGINT AS half100, round({om.t_two_sided("(diff / se)", "df")} * 1000)::BIGINT AS tp1000
      FROM e),
rep AS (SELECT *, true_mean100 + (doc_id % 11 = 3)::BIGINT AS mean100, n + 7 * (doc_id % 13 = 5)::BIGINT AS abs_n,
          CASE WHEN doc_id % 7 = 2 THEN tp1000 // 10 ELSE tp1000 END AS p1000,
          diff100 + 100 * (doc_id % 17 = 6)::BIGINT AS estimate100 FROM i),
fig AS (SELECT *, (p1000 < 50) <> (doc_id % 9 = 4) AS says_significant FROM rep)"""


def reports(t: Tables) -> DataFrame:
    """``(doc_id, text)``: abstract, keywords, methods and results."""
    r = figures(t)
    mean, sd = fixed(F.col("mean100"), 2), fixed(F.col("sd100"), 2)
    p, stat = fixed(F.col("p1000"), 3), fixed(F.col("t100"), 2)
    low = fixed(F.col("diff100") - F.col("half100"), 2)
    high = fixed(F.col("diff100") + F.col("half100"), 2)
    word = F.when(F.col("says_significant"), "differed significantly").otherwise(
        "showed no significant difference")
    c = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    return r.select("doc_id", c(
        "Abstract\nThis report describes ordered quantities of one part over all recorded lines, n = ",
        F.col("abs_n").cast("string"), ". The quantity had M = ", mean, ", SD = ", sd,
        ". Both states were compared (p = ", p, ").\nKeywords: quantity, state\n",
        "Methods\nWe ran an independent samples t test with a significance level of 0.05.\n",
        "Results\nWe used n = ", F.col("n").cast("string"), " lines. The quantity had M = ", mean,
        ", SD = ", sd, ".\nOpen and closed lines ", word, ", t(", F.col("df").cast("string"), ") = ",
        stat, ", p = ", p, ".\nThe difference = ", fixed(F.col("estimate100"), 2), ", 95% CI [", low,
        ", ", high, "].\n").alias("text"))
