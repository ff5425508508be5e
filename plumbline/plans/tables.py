"""Printed tables derived from the driver's tables, and the checks on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import compare as cp
from plumbline.operators import forensics as fo
from plumbline.operators import matching as mt
from plumbline.plans import oracle_math as om
from plumbline.plans.catalog import Tables, query, rounded
from plumbline.plans.reports import fixed
from plumbline.sources import tables as pt

# ---- pipe tables in texts --------------------------------------------------------------------
# per nation: segments with n, mean and sd of account balances; every sixth nation prints a mean that
# is 1.50 too high, every seventh an n that is one too low

_NATION = """
seg AS (SELECT c_nationkey::BIGINT AS doc_id, c_mktsegment AS label, count(*) AS n,
               round(avg(c_acctbal) * 100)::BIGINT + CASE WHEN c_nationkey % 6 = 1 THEN 150 ELSE 0 END AS m100,
               round(stddev_samp(c_acctbal) * 100)::BIGINT AS s100, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s
        FROM customer GROUP BY c_nationkey, c_mktsegment)"""


def _segments(t: Tables):
    off = F.when(F.col("c_nationkey") % 6 == 1, 150).otherwise(0)
    s = t("customer").groupBy(F.col("c_nationkey").cast("long").alias("doc_id"),
                              F.col("c_mktsegment").alias("label"), off.alias("off")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"),
        F.stddev_samp("c_acctbal").alias("s"))
    return s.select("doc_id", "label",
                    (F.col("n") - (F.col("doc_id") % 7 == 3).cast("long")).alias("n"),
                    (F.round(F.col("m") * 100).cast("long") + F.col("off")).alias("m100"),
                    F.round(F.col("s") * 100).cast("long").alias("s100"))


def nation_texts(t: Tables):
    """One text per nation: a Markdown table between two lines of prose."""
    c = F.concat
    row = c(F.lit("| "), "label", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "),
            fixed(F.col("m100"), 2), F.lit(" | "), fixed(F.col("s100"), 2), F.lit(" |"))
    per = _segments(t).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("label", row.alias("row")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["row"]), "\n")
    return per.select("doc_id", c(
        F.lit("Balances by segment are listed below.\n\n### Table 1 Balances\n"
              "| c_acctbal | n | M | SD |\n| --- | ---: | ---: | ---: |\n"), body,
        F.lit("\nNothing else is tabulated.\n")).alias("text"))


@query("pipe_table_cells", f"""
WITH {_NATION},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY label) - 1 AS row_no FROM seg WHERE s100 IS NOT NULL)
SELECT doc_id, count(*) * 4 AS n_cells, count(*) AS n_rows, sum(n - (doc_id % 7 = 3)::BIGINT)::BIGINT AS n_sum,
       sum(m100)::BIGINT AS mean_sum FROM r GROUP BY doc_id""")
def pipe_table_cells(t: Tables):
    cells = pt.pipe_tables(nation_texts(t), ["doc_id"])
    number = F.col("raw").try_cast("double")
    return cells.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("col_no") == 0).alias("n_rows"),
        F.sum(F.when(F.col("header") == "n", number)).cast("long").alias("n_sum"),
        F.round(F.sum(F.when(F.col("header") == "M", number)) * 100).cast("long").alias("mean_sum"))


@query("table_groups", f"""
WITH {_NATION}
SELECT doc_id, label, kind, status FROM seg, LATERAL (
  SELECT 'n' AS kind, CASE WHEN doc_id % 7 = 3 THEN 'mismatch' ELSE 'ok' END AS status
  UNION ALL SELECT 'mean', CASE WHEN abs(m - m100 / 100.0) <= greatest(0.011, abs(m100 / 100.0) * 0.005) THEN 'ok' ELSE 'mismatch' END
  UNION ALL SELECT 'sd', CASE WHEN abs(s - s100 / 100.0) <= greatest(0.011, abs(s100 / 100.0) * 0.005) THEN 'ok' ELSE 'mismatch' END) x
WHERE s IS NOT NULL""")
def table_groups(t: Tables):
    printed = cp.group_rows(pt.pipe_tables(nation_texts(t), ["doc_id"]), ["doc_id"])
    data = t("customer").withColumn("doc_id", F.col("c_nationkey").cast("long"))
    out = cp.groups_against_data(printed, data, "c_mktsegment", "c_acctbal", ["doc_id"])
    return out.select("doc_id", "label", "kind", "status")


@query("table_columns", """
WITH s AS (SELECT c_nationkey::BIGINT AS doc_id, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd,
                  round(avg(c_acctbal) * 10)::BIGINT + (c_nationkey % 4 = 1)::BIGINT AS m10,
                  round(stddev_samp(c_acctbal) * 10)::BIGINT AS s10 FROM customer GROUP BY c_nationkey)
SELECT doc_id, kind, status FROM s, LATERAL (
  SELECT 'mean' AS kind, CASE WHEN abs(m - m10 / 10.0) > 0.05 THEN 'mismatch' ELSE 'ok' END AS status
  UNION ALL SELECT 'sd', CASE WHEN abs(sd - s10 / 10.0) > 0.05 THEN 'mismatch' ELSE 'ok' END) x""")
def table_columns(t: Tables):
    """Rows named after data columns, one decimal printed; every fourth nation is off by 0.1."""
    customer = t("customer").withColumn("doc_id", F.col("c_nationkey").cast("long"))
    stats = customer.groupBy("doc_id").agg(
        F.count("c_acctbal").alias("n"), F.avg("c_acctbal").alias("mean"),
        F.stddev_samp("c_acctbal").alias("sd")).withColumn("name", F.lit("c_acctbal"))
    m10 = F.round(F.col("mean") * 10).cast("long") + (F.col("doc_id") % 4 == 1).cast("long")
    text = F.concat(F.lit("| item | M | SD |\n| --- | --- | --- |\n| c acctbal | "), fixed(m10, 1),
                    F.lit(" | "), fixed(F.round(F.col("sd") * 10).cast("long"), 1), F.lit(" |\n"))
    cells = pt.pipe_tables(stats.select("doc_id", text.alias("text")), ["doc_id"])
    statistics = cp.table_statistics(cells, ["doc_id"])
    labels = statistics.select("doc_id", "label")
    matches = mt.match_labels(labels, mt.column_catalogue(t("customer")), ["doc_id"])
    out = cp.table_against_columns(statistics, stats, matches, ["doc_id"])
    return out.select("doc_id", "kind", "status")


# ---- digits of printed columns ---------------------------------------------------------------

def event_cells(t: Tables):
    """One printed table per event type: value, half-unit grid, and a column with a copied tail."""
    cents = F.round(F.col("value") * 100).cast("long")
    grid = F.round(F.col("value") * 2).cast("long") * 5
    copied = F.floor(F.col("value")).cast("long") * 100 + F.when(
        F.col("event_id") % 5 == 0, cents % 100).otherwise(37)
    return pt.frame_cells(t("events"), ["event_type"], "event_id", {
        "value": fixed(cents, 2), "grid": fixed(grid, 1), "copied": fixed(copied, 2)})


_EVENT = """
v AS (SELECT event_type, 'value' AS header, round(value * 100)::BIGINT AS c FROM events
      UNION ALL SELECT event_type, 'copied', floor(value)::BIGINT * 100
        + CASE WHEN event_id % 5 = 0 THEN round(value * 100)::BIGINT % 100 ELSE 37 END FROM events)"""
_D = [f"count(*) FILTER (c % 10 = {d})" for d in range(10)]


@query("digit_columns", f"""
WITH {_EVENT},
s AS (SELECT event_type, header, count(*) AS n, greatest({", ".join(_D)}) AS top,
             {" + ".join(f"({d} - count(*) / 10.0) ** 2 / (count(*) / 10.0)" for d in _D)} AS chi2
      FROM v GROUP BY ALL)
SELECT event_type, header, n, round(chi2::DOUBLE, 4) AS chi2, top AS top_count FROM s""")
def digit_columns(t: Tables):
    out = fo.digit_tables(event_cells(t), ["event_type"])
    return rounded(out.select("event_type", "header", "n", "chi2", "top_count"), 4)


@query("last_digit_findings", f"""
WITH {_EVENT},
s AS (SELECT event_type, header, {" + ".join(f"({d} - count(*) / 10.0) ** 2 / (count(*) / 10.0)" for d in _D)} AS chi2
      FROM v GROUP BY ALL)
SELECT event_type, header AS columns, 'F1' AS family, 'mid' AS level FROM s WHERE {om.chi2_upper("chi2", "9")} < 1e-3""")
def last_digit_findings(t: Tables):
    out = fo.check_last_digits(event_cells(t), ["event_type"])
    return out.select("event_type", F.concat_ws(",", "columns").alias("columns"), "family", "level")


@query("tail_columns", f"""
WITH {_EVENT},
g AS (SELECT event_type, header, c % 100 AS tail, count(*) AS k FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, header ORDER BY k DESC, tail) AS rk,
             sum(k) OVER (PARTITION BY event_type, header)::BIGINT AS n FROM g)
SELECT event_type, header, n, k AS top_count, tail FROM r WHERE rk = 1""")
def tail_columns(t: Tables):
    out = fo.tail_tables(event_cells(t), ["event_type"])
    return rounded(out.select("event_type", "header", "n", "top_count", "tail"))


# ---- precision, relations, progressions ------------------------------------------------------

def part_cells(t: Tables):
    """One printed table per brand: price, price in another unit, price plus 50, and a column where every
    31st part is printed with one decimal less."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    odd = F.when(F.col("p_partkey") % 31 == 0, fixed(F.round(cents / 10).cast("long"), 1)).otherwise(
        fixed(cents + F.col("p_partkey") % 7, 2))
    return pt.frame_cells(t("part"), ["p_brand"], "p_partkey", {
        "price": fixed(cents, 2), "half": fixed(F.floor(cents / 2).cast("long"), 2),
        "plus": fixed(cents + 5000, 2), "mixed": odd})


@query("mixed_precision", """
WITH s AS (SELECT p_brand, count(*) AS n, count(*) FILTER (p_partkey % 31 = 0) AS odd FROM part GROUP BY p_brand)
SELECT p_brand, 'mixed' AS columns, 'F3' AS family, n, odd FROM s WHERE n >= 10 AND odd > 0 AND odd < 0.1 * n""")
def mixed_precision(t: Tables):
    out = fo.check_mixed_precision(part_cells(t), ["p_brand"])
    return out.select("p_brand", F.concat_ws(",", "columns").alias("columns"), "family",
                      F.col("metric")["n"].cast("long").alias("n"),
                      F.col("metric")["odd"].cast("long").alias("odd"))


@query("fixed_relation", """
WITH s AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) >= 8)
SELECT p_brand, a, b, kind, n, constant FROM s, LATERAL (
  SELECT 'price' AS a, 'plus' AS b, 'offset' AS kind, 50.0::DOUBLE AS constant
  UNION ALL SELECT 'price', 'half', 'ratio', 0.5 UNION ALL SELECT 'half', 'plus', 'ratio', NULL) x
WHERE constant IS NOT NULL""")
def fixed_relation(t: Tables):
    out = fo.column_relations(part_cells(t), ["p_brand"]).where("a = 'price' and b in ('plus', 'half')")
    return rounded(out.select("p_brand", "a", "b", "kind", "n", "constant"), 3)


def month_cells(t: Tables):
    """One printed table per priority: a count per month, and a trend that follows a formula except in
    months whose count is a multiple of five."""
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    per = t("orders").groupBy("o_orderpriority", month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    trend = F.col("month") * 25 + F.when(F.col("n") % 5 == 0, 10).otherwise(0)
    return pt.frame_cells(per, ["o_orderpriority"], "month", {
        "month no": F.col("month").cast("string"), "orders": F.col("n").cast("string"),
        "trend": fixed(trend.cast("long"), 2)})


@query("progression_runs", """
WITH m AS (SELECT o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate) AS mo, count(*) AS n FROM orders GROUP BY ALL),
v AS (SELECT *, mo * 25 + CASE WHEN n % 5 = 0 THEN 10 ELSE 0 END AS x,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY mo) AS i FROM m),
d AS (SELECT *, x - lag(x) OVER (PARTITION BY o_orderpriority ORDER BY mo) AS dx FROM v),
b AS (SELECT *, CASE WHEN dx = lag(dx) OVER (PARTITION BY o_orderpriority ORDER BY mo) THEN 0 ELSE 1 END AS brk FROM d WHERE dx IS NOT NULL),
r AS (SELECT *, sum(brk) OVER (PARTITION BY o_orderpriority ORDER BY mo) AS run FROM b),
g AS (SELECT o_orderpriority, min(i) - 1 AS first, max(i) AS last, any_value(dx) / 100.0 AS constant FROM r WHERE dx <> 0 GROUP BY o_orderpriority, run),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY last - first DESC, first) AS rk FROM g WHERE last - first + 1 >= 5)
SELECT o_orderpriority, first::BIGINT AS first, last::BIGINT AS last, constant::DOUBLE AS constant FROM k WHERE rk = 1""")
def progression_runs(t: Tables):
    out = fo.progression_runs(month_cells(t), ["o_orderpriority"])
    return rounded(out.select("o_orderpriority", "first", "last", "constant"), 4)


# ---- totals, percentages, means --------------------------------------------------------------

def status_cells(t: Tables):
    """Per customer nation: orders by status with their share and a total row.  Every fifth nation prints
    a total that is 3 too high, every sixth a share that is 4 points too high."""
    nation = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = nation.groupBy(F.col("c_nationkey").cast("long").alias("nation"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"))
    total = s.groupBy("nation").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    rows = s.join(total, "nation").select(
        "nation", F.ascii("o_orderstatus").alias("row_no"), F.col("o_orderstatus").alias("label"), "n",
        F.floor((F.col("n") * 2000 + F.col("total")) / (F.col("total") * 2)).cast("long").alias("tenths"))
    rows = rows.withColumn("tenths", F.col("tenths") + F.when(
        (F.col("nation") % 6 == 2) & (F.col("label") == "F"), 40).otherwise(0))
    sums = total.select(
        "nation", F.lit(999).alias("row_no"), F.lit("Total").alias("label"),
        (F.col("total") + 3 * (F.col("nation") % 5 == 1).cast("long")).alias("n"),
        F.lit(1000).cast("long").alias("tenths"))
    both = rows.unionByName(sums)
    return pt.frame_cells(both, ["nation"], "row_no", {
        "status": F.col("label"), "count": F.col("n").cast("string"), "percent": fixed(F.col("tenths"), 1)})


_STATUS = """
s AS (SELECT c_nationkey::BIGINT AS nation, o_orderstatus AS label, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
tt AS (SELECT nation, sum(n)::BIGINT AS total FROM s GROUP BY nation),
r AS (SELECT s.*, total, total + 3 * (s.nation % 5 = 1)::BIGINT AS written,
        (n * 2000 + total) // (total * 2) + CASE WHEN s.nation % 6 = 2 AND label = 'F' THEN 40 ELSE 0 END AS tenths
      FROM s JOIN tt USING (nation))"""


@query("totals", f"""
WITH {_STATUS},
c AS (SELECT nation, 'count' AS name, total::DOUBLE AS parts, written::DOUBLE AS written FROM r
      UNION SELECT nation, 'percent', sum(tenths) / 10.0, 100.0 FROM r GROUP BY nation)
SELECT nation, name, round(parts, 4) AS parts, written,
       (abs(parts - written) > greatest(0.05, 0.005 * greatest(abs(parts), 1)))::BIGINT AS bad FROM c""")
def totals(t: Tables):
    out = fo.total_mismatches(status_cells(t), ["nation"]).where("direction = 'column'")
    return rounded(out.select("nation", "name", "parts", "written", "bad"), 4)


@query("percent_rows", f"""
WITH {_STATUS},
e AS (SELECT *, n * 100.0 / written AS expected, abs(n * 100.0 / written - tenths / 10.0) > 0.6 AS bad FROM r),
k AS (SELECT nation, count(*) AS n_rows, count(*) FILTER (bad) AS n_bad FROM e GROUP BY nation)
SELECT nation, label, n::DOUBLE AS count, round(tenths / 10.0, 2)::DOUBLE AS percent, round(expected, 4)::DOUBLE AS expected,
       CASE WHEN 2 * n_bad > n_rows THEN 'abstain' WHEN bad THEN 'mismatch' ELSE 'ok' END AS status
FROM e JOIN k USING (nation) WHERE n_rows >= 3""")
def percent_rows(t: Tables):
    out = fo.percent_rows(status_cells(t), ["nation"])
    return rounded(out.select("nation", "label", "count", "percent", "expected", "status"), 4)


def order_cells(t: Tables):
    """Per flag: one printed row per order with the size and mean quantity of its lines."""
    q = F.sum(F.col("l_quantity").cast("long"))
    per = t("lineitem").groupBy("l_returnflag", "l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), q.alias("s")).where("n >= 3")
    m = F.floor((F.col("s") * 200 + F.col("n")) / (F.col("n") * 2)).cast("long")
    off = (F.col("l_orderkey") % 3 == 1).cast("long")
    return pt.frame_cells(per, ["l_returnflag"], "l_orderkey", {
        "order": F.col("l_orderkey").cast("string"), "n": F.col("n").cast("string"),
        "mean": fixed(m + off, 2)})


@query("grim_rows", """
WITH m AS (SELECT l_returnflag, l_orderkey AS row_no, count(*) AS n, sum(l_quantity)::BIGINT AS s FROM lineitem
           GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT *, (s * 200 + n) // (n * 2) + (row_no % 3 = 1)::BIGINT AS m100 FROM m)
SELECT l_returnflag, row_no, n::DOUBLE AS n, CASE WHEN n >= 100 THEN 'abstain'
       WHEN 2 * least((m100 * n) % 100, 100 - (m100 * n) % 100) <= n THEN 'ok' ELSE 'impossible' END AS verdict FROM r""")
def grim_rows(t: Tables):
    out = fo.grim_rows(order_cells(t), ["l_returnflag"])
    return out.select("l_returnflag", "row_no", "n", "verdict")


@query("table_votes", """
WITH s AS (SELECT p_brand, count(*) AS n, count(*) FILTER (p_partkey % 31 = 0) AS odd FROM part GROUP BY p_brand)
SELECT p_brand, 'F3' AS family, CASE WHEN n >= 8 THEN 2 ELSE 1 END::BIGINT AS votes, 'low' AS level FROM s
WHERE n >= 10 AND odd > 0 AND odd < 0.1 * n""")
def table_votes(t: Tables):
    """Precision and relation findings of a brand's table speak for each other."""
    cells = part_cells(t)
    both = fo.check_mixed_precision(cells, ["p_brand"]).unionByName(fo.check_relations(cells, ["p_brand"]))
    out = fo.fuse_votes(both, ["p_brand"]).where("family = 'F3'")
    return out.select("p_brand", "family", "votes", "level")


@query("table_audit")
def table_audit(t: Tables):
    """All families over the event tables; the parts are compared one by one above."""
    out = fo.audit_tables(event_cells(t), ["event_type"])
    return out.select("event_type", "family", "level", F.concat_ws(",", "columns").alias("columns"))


@query("table_participation", """
SELECT nation, family, CASE WHEN family IN ('F4', 'F6') THEN 'applicable' ELSE 'abstained' END AS state FROM (
  SELECT DISTINCT c_nationkey::BIGINT AS nation FROM orders JOIN customer ON o_custkey = c_custkey),
  (SELECT unnest(['F1', 'F2', 'F3', 'F4', 'F5', 'F6', 'F7']) AS family)""")
def table_participation(t: Tables):
    out = fo.participation(status_cells(t), ["nation"])
    return out.select("nation", "family", "state")
