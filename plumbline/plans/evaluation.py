"""Evaluation of predictions, advice on results, and the method registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import advice as ad
from plumbline.operators import evaluation as ev
from plumbline.operators import moments as mo
from plumbline.operators import quality as q
from plumbline.operators import registry
from plumbline.plans.catalog import Tables, query, rounded

# a label of three classes from the two marks of a text, and a prediction from its length


def predictions(t: Tables):
    docs = t("documents").select("doc_id", "lang", "n_chars")
    label = F.when(F.col("toxic") == 1, ev.TRUE).when(F.col("quality") == 1, ev.FALSE).otherwise(ev.UNSURE)
    guess = F.when(F.col("n_chars") % 7 == 0, ev.TRUE).when(
        F.col("n_chars") > 600, ev.FALSE).otherwise(ev.UNSURE)
    return t("labels").join(docs, "doc_id").select(
        "doc_id", "lang", label.alias("label"), guess.alias("predicted"), "n_chars")


_P = """
p AS (SELECT doc_id, lang, n_chars, CASE WHEN toxic = 1 THEN '真' WHEN quality = 1 THEN '假' ELSE '存疑' END AS y,
             CASE WHEN n_chars % 7 = 0 THEN '真' WHEN n_chars > 600 THEN '假' ELSE '存疑' END AS v
      FROM labels JOIN documents USING (doc_id))"""
_COUNTS = """count(*) AS n, count(*) FILTER (v = y) AS strict, count(*) FILTER ((y = '真') = (v = '真')) AS directional,
       count(*) FILTER (y <> '真' AND v <> '真') AS spec_num, count(*) FILTER (y <> '真') AS spec_den,
       count(*) FILTER (y = '假' AND v = '假') AS false_num, count(*) FILTER (y = '假') AS false_den,
       count(*) FILTER (y = '真' AND v = '假') AS missed"""
_RATES = """round(strict * 100.0 / n, 4)::DOUBLE AS strict_rate, round(directional * 100.0 / n, 4)::DOUBLE AS direction_rate,
       round(spec_num * 100.0 / nullif(spec_den, 0), 4)::DOUBLE AS specificity,
       round(false_num * 100.0 / nullif(false_den, 0), 4)::DOUBLE AS false_coverage"""


@query("eval_rates", f"WITH {_P}, c AS (SELECT lang, {_COUNTS} FROM p GROUP BY lang) SELECT *, {_RATES} FROM c")
def eval_rates(t: Tables):
    return ev.rates(ev.agreement_counts(predictions(t), ["lang"]))


@query("eval_wilson", f"""
WITH {_P}, c AS (SELECT lang, {_COUNTS} FROM p GROUP BY lang),
w AS (SELECT lang, strict::DOUBLE / n AS s, n::DOUBLE AS n FROM c)
SELECT lang, round(100 * ((s + 1.9208 / n) - 1.96 * sqrt(s * (1 - s) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 5) AS low,
       round(100 * ((s + 1.9208 / n) + 1.96 * sqrt(s * (1 - s) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 5) AS high FROM w""")
def eval_wilson(t: Tables):
    out = ev.with_wilson(ev.agreement_counts(predictions(t), ["lang"]), "strict", "n", "w")
    return rounded(out.select("lang", F.col("w_low").alias("low"), F.col("w_high").alias("high")), 5)


def _trials(t: Tables):
    """Five trials by document number; one item fell back to a rule in trial 2."""
    return predictions(t).withColumns({
        "trial": (F.col("doc_id") % 5).cast("long"),
        "fell_back": (F.col("doc_id") % 5 == 2) & (F.col("doc_id") % 3 == 0)})


_TRIALS = f"""{_P}, pt AS (SELECT *, doc_id % 5 AS trial, (doc_id % 5 = 2 AND doc_id % 3 = 0) AS fb FROM p),
c AS (SELECT trial, {_COUNTS}, count(*) FILTER (fb) AS n_fallback FROM pt GROUP BY trial),
r AS (SELECT *, {_RATES} FROM c)"""


@query("eval_trials", f"""
WITH {_TRIALS}
SELECT count(*) AS trials, round(avg(strict_rate), 2) AS strict_rate_mean, round(stddev_samp(strict_rate), 3) AS strict_rate_sd,
       min(strict_rate) AS strict_rate_min, max(strict_rate) AS strict_rate_max, sum(n)::BIGINT AS n
FROM r WHERE n_fallback = 0 AND n >= 10""")
def eval_trials(t: Tables):
    good, _ = ev.trial_summary(_trials(t), [], "trial", 10, "fell_back")
    return rounded(good.select("trials", "strict_rate_mean", "strict_rate_sd", "strict_rate_min",
                               "strict_rate_max", "n"), 4, strict_rate_mean=2, strict_rate_sd=3)


@query("eval_excluded", f"""
WITH {_TRIALS}
SELECT trial, n, n_fallback, CASE WHEN n < 10 THEN 'incomplete' ELSE 'fallback' END AS reason FROM r WHERE n < 10 OR n_fallback > 0""")
def eval_excluded(t: Tables):
    _, excluded = ev.trial_summary(_trials(t), [], "trial", 10, "fell_back")
    return excluded


@query("eval_missing_arms", """
SELECT lang, string_agg(a, ',' ORDER BY a) AS missing FROM (
  SELECT l.lang, s.a FROM (SELECT DISTINCT lang FROM documents) l, (SELECT unnest(['src0', 'src1', 'src999']) AS a) s
  EXCEPT SELECT lang, source FROM documents) GROUP BY lang""")
def eval_missing_arms(t: Tables):
    out = ev.missing_arms(t("documents"), "lang", "source", ["src0", "src1", "src999"])
    return out.select("lang", F.concat_ws(",", F.array_sort("missing")).alias("missing"))


@query("eval_baselines", f"""
WITH {_P}, b AS (SELECT y, unnest(['真', '假', '存疑']) AS v FROM p),
c AS (SELECT v AS baseline, {_COUNTS} FROM b GROUP BY v) SELECT *, {_RATES} FROM c""")
def eval_baselines(t: Tables):
    return ev.constant_baselines(predictions(t), [])


@query("eval_counterfactual", f"""
WITH {_P}, n AS (SELECT y, v, CASE WHEN n_chars < 200 THEN '假' ELSE v END AS w FROM p)
SELECT v AS predicted, w AS "new", y AS label, count(*) AS n FROM n WHERE v <> w GROUP BY ALL""")
def eval_counterfactual(t: Tables):
    _, flips = ev.counterfactual(predictions(t), F.col("n_chars") < 200)
    return flips


@query("eval_counterfactual_rates", f"""
WITH {_P}, n AS (SELECT 'current' AS version, y, v FROM p UNION ALL
  SELECT 'candidate', y, CASE WHEN n_chars < 200 THEN '假' ELSE v END FROM p),
c AS (SELECT version, {_COUNTS} FROM n GROUP BY version) SELECT *, {_RATES} FROM c""")
def eval_counterfactual_rates(t: Tables):
    scores, _ = ev.counterfactual(predictions(t), F.col("n_chars") < 200)
    return scores


@query("eval_self_check", f"""
WITH {_P}
SELECT doc_id::VARCHAR AS subject, 'excerpt_too_long' AS problem FROM p WHERE n_chars > 5000
UNION ALL SELECT doc_id::VARCHAR, 'no_hit' FROM p WHERE n_chars % 11 = 0
UNION ALL SELECT y, 'class_too_small' FROM p GROUP BY y HAVING count(*) < CASE WHEN y = '真' THEN 8 ELSE 5 END""")
def eval_self_check(t: Tables):
    items = predictions(t).join(t("documents").select("doc_id", F.col("text").alias("excerpt")), "doc_id")
    items = items.withColumn("reasons", F.when(F.col("n_chars") % 11 == 0, F.array().cast("array<string>"))
                             .otherwise(F.array(F.lit("passive"))))
    return ev.corpus_self_check(items, "doc_id", longest=5000)


@query("result_diff", """
WITH a AS (SELECT p_brand, count(*) AS n, max(p_size) AS top FROM part GROUP BY p_brand),
b AS (SELECT p_brand, count(*) AS n, max(p_size) + (p_brand = 'Brand#3')::INT AS top FROM part WHERE p_brand <> 'Brand#7' GROUP BY p_brand)
SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, CASE WHEN b.p_brand IS NULL THEN 'only_mine' ELSE 'both' END AS side, f.field,
       CASE f.field WHEN 'n' THEN a.n::VARCHAR ELSE a.top::VARCHAR END AS mine, CASE f.field WHEN 'n' THEN b.n::VARCHAR ELSE b.top::VARCHAR END AS theirs
FROM a FULL JOIN b USING (p_brand), (SELECT unnest(['n', 'top']) AS field) f
WHERE CASE f.field WHEN 'n' THEN a.n IS DISTINCT FROM b.n ELSE a.top IS DISTINCT FROM b.top END""")
def result_diff(t: Tables):
    a = t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("top"))
    b = a.where("p_brand <> 'Brand#7'").withColumn(
        "top", F.col("top") + (F.col("p_brand") == "Brand#3").cast("int"))
    return ev.result_diff(a, b, ["p_brand"], ["n", "top"])


@query("planted_recall", """
WITH i AS (SELECT DISTINCT 'negative balance in ' || n_name AS title FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0),
a AS (SELECT n_nationkey AS no, n_name FROM nation WHERE n_nationkey % 2 = 0),
h AS (SELECT a.no, count(i.title) AS n_hits FROM a LEFT JOIN i ON contains(i.title, a.n_name) GROUP BY a.no)
SELECT no::BIGINT AS no, '' AS title, n_hits, (n_hits > 0)::BIGINT AS found FROM h
UNION ALL SELECT NULL, title, 0, 0 FROM i WHERE NOT EXISTS (SELECT 1 FROM a WHERE contains(i.title, a.n_name))""")
def planted_recall(t: Tables):
    """Nations of even key are the answer key; findings about other nations are false alarms."""
    issues = t("supplier").where("s_acctbal < 0").join(
        t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("negative balance in "), F.col("n_name")).alias("title"))
    answers = t("nation").where("n_nationkey % 2 = 0").select(
        F.col("n_nationkey").cast("long").alias("no"), F.array("n_name").alias("keywords"))
    recall, alarms = ev.planted_recall(issues, answers)
    both = recall.withColumn("title", F.lit("")).unionByName(alarms.select(
        F.lit(None).cast("long").alias("no"), "title", F.lit(0).cast("long").alias("n_hits"), F.lit(False).alias("found")))
    return rounded(both)


# ---- advice, claims, answers -----------------------------------------------------------------

def _results(t: Tables):
    out = mo.independent_t(t("lineitem"), "l_linestatus", "l_quantity", by=["l_suppkey"], equal_var=False)
    return out.select("l_suppkey", F.lit("independent_t").alias("method"),
                      (F.col("n1") + F.col("n2")).alias("n"), "cohen_d", "p")


_COHEN = """
s AS (SELECT l_suppkey, l_linestatus AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY ALL),
w AS (SELECT l_suppkey, count(*) AS k, sum(n)::BIGINT AS n, arg_min(n, g) AS n1, arg_max(n, g) AS n2, arg_min(m, g) - arg_max(m, g) AS diff,
             arg_min(v, g) AS v1, arg_max(v, g) AS v2 FROM s GROUP BY l_suppkey),
c AS (SELECT l_suppkey, n, diff / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM w WHERE k = 2 AND n1 >= 2 AND n2 >= 2)"""


@query("advice_codes", f"""
WITH {_COHEN}
SELECT l_suppkey, (n < 30)::BIGINT AS small_sample, (n BETWEEN 30 AND 99)::BIGINT AS effect_size, 1::BIGINT AS cohen_d FROM c""")
def advice_codes(t: Tables):
    out = ad.advise(_results(t))
    has = lambda code: F.array_contains("advice", code).cast("long")
    return out.select("l_suppkey", has("small_sample").alias("small_sample"),
                      has("report_effect_size").alias("effect_size"), has("report_cohen_d").alias("cohen_d"))


@query("claim_inventory", f"""
WITH {_COHEN}
SELECT l_suppkey, 'claim-' || l_suppkey || '-independent_t' AS claim_id, 'high' AS confidence, 1::BIGINT AS abstract_ok,
       round(d, 6) AS cohen_d FROM c""")
def claim_inventory(t: Tables):
    out = ad.claim_inventory(_results(t), "lineitem", ["l_suppkey"], metrics=("p", "cohen_d"))
    return rounded(out.select("l_suppkey", "claim_id", "confidence", "abstract_ok",
                              F.col("metrics")["cohen_d"].alias("cohen_d")))


@query("answer_fields", f"""
WITH {_COHEN}
SELECT l_suppkey, 'd' AS effect, round(d, 6) AS value,
       CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS size FROM c""")
def answer_fields(t: Tables):
    return rounded(ad.answer_fields(_results(t), ["l_suppkey"]))


@query("method_candidates", """
SELECT DISTINCT 'independent_t' AS method, 'two_groups' AS question, c AS candidate
FROM (SELECT l_linestatus FROM lineitem), (SELECT unnest(['mann_whitney', 'tost']) AS c)""")
def method_candidates(t: Tables):
    proposed = t("lineitem").agg(F.count_distinct("l_linestatus").alias("k")).select(
        F.when(F.col("k") == 2, "independent_t").otherwise("anova").alias("method"))
    return ad.method_candidates(proposed)


@query("registry_run", """
SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag""")
def registry_run(t: Tables):
    out = registry.run("correlation", t("lineitem"), by=["l_returnflag"], a="l_quantity", b="l_extendedprice")
    return rounded(out.select("l_returnflag", "n", "r"))


@query("registry_user_method", """
SELECT c_mktsegment, count(*) AS n, round(max(c_acctbal) - min(c_acctbal), 2) AS spread FROM customer GROUP BY c_mktsegment""")
def registry_user_method(t: Tables):
    def spread(df, group, value):
        return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"),
                                     (F.max(value) - F.min(value)).alias("spread"))

    registry.register("spread", spread, "group_value", numeric=("value",))
    try:
        out = registry.run("spread", t("customer"), group="c_mktsegment", value="c_acctbal")
    finally:
        registry.unregister("spread")
    return rounded(out, 2)
