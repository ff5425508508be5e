"""Reported statistics: possibility, claims, recomputation, comparison."""

from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import claims as cl
from plumbline.operators import compare as cp
from plumbline.operators import consistency as cs
from plumbline.operators import recheck as rc


@pytest.mark.parametrize("mean,n,items,decimals,lo,hi,want", [
    (3.46, 30, 1, 2, None, None, "impossible"), (3.47, 30, 1, 2, None, None, "ok"),
    (3.50, 30, 1, 2, None, None, "ok"), (3.47, 100, 1, 2, None, None, "abstain"),
    (3.4, 9, 1, 1, None, None, "ok"), (3.47, 30, 1, 1, None, None, "abstain"),
    (3.47, 30, 5, 2, None, None, "abstain"), (9.0, 30, 5, 2, 1.0, 5.0, "impossible"),
    (3.5, 10, 5, 2, 1.0, 5.0, "ok"), (3.47, 10, 5, 2, 1.0, 5.0, "impossible"),
    (3.48, 10, 5, 2, 1.0, 5.0, "ok"), (1.0, 10, 5, 2, 1.0, 5.0, "ok"),
    (5.1, 10, 5, 2, 1.0, 5.0, "impossible"), (4.0, 30, 5, 2, 1.0, 5.0, "abstain"),
    (None, 30, 1, 2, None, None, "abstain"), (3.47, 0, 1, 2, None, None, "abstain"),
])
def test_grim(frame, mean, n, items, decimals, lo, hi, want):
    df = frame([(mean, n)], "m double, n int")
    got = df.select(cs.grim_verdict(F.col("m"), F.col("n"), decimals, items, lo, hi)).first()[0]
    assert got == want


def test_grim_against_brute_force(frame):
    n = 17
    possible = {round(total / n + 1e-12, 2) for total in range(0, 5 * n + 1)}
    grid = [i / 100 for i in range(0, 501)]
    df = frame([(m, n) for m in grid], "m double, n int")
    got = {r["m"]: r["v"] for r in df.select("m", cs.grim_verdict(F.col("m"), F.col("n"), 2).alias("v")).collect()}
    assert all((got[m] == "ok") == (m in possible) for m in grid)


def test_sd_bounds_against_enumeration(frame):
    import statistics
    n, low, high = 6, 1, 5
    by_total = {}
    for seq in combinations_with_replacement(range(low, high + 1), n):
        sd = statistics.pstdev(seq)
        a, b = by_total.get(sum(seq), (9.0, -1.0))
        by_total[sum(seq)] = (min(a, sd), max(b, sd))
    rows = [(t / n, n, t) for t in by_total]
    df = frame(rows, "m double, n int, t int")
    a, b = cs.sd_bounds(F.col("m"), F.col("n"), lo=float(low), hi=float(high), ddof=0)
    for r in df.select("t", a.alias("a"), b.alias("b")).collect():
        assert (r["a"], r["b"]) == pytest.approx(by_total[r["t"]], abs=1e-9)


def test_sd_upper_bound_of_a_known_case(frame):
    df = frame([(4.0, 30)], "m double, n int")
    _, top = cs.sd_bounds(F.col("m"), F.col("n"), lo=1.0, hi=5.0, ddof=0)
    assert df.select(top).first()[0] == pytest.approx(1.6931, abs=1e-4)


def test_grimmer_states(frame):
    df = frame([(4.0, 1.2, 30), (4.0, 2.9, 30), (3.46, 1.0, 30), (4.0, 1.0, 1)], "m double, s double, n int")
    got = [r["grimmer"] for r in cs.grimmer(df, "m", "s", "n", lo=1.0, hi=5.0).collect()]
    assert got == ["ok", "impossible", "impossible", "abstain"]


TEXT = "共 120 名被试。M = 3.47, SD = 0.52, t(28) = -2.31, p < .05; F(2, 57) = 4.10. *** p<0.01, ** p<0.05, * p<0.1"


def test_quantity_claims(frame):
    df = frame([(1, TEXT)], "doc_id int, text string")
    got = {(r["kind"], r["raw"]): r for r in cl.quantity_claims(df, ["doc_id"]).collect()}
    assert got[("t", "t(28) = -2.31")]["value"] == -2.31 and got[("t", "t(28) = -2.31")]["df1"] == 28
    assert got[("f", "F(2, 57) = 4.10")]["df2"] == 57
    assert got[("n", "共 120 名")]["value"] == 120
    assert [k for k in got if k[0] == "p"] == [("p", "p < .05")]  # the legend is skipped
    row = got[("mean", "M = 3.47")]
    assert TEXT[row["pos"]:row["pos"] + len("M = 3.47")] == "M = 3.47"


def test_claims_merge_repeats(frame):
    df = frame([(1, "p = 0.02 and p = 0.02 and p = 0.03")], "doc_id int, text string")
    got = {r["raw"]: r["count"] for r in cl.unique_claims(cl.quantity_claims(df, ["doc_id"]), ["doc_id"]).collect()}
    assert got == {"p = 0.02": 2, "p = 0.03": 1}


def test_locate_offsets_match_python(frame):
    import re
    text = "aXbXXc\u0001dX\nX"
    df = frame([(1, text)], "k int, t string")
    got = sorted(r["start"] for r in tx.locate(df, ["k"], "t", {"x": "X"}, 5).collect())
    assert got == [m.start() for m in re.finditer("X", text)]


def statuses(frame, text):
    df = frame([(1, text)], "doc_id int, text string")
    return [r["status"] for r in rc.recheck(df, ["doc_id"]).collect()]


def test_recheck_states(frame):
    assert statuses(frame, "t(28) = 2.31, p = .028.") == ["consistent"]
    assert statuses(frame, "t(40) = 1.50, p < .05.") == ["decision_error"]
    assert statuses(frame, "t(28) = 2.31, p = .040.") == ["inconsistent"]
    assert statuses(frame, "采用单侧检验。t(40) = 1.80, p = .040.") == ["one_tailed"]
    assert statuses(frame, "未采用单侧检验。t(40) = 1.80, p = .040.") != ["one_tailed"]
    assert statuses(frame, "We used no one-tailed tests. t(40) = 1.80, p = .040.") != ["one_tailed"]
    assert statuses(frame, "r(20) = 1.20, p = .010.") == ["invalid"]
    assert statuses(frame, "F(2, 57) = 4.10, p = .022.") == ["consistent"]
    assert statuses(frame, "χ²(1) = 5.02, p = .025.") == ["consistent"]
    assert statuses(frame, "Spearman r(20) = .50, p = .900.") == []
    assert statuses(frame, "z = 3.00 mm") == []
    assert statuses(frame, "ｔ（２８）＝２．３１，Ｐ＝．０２８") == ["consistent"]


def test_pairing_stops_at_sentences_and_other_statistics(frame):
    assert statuses(frame, "t(28) = 2.31。p = .028") == []
    assert statuses(frame, "t(28) = 2.31 and F(2, 57) = 4.10, p = .022") == ["consistent"]
    assert statuses(frame, "t(28) = 2.31 " + "x" * 60 + " p = .028") == []


def test_wording_conflicts(frame):
    def found(text):
        df = frame([(1, text)], "doc_id int, text string")
        return [r["polarity"] for r in rc.wording_conflicts(df, ["doc_id"]).collect()]

    assert found("两组差异显著（p = .20）。") == ["pos"]
    assert found("两组差异不显著（p = .01）。") == ["neg"]
    assert found("校正后两组差异不显著（p = .01）。") == []
    assert found("若 p < .05 则差异显著。") == []
    assert found("两组差异显著（p = .01）。") == []
    assert found("差异显著（p = .01），但另一项 p = .30。") == []
    assert found("在 10% 水平上差异显著（p = .08）。") == []


def test_confidence_interval(frame):
    def state(text):
        df = frame([(1, text)], "doc_id int, text string")
        return [r["status"] for r in rc.ci_against_estimate(df, ["doc_id"]).collect()]

    assert state("差值为 5.2（95% CI [8.1, 12.3]）") == ["mismatch"]
    assert state("差值为 10.2（95% CI [8.1, 12.3]）") == ["ok"]
    assert state("year 2019.5, 95% CI [8.1, 12.3]") == ["abstain"]
    assert state("about 10.2, 95% CI [8.1, 12.3]") == ["ok"]


@pytest.mark.parametrize("kind,op,claimed,real,want", [
    ("p", "lt", 0.05, 0.04, "ok"), ("p", "lt", 0.05, 0.06, "mismatch"), ("p", "eq", 0.018, 0.02, "ok"),
    ("p", "eq", 0.0, 0.018, "mismatch"), ("p", "eq", 0.018, 0.0, "mismatch"), ("p", "eq", 0.0, 0.0002, "ok"),
    ("p", "eq", 0.10, 0.17, "minor_diff"), ("n", None, 119.0, 120.0, "mismatch"), ("n", None, 120.0, 120.0, "ok"),
    ("t", None, 2.3, 2.9, "minor_diff"), ("r2", None, 0.40, 0.47, "minor_diff"), ("or", None, 2.0, 3.5, "mismatch"),
    ("t", None, None, 2.0, "unknown"),
])
def test_compare_status(frame, kind, op, claimed, real, want):
    df = frame([(kind, op, claimed, real)], "k string, op string, c double, r double")
    assert df.select(cp.compare_status(F.col("k"), F.col("op"), F.col("c"), F.col("r"))).first()[0] == want


def test_abstract_against_body_equals_all_pairs(frame):
    import random
    rnd = random.Random(4)
    kinds = ("p", "t", "n", "r2")
    make = lambda d: (d, k := rnd.choice(kinds), round(rnd.choice([0.0, 0.0002, 0.001, rnd.random()]), 4) if k in ("p", "r2")
                      else float(rnd.randint(1, 6)), rnd.choice(["lt", "eq"]) if k == "p" else None, "raw", "")
    schema = "d int, kind string, value double, op string, raw string, context string"
    a, b = [make(i % 7) for i in range(60)], [make(i % 7) for i in range(90)]
    judged, missing = cp.abstract_against_body(frame(a, schema), frame(b, schema), ["d"])
    pairs = frame([(*x, y[2]) for x in a for y in b if x[0] == y[0] and x[1] == y[1]], schema + ", real double")
    rank = F.when(F.col("s") == "ok", 0).when(F.col("s") == "minor_diff", 1).otherwise(2)
    want = pairs.withColumn("s", cp.compare_status(F.col("kind"), F.col("op"), F.col("value"), F.col("real"))) \
        .groupBy("d", "kind", "value", "op").agg(F.min_by("s", rank).alias("s"))
    key = lambda r: (r[0], r[1], r[2], r[3] or "")
    got = {key((r["d"], r["kind"], r["value"], r["op"])): r["status"] for r in judged.collect()}
    assert got == {key((r["d"], r["kind"], r["value"], r["op"])): r["s"] for r in want.collect()}
    have = {(x[0], x[1]) for x in b}
    assert {(r["d"], r["kind"]) for r in missing.collect()} == {(x[0], x[1]) for x in a} - have


def test_soft_match_styles(frame):
    schema = "d int, kind string, value double, raw string, context string"
    claims = frame([(1, "n", 307.0, "n = 307", ""), (2, "n", 80.0, "n = 80", "招募80名"),
                    (3, "n", 28.0, "n = 28", "共28个题项"), (4, "n", 500.0, "n = 500", "")], schema)
    body = frame([(1, "n", v, "x", "") for v in (84.0, 78.0, 71.0, 74.0)]
                 + [(2, "n", 66.0, "x", ""), (3, "n", 200.0, "x", ""), (4, "n", 90.0, "x", "")], schema)
    got = {r["d"]: r["style"] for r in cp.soft_match_n(claims, body, ["d"]).collect()}
    assert got == {1: "group_sum", 2: "recruit_chain", 3: "item_quantifier", 4: None}


def test_declared_n(frame):
    claims = frame([(1, "n", 120.0, 3), (1, "n", 58.0, 1), (2, "n", 50.0, 1)], "d int, kind string, value double, count long")
    rows = frame([(1, 118), (2, 50)], "d int, n long")
    got = {r["d"]: (r["status"], r["declared"]) for r in cp.declared_n(claims, rows, ["d"]).collect()}
    assert got == {1: ("mismatch", 120), 2: ("ok", 50)}
    printed = frame([(1, 120)], "d int, n long")
    assert {r["d"]: r["status"] for r in cp.declared_n(claims, rows, ["d"], printed).collect()}[1] == "ok"


def test_abstract_needs_a_real_head(frame):
    filler = "本研究考察学习投入。" * 12
    docs = frame([(1, f"目录\n摘 要 ...... 1\n摘要\n{filler}\n关键词：a\n正文"), (2, "没有这样的标题"),
                  (3, f"摘要\n{filler}\n中文摘要\nII\n续页。\n关键词：a")], "d int, text string")
    got = {r["d"]: r["a"] for r in docs.select("d", cl.abstract_text(F.col("text")).alias("a")).collect()}
    assert got[1].strip() == filler and got[2] is None and filler in got[3] and "续页" in got[3]


def test_methods_once_per_sentence(frame):
    df = frame([(1, "本研究为被试内设计，使用重复测量ANOVA检验差异。之后采用线性回归。")], "d int, text string")
    got = sorted(r["method"] for r in cl.method_mentions(df, ["d"]).collect())
    assert got == ["linear_regression", "repeated_measures_anova"]


def test_whole_counts_and_all_p_forms(spark):
    text = ("样本量250000, n = 8, N=1,234,567 and n = 12.5; p = 1.000, p > 0.05, p < 0.1, p ≤ .05, P=.003, p = 1, "
            "共 3 名, 有效问卷 1200345 份")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.kind, r.value, r.op) for r in cl.quantity_claims(docs, ["doc_id"]).orderBy("pos").collect()]
    assert [v for k, v, _ in got if k == "n"] == [250000, 8, 1234567, 3, 1200345]
    assert [(v, o) for k, v, o in got if k == "p"] == [
        (1.0, "eq"), (0.05, "gt"), (0.1, "lt"), (0.05, "lt"), (0.003, "eq"), (1.0, "eq")]
    narrow = cl.quantity_claims(docs, ["doc_id"], patterns=cl.ft.NARROW_QUANTITY_PATTERNS)
    assert 8 not in [r.value for r in narrow.where("kind = 'n'").collect()]


def test_claim_above_a_bound(spark):
    claims = spark.createDataFrame([(1, "p", 0.05, "gt"), (2, "p", 0.05, "gt")], "k long, kind string, value double, op string")
    real = spark.createDataFrame([(1, "p", 0.2), (2, "p", 0.01)], "k long, kind string, value double")
    assert {r.k: r.status for r in cp.compare_claims(claims, real, ["k"]).collect()} == {1: "ok", 2: "mismatch"}


def test_contract_violations_of_constant_sides(spark, frame, tmp_path):
    from plumbline.plans import catalog

    catalog.load()
    rows = [(1, float(i), 0.07) for i in range(5)] + [(2, float(i), float((i * 7) % 5)) for i in range(5)] + [(3, 1.0, 1.0)]
    frame(rows, "l_orderkey long, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["contract_violations"](spark, str(tmp_path)).collect())
    assert (1, "shifted outside 0..1") in got and (3, "n below 2") in got


def test_reports_of_few_bytes_are_spread_over_the_tasks(frame, tmp_path):
    from plumbline.plans.catalog import Tables
    from plumbline.plans.reports import reports

    rows = [(part, state, float(1 + (7 * k + part) % 50)) for part in range(200) for k, state in enumerate("FOFOO")]
    df = frame(rows, "l_partkey long, l_linestatus string, l_quantity double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    made = reports(Tables(df.sparkSession, str(tmp_path))).select("doc_id", F.spark_partition_id().alias("task")).collect()
    assert len(made) == 200 and len({r.task for r in made}) > 1
