"""Detectors: each must fire, stay silent, and survive odd input."""

from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.operators import profile as prof
from plumbline.operators import quality as q
from plumbline.operators import repair, report


def checks(df):
    return {r["check"] for r in df.collect()}


def test_column_sum_fires_and_is_silent(frame):
    rows = [(10.0, 20.0, 30.0), (11.0, 21.0, 32.0), (1.0, 2.0, 3.0), (4.0, 4.0, 8.0), (5.0, 5.0, 10.0),
            (7.0, 8.0, 99.0)]
    df = frame(rows, "part1 double, part2 double, total double")
    found = q.check_column_sum(df).collect()
    assert [(r["level"], r["n_bad"]) for r in found] == [("high", 1)]
    fixed = df.withColumn("total", F.col("part1") + F.col("part2"))
    assert not q.check_column_sum(fixed).collect()
    assert not q.check_column_sum(df.withColumn("total", F.lit(5.0))).collect()
    assert q.violations_column_sum(df, "total", ["part1", "part2"]).count() == 1


def test_column_sum_picks_the_best_group(frame):
    rows = [(float(i), float(i + 1), 100.0, float(2 * i + 1)) for i in range(9)] + [(1.0, 1.0, 3.0, 50.0)]
    df = frame(rows, "q1 double, q2 double, other double, total double")
    found = q.check_column_sum(df).first()
    assert found["columns"] == ["total", "q1", "q2"] and found["n_bad"] == 1


def test_value_range_levels(frame):
    high = frame([(float(v),) for v in (60, 70, 80, 90, 105)], "score double")
    assert q.check_value_range(high).first()["level"] == "high"
    mid = frame([(float(v),) for v in range(200, 230)], "score double")
    assert q.check_value_range(mid).first()["level"] == "mid"
    fine = frame([(float(v),) for v in (60, 70, 80, 90, 100)], "score double")
    assert not q.check_value_range(fine).collect()
    thin = frame([(500.0,), (1.0,)], "score double")
    assert not q.check_value_range(thin).collect()


def test_range_uses_the_exact_median(frame):
    # two of four below: the median is the mean of the two middle values, 1.0, which lies inside
    df = frame([(-3.0,), (-2.0,), (4.0,), (5.0,), (6.0,), (-9.0,)], "age double")
    assert q.check_value_range(df).first()["level"] == "high"
    df = frame([(-30.0,), (-20.0,), (-19.0,), (5.0,), (6.0,), (7.0,)], "age double")
    assert not q.check_value_range(df).collect()


def test_scale_items(frame):
    rows = [(1 + i % 5, 1 + (i * 2) % 5, 1 + (i * 3) % 5) for i in range(20)] + [(99, 3, 3)]
    df = frame(rows, "q1 int, q2 int, q3 int")
    groups = prof.scale_groups(df)
    assert groups == {"q": ["q1", "q2", "q3"]}
    assert q.check_scale_range(df, groups).first()["columns"] == ["q1"]
    assert not q.check_scale_range(df.where("q1 < 8"), groups).collect()


def test_straightlining_levels(frame):
    flat = [(3, 3, 3)] * 6 + [(1, 2, 3)] * 6
    df = frame(flat, "q1 int, q2 int, q3 int")
    assert q.check_straightlining(df).first()["level"] == "high"
    some = frame([(3, 3, 3)] * 3 + [(1, 2, 3), (2, 3, 1), (3, 1, 2)] * 3, "q1 int, q2 int, q3 int")
    assert q.check_straightlining(some).first()["level"] == "mid"
    assert not q.check_straightlining(frame([(1, 2, 3)] * 12, "q1 int, q2 int, q3 int")).collect()


def test_reverse_item(frame):
    rows = [(k, k, 6 - k) for k in (1, 2, 3, 4, 5)] * 3
    found = q.check_reverse_scoring(frame(rows, "q1 int, q2 int, q3 int")).first()
    assert "q3" in found["columns"]


def test_integer_decimals_and_constant(frame):
    df = frame([(float(i), 7.0) for i in range(19)] + [(2.5, 7.0)], "item_count double, k double")
    assert q.check_integer_decimals(df).first()["n_bad"] == 1
    assert q.check_low_variance(df).first()["columns"] == ["k"]
    means = frame([(i + 0.5,) for i in range(20)], "item_count double")
    assert not q.check_integer_decimals(means).collect()


def test_missing_pattern(frame):
    rows = [(i, None, "x" if i % 2 else None, i) for i in range(10)]
    df = frame(rows, "a int, b string, c string, d int")
    found = {(r["check"], tuple(r["columns"])): r["level"] for r in q.check_missing_pattern(df).collect()}
    assert found == {("missing_column", ("b",)): "high", ("missing_column", ("c",)): "mid",
                     ("missing_rows", ()): "mid"}


def test_pre_post_names_and_regularity(frame):
    assert names.pre_post_pairs(["pre_score", "post_score", "x_t1", "x_t2", "test1"]) == [
        ("pre_score", "post_score"), ("x_t1", "x_t2")]
    assert names.pre_post_pairs(["前测", "后测"]) == [("前测", "后测")]
    rows = [(float(i * i), float(i * i + 3)) for i in range(10)]
    df = frame(rows, "pre_score double, post_score double")
    assert q.check_diff_regularity(df).first()["metric"]["difference"] == 3.0
    noisy = df.withColumn("post_score", F.col("post_score") + F.col("pre_score") % 3)
    assert not q.check_diff_regularity(noisy).collect()


def test_duplicates_need_more_than_chance(frame):
    unique = [(i, i * 1.7, i * 0.3, f"t{i}") for i in range(40)]
    df = frame(unique + unique[:3], "k int, a double, b double, c string")
    assert checks(q.check_duplicate_rows(df, id_columns=[])) == {"duplicate_rows"}
    coarse = frame([(i % 2, i % 3) for i in range(60)], "a int, b int")
    assert not q.check_duplicate_rows(coarse, id_columns=[]).collect()


def test_fingerprints_are_compiled(frame):
    rows = [(1, 2.5, "x"), (1, 2.5, "x"), (2, None, "y"), (3, float("nan"), None), (None, None, None), (None, None, None)]
    df = frame(rows, "id int, a double, b string")
    for body in ((), ("a", "b")):
        out = q.fingerprint_counts(df, body)
        assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r["kind"]: (r["n_rows"], r["n_unique"], r["n_unique_ok"], r["n_repeated"], r["n_groups"]) for r in out.collect()}
        bodies = {q.BODY: (2, 1, 1, 2, 1)} if body else {}
        known = (1, 1, 1) if body else (0, 0, 0)
        assert got == {q.WHOLE: (6, 4, 4, 4, 2), 0: (4, 3, known[0], 2, 1), 1: (3, 2, known[1], 2, 1), 2: (3, 2, known[2], 2, 1)} | bodies


def test_duplicates_by_fingerprint(frame, spark):
    schema = "id int, a string, b string, c double"
    rows = [(i, f"a{i}", f"b{i}", i * 0.5) for i in range(30)]
    # a null is told from one in the next column; zeros of both signs are one value, as in a grouping
    near = [(100, None, "x", 1.0), (101, "x", None, 1.0)]
    zeros = [(102, "z", "z", 0.0), (103, "z", "z", -0.0)]
    got = q.check_duplicate_rows(frame(rows + near + zeros, schema), id_columns=["id"]).collect()
    assert [(r["check"], r["n_bad"], r["n_total"]) for r in got] == [("duplicate_body", 2, 32)]
    # an incomplete body takes no part, by null or by not a number
    holes = [(104, "n", "n", float("nan")), (105, "n", "n", float("nan")), (106, "n", None, 2.0), (107, "n", None, 2.0)]
    assert not q.check_duplicate_rows(frame(rows + holes, schema), id_columns=["id"]).collect()
    again = q.check_duplicate_rows(frame(rows + near + near, schema), id_columns=["id"]).collect()
    assert [(r["check"], r["n_bad"], r["n_total"]) for r in again] == [("duplicate_rows", 4, 34)]
    assert not q.check_duplicate_rows(frame([], schema), id_columns=["id"]).collect()
    counts = {r["kind"]: r for r in q.fingerprint_counts(frame(rows + near + holes, schema), ["a", "b", "c"]).collect()}
    assert (counts[q.WHOLE]["n_rows"], counts[q.BODY]["n_rows"]) == (36, 30)
    assert (counts[1]["n_unique"], counts[1]["n_unique_ok"]) == (32, 30)


def test_duplicates_read_the_table_once(frame, spark, tmp_path):
    frame([(i, i % 7, float(i), f"t{i}") for i in range(50)], "id int, a int, b double, c string").write.parquet(str(tmp_path / "t"))
    found = q.check_duplicate_rows(spark.read.parquet(str(tmp_path / "t")), id_columns=["id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan


def test_response_duration(frame):
    df = frame([(float(v),) for v in [100] * 12 + [10]], "duration double")
    assert q.check_response_duration(df).first()["n_bad"] == 1
    assert not q.check_response_duration(frame([(2.0,)] * 12, "duration double")).collect()
    assert q.duration_columns(frame([(1.0,)], "reaction_time double")) == []


def test_benford_gates(frame):
    uniform = frame([(float(v),) for v in range(1, 1001)], "amount double")
    assert q.benford_table(uniform).first()["status"] == "flagged"
    law = frame([(10 ** (i / 250),) for i in range(1000)], "amount double")
    assert q.benford_table(law).first()["status"] == "clear"
    negative = frame([(float(v - 5),) for v in range(1, 1001)], "amount double")
    assert q.benford_table(negative).first()["status"] == "abstained"
    assert not q.check_benford(frame([(float(v),) for v in range(1, 1001)], "unit_price double")).collect()


def test_digit_tables_agree_with_exact_distinct_counts(frame):
    df = frame([(float(k % 40), 10 ** (k % 300 / 100), k) for k in range(2000)], "few double, wide double, serial int")
    for table in (q.benford_table, q.terminal_table):
        pick = lambda exact: {r.name: (r.n, r.status) for r in table(
            df, columns=["few", "wide", "serial"], exact=exact).collect()}
        assert pick(True) == pick(False)
    exact = {r.name: r.n_unique for r in q.terminal_table(df, columns=["few", "serial"], exact=True).collect()}
    assert exact == {"few": 40, "serial": 2000}


def test_terminal_digits(frame):
    heaped = frame([(float(100 + 5 * (i % 30)),) for i in range(200)], "pressure double")
    assert q.terminal_table(heaped).first()["status"] == "flagged"
    even = frame([(100.0 + i % 97,) for i in range(970)], "pressure double")
    assert q.terminal_table(even).first()["status"] == "clear"
    keys = frame([(i,) for i in range(200)], "serial int")
    assert q.terminal_table(keys).first()["status"] == "abstained"


def test_digit_expressions(frame):
    from plumbline.functions import numbers as num
    values = [120.0, 12.5, 0.042, -3.7, 12345678.25, 0.0005, 1e20]
    df = frame([(v,) for v in values], "v double")
    got = df.select(num.terminal_digit(F.col("v")).alias("t"), num.first_digit(F.col("v")).alias("f")).collect()
    assert [r["t"] for r in got][:5] == [0, 5, 2, 7, 5]
    assert [r["f"] for r in got] == [1, 1, 4, 3, 1, 5, 1]


def test_user_rules_are_silent_when_most_rows_break_them(frame):
    df = frame([(float(i),) for i in range(10)], "anxiety_total double")
    rule = {"match": ["total"], "min": 0, "max": 8, "integer": True}
    assert [r["check"] for r in q.check_rules(df, [rule]).collect()] == ["rule_range"]
    assert not q.check_rules(df, [{"match": ["total"], "min": 7, "max": 9}]).collect()


def test_declared_design(frame):
    claims = frame([("paired_t",), ("anova",)], "method string")
    df = frame([(i + 0.5,) for i in range(10)], "score double")
    assert checks(q.check_declared_design(df, claims)) == {"declared_paired", "declared_groups"}
    fine = frame([(1.0, 2.0, "a"), (2.0, 3.0, "b")], "s_pre double, s_post double, g string")
    assert not q.check_declared_design(fine, claims).collect()


def test_report_lists_failures(frame):
    df = frame([(float(i), 7.0) for i in range(20)], "x double, k double")

    def broken(_):
        raise RuntimeError("no")

    issues, status = report.quality_report(df, extra={"broken": broken})
    states = {r["check"]: r["state"] for r in status.collect()}
    assert states["broken"] == "failed" and "low_variance" in checks(issues)
    verdict = report.verdict(issues, status).first()
    assert not verdict["complete"] and verdict["checks_failed"] == 1
    empty = report.verdict(q.no_issues(df), status).first()
    assert empty["verdict"] == "incomplete"


def test_report_isolates_runtime_failures(frame):
    df = frame([(float(i), 7.0) for i in range(20)], "x double, k double")
    bad = lambda d: d.select(F.raise_error(F.lit("boom")).cast("string").alias("check"))
    issues, status = report.quality_report(df, extra={"bad": bad}, isolate=True)
    assert {r["check"]: r["state"] for r in status.collect()}["bad"] == "failed"
    assert "low_variance" in checks(issues)


def test_results_do_not_depend_on_order_or_partitions(frame):
    rows = [(i, float((i * 7919) % 1000 + 1), 1 + i % 5) for i in range(600)]
    df = frame(rows, "k int, amount double, q1 int")
    one = sorted(map(tuple, q.benford_table(df.coalesce(1)).collect()))
    many = sorted(map(tuple, q.benford_table(df.repartition(7).orderBy(F.desc("k"))).collect()))
    assert one == many


def test_repair(frame):
    df = frame([(1, "a", 5), (2, "a", 5), (3, None, 5), (4, None, 5), (4, None, 5)], "k int, b string, v int")
    assert repair.drop_exact_duplicates(df).count() == 4
    kept = sorted(r["k"] for r in repair.drop_body_duplicates(df, ["b", "v"]).collect())
    assert kept == [1, 3, 4, 4]
    scale = frame([(1, 2), (2, 9), (3, None)], "k int, q int")
    fixed = {r["k"]: r["q"] for r in repair.reverse_score(scale, ["q"]).collect()}
    assert fixed == {1: 6, 2: 9, 3: None}
    log = repair.reverse_score_log(scale, ["k"], ["q"]).collect()
    assert [(r["k"], r["before"], r["after"]) for r in log] == [(1, "2", "6")]
    same = repair.change_log(scale, repair.reverse_score(scale, ["q"]), ["k"], ["q"]).collect()
    assert [(r["k"], r["before"], r["after"]) for r in same] == [(1, "2", "6")]


def test_profile_kinds(frame):
    df = frame([(i, float(i) / 3, i % 3, "ab"[i % 2]) for i in range(100)], "id int, x double, g int, t string")
    got = {r["name"]: r for r in prof.profile(df).collect()}
    assert got["x"]["type"] == "continuous" and got["g"]["is_numeric_discrete"]
    assert got["t"]["type"] == "categorical" and got["t"]["mean"] is None
    rec = prof.recommend_method(prof.profile(df), order=df.columns).first()
    assert (rec["method"], rec["group_col"], rec["value_col"]) == ("independent_t", "t", "x")
    approx = {r["name"]: r["n_unique"] for r in prof.profile(df, approx=True).collect()}
    assert approx["t"] == 2
    top = {r["name"]: r["top_values"] for r in prof.profile_with_top(df).collect()}
    assert [x["value"] for x in top["t"]] == ["a", "b"] and top["x"] is None


def test_empty_frame_never_crashes(frame):
    df = frame([], "score double, q1 int, total double, duration double")
    issues, _ = report.quality_report(df)
    assert issues.collect() == []


def test_many_columns_still_try_named_groups(frame):
    parts = {f"score_{k}": float(k) for k in range(4)} | {f"other{k}_x": 1.0 for k in range(14)}
    columns = [*parts, "score_total"]
    rows = [(*[v + i for v in parts.values()], sum(v + i for n, v in parts.items() if n.startswith("score_")) + (9 if i == 7 else 0))
            for i in range(12)]
    df = frame(rows, ", ".join(f"{c} double" for c in columns))
    found = q.check_column_sum(df).collect()
    assert [r["n_bad"] for r in found] == [1] and not any("other" in c for c in found[0]["columns"])


def test_last_digits_of_nearly_all_different_integers(frame):
    rows = [(10 * k + 5 * (k % 3 == 0), 7 * k) for k in range(970)]
    rows += [(rows[k][0], 7 * (970 + k)) for k in range(30)]
    df = frame(rows, "income long, serial_value long")
    for exact in (False, True):
        got = {r.name: (r.n_unique, r.status) for r in q.terminal_table(df, columns=["income", "serial_value"], exact=exact).collect()}
        assert got == {"income": (970, "flagged"), "serial_value": (1000, "abstained")}
    assert [r["columns"] for r in q.check_terminal_digits(df).collect()] == [["income"]]
    gates = frame([(v % 49 + 1 + 1000 * (v % 49 == 48), v % 50 + 1 + 1000 * (v % 50 == 49), 10.0 * (v % 4), 10.0 * (v % 5)) for v in range(2000)],
                  "a long, b long, c double, d double")
    for table in (q.benford_table, q.terminal_table):
        for exact in (False, True):
            got = {r.name: (r.n_unique, r.eligible) for r in table(gates, columns=["a", "b", "c", "d"], exact=exact).collect()}
            assert {k: v[0] for k, v in got.items()} == {"a": 49, "b": 50, "c": 4, "d": 5}
            assert got["c"][1] is False and got["a"][1] is (table is q.terminal_table) and got["b"][1] is True


def test_measured_column_with_repeated_values(frame):
    df = frame([("ab"[i % 2], float(i % 7) + 0.5) for i in range(400)], "t string, price double")
    profiled = prof.profile(df)
    assert prof.recommend_method(profiled, order=df.columns).first()["method"] == "chi_square"
    rec = prof.recommend_method(profiled, order=df.columns, measured=["price"]).first()
    assert (rec["method"], rec["group_col"], rec["value_col"]) == ("independent_t", "t", "price")
