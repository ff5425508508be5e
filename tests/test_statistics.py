"""Tests and models against plain numpy on small data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import dist
from plumbline.operators import matrix as mx
from plumbline.operators.grouped_logit import grouped_logistic
from plumbline.operators import moments as mo
from plumbline.operators import ordering, ranks, registry


def rng_frame(frame, seed, n=60):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, n)
    x = rng.normal(size=n).round(2)
    z = rng.normal(size=n).round(2)
    y = (1.5 * x - 0.5 * z + g + rng.normal(size=n)).round(2)
    rows = [(int(i), "abc"[g[i]], "uv"[i % 2], float(x[i]), float(z[i]), float(y[i])) for i in range(n)]
    return frame(rows, "k int, g string, h string, x double, z double, y double"), rows


@pytest.mark.parametrize("seed", [1, 7, 42])
def test_ols_matches_lstsq(frame, seed):
    df, rows = rng_frame(frame, seed)
    a = np.array([[1, r[3], r[4]] for r in rows])
    y = np.array([r[5] for r in rows])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    rss = ((y - a @ beta) ** 2).sum()
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * rss / (len(y) - 3))
    model, coef = mx.linear_regression(df, "y", ["x", "z"])
    got = sorted(coef.collect(), key=lambda r: r["position"])
    assert np.allclose([r["beta"] for r in got], beta)
    assert np.allclose([r["se"] for r in got], se)
    assert model.first()["rss"] == pytest.approx(rss)


def test_ols_abstains(frame):
    df, _ = rng_frame(frame, 1)
    model, coef = mx.linear_regression(df.withColumn("w", F.col("x") * 3), "y", ["x", "w"])
    assert model.first()["status"] == "abstained" and coef.count() == 0
    model, _ = mx.linear_regression(df.limit(3), "y", ["x", "z"])
    assert model.first()["status"] == "abstained"


def test_logit_matches_direct_newton(frame):
    rng = np.random.default_rng(5)
    x = rng.normal(size=200)
    p = 1 / (1 + np.exp(-(0.3 + 1.2 * x)))
    y = (rng.random(200) < p).astype(int)
    df = frame([(int(b), float(a)) for a, b in zip(x, y)], "y int, x double")
    beta = np.zeros(2)
    a = np.column_stack([np.ones(200), x])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-a @ beta))
        w = mu * (1 - mu)
        beta = beta + np.linalg.solve((a * w[:, None]).T @ a, a.T @ (y - mu))
    model, coef = mx.logistic_regression(df, "y", ["x"])
    got = [r["beta"] for r in sorted(coef.collect(), key=lambda r: r["position"])]
    assert np.allclose(got, beta, atol=1e-6)
    row = model.first()
    assert row["converged"] and not row["separation"] and 0 < row["mcfadden_r2"] < 1


def test_grouped_logit_equals_one_model_a_group(frame):
    rng = np.random.default_rng(7)
    rows = []
    for g, n, slope in (("a", 300, 1.0), ("b", 80, -2.0), ("c", 4, 1.0)):
        x = rng.normal(size=(n, 2))
        y = rng.random(n) < 1 / (1 + np.exp(-(0.2 + x @ [slope, 0.5])))
        rows += [(g, int(t), float(u), float(v)) for t, (u, v) in zip(y, x)]
    rows += [("d", 1, float(k), 0.0) for k in range(30)] + [("e", int(k > 15), float(k), 1.0) for k in range(30)]
    rows += [("a", None, 1.0, 1.0), (None, 1, 1.0, 1.0), ("b", 1, None, 1.0)]
    df = frame(rows, "grp string, y int, u double, v double")
    model, coef = grouped_logistic(df, "y", ["u", "v"], ["grp"])
    by = {r[0]: r for r in model.collect()}
    assert [by[g]["status"] for g in "abcd"] == ["ok", "ok", "abstained", "abstained"] and by["e"]["separation"]
    got = {}
    for r in coef.drop("z").collect():
        got.setdefault(r[0], {})[r["position"]] = (r[3], r["se"])
    for g in "ab":
        part = np.array([(t, u, v) for k, t, u, v in rows if k == g and t is not None and u is not None])
        a, y, beta = np.column_stack([np.ones(len(part)), part[:, 1:]]), part[:, 0], np.zeros(3)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-a @ beta))
            h = (a * (mu * (1 - mu))[:, None]).T @ a
            beta = beta + np.linalg.solve(h, a.T @ (y - mu))
        se = np.sqrt(np.diag(np.linalg.inv(h)))
        assert np.allclose([got[g][k][0] for k in range(3)], beta, atol=1e-6) and np.allclose([got[g][k][1] for k in range(3)], se, atol=1e-5)


def test_logit_flags_separation(frame):
    df = frame([(int(i >= 10), float(i)) for i in range(20)], "y int, x double")
    model, _ = mx.logistic_regression(df, "y", ["x"], max_steps=15)
    assert model.first()["separation"]
    with pytest.raises(ValueError):
        mx.logistic_regression(df.withColumn("y", F.lit(1)), "y", ["x"])


@pytest.mark.parametrize("coding", ["sum", "treatment"])
def test_two_way_matches_row_level_least_squares(frame, coding):
    df, rows = rng_frame(frame, 7)
    la, lb = sorted({r[1] for r in rows}), sorted({r[2] for r in rows})
    y = np.array([r[5] for r in rows])

    def code(levels, values):
        base = levels[-1] if coding == "sum" else levels[0]
        cols = [[1.0 if v == lv else (-1.0 if coding == "sum" and v == base else 0.0) for v in values]
                for lv in levels if lv != base]
        return np.array(cols).T

    a, b = code(la, [r[1] for r in rows]), code(lb, [r[2] for r in rows])
    ab = (a[:, :, None] * b[:, None, :]).reshape(len(y), -1)
    one = np.ones((len(y), 1))

    def rss(*parts):
        m = np.hstack(parts)
        return ((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum()

    full = rss(one, a, b, ab)
    want = {"a": rss(one, b, ab) - full, "b": rss(one, a, ab) - full, "ab": rss(one, a, b) - full}
    got = {r["term"]: r for r in mx.two_way_anova(df, "g", "h", "y", coding=coding).collect()}
    for term, ss in want.items():
        assert got[term]["ss"] == pytest.approx(ss, rel=1e-9)
        assert got[term]["ss_error"] == pytest.approx(full, rel=1e-9)


def test_repeated_measures_matches_rows(frame):
    rng = np.random.default_rng(3)
    m = (rng.normal(size=(12, 4)) + np.arange(4) * 0.4 + rng.normal(size=(12, 1))).round(3)
    df = frame([tuple(map(float, r)) for r in m], "t1 double, t2 double, t3 double, t4 double")
    grand = m.mean()
    ss_time = 12 * ((m.mean(0) - grand) ** 2).sum()
    ss_subject = 4 * ((m.mean(1) - grand) ** 2).sum()
    ss_error = ((m - grand) ** 2).sum() - ss_time - ss_subject
    model, pairs = mx.repeated_measures_anova(df, ["t1", "t2", "t3", "t4"])
    row = model.first()
    assert row["ss_time"] == pytest.approx(ss_time) and row["ss_error"] == pytest.approx(ss_error)
    basis = np.linalg.qr(np.column_stack([np.ones(4), np.eye(4)[:, :3]]))[0][:, 1:]
    s = np.cov(m @ basis, rowvar=False)
    w = np.linalg.det(s) / (np.trace(s) / 3) ** 3
    eps = np.trace(s) ** 2 / (3 * (s ** 2).sum())
    assert row["mauchly_w"] == pytest.approx(w) and row["epsilon_gg"] == pytest.approx(eps)
    chi2 = -((12 - 1) - (2 * 9 + 3 + 2) / 18) * math.log(w)
    assert row["mauchly_chi2"] == pytest.approx(chi2)
    d = m[:, 0] - m[:, 1]
    first = [r for r in pairs.collect() if (r["a"], r["b"]) == ("t1", "t2")][0]
    assert first["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(12)))


def test_alpha_by_hand(frame):
    m = np.array([[1, 2, 3], [2, 2, 4], [4, 5, 5], [3, 3, 4], [5, 4, 5], [2, 1, 2]], dtype=float)
    df = frame([tuple(map(float, r)) for r in m] + [(None, 1.0, 2.0)], "a double, b double, c double")
    want = 1.5 * (1 - m.var(0, ddof=1).sum() / m.sum(1).var(ddof=1))
    overall, items = mx.cronbach_alpha(df, ["a", "b", "c"])
    assert overall.first()["alpha"] == pytest.approx(want) and overall.first()["n"] == 6
    # without a the row that misses only a takes part
    bc = np.vstack([m[:, 1:], [1.0, 2.0]])
    want = 2 * (1 - bc.var(0, ddof=1).sum() / bc.sum(1).var(ddof=1))
    got = {r["item"]: r["alpha_if_deleted"] for r in items.collect()}
    assert got["a"] == pytest.approx(want)


def test_t_and_levene_by_hand(frame):
    a, b = [1.0, 2.0, 4.0, 7.0, 9.0], [2.0, 2.5, 3.0, 3.5, 10.0, 11.0]
    df = frame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    row = mo.independent_t(df, "g", "v").first()
    za = np.abs(np.array(a) - np.median(a))
    zb = np.abs(np.array(b) - np.median(b))
    grand = np.concatenate([za, zb]).mean()
    between = 5 * (za.mean() - grand) ** 2 + 6 * (zb.mean() - grand) ** 2
    within = ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum()
    assert row["levene_w"] == pytest.approx(between / (within / 9))
    pooled = (np.var(a, ddof=1) * 4 + np.var(b, ddof=1) * 5) / 9
    t = (np.mean(a) - np.mean(b)) / math.sqrt(pooled * (1 / 5 + 1 / 6))
    assert row["t"] == pytest.approx(t) and row["df"] == 9
    welch = mo.independent_t(df, "g", "v", equal_var=False).first()
    assert welch["df"] < 9
    three = df.unionByName(frame([("c", 1.0), ("c", 2.0)], "g string, v double"))
    assert mo.independent_t(three, "g", "v", equal_var=True).count() == 0


def test_pooled_t_with_a_group_of_one_row(frame):
    df = frame([("a", 4.0), ("b", 1.0), ("b", 2.0), ("b", 6.0)], "g string, v double")
    row = mo.independent_t(df, "g", "v", equal_var=True).first()
    assert row["df"] == 2 and row["t"] == pytest.approx((4 - 3) / math.sqrt(14 / 2 * (1 + 1 / 3)))
    assert 0 < row["p"] < 1 and row["sd1"] is None
    assert mo.independent_t(df, "g", "v", equal_var=False).count() == 0
    assert mo.independent_t(df.where("v IN (1, 4)"), "g", "v", equal_var=True).count() == 0


def test_constant_values_do_not_fail(frame):
    df = frame([("a", 1.0, 2.0)] * 4 + [("b", 1.0, 2.0)] * 4 + [("c", 1.0, 2.0)] * 3,
               "g string, v double, w double")
    assert mo.anova(df, "g", "v").first()["f"] is None
    assert mo.pearson(df, "v", "w").first()["r"] is None
    assert mo.paired_t(df, "v", "w").first()["t"] is None
    assert mo.levene(df.where("g = 'a'"), "g", "v").first()["w"] is None
    assert ranks.wilcoxon(df, "v", "v").count() == 0


def test_quantiles_and_ranks_match_numpy(frame):
    rng = np.random.default_rng(11)
    v = rng.integers(0, 40, 500) / 4.0
    g = ["hot" if i % 3 else f"g{i % 5}" for i in range(500)]
    df = frame([(g[i], float(v[i])) for i in range(500)], "g string, v double")
    got = {r["g"]: r for r in ordering.quantiles(df, ["g"], "v", {"q": 0.3, "m": 0.5}).collect()}
    for key in set(g):
        mine = v[[i for i in range(500) if g[i] == key]]
        assert got[key]["q"] == pytest.approx(np.quantile(mine, 0.3))
        assert got[key]["m"] == pytest.approx(np.median(mine))
    ranked = ordering.average_ranks(ordering.value_frequency(df, [], "v"), [], "v").collect()
    order = np.argsort(v, kind="stable")
    rank = np.empty(500)
    rank[order] = np.arange(1, 501)
    for r in ranked:
        assert r["avg_rank"] == pytest.approx(rank[v == r["v"]].mean())


def test_mann_whitney_and_wilcoxon_by_pairs(frame):
    a, b = [1.0, 3.0, 3.0, 8.0], [2.0, 3.0, 9.0, 10.0, 11.0]
    df = frame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert ranks.mann_whitney(df, "g", "v").first()["u"] == u
    pre, post = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 2.0, 1.0, 7.0, 9.0]
    pairs = frame(list(zip(pre, post)), "pre double, post double")
    row = ranks.wilcoxon(pairs, "pre", "post").first()
    assert (row["n_pairs"], row["n_used"], row["w_plus"], row["w_minus"]) == (5, 4, 8.0, 2.0)


def test_exact_p_counts_every_assignment(frame):
    from itertools import combinations, product

    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k, (n1, n2) in enumerate([(1, 1), (1, 6), (2, 3), (4, 4), (3, 7), (6, 5)]):
        x = rng.permutation(n1 + n2) * 1.5
        rows += [(k, "a" if i < n1 else "b", float(v)) for i, v in enumerate(x)]
        ranks_of = np.argsort(np.argsort(x)) + 1
        low = min(s := ranks_of[:n1].sum() - n1 * (n1 + 1) // 2, n1 * n2 - s)
        every = [sum(c) - n1 * (n1 + 1) // 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
        want[k] = min(1, 2 * np.mean([u <= low for u in every]))
    rows += [(9, "a", 1.0), (9, "b", 1.0), (9, "b", 2.0)]
    got = {r["k"]: r for r in ranks.mann_whitney(frame(rows, "k int, g string, v double"), "g", "v", by=["k"]).collect()}
    assert all(got[k]["p_exact"] == pytest.approx(p, abs=1e-12) and got[k]["p_method"] == "exact" for k, p in want.items())
    assert got[9]["p_exact"] is None and got[9]["p_method"] == "normal"

    pairs, want = [], {}
    for n in (1, 3, 6, 9):
        d = (rng.permutation(n) + 1.0) * rng.choice([-1, 1], n)
        pairs += [(n, 0.0, float(x)) for x in d]
        low = min(s := sum(int(abs(x)) for x in d if x > 0), n * (n + 1) // 2 - s)
        every = [sum(i * t for i, t in enumerate(signs, 1)) for signs in product((0, 1), repeat=n)]
        want[n] = min(1, 2 * np.mean([w <= low for w in every]))
    pairs += [(20, 0.0, 1.0), (20, 0.0, -1.0)]
    got = {r["k"]: r for r in ranks.wilcoxon(frame(pairs, "k int, pre double, post double"), "pre", "post", by=["k"]).collect()}
    assert all(got[n]["p_exact"] == pytest.approx(p, abs=1e-12) for n, p in want.items())
    assert got[20]["p_exact"] is None and got[20]["p_method"] == "normal"


def test_shapiro_on_published_sample(frame):
    # weights in pounds of eleven men, the sample of the original article: W = 0.79
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = ranks.shapiro(frame([(float(v),) for v in men], "v double"), "v").first()
    assert row["w"] == pytest.approx(0.79, abs=0.005) and row["p"] < 0.01
    normal = dist.norm_quantile((np.arange(1, 201) - 0.375) / 200.25)
    row = ranks.shapiro(frame([(float(v),) for v in normal], "v double"), "v").first()
    assert row["w"] > 0.995 and row["normal"]


def test_shapiro_with_many_ties(frame, monkeypatch):
    rows = [(float(i % 4),) for i in range(400)]
    whole = ranks.shapiro(frame(rows, "v double"), "v").first()["w"]
    monkeypatch.setattr(ranks, "RANK_BLOCK", 7)
    assert ranks.shapiro(frame(rows, "v double"), "v").first()["w"] == pytest.approx(whole)


def test_chi_square_fills_empty_cells(frame):
    rows = [("a", "x")] * 5 + [("a", "y")] * 3 + [("b", "x")] * 4
    df = frame(rows, "r string, c string")
    cells = mo.contingency(df, "r", "c").collect()
    assert len(cells) == 4 and sum(c["observed"] for c in cells) == 12
    o = np.array([[5, 3], [4, 0]])
    e = o.sum(1, keepdims=True) * o.sum(0) / 12
    gap = np.abs(o - e) - np.minimum(0.5, np.abs(o - e))
    assert mo.chi_square(df, "r", "c").first()["chi2"] == pytest.approx((gap ** 2 / e).sum())


def test_registry_contracts(frame):
    df, _ = rng_frame(frame, 1)
    assert registry.run("paired_t", df, a="x", b="z").first()["n"] == 60
    with pytest.raises(ValueError, match="numeric"):
        registry.run("paired_t", df, a="x", b="g")
    with pytest.raises(ValueError, match="no column"):
        registry.run("correlation", df, a="x", b="missing")
    with pytest.raises(ValueError, match="at least"):
        registry.run("repeated_measures_anova", df, columns=["x", "z"])
    with pytest.raises(ValueError, match="built-in"):
        registry.register("anova", lambda d: d, "two_columns")
    registry.register("bad", lambda d, a, b: d.limit(1).select(F.lit(1.5).alias("p")), "two_columns")
    try:
        with pytest.raises(ValueError, match="contract"):
            registry.run("bad", df, a="x", b="z")
    finally:
        registry.unregister("bad")


@pytest.mark.parametrize("largest", [10_000, 3])
def test_ranks_of_many_small_groups_need_no_cut_points(frame, monkeypatch, largest):
    from plumbline.operators import ordering

    monkeypatch.setattr(ordering, "WINDOW_VALUES", largest)
    rows = [(g, float(v), n) for g, m in (("a", 2), ("b", 9), (None, 5)) for v in range(m) for n in (v + 1,)]
    out = ordering.cumulate(frame(rows, "g string, x double, n long"), ["g"], "x")
    got = {(r["g"], r["x"]): (r["before"], r["total"]) for r in out.collect()}
    assert got == {(g, x): (sum(n2 for g2, x2, n2 in rows if g2 == g and x2 < x), sum(n2 for g2, _, n2 in rows if g2 == g)) for g, x, _ in rows}
    assert ("_bucket" in out._jdf.queryExecution().optimizedPlan().toString()) == (largest == 3)


def test_signed_ranks_beside_zero_differences(frame):
    from plumbline.operators import ranks

    rows = [(g, 0.0, d) for g, ds in ((1, [0, 0, 1, -2, 3, 3]), (2, [0, 0]), (3, [5, -4, 2, 1])) for d in map(float, ds)]
    out = {r["g"]: r for r in ranks.wilcoxon(frame(rows, "g int, a double, b double"), "a", "b", by=["g"]).collect()}
    assert sorted(out) == [1, 3]
    assert [out[1][c] for c in ("n_pairs", "n_used", "w_plus", "w", "ties", "p_method")] == [6, 4, 8.0, 2.0, 6.0, "normal"]
    assert [out[3][c] for c in ("n_pairs", "n_used", "w_plus", "w", "ties", "p_method")] == [4, 4, 7.0, 3.0, 0.0, "exact"]
