"""Distribution functions against published quantiles and each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import dist


@pytest.mark.parametrize("q,df,want", [
    (0.975, 1, 12.706205), (0.975, 10, 2.228139), (0.975, 58, 2.001717), (0.95, 5, 2.015048),
    (0.995, 30, 2.749996), (0.025, 10, -2.228139),
])
def test_t_quantiles(q, df, want):
    assert dist.t_quantile(q, df) == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("x,df,want", [(3.841459, 1, 0.05), (16.918978, 9, 0.05), (27.877165, 9, 0.001),
                                       (124.342113, 100, 0.05)])
def test_chi2_tail(x, df, want):
    assert float(dist.chi2_upper(x, df)) == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("f,d1,d2,want", [(4.964603, 1, 10, 0.05), (3.492828, 2, 20, 0.05),
                                          (2.866081, 4, 20, 0.05)])
def test_f_tail(f, d1, d2, want):
    assert float(dist.f_upper(f, d1, d2)) == pytest.approx(want, rel=1e-5)


def test_far_tails_keep_relative_accuracy():
    # with one degree of freedom the tail has a closed form
    assert float(dist.t_two_sided(1e6, 1)) == pytest.approx(2 / math.pi * math.atan(1e-6), rel=1e-8)
    assert float(dist.chi2_upper(200.0, 2)) == pytest.approx(math.exp(-100), rel=1e-9)


def test_discrete_tails_by_summation():
    k, n, p = 7, 20, 0.1
    want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert float(dist.binom_upper(k, n, p)) == pytest.approx(want, rel=1e-9)
    mu = 2.5
    want = 1 - sum(math.exp(-mu) * mu ** i / math.factorial(i) for i in range(6))
    assert float(dist.poisson_upper(6, mu)) == pytest.approx(want, rel=1e-9)


def test_bad_input_gives_null(frame):
    df = frame([(1.0, -1.0), (None, 3.0), (1.0, 4.0)], "t double, df double")
    got = [r[0] for r in df.select(dist.p_t(F.col("t"), F.col("df"))).collect()]
    assert got[0] is None and got[1] is None and 0 < got[2] < 1


def test_normal_quantile_expression_matches(frame):
    grid = [0.0001, 0.01, 0.02425, 0.3, 0.5, 0.7, 0.99, 0.9999]
    df = frame([(g,) for g in grid], "p double")
    got = [r[0] for r in df.select(dist.norm_quantile_expr(F.col("p"))).collect()]
    assert np.allclose(got, dist.norm_quantile(np.array(grid)), atol=1e-7)
