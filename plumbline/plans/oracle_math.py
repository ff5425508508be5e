"""Distribution tails as SQL text, by numerical integration: an independent check of the UDFs."""

from __future__ import annotations


def _simpson(integrand: str, upper: str, steps: int = 4000) -> str:
    """Integral of ``integrand`` (in ``y``) from 0 to ``upper``."""
    point = f"(i * ({upper}) / {steps}.0)"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    body = integrand.replace("{y}", point)
    return (f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * {body})) "
            f"* ({upper}) / {3 * steps}.0)")


def t_two_sided(t: str, df: str) -> str:
    scale = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    kernel = f"exp(-((({df}) + 1) / 2.0) * ln(1 + {{y}} * {{y}} / ({df})))"
    return f"greatest(0, 1 - 2 * {scale} * {_simpson(kernel, f'least(abs({t}), 60.0)')})"


def t_upper(t: str, df: str) -> str:
    half = f"({t_two_sided(t, df)} / 2)"
    return f"(CASE WHEN ({t}) >= 0 THEN {half} ELSE 1 - {half} END)"


def f_upper(f: str, d1: str, d2: str) -> str:
    log_c = (f"(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0) "
             f"+ ({d1}) / 2.0 * ln(({d1}) / ({d2})::DOUBLE))")
    kernel = (f"2 * pow({{y}}, ({d1}) - 1) * exp({log_c} - (({d1}) + ({d2})) / 2.0 * "
              f"ln(1 + ({d1}) * {{y}} * {{y}} / ({d2})))")
    return f"greatest(0, 1 - {_simpson(kernel, f'least(sqrt({f}), 40.0)')})"


def chi2_upper(x: str, df: str) -> str:
    log_c = f"(-lgamma(({df}) / 2.0) - ({df}) / 2.0 * ln(2.0))"
    kernel = f"2 * pow({{y}}, ({df}) - 1) * exp({log_c} - {{y}} * {{y}} / 2.0)"
    return f"greatest(0, 1 - {_simpson(kernel, f'least(sqrt({x}), 60.0)')})"


def norm_two_sided(z: str) -> str:
    kernel = "exp(-{y} * {y} / 2.0)"
    return f"greatest(0, 1 - 2 / sqrt(2 * pi()) * {_simpson(kernel, f'least(abs({z}), 40.0)')})"
