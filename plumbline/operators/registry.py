"""Registry of test operators: what each needs, and how to run it by name.

User methods are callables ``DataFrame -> DataFrame`` with a contract; they cannot take a built-in name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.operators import compare, matrix, moments, ranks


@dataclass(frozen=True)
class Method:
    """A runnable method: the shape of its arguments and the columns that must be numeric."""

    name: str
    run: Callable[..., DataFrame]
    shape: str  # group_value | two_columns | y_xs | two_way | items | times
    least: int = 1
    numeric: tuple[str, ...] = ()
    user: bool = False


def _first(fn):
    return lambda *a, **k: fn(*a, **k)[0]


BUILT_IN: dict[str, Method] = {m.name: m for m in (
    Method("independent_t", moments.independent_t, "group_value", numeric=("value",)),
    Method("tost", moments.tost, "group_value", numeric=("value",)),
    Method("anova", moments.anova, "group_value", numeric=("value",)),
    Method("mann_whitney", ranks.mann_whitney, "group_value", numeric=("value",)),
    Method("chi_square", moments.chi_square, "group_value"),
    Method("paired_t", moments.paired_t, "two_columns", numeric=("a", "b")),
    Method("wilcoxon", ranks.wilcoxon, "two_columns", numeric=("a", "b")),
    Method("correlation", moments.pearson, "two_columns", numeric=("a", "b")),
    Method("linear_regression", _first(matrix.linear_regression), "y_xs", numeric=("y", "xs")),
    Method("logistic_regression", _first(matrix.logistic_regression), "y_xs", numeric=("xs",)),
    Method("two_way_anova", matrix.two_way_anova, "two_way", numeric=("value",)),
    Method("cronbach_alpha", _first(matrix.cronbach_alpha), "items", 2, ("columns",)),
    Method("repeated_measures_anova", _first(matrix.repeated_measures_anova), "times", 3, ("columns",)),
)}
_USER: dict[str, Method] = {}

_ARGUMENTS = {
    "group_value": ("group", "value"), "two_columns": ("a", "b"), "y_xs": ("y", "xs"),
    "two_way": ("group", "group2", "value"), "items": ("columns",), "times": ("columns",),
}


def register(name: str, fn: Callable[..., DataFrame], shape: str, least: int = 1,
             numeric: Sequence[str] = ()) -> Method:
    """Add a user method.  Built-in names cannot be taken over."""
    if name in BUILT_IN:
        raise ValueError(f"{name} is a built-in method")
    if shape not in _ARGUMENTS:
        raise ValueError(f"unknown argument shape {shape}")
    _USER[name] = Method(name, fn, shape, least, tuple(numeric), user=True)
    return _USER[name]


def unregister(name: str) -> None:
    _USER.pop(name, None)


def methods() -> list[str]:
    return sorted([*BUILT_IN, *_USER])


def _as_list(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def run(name: str, df: DataFrame, by: Sequence[str] = (), **columns) -> DataFrame:
    """Run a method by name after checking its columns against the schema.

    The result of a user method must hold the contract: p in [0, 1], degrees of freedom above 0, n of at
    least 2.  Its violations are looked up once, on result rows.
    """
    method = BUILT_IN.get(name) or _USER.get(name)
    if method is None:
        raise KeyError(f"no method {name}; there are {methods()}")
    wanted = _ARGUMENTS[method.shape]
    extra = {k: v for k, v in columns.items() if k not in wanted}
    missing = [w for w in wanted if columns.get(w) in (None, [], "")]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    fields = {f.name: f.dataType for f in df.schema.fields}
    for w in wanted:
        for c in _as_list(columns[w]):
            if c not in fields:
                raise ValueError(f"{name}: no column {c}")
            if w in method.numeric and not isinstance(fields[c], T.NumericType):
                raise ValueError(f"{name}: {c} must be numeric")
    args = [columns[w] for w in wanted]
    if method.shape in ("items", "times"):
        args = [_as_list(args[0])]
        if len(args[0]) < method.least:
            raise ValueError(f"{name} needs at least {method.least} columns")
    if method.shape == "y_xs":
        args = [args[0], _as_list(args[1])]
    if by:
        extra["by"] = list(by)
    out = method.run(df, *args, **extra)
    return checked(out, by) if method.user else out


def checked(result: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The result itself, or an error naming the first contract violation."""
    if not result.columns:
        raise ValueError("a method must return columns")
    have = lambda *names: [c for c in result.columns if c in names]
    p, dof, n = have("p", "p_value", "p_adj"), have("df", "df1", "df2"), have("n", "n1", "n2", "n_total")
    if p or dof or n:
        bad = compare.contract_violations(result, [c for c in by if c in result.columns],
                                          p=p, df=dof, n=n).limit(1).collect()
        if bad:
            raise ValueError(f"contract violated: {bad[0]['violation']}")
    return result
