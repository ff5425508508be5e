"""Safe repairs on a copy: only what is unambiguous is changed, the rest is listed for a person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as fv
from plumbline.operators import profile as prof


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One copy of each row.  The copies are identical, so which one stays does not matter."""
    return df.groupBy(*df.columns).agg(F.lit(1).alias("_one")).drop("_one")


def drop_body_duplicates(df: DataFrame, body: Sequence[str]) -> DataFrame:
    """Among rows with the same complete body keep the one with the smallest remaining columns.

    A grouped minimum combines before the shuffle, so one body copied a billion times is no hot task.
    """
    rest = [c for c in df.columns if c not in body]
    full = F.lit(True)
    for c in body:
        full = full & F.col(c).isNotNull()
    kept = (
        df.where(full).groupBy(*body).agg(F.min(F.struct(*rest)).alias("_first"))
        .select(*body, "_first.*").select(*df.columns)
    )
    return kept.unionByName(df.where(~full))


def reverse_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(1 + 7) - x for values inside the scale; anything outside stays for the range check."""
    top = fv.SCALE_LOW + fv.SCALE_HIGH
    types = dict(df.dtypes)
    return df.withColumns({
        c: F.when(F.col(c).between(fv.SCALE_LOW, fv.SCALE_HIGH), top - F.col(c))
        .otherwise(F.col(c)).cast(types[c])
        for c in columns
    })


def change_log(
    before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Changed cells as ``(keys, column, before, after)``; every change is listed."""
    left = before.select(*keys, *[F.col(c).cast("string").alias(f"_b_{c}") for c in columns])
    right = after.select(*keys, *[F.col(c).cast("string").alias(f"_a_{c}") for c in columns])
    cells = F.filter(
        F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"_b_{c}").alias("before"),
                     F.col(f"_a_{c}").alias("after"))
            for c in columns
        ]),
        lambda cell: ~cell["before"].eqNullSafe(cell["after"]),
    )
    return left.join(right, list(keys)).select(*keys, F.inline(cells))


def reverse_score_log(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Change log of a reverse scoring, from one scan instead of a join."""
    fixed = reverse_score(df.select(*keys, *columns, *[F.col(c).alias(f"_b_{c}") for c in columns]),
                          columns)
    cells = F.filter(
        F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"_b_{c}").cast("string").alias("before"),
                     F.col(c).cast("string").alias("after"))
            for c in columns
        ]),
        lambda cell: ~cell["before"].eqNullSafe(cell["after"]),
    )
    return fixed.select(*keys, F.inline(cells))


def actions(issues: DataFrame) -> DataFrame:
    """What would be done about each issue, automatic ones first; totals are never overwritten."""
    kind = (
        F.when(F.col("check") == "duplicate_rows", "dedup_exact")
        .when(F.col("check") == "duplicate_body", "dedup_body")
        .when(F.col("check") == "reverse_scoring", "reverse_score")
        .when(F.col("check") == "column_sum", "sum_review")
        .otherwise("manual")
    )
    auto = kind.isin("dedup_exact", "dedup_body", "reverse_score")
    return issues.select(
        kind.alias("kind"), auto.alias("auto"), "level", "check", "columns", "n_bad")


def propose_fix(df: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned copy and action list.  The decisions are a few rows per column, read once."""
    todo = actions(issues)
    clean = df
    rows = todo.where("auto").select("kind", "columns").collect()
    for row in rows:
        if row["kind"] == "reverse_score":
            clean = reverse_score(clean, row["columns"])
    for row in rows:
        if row["kind"] == "dedup_exact":
            clean = drop_exact_duplicates(clean)
        elif row["kind"] == "dedup_body":
            clean = drop_body_duplicates(clean, row["columns"])
    return clean, todo


__all__ = ["actions", "change_log", "drop_body_duplicates", "drop_exact_duplicates", "propose_fix",
           "reverse_score", "reverse_score_log", "prof"]
